"""Text functions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it (fixed value).
WS = r"[\t\n\x0b\f\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def norm_ws(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def plain(c: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def word_set(c: Column) -> Column:
    """Distinct words of two characters or more and single Han characters, sorted; null counts as empty."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]{2,}|[\x{4e00}-\x{9fff}])"), 1)))


def slug(c: Column, length: int = 80) -> Column:
    """Letters and digits in lower case, everything else one dash, no dash at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", ""), 1, length)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct values; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)

