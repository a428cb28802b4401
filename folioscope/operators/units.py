"""Quantities recorded in different units, brought to the base unit of their metric.

A multi-pattern automaton over all unit aliases reads every field once; of the aliases it meets, only those of the metric's
dimension that stand free (no letter beside a letter) count, the longest at a place wins. Fields are asked in the order
unit, raw (right behind the number), metric (at its end), context (right behind the same number, then a heading such as
"All times in sec."). Units, dimensions and factors are then joined as broadcast tables of fixed size.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.units import ALIASES, UNITS

NUMBER = re.compile(r"[-−]?\d+(?:[,   ]\d{3})*(?:\.\d+)?(?:e[-+]?\d+)?|[-−]?\.\d+", re.IGNORECASE)
LEAD = re.compile(r"^(?:mean|median|average|avg|overall|total|the|平均|中位)\s*", re.IGNORECASE)
#: Headings before the metric: "(lengths, cm)", "All lengths in cm.", "lengths are given in cm;", "单位：cm".
HEADINGS = [re.compile(p) for p in (r"[(（]\s*[^()（）]*?[,，]\s*([^()（）]+?)\s*[)）]", r"\bin\s+(\S.*?)(?=[.;；。]+(?:\s|$)|$)", r"[:：]\s*([^.;；。,，]+)", r"单位[为是]?\s*([^.;；。,，]+)")]
#: "12.5 in the control arm" has no inches.
PREPOSITION = re.compile(r"\s*in\s+(?!in\b)\w")
SHIFT = str.maketrans("０１２３４５６７８９．，％−", "0123456789.,%-")
#: Behind a number a unit is sought no further than the longest alias reaches.
LONGEST = max(len(a) for a, _, _ in ALIASES)
#: metric_dims is a small table; more metrics than this are an error.
MOST_METRICS = 10_000
#: Facts whose metric is in no row of metric_dims, and those without a usable number or unit, have no row.
PARTS = "fact_id bigint, metric_key string, amount string, unit string"


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    by: dict[str, list[tuple[str, bool, str]]] = {}
    for alias, unit, exact in ALIASES:
        by.setdefault(alias.lower(), []).append((alias, exact, unit))
    for low, entries in by.items():
        found.add_word(low, (low, entries))
    found.make_automaton()
    return found


def _wordy(ch: str) -> bool:
    return ch.isalpha() and not "一" <= ch <= "鿿"


def unit_spans(text: str, dimension: str) -> list[tuple[int, int, str]]:
    """Free-standing aliases of one dimension in text as (start, end, unit); overlaps go to the longest."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = []
    for last, (alias, entries) in _automaton().iter(low):
        start, end = last + 1 - len(alias), last + 1
        if start and _wordy(low[start]) and _wordy(low[start - 1]):
            continue
        if end < len(low) and (_wordy(low[end - 1]) and (_wordy(low[end]) or low[end] in "/%") or low[end - 1].isdigit() and low[end].isdigit()):
            continue
        for spelt, exact, unit in entries:
            if UNITS[unit][0] == dimension and (not exact or text[start:end] == spelt):
                spans.append((start, end, unit))
    spans.sort(key=lambda s: (s[0] - s[1], s[0]))
    kept: list[tuple[int, int, str]] = []
    for s in spans:
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def _whole(text: str, dimension: str) -> str | None:
    """The unit if the text is nothing but one alias."""
    text = text.strip().strip("()[]").strip()
    for start, end, unit in unit_spans(text, dimension):
        if start == 0 and end >= len(text.rstrip(".")):
            return unit
    return None


def _behind(text: str, at: int, dimension: str) -> tuple[str | None, int]:
    """The unit that starts at `at`, spaces and one opening bracket apart, and where it ends."""
    gap = len(text[at:]) - len(text[at:].lstrip("   ([-"))
    for start, end, unit in unit_spans(text[at : at + gap + LONGEST + 1], dimension):
        if start == gap or start <= gap < end:
            return unit, at + end
        if start > gap:
            break
    return None, at


def _amount(text: str) -> Fraction | None:
    try:
        return Fraction(text.replace(",", "").replace(" ", "").replace(" ", "").replace(" ", "").replace("−", "-"))
    except (ValueError, ZeroDivisionError):
        return None


def _clean(text) -> str:
    return text.translate(SHIFT) if isinstance(text, str) else ""


def metric_key(metric: str) -> str:
    """A metric name without unit suffix, lead word and letter case."""
    m = unicodedata.normalize("NFKC", metric).strip()
    m = re.split(r"\s*[\[(（【,，]|\s+in\s+(?=\S+(?:\s\S+){0,2}$)", m, maxsplit=1)[0]
    return re.sub(r"\s+", " ", LEAD.sub("", m)).strip().lower()


def quantity(value, unit, metric, raw, context, dimension: str) -> tuple[Fraction, str] | None:
    """(amount, unit) of one fact, unit "" where none stands anywhere, or None without a number."""
    unit, metric, raw, context = map(_clean, (unit, metric, raw, context))
    number = NUMBER.search(raw) or None
    found = _whole(unit, dimension) if unit.strip() else None
    if number:
        behind, end = _behind(raw, number.end(), dimension)
        total, parts, at = Fraction(0), 0, number
        while dimension in ("duration", "length", "mass") and at:  # 1 h 20 min
            u, e = _behind(raw, at.end(), dimension)
            if not u:
                break
            total, parts = total + (_amount(at.group()) or 0) * UNITS[u][1], parts + 1
            at = NUMBER.match(raw, e + len(raw[e:]) - len(raw[e:].lstrip(" ,")))
        if parts > 1:
            base = next(n for n, (d, f, o) in UNITS.items() if d == dimension and f == 1)
            return total / 1, f"={base}"
        found = found or behind
    amount = _amount(number.group()) if number else None
    if value is not None and value == value:
        given = Fraction(repr(float(value)))
        amount = given if amount is None or abs(amount - given) > abs(given) / 10**9 else amount
    if amount is None:
        return None
    if not found:
        tail = re.search(r"(?:[\[(（【,，]|\s+in\s+)\s*([^\[\](（）)【】]+?)\s*[\])）】]?\s*$", metric)
        found = _whole(tail.group(1), dimension) if tail else None
    if not found and context:
        at = context.find(number.group()) if number else -1
        found = _behind(context, at + len(number.group()), dimension)[0] if at >= 0 and not PREPOSITION.match(context, at + len(number.group())) else None
        if not found:
            head = context[: at if at >= 0 else len(context)]
            cut = head.rfind(metric) if metric else -1
            head = head[:cut] if cut > 0 else head
            for pattern in HEADINGS:
                for m in pattern.finditer(head):
                    found = found or _whole(m.group(1).strip(), dimension)
    return amount, found or ""


def quantities(facts: DataFrame, dims: DataFrame) -> DataFrame:
    """(fact_id, dimension, base_unit, amount STRING, unit) of every fact of kind `value` whose metric is known.

    amount is an exact ratio of two integers. Repeated facts count once; null fields are read as blank; other columns are ignored.
    """
    f = facts.where((F.col("kind") == "value") & F.col("fact_id").isNotNull()).select("fact_id", "metric", "value", "unit", "context", "raw").dropDuplicates(["fact_id"])
    listed = dims.select("metric", "dimension").distinct().limit(MOST_METRICS + 1).collect()
    if len(listed) > MOST_METRICS:
        raise ValueError(f"more than {MOST_METRICS} metrics")
    known = {r["metric"].strip().lower(): r["dimension"] for r in listed if r["metric"]}

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for fact, metric, value, unit, context, raw in b[["fact_id", "metric", "value", "unit", "context", "raw"]].itertuples(index=False, name=None):
                key = metric_key(metric) if isinstance(metric, str) else ""
                q = quantity(value, unit, metric, raw, context, known[key]) if key in known else None
                if q:
                    out.append((fact, key, f"{q[0].numerator}/{q[0].denominator}", q[1]))
            yield pd.DataFrame(out, columns=["fact_id", "metric_key", "amount", "unit"])

    named = dims.select(F.lower(F.trim("metric")).alias("metric_key"), "dimension", "base_unit").dropDuplicates(["metric_key"])
    return f.mapInPandas(read, PARTS).join(F.broadcast(named), "metric_key")


def to_base_units(facts: DataFrame, dims: DataFrame) -> DataFrame:
    """(fact_id, dimension, unit, base_unit, base_value BIGINT), nearest whole number, halves away from zero; null beyond 64 bits.

    A proportion without unit is a fraction of one; a quantity without unit is a plain number; other facts without unit are left out.
    """
    spark = facts.sparkSession
    factors = spark.createDataFrame([(n, d, str(f.numerator), str(f.denominator), str(o.numerator), str(o.denominator)) for n, (d, f, o) in UNITS.items()], "unit string, dimension string, fn string, fd string, on string, od string")
    q = quantities(facts, dims)
    default = F.when(F.col("dimension") == "proportion", "fraction").when(F.col("dimension") == "quantity", "count")
    compound = F.startswith("unit", F.lit("="))
    q = q.withColumn("stated", F.when(F.col("unit") == "", default).otherwise(F.regexp_replace("unit", "^=", ""))).where(F.col("stated").isNotNull())
    q = q.withColumn("mixed", compound).drop("unit").withColumnRenamed("stated", "unit")
    q = q.join(F.broadcast(factors), ["unit", "dimension"])

    @F.pandas_udf("bigint")
    def scaled(amount: pd.Series, fn: pd.Series, fd: pd.Series, on: pd.Series, od: pd.Series) -> pd.Series:
        def one(a: str, n: str, d: str, p: str, r: str) -> int | None:
            x = (Fraction(a) + Fraction(int(p), int(r))) * Fraction(int(n), int(d))
            y = int((abs(x) * 2 + 1) // 2) * (1 if x >= 0 else -1)
            return y if -(2**63) <= y < 2**63 else None

        return pd.Series([one(*t) for t in zip(amount, fn, fd, on, od)], dtype="Int64")

    return q.select("fact_id", "dimension", "unit", "base_unit", "mixed", scaled("amount", "fn", "fd", "on", "od").alias("base_value"))


def converted(facts: DataFrame, dims: DataFrame) -> DataFrame:
    """(fact_id, base_unit, base_value) of the facts stated in another unit than the base unit of their metric."""
    return to_base_units(facts, dims).where((F.col("unit") != F.col("base_unit")) | F.col("mixed")).select("fact_id", "base_unit", "base_value")

