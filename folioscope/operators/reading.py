"""Reading citations, reference entries and headings from texts: all notations of author and year, fields of a reference, headings by their look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.gate import id_variants

#: Author-year citations: in brackets, in the sentence, in Chinese; and headings by name or number (fixed values).
AUTHOR_YEAR = {
    "bracket": r"(?i)[\(（]\s*([^()（）,，;；]{1,100}?)\s*[,，;；]\s*((?:19|20)\d{2}[a-z]?)\s*[\)）]",
    "narrative": r"(?i)(?:^|[^\p{L}\p{N}_])([A-Z][A-Za-z'\-]+(?:\s+et\s+al\.)?)\s*[\(（]\s*((?:19|20)\d{2}[a-z]?)\s*[\)）]",
    "chinese": r"(?i)([\x{4e00}-\x{9fff}]{2,8})\s*[\(（]\s*((?:19|20)\d{2}[a-z]?)\s*[\)）]",
}
NAMED = r"(?i)^\s*(?:摘要|引言|绪论|背景|方法|结果|讨论|结论|局限性|致谢|参考文献|附录|abstract|introduction|background|method(?:s)?|results?|discussion|conclusion|limitations?|acknowledg(?:e)?ments?|references|bibliography)\s*[:：]?\s*$"
NUMBERED, CAPITALS, SENTENCE_END = r"^\s*\d+(?:[.\-]\d+)*[.)]?\s+\S", r"^[A-Z][A-Z0-9\s:,&\-]{3,}$", r"[。！？.!?;；]$"
FIRST_AUTHOR, ET_AL = r"(?i)\s+(?:and|&|等)\s+|[,，;；]", r"(?i)(?:^|\s)et\s+al\.?$"
YEAR = r"\b((?:18|19|20|21)\d{2})\b"


def author_year_citations(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, pattern, place, key): author-year citations in body texts by each pattern, which may overlap; key is first author and year in lower case."""
    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("not is_bibliography and kind <> 'biblio_entry' and text is not null")

    def found(name: str, pattern: str) -> Column:
        authors, years = (F.regexp_extract_all("text", F.lit(pattern), k) for k in (1, 2))
        return F.transform(F.arrays_zip(authors.alias("a"), years.alias("y")), lambda x, k: F.struct(F.lit(name).alias("pattern"), (k + 1).alias("place"), x.a.alias("author"), x.y.alias("year")))

    each = [found(name, pattern) for name, pattern in AUTHOR_YEAR.items()]
    m = b.select("doc_id", "block_id", F.explode(F.concat(*each)).alias("x")).select("doc_id", "block_id", "x.*")
    first = F.regexp_replace(F.split("author", FIRST_AUTHOR, 2)[0], ET_AL, "")
    return m.select("doc_id", "block_id", "pattern", "place", F.lower(F.concat(F.regexp_replace(first, r"^[ .]+|[ .]+$", ""), F.lit("|"), F.col("year"))).alias("key"))


def headings_by_look(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, level): body blocks that read like headings: named and capital ones have level 1, numbered ones their depth; numbered sentences are none."""
    t = F.trim("text")
    number = F.regexp_extract(t, r"^(\d+(?:[.\-]\d+)*)", 1)
    depth = F.length(number) - F.length(F.regexp_replace(number, r"[.\-]", "")) + 1
    level = F.when(F.length(t) > 180, None).when(t.rlike(NAMED), 1).when(t.rlike(NUMBERED), F.when(~t.rlike(SENTENCE_END), depth)).when((F.length(t) <= 90) & t.rlike(CAPITALS), 1)
    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("kind in ('paragraph', 'list_item') and trim(text) <> ''")
    return b.select("doc_id", "block_id", level.cast("int").alias("level")).where("level is not null")


def work_identifiers(works: DataFrame) -> DataFrame:
    """(identifier, variant): every notation under which a work's identifier and DOI may be looked up."""
    w = works.dropDuplicates(["identifier"])
    return w.select("identifier", F.explode(F.array_distinct(F.concat(id_variants(F.coalesce("identifier", F.lit(""))), id_variants(F.coalesce("doi", F.lit("")))))).alias("variant"))


def _title(text: Column) -> Column:
    """A quoted beginning, else the first sentence, without address at its end."""
    t = F.trim(text)
    first = F.split(t, r"\s*\.\s+(?=[A-Z一-鿿0-9])|\s*[。！？]\s*", 2)[0]
    plain = F.regexp_replace(F.regexp_replace(first, r"^[ .,:;\[\]]+|[ .,:;\[\]]+$", ""), r"(?i)\s+(?:doi|https?://)\s*:?\s*\S+$", "")
    quoted = F.trim(F.regexp_extract(t, r"^[\"“](.+?)[\"”](?:\.|$)", 1))
    return F.when(quoted != "", quoted).otherwise(F.trim(plain))


def reference_fields(records: DataFrame) -> DataFrame:
    """(rec_id, year, authors, title) of reference texts: what stands before the first year is authors, what follows begins with the title; without year a quoted title or the first sentence.

    Null and blank texts have no row; a text may have no author or title.
    """
    r = records.dropDuplicates(["rec_id"]).where("trim(raw) <> ''")
    r = r.select("rec_id", F.trim(F.regexp_replace(F.trim("raw"), r"^\s*\[\d+\]\s*", "")).alias("t")).withColumn("y", F.regexp_extract("t", YEAR, 1))
    at = F.instr("t", F.col("y"))
    quoted = F.trim(F.regexp_extract("t", r"[\"“](.+?)[\"”]", 1))
    r = r.withColumn("title", F.when(F.col("y") != "", _title(F.regexp_replace(F.substring("t", at + 4, F.length("t")), r"^[ .,:;()\[\]]+", ""))).when(quoted != "", quoted).otherwise(_title(F.col("t"))))
    before = F.when(F.col("y") != "", F.substring("t", F.lit(1), at - 1)).when(F.instr("t", F.col("title")) > 0, F.substring("t", F.lit(1), F.instr("t", F.col("title")) - 1)).otherwise("")
    names = F.regexp_replace(F.regexp_replace(before, r"^[ .,:;()\[\]]+|[ .,:;()\[\]]+$", ""), r"(?i)\bet\s+al\.?\b", "")
    pieces = F.transform(F.split(F.trim(names), r"(?i)\s*;\s*|\s+and\s+|\s*&\s*|\s+等\s*|(?<=\.)\s+(?=[A-Z一-鿿])"), lambda p: F.regexp_replace(p, r"^[ .,]+|[ .,]+$", ""))
    return r.select("rec_id", F.nullif("y", F.lit("")).cast("int").alias("year"), F.filter(pieces, lambda p: p != "").alias("authors"), "title")
