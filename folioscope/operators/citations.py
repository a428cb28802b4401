"""Reference lists against in-text citations, for whole corpora keyed by doc_id.

Entries are `citation_records` (doc_id, seq, entry_index, key, raw, block_id), marks are `marks` (doc_id, seq, key, block_id).
Repeated rows of a key count once. Every check is one or two joins or aggregates on (doc_id, number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.functions.text import norm_ws, plain, word_set

RANGE = r"^\s*(\d{1,9})\s*[-–—‑~～－]\s*(\d{1,9})\s*$"
#: Runs of numbers are counted out in stretches of so many.
STRETCH = 10_000


def entries_of(records: DataFrame) -> DataFrame:
    return records.dropDuplicates(["doc_id", "seq"]).select("doc_id", "seq", F.col("entry_index").alias("number"), "key", "raw", "block_id")


def mark_numbers(marks: DataFrame) -> DataFrame:
    """(doc_id, seq, number, block_id): every number that a numeric mark's key names, ranges (ends in any order) in full."""
    m = marks.dropDuplicates(["doc_id", "seq"]).where("key is not null and not contains(key, '|')")
    a, b = (F.regexp_extract("p", RANGE, k).try_cast("int") for k in (1, 2))
    m = m.select("doc_id", "seq", "block_id", F.explode(F.split("key", "[,;，；、]")).alias("p"))
    one = lambda x: F.struct(x.cast("int").alias("low"), x.cast("int").alias("high"))
    runs = F.when(a.isNotNull(), F.array(F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")))).otherwise(F.transform(F.regexp_extract_all("p", F.lit(r"(\d{1,9})"), 1), one))
    return counted_out(m.select("doc_id", "seq", "block_id", F.explode(runs).alias("r")).select("doc_id", "seq", "block_id", "r.low", "r.high"))


def counted_out(runs: DataFrame) -> DataFrame:
    """All whole numbers from low to high as `number`, however many, a stretch at a time."""
    keep = [c for c in runs.columns if c not in ("low", "high")]
    at = runs.where("low <= high").select(*keep, "high", F.explode(F.sequence("low", "high", F.lit(STRETCH))).alias("at"))
    return at.select(*keep, F.explode(F.sequence("at", F.least(F.col("at") + STRETCH - 1, "high"))).alias("number"))


def range_expand(marks: DataFrame) -> DataFrame:
    return mark_numbers(marks).groupBy("doc_id", "seq").agg(F.count("*").alias("n"), F.min("number").alias("lowest"), F.max("number").alias("highest"), F.sum("number").cast("bigint").alias("total"))


def unused(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Numbered entries that no mark of their document names."""
    e = entries_of(records).where("number is not null").select("doc_id", "number").distinct()
    return e.join(mark_numbers(marks).select("doc_id", "number").distinct(), ["doc_id", "number"], "left_anti")


def missing(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Cited numbers that the document's list lacks, with how many marks name them and the first of their blocks."""
    e = entries_of(records).where("number is not null").select("doc_id", "number").distinct()
    m = mark_numbers(marks).join(e, ["doc_id", "number"], "left_anti")
    return m.groupBy("doc_id", "number").agg(F.count_distinct("seq").alias("n_marks"), F.min_by("block_id", "seq").alias("first_block"))


def author_year_status(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Author-year keys of documents without numbered entries: listed but uncited, or cited but not listed."""
    e = entries_of(records)
    numbered = e.where("number is not null").select("doc_id").distinct()
    listed = e.where("number is null and key like '%|%'").join(numbered, "doc_id", "left_anti").select("doc_id", F.lower("key").alias("key")).distinct()
    docs = e.join(numbered, "doc_id", "left_anti").select("doc_id").distinct()
    cited = marks.where("key like '%|%'").select("doc_id", F.explode(F.split(F.lower("key"), "[;；]")).alias("key")).select("doc_id", F.trim("key").alias("key"))
    cited = cited.where(F.col("key").rlike(r"^[^|,]+\|\d{4}[a-z]?$")).distinct().join(docs, "doc_id", "left_semi")
    a = listed.join(cited, ["doc_id", "key"], "left_anti").withColumn("status", F.lit("unused"))
    return a.unionByName(cited.join(listed, ["doc_id", "key"], "left_anti").withColumn("status", F.lit("missing")))


def duplicates(records: DataFrame) -> DataFrame:
    """Numbers that several entries of a document bear."""
    e = entries_of(records).where("number is not null")
    return e.groupBy("doc_id", "number").agg(F.count("*").alias("n")).where("n > 1")


def gaps(records: DataFrame) -> DataFrame:
    """Numbers from 1 to a document's highest that no entry bears."""
    e = entries_of(records).where("number > 0").select("doc_id", "number")
    top = e.groupBy("doc_id").agg(F.lit(1).alias("low"), F.max("number").alias("high"))
    return counted_out(top).join(e.distinct(), ["doc_id", "number"], "left_anti")


def first_appearance(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Listed numbers first cited after a larger one: (doc_id, number, previous), previous the number first cited just before."""
    e = entries_of(records).where("number is not null").select("doc_id", "number").distinct()
    m = mark_numbers(marks).join(e, ["doc_id", "number"], "left_semi")
    first = m.groupBy("doc_id", "number").agg(F.min("seq").alias("seq"))
    w = W.partitionBy("doc_id").orderBy("seq", "number")
    return first.withColumn("previous", F.lag("number").over(w)).where("number < previous").select("doc_id", "number", "previous")


def sites(records: DataFrame, marks: DataFrame) -> DataFrame:
    """Every entry with the number of marks and blocks that cite it, by number or by author-year key."""
    e = entries_of(records)
    by_number = e.where("number is not null").join(mark_numbers(marks).withColumnRenamed("seq", "mark").withColumnRenamed("block_id", "at"), ["doc_id", "number"]).select("doc_id", "seq", "mark", "at")
    keys = marks.dropDuplicates(["doc_id", "seq"]).where("key like '%|%'").select("doc_id", F.col("seq").alias("mark"), F.col("block_id").alias("at"), F.explode(F.split(F.lower("key"), "[;；]")).alias("key")).withColumn("key", F.trim("key"))
    by_key = e.where("number is null").withColumn("key", F.lower("key")).join(keys, ["doc_id", "key"]).select("doc_id", "seq", "mark", "at")
    n = by_number.unionByName(by_key).groupBy("doc_id", "seq").agg(F.count_distinct("mark").alias("n_marks"), F.count_distinct("at").alias("n_blocks"))
    return e.select("doc_id", "seq").join(n, ["doc_id", "seq"], "left").fillna(0, ["n_marks", "n_blocks"])


def citation_findings(records: DataFrame, marks: DataFrame) -> DataFrame:
    """(doc_id, issue, n, sample): all checks of the citations detector, one row a document and issue; sample holds up to 20 numbers.

    Entries and cited numbers are counted once each and meet in one join on (doc_id, number); every number then tells its issues.
    """
    e = entries_of(records).where("number is not null").groupBy("doc_id", "number").agg(F.count("*").alias("n_entries"))
    m = mark_numbers(marks).groupBy("doc_id", "number").agg(F.min("seq").alias("first"))
    j = e.join(m, ["doc_id", "number"], "full").withColumn("both", F.col("n_entries").isNotNull() & F.col("first").isNotNull())
    before = F.lag("number").over(W.partitionBy("doc_id", "both").orderBy("first", "number"))
    j = j.withColumn("late", F.col("both") & (F.col("number") < before))
    issues = F.array_compact(F.array(F.when(F.col("n_entries") > 1, "duplicate"), F.when(F.col("first").isNull(), "unused"), F.when(F.col("n_entries").isNull(), "missing"), F.when(F.col("late"), "order")))
    rows = j.select("doc_id", F.explode(issues).alias("issue"), F.col("number").cast("bigint").alias("number"))
    rows = rows.unionByName(gaps(records).select("doc_id", F.lit("gap").alias("issue"), F.col("number").cast("bigint").alias("number")))
    return rows.groupBy("doc_id", "issue").agg(F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("number")), 1, 20), ",").alias("sample"))


def bracket_marks(blocks: DataFrame) -> DataFrame:
    """Numeric citation marks in body texts: (doc_id, block_id, place, key), a lone four-digit year is none."""
    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("not is_bibliography and kind in ('heading', 'paragraph', 'table')")
    m = b.select("doc_id", "block_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[(\d[\d\s,;–—\-]*)\]"), 1)).alias("place", "key"))
    return m.where(~F.col("key").rlike(r"^(19|20)\d\d$")).select("doc_id", "block_id", (F.col("place") + 1).alias("place"), "key")


AUTHOR_YEAR = r"(\p{Lu}[\p{L}\-]+)(?: et al\.| & \p{Lu}[\p{L}\-]+)?,? \(?((?:19|20)\d{2}[a-z]?)\b"


def author_year_marks(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, key, n): author-year citations in body texts by first author and year."""
    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("not is_bibliography and kind <> 'biblio_entry'")
    names, years = (F.regexp_extract_all("text", F.lit(AUTHOR_YEAR), k) for k in (1, 2))
    m = b.select("doc_id", "block_id", F.explode(F.zip_with(names, years, lambda n, y: F.concat(F.lower(n), F.lit("|"), y))).alias("key"))
    return m.groupBy("doc_id", "block_id", "key").agg(F.count("*").alias("n"))


def bibliography(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, number, key): entries of bibliography blocks, numbered or by first author and year."""
    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("kind = 'biblio_entry' and text is not null")
    number = F.regexp_extract("text", r"^\s*\[(\d{1,9})\]", 1).try_cast("int")
    author, year = F.regexp_extract("text", r"^\s*([\p{L}\-]+)", 1), F.regexp_extract("text", r"\b((?:19|20)\d{2}[a-z]?)\b", 1)
    key = F.when(number.isNotNull(), F.concat(F.lit("["), number.cast("string"), F.lit("]"))).when((author != "") & (year != ""), F.concat(F.lower(author), F.lit("|"), year))
    return b.select("doc_id", "block_id", number.alias("number"), key.alias("key"))


def identifiers(records: DataFrame, works: DataFrame) -> DataFrame:
    """(source, id, kind, value): DOI, arXiv and PubMed identifiers in reference texts and resolver rows, without prefix and final punctuation."""
    r = records.dropDuplicates(["rec_id"]).select(F.lit("record").alias("source"), F.col("rec_id").cast("string").alias("id"), "raw")
    w = works.dropDuplicates(["identifier"]).select(F.lit("work").alias("source"), F.col("identifier").alias("id"), F.concat(F.lit("doi:"), "doi").alias("raw"))
    patterns = {"doi": r"(?i)(10\.\d{4,9}/[^\s\"<>]+)", "arxiv": r"(?i)(?:arxiv:\s*)?\b(\d{4}\.\d{4,5})(?:v\d+)?\b", "pmid": r"(?i)\bpmid:?\s*(\d{4,9})"}
    both = r.unionByName(w)
    found = [both.select("source", "id", F.lit(k).alias("kind"), F.lower(F.regexp_replace(F.regexp_extract("raw", p, 1), r"[.,;)\]]+$", "")).alias("value")) for k, p in patterns.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).where("value <> ''")


def style_of(raw: Column, number: Column) -> Column:
    """Bibliography style by lexical cues."""
    year = r"\(\s*\d{4}[a-z]?\s*\)"
    return (
        F.when(number.isNotNull() | raw.rlike(r"^\s*\[\d+\]"), "numeric").when(raw.rlike(r"[\x{4e00}-\x{9fff}]"), "gbt7714").when(raw.rlike(r"(?i)(?:\bet\s+al\b|&)") & raw.rlike(year), "apa")
        .when(raw.rlike(year), "harvard").when(raw.rlike(r"\b(?:19|20|21)\d{2}\b"), "author_year").otherwise("unknown")
    )


def styles(records: DataFrame) -> DataFrame:
    return records.dropDuplicates(["rec_id"]).select("rec_id", style_of(F.coalesce("raw", F.lit("")), F.col("entry_index")).alias("found_style"))


def parsed_references(records: DataFrame) -> DataFrame:
    """(rec_id, year, first_author, quoted_title) read from the reference text."""
    r = records.dropDuplicates(["rec_id"]).where("raw is not null")
    body = F.regexp_replace("raw", r"^\s*\[\d+\]\s*", "")
    return r.select("rec_id", F.regexp_extract("raw", r"\b((?:18|19|20|21)\d{2})\b", 1).try_cast("int").alias("year"), F.lower(F.regexp_extract(body, r"^([\p{L}\-]+)", 1)).alias("first_author"), F.regexp_extract("raw", r"[“\"]([^”\"]+?),?[”\"]", 1).alias("quoted_title"))


def _title_key(c: Column) -> Column:
    return plain(c)


def metadata_mismatch(records: DataFrame, works: DataFrame) -> DataFrame:
    """(rec_id, identifier, year_differs, author_differs): records against the works of equal title."""
    r = records.dropDuplicates(["rec_id"]).withColumn("k", _title_key(F.col("title"))).where("k <> ''")
    w = works.dropDuplicates(["identifier"]).select("identifier", _title_key(F.col("title")).alias("k"), F.col("year").alias("work_year"), F.col("authors").alias("work_authors")).where("k <> ''")
    words = lambda a: F.array_distinct(F.flatten(F.transform(a, word_set)))
    first = word_set(F.try_element_at("authors", F.lit(1)))
    j = r.join(w, "k")
    known = (F.size("authors") > 0) & (F.size("work_authors") > 0)
    return j.select("rec_id", "identifier", F.coalesce(F.col("year") != F.col("work_year"), F.lit(False)).alias("year_differs"), F.coalesce(known & ~F.arrays_overlap(first, words(F.col("work_authors"))), F.lit(False)).alias("author_differs"))


def publication_status(works: DataFrame) -> DataFrame:
    """(identifier, publication_status): retracted before concern before corrected, by words in status, type, title and updates."""
    text = F.lower(F.concat_ws(" ", "status", "work_type", "title", "update_to"))
    status = F.when(text.rlike(r"\bretract(ed|ion)?\b|withdrawn"), "retracted").when(text.rlike(r"expression\s+of\s+concern|\bconcern\b"), "concern").when(text.rlike(r"correct(ed|ion)|erratum|corrigendum"), "corrected").otherwise("normal")
    return works.dropDuplicates(["identifier"]).select("identifier", status.alias("publication_status"))


def audit_summary(records: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by metadata status, publication status and style, in one pass of grouping sets."""
    r = records.dropDuplicates(["rec_id"]).select("metadata_status", "publication_status", "style")
    names = ["metadata_status", "publication_status", "style"]
    g = r.groupingSets([[F.col(n)] for n in names], *names).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, names[0]).when(F.col("g") == 5, names[1]).otherwise(names[2])
    value = F.when(F.col("g") == 3, F.col(names[0])).when(F.col("g") == 5, F.col(names[1])).otherwise(F.col(names[2]))
    return g.select(dimension.alias("dimension"), value.alias("value"), "n")


def support(records: DataFrame, works: DataFrame, top: int = 3) -> DataFrame:
    """(rec_id, identifier, passage_no, overlap): the abstract sentences that share most words with a record's title, by equal title."""
    r = records.dropDuplicates(["rec_id"]).select("rec_id", "title", _title_key(F.col("title")).alias("k")).where("k <> ''")
    w = works.dropDuplicates(["identifier"]).where("abstract is not null").select("identifier", _title_key(F.col("title")).alias("k"), F.posexplode(F.split("abstract", r"[.!?。]+\s*")).alias("p", "passage")).where("trim(passage) <> ''")
    claim = word_set(F.col("title"))
    j = r.join(w, "k").select("rec_id", "identifier", (F.col("p") + 1).alias("passage_no"), F.round(F.size(F.array_intersect(claim, word_set(F.col("passage")))) / F.size(claim), 6).alias("overlap"))
    rank = F.row_number().over(W.partitionBy("rec_id", "identifier").orderBy(F.desc("overlap"), "passage_no"))
    return j.withColumn("k", rank).where(F.col("k") <= top).drop("k")

