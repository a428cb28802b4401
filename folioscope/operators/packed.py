"""Several values packed in one field: delimiters inferred per source, then split and exploded with position.

A source is one document and one notation (numeric, author-year in key, author-year in raw). Every candidate delimiter is
scored on all values of its source that hold it: the share of pieces that begin and end as a value of the notation does (piece
type regularity), and the share of values whose raw and key fall into equally many pieces (piece-count consistency). A source
of few values leans on the scores of its notation in the whole table. Values are split at the delimiters that their source
accepts and nowhere else: a piece that is no value of its notation stays whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AND, BRACKETS, YEAR_JOIN, SPACE, CUT = "\ue000", "\ue001", "\ue002", "\ue003", "\u001f"
#: Candidate delimiters by notation. The bar is no candidate in author-year keys: it stands between name and year.
CANDIDATES = {
    "num": [",", ";", "，", "；", "、", "/", "|", "&", "+", "\t", "\n", AND, BRACKETS, SPACE],
    "ay_key": [",", ";", "，", "；", "、", "/", "&", "+", "\t", "\n", AND, BRACKETS, SPACE],
    "ay_raw": [",", ";", "，", "；", "、", "/", "|", "&", "\t", "\n", AND, BRACKETS],
}
ALL = "".join(dict.fromkeys(sum(CANDIDATES.values(), [])))
HIDDEN = "".join(chr(0xE100 + i) for i in range(len(ALL)))
DASH = "[-‐‑‒–—―−~～－]"
RANGE = rf"^\s*(\d+)\s*(?:{DASH}|to|bis|至|到)\s*(\d+)\s*$"
YEAR_ONLY = r"(?:1[5-9]|20|21)\d{2}"
YEAR = YEAR_ONLY + "[a-z]?"
#: A piece is regular if it begins and ends as a value of its notation does; empty places are not counted.
REGULAR = {
    "num": r"^[\s,;，；、\ue000-\ue003]*\d(?:.*\d)?[\s,;，；、\ue000-\ue003]*$",
    "ay_key": rf"(?s)^\s*(?:[^|]*\p{{L}}[^|]*\|\s*{YEAR}|{YEAR})(?:.*{YEAR})?\s*$",
    "ay_raw": rf"(?s)^\s*[\p{{L}}].*{YEAR}\s*$",
}
#: The whole table's score of a delimiter counts as so many values of a source; the least score of an accepted delimiter.
PRIOR, LEAST = 0.5, 0.6
#: Ranges wider than this are counted out over rows instead of inside one.
IN_ROW = 10_000


def _prepared(value: Column, kind: Column) -> Column:
    """Digits plain, word and bracket delimiters as one character each, outer brackets and lead words gone, quoted delimiters hidden."""
    v = F.translate(value, "０１２３４５６７８９", "0123456789")
    v = F.regexp_replace(v, r"[\u200b-\u200d\ufeff\u2060\u00ad]", "")
    v = F.regexp_replace(v, r"[\u00a0\u2000-\u200a\u202f\u3000]", " ")
    v = F.regexp_replace(v, r"(?i)^\s*(?:see\s+)?(?:refs?\.?|references?|see)\s+", "")
    v = F.regexp_replace(v, r"^\s*[\[［【(（]\s*|\s*[\]］】)）]\s*$", "")
    v = F.regexp_replace(v, r"\s*[\]］】)）]\s*[,;，；、]?\s*[\[［【(（]\s*", BRACKETS)
    v = F.regexp_replace(v, r"(?i)(?<=[\s,;，；、])(?:and|und|et|和|与)(?=\s)(?!\s+al\b)\s*", AND)
    numeric = F.regexp_replace(F.regexp_replace(v, "[\"'“”‘’«»]", ""), r"(?<=\d) +(?=\d)", SPACE)
    parts = F.regexp_extract_all(v, F.lit("(?s)([\"“][^\"“”]*[\"”](?=\\s*\\|)|['‘][^'‘’]*['’](?=\\s*\\|)|[^\"“'‘]+|.)"), 1)
    quoted = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("(?s)^[\"“'‘].+[\"”'’]$"), F.translate(p, ALL, HIDDEN)).otherwise(p)), "")
    return F.when(kind == "num", numeric).when(kind == "ay_key", quoted).otherwise(v)


def _kind(key: Column, raw: Column) -> Column:
    has_key = F.length(F.trim(F.coalesce(key, F.lit("")))) > 0
    by_key = F.when(key.rlike(rf"\p{{L}}[^|]*\|\s*{YEAR}"), "ay_key").otherwise("num")
    by_raw = F.when(raw.rlike(rf"\p{{L}}{{2,}}.*{YEAR}") & ~raw.rlike(r"(?i)^\s*\W*(?:refs?\.?|see)?[\s\d,;，；、&/|~–—‑－～\-\[\]［］【】()and to“”\"']*$"), "ay_raw").otherwise("num")
    return F.when(has_key, by_key).otherwise(by_raw)


def _pieces(value: Column, delimiter: Column) -> Column:
    return F.filter(F.split(F.replace(value, delimiter, F.lit(CUT)), CUT), lambda p: F.length(F.trim(p)) > 0)


def delimiter_scores(values: DataFrame) -> DataFrame:
    """(source, kind, delimiter, regularity, consistency, n, score, accepted) from columns source, kind, v and other.

    v is the prepared field, other the prepared second field of the same row or null. Sums are partial before the shuffle, so
    one source with a third of all rows is no hot task.
    """
    candidates = F.create_map(*[x for k, c in CANDIDATES.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    held = F.filter(F.element_at(candidates, F.col("kind")), lambda d: F.contains("v", d))
    seen = values.select("source", "kind", "v", "other", F.explode(held).alias("delimiter"))
    regular = F.when(F.col("kind") == "num", F.lit(REGULAR["num"])).when(F.col("kind") == "ay_key", F.lit(REGULAR["ay_key"])).otherwise(F.lit(REGULAR["ay_raw"]))
    seen = seen.withColumn("pieces", _pieces(F.col("v"), F.col("delimiter"))).withColumn("pattern", regular)
    seen = seen.select(
        "source", "kind", "delimiter",
        (F.size(F.filter("pieces", lambda p: F.regexp_like(p, F.col("pattern")))) / F.greatest(F.size("pieces"), F.lit(1))).alias("good"),
        F.when(F.col("other").isNotNull() & ~F.contains("other", F.lit("…")), (F.size(_pieces(F.col("other"), F.col("delimiter"))) == F.size("pieces")).cast("double")).alias("same"),
    )
    own = seen.groupBy("source", "kind", "delimiter").agg(F.sum("good").alias("good"), F.sum("same").alias("same"), F.count("same").alias("both"), F.count("*").alias("n"))
    all_ = own.groupBy("kind", "delimiter").agg((F.sum("good") / F.sum("n")).alias("all_good"), F.coalesce(F.sum("same") / F.sum("both"), F.lit(0.5)).alias("all_same"))  # at most one row a candidate
    own = own.join(F.broadcast(all_), ["kind", "delimiter"])
    own = own.withColumn("regularity", (F.col("good") + PRIOR * F.col("all_good")) / (F.col("n") + PRIOR))
    own = own.withColumn("consistency", (F.coalesce("same", F.lit(0.0)) + PRIOR * F.col("all_same")) / (F.col("both") + PRIOR))
    own = own.withColumn("score", 0.7 * F.col("regularity") + 0.3 * F.col("consistency"))
    return own.select("source", "kind", "delimiter", "regularity", "consistency", "n", "score", (F.col("score") >= LEAST).alias("accepted"))


def _number(text: Column) -> Column:
    return F.regexp_replace(text, r"^0+(?=\d)", "")


def _ends(piece: Column, kind: str) -> tuple[Column, Column]:
    return tuple(F.regexp_extract(piece, RANGE, k).try_cast(kind) for k in (1, 2))


def _numbers(piece: Column) -> Column:
    """The value of a numeric piece of one number, all numbers of a range, else the piece as it stands."""
    a, b = _ends(piece, "bigint")
    single = F.regexp_extract(piece, r"^\D*(\d+)\D*$", 1)
    return F.when(single != "", F.array(_number(single))).when(a.isNotNull() & b.isNotNull(), F.transform(F.sequence(F.least(a, b), F.greatest(a, b)), lambda i: i.cast("string"))).otherwise(F.array(F.trim(piece)))


def _runs(pieces: Column) -> Column:
    """The values of numeric pieces as structs (text, low, n): a text, or n whole numbers from low on."""

    def one(piece: Column) -> Column:
        a, b = _ends(piece, "decimal(38,0)")
        single = F.regexp_extract(piece, r"^\D*(\d+)\D*$", 1)
        text = F.when(single != "", _number(single)).when(a.isNull() | b.isNull(), F.trim(piece))
        return F.struct(text.alias("text"), F.least(a, b).alias("low"), F.when(text.isNotNull(), F.lit(1)).otherwise((F.abs(a - b) + 1).cast("bigint")).alias("n"))

    return F.transform(pieces, one)


def _author_years(piece: Column, in_key: Column) -> Column:
    """name|year for every year of an author-year piece."""
    shown = F.translate(piece, HIDDEN, ALL)
    name_key = F.trim(F.regexp_replace(F.trim(F.regexp_replace(shown, r"(?s)\|[^|]*$", "")), "^[\"'“‘]+|[\"'”’]+$", ""))
    lead = F.regexp_replace(shown, r"(?i)^\s*(?:see(?: also)?|e\.g\.,?|cf\.)\s+", "")
    name_raw = F.lower(F.trim(F.regexp_extract(lead, rf"(?s)^\s*(.*?)\s*(?:[,，&{AND}{YEAR_JOIN}(（]|\bet al|\band\b|等|{YEAR})", 1)))
    years = F.regexp_extract_all(F.when(in_key, F.regexp_extract(shown, r"(?s)\|([^|]*)$", 1)).otherwise(shown), F.lit(rf"(?<![\d\p{{L}}])({YEAR})(?![\d\p{{L}}])"), 1)
    return F.transform(years, lambda y: F.concat(F.when(in_key, name_key).otherwise(name_raw), F.lit("|"), y))


def _rows(m: DataFrame) -> DataFrame:
    """(doc_id, seq, val_pos, val) of marks (doc_id, seq, kind, pieces) with two values or more; a wide range is counted out over rows, in stretches."""
    a, b = (lambda p: _ends(p, "decimal(38,0)")[0]), (lambda p: _ends(p, "decimal(38,0)")[1])
    wide = (F.col("kind") == "num") & F.array_join("pieces", " ").rlike(r"\d{5}") & F.exists("pieces", lambda p: F.coalesce((F.abs(a(p) - b(p)) >= IN_ROW) | (F.greatest(a(p), b(p)) >= 10**18), F.lit(False)))
    values = F.flatten(F.transform("pieces", lambda p: F.when(F.col("kind") == "num", _numbers(p)).otherwise(_author_years(p, F.col("kind") == "ay_key"))))
    m = m.withColumn("wide", wide)
    m = m.select("doc_id", "seq", F.when(~F.col("wide"), values).alias("vals"), F.when(F.col("wide"), _runs(F.col("pieces"))).alias("runs")).where("runs is not null or size(vals) >= 2")
    zero, step = F.lit(0).cast("bigint"), F.lit(IN_ROW).cast("bigint")
    part = lambda first, vals, low, n: F.struct(first.alias("first"), vals.alias("vals"), low.alias("low"), n.alias("n"))
    before = lambda k: F.aggregate(F.slice("runs", F.lit(1), k), zero, lambda t, r: t + r.n)
    stretch = lambda r, k, at: part(before(k) + at, F.when(r.text.isNotNull(), F.array(r.text)), r.low + at, F.least(step, r.n - at))
    parts = F.flatten(F.transform("runs", lambda r, k: F.transform(F.sequence(zero, r.n - 1, step), lambda at: stretch(r, k, at).cast("struct<first:bigint,vals:array<string>,low:decimal(38,0),n:bigint>"))))
    whole = F.array(part(zero, F.col("vals"), F.lit(None).cast("decimal(38,0)"), zero))
    m = m.select("doc_id", "seq", F.explode(F.when(F.col("runs").isNull(), whole).otherwise(parts)).alias("x")).select("doc_id", "seq", "x.*")
    counted = F.transform(F.sequence(zero, F.col("n") - 1), lambda i: (F.col("low") + i).cast("decimal(38,0)").cast("string"))
    m = m.select("doc_id", "seq", "first", F.posexplode(F.when(F.col("vals").isNotNull(), F.col("vals")).otherwise(counted)).alias("p", "val"))
    return m.select("doc_id", "seq", (F.col("first") + F.col("p") + 1).cast("int").alias("val_pos"), "val")


def split_marks(marks: DataFrame, salt: int = 16) -> DataFrame:
    """One row (doc_id, seq, val_pos, val) per value of each citation mark with two values or more.

    key counts, or raw where key is null or blank. Repeated rows of a mark count once; null and blank marks, and those of one
    value, have no row. Ranges stand for all their numbers in ascending order, however wide (ends of up to 38 digits); a numeric
    piece of several numbers that is no range stays as it stands. Repeated values are kept, empty places are not counted. Other
    columns of the input are ignored. A document with very many marks is spread over `salt` tasks throughout.
    """
    part = F.pmod(F.xxhash64("seq"), F.lit(salt)).cast("int")
    m = marks.select("doc_id", "seq", "raw", "key", F.coalesce("doc_id", F.lit("\x00")).alias("source"), part.alias("part")).repartition("source", "part").distinct()
    has_key = F.length(F.trim(F.coalesce("key", F.lit("")))) > 0
    m = m.withColumn("kind", _kind(F.col("key"), F.coalesce("raw", F.lit("")))).withColumn("field", F.when(has_key, F.col("key")).otherwise(F.col("raw")))
    m = m.where(F.length(F.trim("field")) > 0)
    m = m.withColumn("v", _prepared(F.col("field"), F.col("kind")))
    other = F.when(has_key & (F.length(F.trim(F.coalesce("raw", F.lit("")))) > 0), _prepared(F.col("raw"), F.when(F.col("kind") == "num", "num").otherwise("ay_raw")))
    scored = delimiter_scores(m.select("source", "kind", "v", other.alias("other"))).where("accepted")
    accepted = (
        scored.groupBy("source").agg(F.collect_list(F.struct("kind", "delimiter")).alias("delimiters"))  # at most all candidates
        .select("source", "delimiters", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("part"))
    )
    m = m.join(accepted, ["source", "part"], "left")
    joined = F.regexp_replace("v", rf"\s*[{ALL.replace('|', '')}]+\s*(?={YEAR}(?![\d|\p{{L}}]))", YEAR_JOIN)
    v = F.when(F.col("kind") == "num", F.col("v")).otherwise(joined)
    d = F.coalesce(F.array_join(F.transform(F.filter("delimiters", lambda x: x.kind == F.col("kind")), lambda x: x.delimiter), ""), F.lit(""))
    m = m.select("doc_id", "seq", "kind", v.alias("v"), d.alias("d"))
    pieces = F.filter(F.split(F.call_function("translate", F.col("v"), F.col("d"), F.repeat(F.lit(CUT), F.length("d"))), CUT), lambda p: F.length(F.trim(p)) > 0)
    return _rows(m.select("doc_id", "seq", "kind", pieces.alias("pieces")))
