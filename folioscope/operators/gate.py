"""The quote gate in full, and the comparison of two runs' findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.functions.text import norm_ws, plain
from folioscope.operators.findings import DETECTORS, findings_of

#: Most confidence of a finding whose quote is not there (fixed value).
DOUBTFUL = 0.3
#: Length of the stretch of a quote by which blocks are sought where a finding names none.
GRAM = 3


def gated(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, passed, reason, confidence): whether a finding's quote stands in its blocks, white space apart, or anywhere in its document if it names none.

    No quote passes; an unknown block rejects. In mode disjoint_parts every part between commas must stand in some block: the
    reason counts the parts found. Rejected findings keep a confidence of DOUBTFUL at most. Findings without blocks meet only blocks
    that hold the middle GRAM signs of a part, never all blocks of the document.
    """
    none = F.array().cast("array<string>")
    f = findings_of(findings).select("id", "doc_id", "confidence", F.coalesce("verbatim_quote", F.lit("")).alias("quote"), F.coalesce("quote_mode", F.lit("")).alias("mode"), F.coalesce("block_ids", none).alias("block_ids"))
    split = F.filter(F.transform(F.split("quote", "[、,]"), norm_ws), lambda p: p != "")
    f = f.withColumn("parts", F.when(F.col("mode") == "disjoint_parts", split).otherwise(F.array(norm_ws(F.col("quote")))))
    b = blocks.dropDuplicates(["doc_id", "block_id"]).select("doc_id", "block_id", norm_ws(F.coalesce("text", F.lit(""))).alias("text"))
    named = f.where("size(block_ids) > 0 and quote <> ''").select("id", "doc_id", "parts", F.explode("block_ids").alias("block_id"))
    named = named.join(b, ["doc_id", "block_id"], "left")
    hits = named.select("id", F.col("text").isNull().alias("unknown"), F.explode(F.transform("parts", lambda p, k: F.struct(k.alias("k"), F.coalesce(F.contains("text", p), F.lit(False)).alias("hit")))).alias("x"))
    free = f.where("size(block_ids) = 0 and quote <> ''").select("id", "doc_id", F.posexplode("parts").alias("k", "part"))
    middle = F.greatest(F.lit(1), F.floor((F.length("part") - GRAM) / 2).cast("int") + 1)
    free = free.withColumn("gram", F.substring("part", middle, F.lit(GRAM)))
    sought = b.join(free.select("doc_id").distinct(), "doc_id", "left_semi")
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text"))), lambda at: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring("text", at, n)))))
    there = free.join(sought.select("doc_id", "text", F.explode(grams).alias("gram")), ["doc_id", "gram"]).where(F.contains("text", F.col("part"))).select("id", "k").distinct()
    found = hits.groupBy("id", "x.k").agg(F.bool_or("x.hit").alias("hit"), F.bool_or("unknown").alias("unknown"))
    empty = free.where("part = ''").select("id", "k")  # a blank part stands anywhere
    found = found.unionByName(there.unionByName(empty).distinct().select("id", "k", F.lit(True).alias("hit"), F.lit(False).alias("unknown")))
    g = found.groupBy("id").agg(F.count_if("hit").alias("hits"), F.bool_or("unknown").alias("unknown"))
    j = f.join(g, "id", "left").withColumn("n", F.size("parts")).withColumn("hits", F.coalesce("hits", F.lit(0)))
    parted, whole = F.col("mode") == "disjoint_parts", (F.col("n") > 0) & (F.col("hits") == F.col("n"))
    counted = F.concat_ws("/", F.col("hits").cast("string"), F.col("n").cast("string"))
    reason = (
        F.when(F.col("quote") == "", "no-quote").when(F.coalesce("unknown", F.lit(False)), "block-not-found").when(parted & whole, F.concat(F.lit("all-parts-match "), counted)).when(parted, F.concat(F.lit("partial-match "), counted))
        .when(whole, "exact-match").otherwise("quote-not-found")
    )
    passed = (F.col("quote") == "") | (~F.coalesce("unknown", F.lit(False)) & whole)
    return j.select("id", passed.alias("passed"), reason.alias("reason"), F.when(passed, F.col("confidence")).otherwise(F.least("confidence", F.lit(DOUBTFUL))).alias("confidence"))


def _identity(f: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, family, severity) of active findings: those that passed the gate and are not unverifiable."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    issue = F.lower(F.trim(F.coalesce(F.nullif("issue_type", F.lit("")), F.lit("other"))))
    other = F.coalesce(F.nullif("source", F.lit("")), F.nullif("checklist_id", F.lit("")), F.lit("other"))
    detector = F.coalesce(*[F.when(issue.startswith(k), v) for k, v in DETECTORS.items()], F.lower(F.trim(other)))
    subject = F.substring(plain(blank("rationale")), 1, 240)
    placed = F.array_join(F.array_sort(F.coalesce("block_ids", F.array().cast("array<string>"))), ",")
    active = F.coalesce("gate_passed", F.lit(True)) & (F.coalesce("verdict", F.lit("confirmed")) != "unverifiable")
    severity = F.when(F.col("severity") == "major", 0).when(F.col("severity") == "nit", 2).otherwise(1)
    return findings_of(f).where(active).select("doc_id", F.concat_ws("|", detector, issue, placed, plain(blank("verbatim_quote")), subject).alias("fingerprint"), F.concat_ws("|", detector, issue, subject).alias("family"), severity.alias("severity"))


def run_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, moved_to, n_before, n_after, status): findings of two runs as multisets.

    Equal counts are unchanged, or worsened if the severity rose; more are worsened, fewer or none left resolved, else new. Within a
    family (detector, issue, subject) fingerprints of one side only are paired in sorted order as moved, with one row a pair.
    """
    count = lambda f, n, s: _identity(f).groupBy("doc_id", "family", "fingerprint").agg(F.count("*").alias(n), F.min("severity").alias(s))
    j = count(before, "n_before", "s_before").join(count(after, "n_after", "s_after"), ["doc_id", "family", "fingerprint"], "full").fillna(0, ["n_before", "n_after"])
    one = j.where("n_before = 0 or n_after = 0")
    turn = F.row_number().over(W.partitionBy("doc_id", "family", F.col("n_before") > 0).orderBy("fingerprint"))
    one = one.withColumn("turn", turn)
    gone, come = one.where("n_before > 0"), one.where("n_after > 0")
    pair = gone.select("doc_id", "family", "turn", F.col("fingerprint").alias("from"), "n_before").join(come.select("doc_id", "family", "turn", F.col("fingerprint").alias("moved_to"), "n_after"), ["doc_id", "family", "turn"], "full")
    status = F.when(F.col("moved_to").isNull(), "resolved").when(F.col("from").isNull(), "new").otherwise("moved")
    alone = pair.select("doc_id", F.coalesce("from", "moved_to").alias("fingerprint"), F.when(status == "moved", F.col("moved_to")).alias("moved_to"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"), status.alias("status"))
    status = F.when(F.col("n_after") > F.col("n_before"), "worsened").when(F.col("n_after") < F.col("n_before"), "resolved").when(F.col("s_after") < F.col("s_before"), "worsened").otherwise("unchanged")
    both = j.where("n_before > 0 and n_after > 0").select("doc_id", "fingerprint", F.lit(None).cast("string").alias("moved_to"), "n_before", "n_after", status.alias("status"))
    return both.unionByName(alone)


def compared_runs(findings: DataFrame) -> DataFrame:
    """run_difference of what deterministic checks and what reviewers found."""
    own = F.coalesce(F.col("source") == "deterministic", F.lit(False))
    return run_difference(findings.where(own), findings.where(~own))


def id_variants(c: Column) -> Column:
    """An identifier as written in lower case, and without resolver address, scheme and final punctuation."""
    raw = F.lower(F.trim(c))
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"[.,;)\]}]+$", ""), r"^https?://(?:dx\.)?doi\.org/", ""), r"^(?:doi:|arxiv:|pmid:)\s*", "")
    return F.filter(F.array_distinct(F.array(raw, cleaned)), lambda x: x != "")


def looked_up(records: DataFrame, works: DataFrame) -> DataFrame:
    """(rec_id, identifier, found_by): the resolver row of a record by its DOI, arXiv or PubMed number, in this order, in any notation.

    Numbers are read from doi and raw of the record and matched with identifier and doi of the works; of several works the least
    identifier counts. Records without number, or whose numbers no work bears, have no row.
    """
    r = records.dropDuplicates(["rec_id"])
    read = {"doi": F.coalesce(F.nullif("doi", F.lit("")), F.nullif(F.regexp_extract("raw", r"(?i)(10\.\d{4,9}/[^\s\"<>]+)", 1), F.lit(""))), "arxiv": F.nullif(F.regexp_extract("raw", r"(?i)(?:arxiv:\s*)?\b(\d{4}\.\d{4,5})(?:v\d+)?\b", 1), F.lit("")), "pmid": F.nullif(F.regexp_extract("raw", r"(?i)\bpmid:?\s*(\d{4,9})", 1), F.lit(""))}
    asked = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(n).alias("found_by"), v.alias("value")) for k, (n, v) in enumerate(read.items())])
    r = r.select("rec_id", F.explode(asked).alias("x")).where("x.value is not null").select("rec_id", "x.turn", "x.found_by", F.explode(id_variants(F.col("x.value"))).alias("key"))
    names = F.array_distinct(F.concat(id_variants(F.coalesce("identifier", F.lit(""))), id_variants(F.coalesce("doi", F.lit("")))))
    w = works.dropDuplicates(["identifier"]).select("identifier", F.explode(names).alias("key"))
    return r.join(w, "key").groupBy("rec_id").agg(F.min(F.struct("turn", "identifier", "found_by")).alias("x")).select("rec_id", "x.identifier", "x.found_by")
