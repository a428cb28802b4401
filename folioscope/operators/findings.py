"""Findings: the quote gate, identity, relations, classes, ranks and comparisons of finding sets.

Findings are keyed by id and ordered by seq in their document; repeated rows of a key count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from folioscope.functions.text import jaccard, norm_ws, plain, word_set
from folioscope.session import written

SEVERITY = {"major": 0, "minor": 1, "nit": 2}
VERDICTS = ["confirmed", "contested", "refuted", "unverifiable"]
#: Detector by the beginning of an issue type (fixed values).
DETECTORS = {"citation_": "citations", "crossref_": "crossref", "numeric_": "numbers", "stats_": "numbers", "terminology_": "terminology", "structure_": "structure", "privacy_": "privacy"}
#: Words that deny and words that affirm (fixed values).
NEGATIVE = ["no", "not", "without", "missing", "absent", "unsupported", "inconsistent", "failed", "fail"]
POSITIVE = ["yes", "present", "supported", "consistent", "significant", "confirmed"]
#: Relations of findings, the strongest first (fixed values).
STRENGTH = ["duplicate", "supports", "contradicts", "same_root_cause"]
NUMBER = r"(\d+(?:\.\d+)?)"


def findings_of(findings: DataFrame) -> DataFrame:
    return findings.dropDuplicates(["id"])


def severity_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SEVERITY.items() for x in p]), c), F.lit(3))


def gate(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, passed, reason): whether a finding's quote stands in one of its blocks, white space apart.

    An empty quote passes; any unknown block rejects; without blocks the finding is rejected as unanchored. In mode
    disjoint_parts the parts between commas must each stand in some block.
    """
    f = findings_of(findings).select("id", "doc_id", "quote_mode", F.coalesce("verbatim_quote", F.lit("")).alias("quote"), "block_ids")
    b = blocks.dropDuplicates(["doc_id", "block_id"]).select("doc_id", "block_id", norm_ws(F.coalesce("text", F.lit(""))).alias("text"), F.lit(1).alias("known"))
    x = f.select("id", "doc_id", "quote_mode", "quote", F.explode_outer("block_ids").alias("block_id")).join(b, ["doc_id", "block_id"], "left")
    parts = F.filter(F.transform(F.split("quote", "[、,]"), norm_ws), lambda p: p != "")
    x = x.withColumn("parts", F.when(F.col("quote_mode") == "disjoint_parts", parts).otherwise(F.array(norm_ws(F.col("quote")))))
    x = x.withColumn("hit", F.transform("parts", lambda p: F.coalesce(F.contains("text", p), F.lit(False)).cast("int")))
    g = x.groupBy("id").agg(
        F.first("quote").alias("quote"), F.bool_or(F.col("block_id").isNotNull() & F.col("known").isNull()).alias("unknown"), F.count("block_id").alias("n_blocks"),
        F.max("hit").alias("any_hit"), F.collect_list("hit").alias("hits"), F.first(F.size("parts")).alias("n_parts"),
    )
    found = F.forall(F.sequence(F.lit(1), F.col("n_parts")), lambda k: F.exists("hits", lambda h: F.try_element_at(h, k) == 1))
    reason = F.when(F.col("quote") == "", "empty").when(F.col("n_blocks") == 0, "unanchored").when(F.col("unknown"), "block-not-found").when(F.col("n_parts") == 0, "no-part").when(found, "match").otherwise("quote-not-found")
    return g.select("id", reason.isin("empty", "match").alias("passed"), reason.alias("reason"))


def schema_errors(findings: DataFrame) -> DataFrame:
    """(id, error): the first rule that a finding breaks; sound findings have no row."""
    error = (
        F.when(F.coalesce(F.trim("doc_id"), F.lit("")) == "", "no document").when(F.coalesce(F.size("block_ids"), F.lit(0)) < 1, "no block").when(F.coalesce(norm_ws(F.col("verbatim_quote")), F.lit("")) == "", "blank quote")
        .when(~F.coalesce(F.col("severity").isin(*SEVERITY), F.lit(False)), "unknown severity").when(~F.coalesce(F.col("confidence").between(0, 1), F.lit(False)), "confidence out of range").when(F.col("rationale").isNull(), "no rationale")
        .when(F.col("received_at") < F.col("recorded_at"), "received before recorded")
    )
    return findings_of(findings).select("id", error.alias("error")).where("error is not null")


def severity_counts(findings: DataFrame) -> DataFrame:
    """(severity, verdict, n): counts by both, by each and in all (null stands for all)."""
    return findings_of(findings).cube("severity", "verdict").agg(F.count("*").alias("n"))


def coverage(findings: DataFrame) -> DataFrame:
    """(doc_id, n_checks, share, n_findings): how many of all checklists a document's findings come from."""
    f = findings_of(findings).select("doc_id", F.substring_index("checklist_id", "/", -1).alias("check"))
    total = f.agg(F.count_distinct("check").alias("n")).first()["n"] or 1
    return f.groupBy("doc_id").agg(F.count_distinct("check").alias("n_checks"), F.count("*").alias("n_findings")).select("doc_id", "n_checks", F.round(F.col("n_checks") / F.lit(total), 6).alias("share"), "n_findings")


def ranks(findings: DataFrame) -> DataFrame:
    """(id, rank, display): rank in the document by severity, confidence and seq.

    The rank is the number of findings in better (severity, confidence) classes of the document plus the rank inside the class,
    so that no window holds more than one class of one document.
    """
    f = findings_of(findings).select("id", "doc_id", "seq", severity_rank(F.col("severity")).alias("sev"), F.coalesce("confidence", F.lit(0.0)).alias("conf"))
    classes = f.groupBy("doc_id", "sev", "conf").agg(F.count("*").alias("n"))
    before = W.partitionBy("doc_id").orderBy("sev", F.desc("conf")).rowsBetween(W.unboundedPreceding, -1)
    classes = classes.select("doc_id", "sev", "conf", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("doc_id", "sev", "conf").orderBy("seq"))
    r = f.withColumn("inside", inside).join(classes, ["doc_id", "sev", "conf"]).select("id", (F.col("before") + F.col("inside")).alias("rank"))
    return r.select("id", "rank", F.concat(F.lit("F"), F.when(F.col("rank") < 1000, F.lpad(F.col("rank").cast("string"), 3, "0")).otherwise(F.col("rank").cast("string"))).alias("display"))


def uids(findings: DataFrame) -> DataFrame:
    """(id, uid, fingerprint): identity by issue, checklist, blocks and quote; fingerprint by detector, issue, blocks, quote and subject."""
    blocks = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("block_ids", F.array().cast("array<string>")), lambda b: F.trim(b)), lambda b: b != ""))), ",")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    issue = F.lower(F.trim(blank("issue_type")))
    material = F.concat_ws("\x1f", issue, F.lower(norm_ws(blank("checklist_id"))), blocks, F.lit(""), F.lit(""), norm_ws(blank("verbatim_quote")), F.when(blocks == "", norm_ws(blank("rationale"))).otherwise(""))
    detector = F.coalesce(*[F.when(issue.startswith(k), v) for k, v in DETECTORS.items()], F.lower(blank("source")))
    mark = F.concat_ws("|", detector, issue, blocks, plain(blank("verbatim_quote")), F.substring(plain(blank("rationale")), 1, 240))
    return findings_of(findings).select("id", F.concat(F.lit("fd_"), F.substring(F.sha2(material, 256), 1, 24)).alias("uid"), F.substring(F.sha2(mark, 256), 1, 24).alias("fingerprint"))


def exact_duplicates(findings: DataFrame) -> DataFrame:
    """(id, kept, n): findings of equal issue, quote and blocks; kept is the one that stays: deterministic first, then by confidence and id."""
    key = [F.col("doc_id"), F.col("issue_type"), norm_ws(F.coalesce("verbatim_quote", F.lit(""))).alias("quote"), F.array_join(F.array_sort("block_ids"), ",").alias("blocks")]
    f = findings_of(findings).select("id", *key, F.struct((F.col("source") != "deterministic").cast("int").alias("late"), (-F.coalesce("confidence", F.lit(0.0))).alias("c"), F.col("id")).alias("order"))
    g = f.groupBy("doc_id", "issue_type", "quote", "blocks").agg(F.min("order").alias("best"), F.count("*").alias("n"))
    return f.join(g, ["doc_id", "issue_type", "quote", "blocks"]).select("id", F.col("best.id").alias("kept"), "n")


def polarity(text: Column) -> Column:
    """-1 for a text that denies, 1 for one that affirms, 0 else."""
    words = word_set(text)
    no, yes = (F.arrays_overlap(words, F.array(*map(F.lit, w))) for w in (NEGATIVE, POSITIVE))
    return F.when(no, -1).when(yes, 1).otherwise(0)


def relations(findings: DataFrame) -> DataFrame:
    """(a, b, location, text, relation): pairs of findings of one document that share a block and say different things, a before b.

    location is the Jaccard similarity of their blocks, text that of their words. Pairs of equal quote and rationale are left to
    exact_duplicates.
    """
    said = F.concat_ws(" ", "verbatim_quote", "rationale")
    f = findings_of(findings).select("id", "doc_id", "seq", "issue_type", "block_ids", said.alias("said"))
    at = f.select("doc_id", "id", "seq", F.explode(F.array_distinct("block_ids")).alias("block_id"))
    pairs = at.join(at.select("doc_id", "block_id", F.col("id").alias("b"), F.col("seq").alias("seq_b")), ["doc_id", "block_id"]).where("seq < seq_b").select(F.col("id").alias("a"), "b").distinct()
    left = f.select(F.col("id").alias("a"), F.col("issue_type").alias("ia"), F.col("block_ids").alias("ba"), F.col("said").alias("sa"))
    right = f.select(F.col("id").alias("b"), F.col("issue_type").alias("ib"), F.col("block_ids").alias("bb"), F.col("said").alias("sb"))
    p = pairs.join(left, "a").join(right, "b").where("sa <> sb")
    p = p.withColumn("location", F.round(jaccard(F.array_distinct("ba"), F.array_distinct("bb")), 6)).withColumn("text", F.round(jaccard(word_set(F.col("sa")), word_set(F.col("sb"))), 6))
    opposed = (polarity(F.col("sa")) * polarity(F.col("sb"))) < 0
    relation = F.when(opposed & (F.col("text") >= 0.38), "contradicts").when((F.col("ia") == F.col("ib")) & (F.col("text") >= 0.55), "duplicate").when(F.col("text") >= 0.45, "supports").when(F.col("ia") == F.col("ib"), "same_root_cause").otherwise("co_located")
    return p.select("a", "b", "location", "text", relation.alias("relation"))


def anchor_classes(findings: DataFrame) -> DataFrame:
    """(id, class_id): classes of findings connected by common blocks, named by their least id; findings without blocks stand alone.

    Every block links its findings to the least of them, not in pairs; the least label then spreads over these stars and is
    followed to its own label until nothing changes.
    """
    f = findings_of(findings).select("id", "doc_id", "block_ids")
    at = f.select("id", "doc_id", F.explode("block_ids").alias("block")).select("id", F.concat_ws("/", "doc_id", "block").alias("spot"))
    return linked_classes(f, at)


def linked_classes(nodes: DataFrame, at: DataFrame) -> DataFrame:
    """(id, class_id): classes of nodes (id) connected by common spots (id, spot), named by their least id."""
    at = written(at.distinct(), "anchors")
    label = written(nodes.select("id", F.col("id").alias("label")), "labels")
    while True:
        spot = at.join(label, "id").groupBy("spot").agg(F.min("label").alias("low"))
        near = at.join(spot, "spot").groupBy("id").agg(F.min("low").alias("low"))
        step = written(label.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("low", "label")).alias("new")), "labels")
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        step = written(step.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        label = step.select("id", F.col("new").alias("label"))
        if step.where("new <> label").isEmpty():
            return label.withColumnRenamed("label", "class_id")


def edges(findings: DataFrame) -> DataFrame:
    """(a, b, relation): related findings, a before b, and among findings of equal issue and text on a block the first with every other as duplicates."""
    f = findings_of(findings).select("id", "doc_id", "issue_type", "seq", F.concat_ws(" ", "verbatim_quote", "rationale").alias("said"), F.explode(F.array_distinct("block_ids")).alias("block_id")).where("trim(said) <> ''")
    key = ["doc_id", "issue_type", "block_id", "said"]
    first = f.groupBy(*key).agg(F.min(F.struct("seq", "id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    equal = f.join(first, key).where("id <> first.id").select(F.col("first.id").alias("a"), F.col("id").alias("b"), F.lit("duplicate").alias("relation")).distinct()
    return relations(findings).where("relation <> 'co_located'").select("a", "b", "relation").unionByName(equal)


def duplicate_groups(findings: DataFrame, linkable: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, class_id) of all findings by duplicate edges, and (class_id, n_supports, related, relation) of classes that have edges.

    Edges are sought among linkable findings, all if not given. A class counts every edge that touches it once; related are the other
    ends, relation the strongest one.
    """
    e = written(edges(findings if linkable is None else linkable), "edges")
    d = e.where("relation = 'duplicate'").select("a", "b", F.concat_ws("|", "a", "b").alias("spot"))
    at = d.select(F.col("a").alias("id"), "spot").unionByName(d.select(F.col("b").alias("id"), "spot"))
    joined = linked_classes(at.select("id").distinct(), at)
    c = written(findings_of(findings).select("id").join(joined, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id")), "classes")
    e = e.join(c.select(F.col("id").alias("a"), F.col("class_id").alias("ca")), "a").join(c.select(F.col("id").alias("b"), F.col("class_id").alias("cb")), "b")
    touch = e.select(F.col("ca").alias("class_id"), F.col("b").alias("other"), "relation").unionByName(e.where("ca <> cb").select(F.col("cb").alias("class_id"), F.col("a").alias("other"), "relation"))
    strength = F.array_position(F.array(*map(F.lit, STRENGTH)), F.col("relation"))
    peers = touch.groupBy("class_id").agg(F.count_if(F.col("relation") == "supports").alias("n_supports"), F.array_sort(F.collect_set("other")).alias("related"), F.min_by("relation", strength).alias("relation"))
    return c, peers


def best_order() -> Column:
    return F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), severity_rank(F.col("severity")).alias("s"), "seq", "id")


def collapsed_duplicates(findings: DataFrame) -> DataFrame:
    """(representative, n, support, n_reviewers, reviewers, sources, related, relation, top_confidence): classes of findings joined by duplicate edges, by their best finding.

    support is the size of the class plus the supports edges that touch it.
    """
    c, peers = duplicate_groups(findings)
    g = findings_of(findings).join(c, "id").groupBy("class_id").agg(
        F.min(best_order()).alias("best"), F.count("*").alias("n"), F.array_sort(F.collect_set("reviewer_id")).alias("reviewers"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("confidence").alias("top_confidence")
    )
    support = F.col("n") + F.coalesce("n_supports", F.lit(0))
    return g.join(peers, "class_id", "left").select(F.col("best.id").alias("representative"), "n", support.alias("support"), F.size("reviewers").alias("n_reviewers"), "reviewers", "sources", F.coalesce("related", F.array().cast("array<string>")).alias("related"), "relation", "top_confidence")


def collapsed(findings: DataFrame) -> DataFrame:
    """(representative, n, n_reviewers, sources, top_confidence): classes of findings of equal document, issue and first block, by their best finding."""
    f = findings_of(findings).withColumn("anchor", F.array_min("block_ids"))
    order = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), severity_rank(F.col("severity")).alias("s"), "seq", "id")
    g = f.groupBy("doc_id", "issue_type", "anchor").agg(F.min(order).alias("best"), F.count("*").alias("n"), F.count_distinct("reviewer_id").alias("n_reviewers"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.max("confidence").alias("top_confidence"))
    return g.select(F.col("best.id").alias("representative"), "n", "n_reviewers", "sources", "top_confidence")


def edit_conflicts(findings: DataFrame) -> DataFrame:
    """(doc_id, block_id, n_findings, first_id): blocks that several findings with a suggested fix target."""
    f = findings_of(findings).where("trim(suggested_fix) <> ''").select("doc_id", "id", F.explode(F.array_distinct("block_ids")).alias("block_id"))
    return f.groupBy("doc_id", "block_id").agg(F.count("*").alias("n_findings"), F.min("id").alias("first_id")).where("n_findings > 1")


def set_difference(findings: DataFrame) -> DataFrame:
    """(doc_id, issue_type, checklist_id, n_before, n_after, status): finding multisets of deterministic checks (before) and reviewers (after)."""
    f = findings_of(findings).groupBy("doc_id", "issue_type", "checklist_id").agg(F.count_if(F.col("source") == "deterministic").alias("n_before"), F.count_if(F.col("source") != "deterministic").alias("n_after"))
    status = F.when(F.col("n_after") == 0, "resolved").when(F.col("n_before") == 0, "new").when(F.col("n_after") > F.col("n_before"), "worsened").when(F.col("n_after") < F.col("n_before"), "improved").otherwise("unchanged")
    return f.withColumn("status", status)


def reviewer_status(findings: DataFrame) -> DataFrame:
    """(reviewer_id, n, n_docs, n_passed, mean_confidence, late): what each reviewer filed; late counts findings received over a day after they were recorded."""
    late = (F.unix_timestamp("received_at") - F.unix_timestamp("recorded_at")) > 86400
    return findings_of(findings).groupBy("reviewer_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.count_if("gate_passed").alias("n_passed"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_if(late).alias("late"))


def scores(findings: DataFrame) -> DataFrame:
    """(issue_type, tp, fp, fn, precision, recall, f1): gate decisions against verdicts, by issue type and in all (null).

    Predicted are findings that passed the gate, right are those with verdict confirmed.
    """
    f = findings_of(findings).select("issue_type", F.coalesce("gate_passed", F.lit(False)).alias("p"), F.coalesce(F.col("verdict") == "confirmed", F.lit(False)).alias("g"))
    s = f.rollup("issue_type").agg(F.count_if(F.expr("p and g")).alias("tp"), F.count_if(F.expr("p and not g")).alias("fp"), F.count_if(F.expr("g and not p")).alias("fn"))
    return rated(s)


def rated(s: DataFrame) -> DataFrame:
    """Precision, recall and F1 of counts (issue_type, tp, fp, fn)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).when(fn > 0, 0.0).otherwise(1.0)
    recall = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)
    s = s.withColumn("p0", precision).withColumn("r0", recall)
    f1 = F.when(F.col("p0") + F.col("r0") > 0, 2 * F.col("p0") * F.col("r0") / (F.col("p0") + F.col("r0"))).otherwise(0.0)
    return s.select("issue_type", "tp", "fp", "fn", F.round("p0", 4).alias("precision"), F.round("r0", 4).alias("recall"), F.round(f1, 4).alias("f1"))


def gold_compatible(findings: DataFrame) -> DataFrame:
    """(doc_id, issue_type, n_gold, n_predicted, n_compatible): gold (confirmed deterministic) findings and those with a reviewer's finding of the issue on a common block."""
    f = findings_of(findings).select("doc_id", "issue_type", "id", "source", "verdict", F.explode_outer(F.array_distinct("block_ids")).alias("block_id"))
    gold, found = f.where("source = 'deterministic' and verdict = 'confirmed'"), f.where("source <> 'deterministic'")
    hit = gold.join(found.select("doc_id", "issue_type", "block_id").distinct(), ["doc_id", "issue_type", "block_id"], "left_semi").groupBy("doc_id", "issue_type").agg(F.count_distinct("id").alias("n_compatible"))
    n = gold.groupBy("doc_id", "issue_type").agg(F.count_distinct("id").alias("n_gold")).join(found.groupBy("doc_id", "issue_type").agg(F.count_distinct("id").alias("n_predicted")), ["doc_id", "issue_type"], "full")
    return n.join(hit, ["doc_id", "issue_type"], "left").fillna(0, ["n_gold", "n_predicted", "n_compatible"])


def verified(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, severity, n, n_passed, n_kept, n_unsound): the verify pipeline: gate, exact duplicates and schema rules over all findings."""
    f = findings_of(findings).select("id", "doc_id", "severity")
    g, d, e = gate(findings, blocks), exact_duplicates(findings), schema_errors(findings)
    j = f.join(g, "id").join(d, "id").join(e, "id", "left")
    kept = F.col("passed") & (F.col("kept") == F.col("id"))
    return j.groupBy("doc_id", "severity").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.count_if(kept).alias("n_kept"), F.count_if(F.col("error").isNotNull()).alias("n_unsound"))


def verified_findings(findings: DataFrame, blocks: DataFrame, least: float = 0.55) -> DataFrame:
    """(id, doc_id, error, reason, representative, support, rank, display, status): the verify pipeline, one row a finding.

    Reviewers' findings are validated and gated, where an empty quote fails too; deterministic ones bring their gate result. Sound
    findings of confidence `least` or more are linked and duplicates collapsed; a representative's rank in its document and whether it
    passed (confirmed or rejected) hold for all findings of its class. Unsound findings stand alone and rank as nits of confidence 1.
    """
    f = findings_of(findings).join(schema_errors(findings), "id", "left").join(gate(findings, blocks).select("id", "reason"), "id")
    own = F.coalesce(F.col("source") == "deterministic", F.lit(False))
    f = f.withColumn("error", F.when(~own, F.col("error"))).withColumn("passed", F.when(own, F.coalesce("gate_passed", F.lit(False))).otherwise(F.col("error").isNull() & (F.col("reason") == "match")))
    f = f.withColumn("severity", F.when(F.col("error").isNull(), F.col("severity")).otherwise("nit")).withColumn("confidence", F.when(F.col("error").isNull(), F.col("confidence")).otherwise(1.0))
    f = written(f.select("id", "doc_id", "seq", "issue_type", "severity", "confidence", "block_ids", "verbatim_quote", "rationale", "error", "reason", "passed"), "checked")
    c, peers = duplicate_groups(f, f.where("error is null").where(F.col("confidence") >= least))
    g = f.join(c, "id").groupBy("class_id").agg(F.min_by(F.struct("id", "passed"), best_order()).alias("best"), F.count("*").alias("n"))
    g = written(g.join(peers, "class_id", "left").select("class_id", F.col("best.id").alias("representative"), "best.passed", (F.col("n") + F.coalesce("n_supports", F.lit(0))).alias("support")), "groups")
    r = ranks(f.join(g, f.id == g.representative, "left_semi")).withColumnRenamed("id", "representative")
    status = F.when(F.col("passed"), "confirmed").otherwise("rejected")
    return f.select("id", "doc_id", "error", "reason").join(c, "id").join(g, "class_id").join(r, "representative").select("id", "doc_id", "error", "reason", "representative", "support", "rank", "display", status.alias("status"))
