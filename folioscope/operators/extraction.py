"""Numeric statements read from body texts and tables, and the contradictions between them.

Reading is a map over blocks: in prose the rules run in order, and a stretch that one rule has read is closed to the later ones;
in tables every body cell is read under its header and row label. The checks are groupings of the statements by Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.session import spread, written

#: Patterns of numbers, units, statistical statements and names of measures (fixed values).
NUM = r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[eE][-+]?\d+)?|[-+]?\.\d+(?:[eE][-+]?\d+)?"
NUMBER = re.compile(NUM)
UNIT = re.compile(r"(?:%|％|百分比|百分点(?:数)?|percentage\s*points?|pp\b|倍|times?|points?|point|ms\b|毫秒|秒|s\b|kg\b|g\b|mg\b|cm\b|mm\b|mmhg\b|°c|℃|万|亿)", re.I)
P_VALUE = re.compile(rf"(?<![A-Za-z])p\s*(<=|>=|<|>|=|：|:)\s*({NUM})", re.I)
P_BARE = re.compile(rf"(?<![A-Za-z])p\s+({NUM})", re.I)
SIZES = [re.compile(rf"(?<![A-Za-z])[Nn]\s*(?:=|：|:|为|is|was)?\s*({NUM})(?![A-Za-z])"), re.compile(rf"(?:样本量|样本数|病例数|受试者(?:数|人数)?|人数)\s*(?:=|：|:|为|是)?\s*({NUM})")]
INTERVAL = re.compile(rf"(\d{{1,3}})\s*%?\s*(?:CI|置信区间|confidence\s+interval)\s*[\[（(]?\s*({NUM})\s*(?:[,，;；]|至|to|[-–—])\s*({NUM})\s*[\]）)]?", re.I)
SPREAD = re.compile(rf"({NUM})\s*([%％]|个百分点|points?|倍)?\s*(?:±|\+/-|\+\-+)\s*({NUM})\s*([%％]|个百分点|points?|倍)?", re.I)
MEASURE = re.compile(
    r"(?:accuracy|precision|recall|f1(?:[- ]?score)?|sensitivity|specificity|prevalence|incidence|rate|ratio|odds|hazard|risk|effect|mean|median|average|score|value|level|concentration|weight|height|age|duration|"
    r"proportion|percentage|percent|change|difference|error|loss|yield|auc|rmse|mae|correlation|coefficient|效率|准确率|精确率|召回率|灵敏度|特异度|患病率|发生率|比例|占比|比率|均值|平均值|中位数|得分|分数|"
    r"数值|值|水平|浓度|体重|身高|年龄|时长|持续时间|误差|损失|产量|差异|变化|风险|优势比|比值比|相关系数|回归系数|效应量|显著性)", re.I,
)
CITATION = re.compile(r"^\s*\[\s*\d+(?:\s*[,;，；]\s*\d+)*\s*\]\s*$")
CLAUSE = re.compile(r"[。.!?；;\n]|(?<!\d)[,:：，](?!\d)")
FILLERS, LINKS = re.compile(r"(?:was|were|is|are|of|for|the|a|an|为|是|达|约|平均)\s+", re.I), re.compile(r"\b(?:was|were|is|are|of|for|the|a|an|and|with|为|是|达|约)\b", re.I)
EDGES, SIZE_HEADER, TOTAL_LABEL = " ,，;；:：()（）[]", re.compile(r"\s*(?:n|sample\s*size|样本(?:量|数)|人数)\s*", re.I), re.compile(r"total|合计|总计|sum", re.I)
SAME_UNIT = {"％": "%", "percent": "%", "percentage": "%", "point": "points", "percentage points": "points", "个百分点": "points", "百分点数": "points"}
#: Characters before a number in which its measure stands, before the measure, and on either side as context; longest context (fixed values).
LOOK_BACK, LEAD, AROUND, LONGEST = 90, 36, 70, 120
NEGATED, CLAIMED = r"(?i)not\s+significant|non[- ]?significant|不显著|未达显著|无显著", r"(?i)statistically\s+significant|significant|显著(?:性)?|有显著"
FAMILIES = {"precision": r"\bprecision\b|精确率|查准率", "recall": r"\brecall\b|召回率|查全率", "f1": r"\bf1(?:[- ]?score)?\b|f1分数|f1值"}
COUNT_COLUMN, OVERALL = r"(?i)\bn\b|sample|样本|人数|count", r"(?i)total|overall|合计|总计|总体|整体|all"
FACT = "metric string, value double, unit string, context string, raw string, kind string, operator string, uncertainty double, low double, high double, level double"


def amount(text: str) -> float:
    return float(text.replace(",", ""))


def year_like(text: str) -> bool:
    t = text.replace(",", "")
    return bool(re.fullmatch(r"\d{4}", t)) and 1900 <= int(t) <= 2100


def unit_name(text: str) -> str:
    u = text.strip().casefold()
    return SAME_UNIT.get(u, u)


def tidy(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip(EDGES)


def measure_before(text: str, at: int) -> str:
    """The name of the measure that a number at `at` belongs to: the end of the clause before it, up to the last word for a measure."""
    clause = CLAUSE.split(text[max(0, at - LOOK_BACK) : at])[-1]
    last = None
    for last in MEASURE.finditer(clause):
        pass
    if last is None:
        return ""
    phrase = FILLERS.sub(" ", clause[max(0, last.start() - LEAD) : last.end()])
    phrase = re.sub(r"^[\s(\[,:：，、-]+|[\s)\],:：，、-]+$", "", phrase)
    return tidy(" ".join(phrase.split()[-6:])).casefold()


def context_of(text: str, start: int, end: int) -> str:
    around = tidy(f"{text[max(0, start - AROUND) : start]} {text[end : end + AROUND]}")
    return re.sub(r"\s+", " ", LINKS.sub(" ", around)).strip()[:LONGEST]


def in_citation(text: str, start: int, end: int) -> bool:
    left, right = text.rfind("[", 0, start + 1), text.find("]", end)
    return left >= 0 and right >= 0 and not any(c.isalpha() for c in text[left + 1 : right])


class Prose:
    """The statements of one text, and the stretches already read."""

    def __init__(self, text: str):
        self.text, self.out, self.read = text, [], bytearray(len(text) + 1)
        if text.strip() and not CITATION.match(text):
            self.statistics()
            self.measures()

    def free(self, at: int) -> bool:
        return not self.read[at]

    def close(self, span: tuple[int, int]) -> None:
        self.read[slice(*span)] = b"\1" * (span[1] - span[0])

    def add(self, span: tuple[int, int], metric: str, value: float, unit: str, kind: str, operator: str = "=", uncertainty=None, bounds=(None, None), level=None) -> None:
        self.out.append((metric, value, unit, context_of(self.text, *span), self.text[slice(*span)], kind, operator, uncertainty, *bounds, level))

    def statistics(self) -> None:
        """p values, sample sizes and confidence intervals, which name themselves."""
        for m in P_VALUE.finditer(self.text):
            self.add(m.span(), "p-value", amount(m[2]), "p-value", "p_value", m[1])
            self.close(m.span())
        for m in P_BARE.finditer(self.text):
            if self.free(m.start()):
                self.add(m.span(), "p-value", amount(m[1]), "p-value", "p_value")
                self.close(m.span())
        for pattern in SIZES:
            for m in pattern.finditer(self.text):
                if not year_like(m[1]):
                    self.add(m.span(), "sample size", amount(m[1]), "count", "sample_size")
                    self.close(m.span())
        for m in INTERVAL.finditer(self.text):
            low, high = amount(m[2]), amount(m[3])
            if low <= high:
                self.add(m.span(), measure_before(self.text, m.start()) or "estimate", (low + high) / 2, "CI", "ci", bounds=(low, high), level=amount(m[1]))
                self.close(m.span())

    def measures(self) -> None:
        """Values with an uncertainty, then single values, which need the name of a measure before them."""
        for m in SPREAD.finditer(self.text):
            name = measure_before(self.text, m.start()) if self.free(m.start()) and (m[2] or not year_like(m[1])) else ""
            if name:
                self.add(m.span(), name, amount(m[1]), unit_name(m[2] or m[4] or ""), "value", uncertainty=amount(m[3]))
                self.close(m.span())
        for m in NUMBER.finditer(self.text):
            start, end = m.span()
            if not self.free(start) or year_like(m[0]) or in_citation(self.text, start, end):
                continue
            name = measure_before(self.text, start)
            if name:
                tail = self.text[end : end + 18]
                gap = len(tail) - len(tail.lstrip())
                unit = UNIT.match(tail, gap)
                self.add((start, end + unit.end() if unit else end), name, amount(m[0]), unit_name(unit[0]) if unit else "", "value")


def cell_statement(cell: str, label: str, header: str) -> tuple | None:
    """The statement of one table cell: a p value before a sample size before an interval before a single value."""
    text, label, header = cell.strip(), re.sub(r"\s+", " ", label).strip(), re.sub(r"\s+", " ", header).strip()
    if not text or CITATION.match(text):
        return None
    name = "table total" if TOTAL_LABEL.search(label) else tidy(f"{label} {header}").casefold()
    context = f"{label} {header}"
    p = P_VALUE.search(text)
    if p:
        return ("p-value", amount(p[2]), "p-value", context, text, "p_value", p[1], None, None, None, None)
    n = SIZES[0].search(text) or SIZES[1].search(text)
    if n:
        return None if year_like(n[1]) else ("sample size", amount(n[1]), "count", context, text, "sample_size", "=", None, None, None, None)
    ci = INTERVAL.search(text)
    if ci:
        low, high = amount(ci[2]), amount(ci[3])
        return (name, (low + high) / 2, "CI", context, text, "ci", "=", None, low, high, amount(ci[1])) if low <= high else None
    v = NUMBER.search(text)
    if not v or year_like(v[0]) or not name:
        return None
    if SIZE_HEADER.fullmatch(header) and name != "table total":
        return ("sample size", amount(v[0]), "count", context, text, "sample_size", "=", None, None, None, None)
    unit = UNIT.search(text[v.end() :])
    return (name, amount(v[0]), unit_name(unit[0] if unit else header if UNIT.search(header) else ""), context, text, "value", "=", None, None, None, None)


def facts(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, fact_no, FACT): the numeric statements of every block outside reference lists, equal ones once.

    Paragraphs, headings and captions are read as prose, tables and other blocks with rows by cell, tables without rows as prose.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, block, kind, text, rows in b.itertuples(index=False, name=None):
                if kind in ("paragraph", "heading", "caption") or rows is None or not len(rows):
                    found = Prose(text or "").out
                else:
                    head = [str(c or "").strip() for c in rows[0]]
                    cells = ((str(c or ""), str(row[0] or ""), head[k] if k < len(head) else "") for row in rows[1:] for k, c in enumerate(row))
                    found = [s for s in (cell_statement(*c) for c in cells) if s]
                out.extend((doc, block, k, *s) for k, s in enumerate(found, 1))
            yield pd.DataFrame(out, columns=["doc_id", "block_id", "fact_no", *[c.split()[0] for c in FACT.split(", ")]]).astype({c: "float64" for c in ("value", "uncertainty", "low", "high", "level")})

    b = blocks.dropDuplicates(["doc_id", "block_id"]).where("not is_bibliography and (kind in ('paragraph', 'heading', 'caption', 'table') or size(cell_rows) > 0)").select("doc_id", "block_id", "kind", "text", "cell_rows")
    f = spread(b).mapInPandas(read, f"doc_id string, block_id string, fact_no int, {FACT}")
    same = ["doc_id", "block_id", "metric", "value", "unit", "context", "kind", "raw"]
    rest = ["operator", "uncertainty", "low", "high", "level"]
    first = f.groupBy(*same).agg(F.min(F.struct("fact_no", *rest)).alias("x"))
    return first.select("doc_id", "block_id", "x.fact_no", *[f"x.{c}" if c in rest else c for c in (x.split()[0] for x in FACT.split(", "))])


def context_key(c: Column) -> Column:
    """A context without years, numbers, needless blanks and punctuation at its ends."""
    t = F.regexp_replace(F.regexp_replace(F.lower(c), r"\b(?:19|20)\d{2}\b", " "), r"\d+(?:\.\d+)?", " ")
    return F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ ,，;；:：()（）\[\]]+|[ ,，;；:：()（）\[\]]+$", "")


def value_conflicts(f: DataFrame) -> DataFrame:
    """(doc_id, metric, context_key, unit, n_values, quotes, blocks): one measure with several values in one context and unit; p values, sample sizes and table totals apart.

    quotes are the first four statements as written, blocks the first eight in order.
    """
    f = f.where(F.col("kind").isin("value", "p_value", "sample_size") & ~F.col("metric").isin("p-value", "sample size", "table total") & F.col("value").isNotNull()).withColumn("context_key", context_key(F.col("context"))).where("context_key <> ''")
    at = F.struct("block_id", "fact_no", "raw")
    g = f.groupBy("doc_id", "metric", "context_key", "unit").agg(F.count_distinct(F.round("value", 10)).alias("n_values"), F.array_sort(F.collect_list(at)).alias("a")).where("n_values >= 2")
    return g.select("doc_id", "metric", "context_key", "unit", "n_values", F.transform(F.slice("a", 1, 4), lambda x: x.raw).alias("quotes"), F.slice(F.array_distinct(F.transform("a", lambda x: x.block_id)), 1, 8).alias("blocks"))


def f1_conflicts(f: DataFrame, least_shared: int = 2, most: float = 0.02) -> DataFrame:
    """(doc_id, block_id, precision, recall, f1, expected): blocks whose first precision, recall and F1, in contexts with common words, do not fit each other."""
    m = F.lower("metric")
    family = F.when(m.rlike(FAMILIES["precision"]), "precision").when(m.rlike(FAMILIES["recall"]), "recall").when(m.rlike(FAMILIES["f1"]), "f1")
    share = F.when(F.col("unit") == "%", F.col("value") / 100).otherwise(F.col("value"))
    tokens = F.array_distinct(F.regexp_extract_all(context_key(F.col("context")), F.lit(r"([A-Za-z][A-Za-z0-9_-]*|[\x{4e00}-\x{9fff}]{2,})"), 1))
    v = f.where(F.col("unit").isin("%", "") & (F.col("kind") == "value")).select("doc_id", "block_id", "fact_no", family.alias("family"), share.alias("share"), tokens.alias("tokens")).where("family is not null")
    first = lambda k: F.min_by(F.struct("share", "tokens"), F.when(F.col("family") == k, F.col("fact_no"))).alias(k)
    g = v.groupBy("doc_id", "block_id").agg(*[F.max(F.when(F.col("family") == k, 1)).alias(f"has_{k}") for k in FAMILIES], *[first(k) for k in FAMILIES]).where(" and ".join(f"has_{k} = 1" for k in FAMILIES))
    shared = F.size(F.array_intersect(F.array_intersect("precision.tokens", "recall.tokens"), F.col("f1.tokens")))
    g = g.where(shared >= least_shared).select("doc_id", "block_id", *[F.col(f"{k}.share").alias(k) for k in FAMILIES])
    g = g.where(" and ".join(f"{k} between 0 and 1" for k in FAMILIES) + " and precision + recall > 0").withColumn("expected", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return g.where(F.abs(F.col("expected") - F.col("f1")) > most)


def claim_conflicts(f: DataFrame) -> DataFrame:
    """(doc_id, block_id, fact_no, raw, significant, claim): p values against a claim of significance in their context; undecided p values have no row."""
    op = F.coalesce(F.nullif("operator", F.lit("")), F.lit("="))
    below = F.when(F.col("value") > 0.05, False).when((op == "<=") | (F.col("value") < 0.05), True)
    above = F.when(F.col("value") >= 0.05, False)
    significant = F.when(op.isin("<", "<="), below).when(op.isin(">", ">="), above).otherwise(F.col("value") < 0.05)
    said = F.lower(F.concat_ws(" ", "context", "raw"))
    denied = said.rlike(NEGATED)
    p = f.where("kind = 'p_value'").withColumn("significant", significant).where("significant is not null")
    return p.where((F.col("significant") & denied) | (~F.col("significant") & ~denied & said.rlike(CLAIMED))).select("doc_id", "block_id", "fact_no", "raw", "significant", F.when(denied, "not significant").otherwise("significant").alias("claim"))


def total_conflicts(f: DataFrame) -> DataFrame:
    """(doc_id, block_id, fact_no, total, expected): totals of a table against its sample size: the one labelled overall, else the sum of all.

    Totals in a count column are taken before others; several others and none in a count column are left alone.
    """
    t = f.where("metric = 'table total' and value is not null").withColumn("counted", F.col("context").rlike(COUNT_COLUMN).cast("int"))
    n = f.where("kind = 'sample_size' and value is not null").groupBy("doc_id", "block_id").agg(F.min_by("value", F.when(F.col("context").rlike(OVERALL), F.col("fact_no"))).alias("overall"), F.max(F.col("context").rlike(OVERALL)).alias("has"), F.sum("value").alias("sum"))
    g = t.groupBy("doc_id", "block_id").agg(F.sum("counted").alias("n_counted"), F.count("*").alias("n_totals"))
    t = t.join(g, ["doc_id", "block_id"]).where("if(n_counted > 0, counted = 1, n_totals = 1)").join(n, ["doc_id", "block_id"])
    t = t.select("doc_id", "block_id", "fact_no", F.col("value").alias("total"), F.when(F.col("has"), F.col("overall")).otherwise(F.col("sum")).alias("expected"))
    return t.where(F.abs(F.col("total") - F.col("expected")) > 1e-9)


def numeric_issues(blocks: DataFrame) -> DataFrame:
    """(doc_id, issue, confidence, block_id, quote): all numeric checks over the statements of a corpus, one row an issue."""
    f = written(facts(blocks), "facts")
    issue = lambda d, name, sure, block, quote: d.select("doc_id", F.lit(name).alias("issue"), F.lit(sure).alias("confidence"), block.alias("block_id"), quote.alias("quote"))
    named = f.select("doc_id", "block_id", "fact_no", "raw")
    same = issue(value_conflicts(f), "value", 0.93, F.col("blocks")[0], F.col("quotes")[0])
    f1 = issue(f1_conflicts(f), "f1", 0.94, F.col("block_id"), F.round("f1", 6).cast("string"))
    far = issue(f.where("kind = 'p_value' and not value between 0 and 1"), "p range", 0.99, F.col("block_id"), F.col("raw"))
    claim = issue(claim_conflicts(f), "p claim", 0.96, F.col("block_id"), F.col("raw"))
    total = issue(total_conflicts(f).join(named, ["doc_id", "block_id", "fact_no"]), "total", 0.97, F.col("block_id"), F.col("raw"))
    return same.unionByName(f1).unionByName(far).unionByName(claim).unionByName(total).distinct()
