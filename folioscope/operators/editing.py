"""Text spans: claims around marks, chunks for reviewers, edit proposals, differences, best title matches, matching of gold labels."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from folioscope.functions.text import norm_ws, plain, word_set
from folioscope.operators.findings import linked_classes, rated
from folioscope.operators.running import running_last, running_min, running_sum
from folioscope.operators.structure import BIBLIOGRAPHY, numbered_sections
from folioscope.operators.titles import Tile
from folioscope.session import spread, written

#: Records and works of a year that meet in one tile, about.
TITLES, WORKS = 16384, 8192


def claims(marks: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, seq, claim): the sentence around each mark, without the mark; char_range counts code points, end exclusive.

    Marks without block, text or a range inside it have no row.
    """
    m = marks.dropDuplicates(["doc_id", "seq"]).select("doc_id", "seq", "block_id", F.col("char_range.start_pos").alias("a"), F.col("char_range.end_pos").alias("z"))
    b = blocks.dropDuplicates(["doc_id", "block_id"]).select("doc_id", "block_id", "text")
    j = m.join(b, ["doc_id", "block_id"]).where("a >= 0 and z >= a and z <= length(text)")
    before = F.expr("substring(text, 1, a)")
    after = F.expr("substring(text, z + 1)")
    head = F.regexp_extract(before, r"(?s)((?:[^.!?。！？]|[.](?=\S))*)$", 1)
    tail = F.regexp_extract(after, r"(?s)^((?:[^.!?。！？]|[.](?=\S))*)", 1)
    return j.select("doc_id", "seq", norm_ws(F.concat(head, F.lit(" "), tail)).alias("claim"))


def chunks(blocks: DataFrame, most: int = 3500) -> DataFrame:
    """(doc_id, section_no, chunk_no, first_pos, n_blocks, n_chars): body blocks of each section packed in order into chunks of at most `most` characters.

    A block longer than that is a chunk of its own. Sections open at headings of level 2 or less. Sections are read in order from
    sorted partitions, a batch at a time; only the open chunk is held.
    """
    j = numbered_sections(blocks.where("not is_bibliography and length(text) > 0")).select("doc_id", "section_no", "pos", F.length("text").alias("n"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, chunk = None, None
        for rows in batches:
            out = []
            for doc, section, pos, n in rows.itertuples(index=False, name=None):
                if key != (doc, section):
                    if chunk:
                        out.append(chunk)
                    key, chunk = (doc, section), None
                if chunk and chunk[5] + n <= most:
                    chunk = (*chunk[:4], chunk[4] + 1, chunk[5] + n)
                else:
                    if chunk:
                        out.append(chunk)
                    chunk = (doc, section, chunk[2] + 1 if chunk else 1, pos, 1, n)
            yield pd.DataFrame(out, columns=["doc_id", "section_no", "chunk_no", "first_pos", "n_blocks", "n_chars"])
        yield pd.DataFrame([chunk] if chunk else [], columns=["doc_id", "section_no", "chunk_no", "first_pos", "n_blocks", "n_chars"])

    return j.repartition("doc_id", "section_no").sortWithinPartitions("doc_id", "section_no", "pos").mapInPandas(pack, "doc_id string, section_no int, chunk_no int, first_pos int, n_blocks int, n_chars bigint")


def proposals(findings: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, block_id, status, start, new_text): findings with a suggested fix as edits of their first block.

    An edit is ready if its quote stands exactly once in the block and no other finding edits the block; start counts code
    points from 0, new_text is the block with the quote replaced by the fix in brackets.
    """
    f = findings.dropDuplicates(["id"]).where("trim(suggested_fix) <> ''").select("id", "doc_id", F.try_element_at("block_ids", F.lit(1)).alias("block_id"), F.coalesce("verbatim_quote", F.lit("")).alias("quote"), "suggested_fix")
    owners = f.groupBy("doc_id", "block_id").agg(F.count("*").alias("owners"))
    b = blocks.dropDuplicates(["doc_id", "block_id"]).select("doc_id", "block_id", "text")
    j = f.join(b, ["doc_id", "block_id"], "left").join(owners, ["doc_id", "block_id"], "left")
    times = (F.length("text") - F.length(F.replace("text", F.col("quote"), F.lit("")))) / F.length("quote")
    status = F.when(F.col("text").isNull(), "unknown block").when(F.col("quote") == "", "no quote").when(times == 0, "stale").when(times > 1, "ambiguous").when(F.col("owners") > 1, "conflict").otherwise("ready")
    start = F.expr("instr(text, quote) - 1")
    new = F.concat(F.expr("substring(text, 1, instr(text, quote) - 1)"), F.lit("["), F.col("suggested_fix"), F.lit("]"), F.expr("substring(text, instr(text, quote) + length(quote))"))
    j = j.withColumn("status", status)
    return j.select("id", "block_id", "status", F.when(F.col("status") == "ready", start).alias("start"), F.when(F.col("status") == "ready", new).alias("new_text"))


def differences(edits: DataFrame, blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, n_added, n_removed): lines that a ready edit adds and removes in a unified line difference."""
    doc = findings.dropDuplicates(["id"]).select("id", "doc_id")
    b = blocks.dropDuplicates(["doc_id", "block_id"]).select("doc_id", "block_id", "text")
    j = edits.where("status = 'ready'").join(doc, "id").join(b, ["doc_id", "block_id"]).select("id", "text", "new_text")

    @F.pandas_udf("n_added int, n_removed int")
    def count(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for a, z in zip(old, new):
            lines = list(difflib.unified_diff(a.splitlines(), z.splitlines(), lineterm="", n=0))[2:]
            rows.append((sum(x.startswith("+") for x in lines), sum(x.startswith("-") for x in lines)))
        return pd.DataFrame(rows, columns=["n_added", "n_removed"])

    return j.select("id", count("text", "new_text").alias("c")).select("id", "c.*")


def tile_parts(df: DataFrame, size: int, others: str, all_: bool) -> tuple[dict[str, int], int]:
    """(parts by year, parts of all rows) of at most about size rows; years of one part are left out, rows without year are under others."""
    n = df.groupBy("year").count().select(F.when(F.col("year").isNull(), others).when(F.col("count") > size, F.col("year").cast("string")).alias("k"), "count")
    rows = {r["k"]: r["n"] for r in n.groupBy("k").agg(F.sum("count").alias("n")).collect()}  # no more rows than there are parts
    return {k: -(-v // size) for k, v in rows.items() if k is not None and v > size}, max(1, -(-sum(v for k, v in rows.items() if all_ or k != others) // size))


def best_titles(records: DataFrame, works: DataFrame, least: float = 0.84) -> DataFrame:
    """(rec_id, identifier, score): the work of most similar title of each record, if near enough.

    Similarity is the sequence matcher's ratio of normalised titles less 0.2 for another year; titles without letter or digit have
    none. No pair of a score of at least `least` is lost: where 0.2 less cannot reach it, works of another year are not looked at, and a
    title with an equal one of its year, which nothing can exceed, needs no other. The rest meet in tiles of titles and works. If u
    characters of both titles match nothing, their multisets of characters differ in at most u, those of pairs in at most 3u elements,
    and bits of counts differ in no more bits than the multisets in elements. Counts the rows of each year when it is called.
    """
    less = 0.2
    at_year = 1 - less < least
    r = records.dropDuplicates(["rec_id"]).select("rec_id", plain(F.col("title")).alias("ta"), F.col("year").alias("ya")).where("ta <> ''")
    w = works.dropDuplicates(["identifier"]).select("identifier", plain(F.col("title")).alias("tb"), F.col("year").alias("yb")).where("tb <> ''")
    w = w.groupBy("tb", "yb").agg(F.max("identifier").alias("identifier"))
    t = r.select("ta", "ya").distinct()
    same_year = F.col("ya").isNull() | F.col("yb").isNull() | (F.col("ya") == F.col("yb"))
    t = t.join(w.hint("merge"), F.col("ta") == F.col("tb"), "left").groupBy("ta", "ya").agg(F.max(F.when(same_year, F.col("identifier"))).alias("equal"))

    # works without year are listed under ?, all others under their year and, for records without year, under *
    nt, all_titles = tile_parts(records, TITLES, "*", True)
    nw, dated = tile_parts(works, WORKS, "?", False)
    nt, nw = (nt | {"?": all_titles}, nw | {"*": dated}) if at_year else ({"": all_titles}, {"": tile_parts(works, WORKS, "?", True)[1]})
    parts = lambda n, k: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in n.items() for x in kv]), k), F.lit(1))
    year = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    asked = F.array(year("ya", "*"), F.lit("?")) if at_year else F.array(F.lit(""))
    listed = F.when(F.col("yb").isNull(), F.array(F.lit("?"))).otherwise(F.array(year("yb", "?"), F.lit("*"))) if at_year else F.array(F.lit(""))
    k, settled = F.col("k"), F.col("equal").isNotNull()
    at = lambda c, n: F.pmod(F.xxhash64(c), parts(n, k)).cast("int")
    each = lambda n: F.sequence(F.lit(0), parts(n, k) - 1)
    titles = t.select("ta", "ya", "equal", F.explode(F.when(settled, F.slice(asked, 1, 1)).otherwise(asked)).alias("k"))
    titles = titles.select("ta", "ya", "equal", "k", at("ta", nt).alias("i"), F.explode(F.when(settled, F.array(F.lit(0))).otherwise(each(nw))).alias("j"))
    others = w.select("identifier", "tb", "yb", F.explode(listed).alias("k"))
    others = others.select("identifier", "tb", "yb", "k", F.explode(each(nt)).alias("i"), at("tb", nw).alias("j"))
    kinds = {f.name: f.dataType for f in [*r.schema, *w.schema]}
    schema = StructType([StructField("t", kinds["ta"]), StructField("y", kinds["ya"]), StructField("identifier", kinds["identifier"]), StructField("score", DoubleType())])

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        equal, rest = a.filter(pc.is_valid(a["equal"])), a.filter(pc.is_null(a["equal"]))
        found = []
        if len(rest) and len(b):
            columns = [x.to_pylist() for x in (rest["ta"], rest["ya"], b["tb"], b["yb"], b["identifier"])]
            found = Tile(*columns, least, less).best()
        x = rest.select(["ta", "ya"]).take(pa.array([i for i, _, _ in found], pa.int64()))
        near = [x["ta"], x["ya"], pa.chunked_array([pa.array([key for _, key, _ in found], a["equal"].type)]), pa.chunked_array([pa.array([s for _, _, s in found], pa.float64())])]
        sure = [equal["ta"], equal["ya"], equal["equal"], pa.chunked_array([pa.array([1.0] * len(equal), pa.float64())])]
        return pa.concat_tables([pa.table(c, names=schema.names) for c in (near, sure)])

    tile = ["k", "i", "j"]
    s = spread(titles, *tile).groupBy(tile).cogroup(spread(others, *tile).groupBy(tile)).applyInArrow(meet, schema)
    best = s.groupBy("t", "y").agg(F.max_by(F.struct("identifier", "score"), F.struct("score", "identifier")).alias("x"))
    return r.join(best.hint("merge"), (F.col("ta") == F.col("t")) & F.col("ya").eqNullSafe(F.col("y"))).select("rec_id", "x.identifier", F.round("x.score", 6).alias("score"))


def normal_texts(findings: DataFrame) -> DataFrame:
    """(id, normal): quotes in compatibility form, folded case, every run of other characters than letters and digits one blank."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            t = unicodedata.normalize("NFKC", t).casefold()
            return " ".join("".join(c if c.isalnum() else " " for c in t).split())

        return s.map(one)

    return findings.dropDuplicates(["id"]).select("id", normal("verbatim_quote").alias("normal"))


def supports(records: DataFrame, works: DataFrame) -> DataFrame:
    """(rec_id, identifier, overlap, status): how far a work's abstract holds the words of a record's title, works by equal title.

    status: uncertain without abstract; supported from 0.55 on, partly from 0.2 on, else unsupported.
    """
    r = records.dropDuplicates(["rec_id"]).select("rec_id", "title", plain(F.col("title")).alias("k")).where("k <> ''")
    w = works.dropDuplicates(["identifier"]).select("identifier", "abstract", plain(F.col("title")).alias("k"))
    claim = word_set(F.col("title"))
    j = r.join(w, "k").withColumn("overlap", F.round(F.size(F.array_intersect(claim, word_set(F.col("abstract")))) / F.size(claim), 6))
    status = F.when(F.col("abstract").isNull(), "uncertain").when(F.col("overlap") >= 0.55, "supported").when(F.col("overlap") >= 0.2, "partly").otherwise("unsupported")
    return j.select("rec_id", "identifier", "overlap", status.alias("status"))


def matched_labels(findings: DataFrame) -> DataFrame:
    """(doc_id, issue_type, anchor, n_gold, n_found, n_matched): gold and found findings matched one to one inside each (document, issue, first block).

    All pairs inside such a group are compatible, so the largest matching is the smaller count: no search is needed.
    """
    f = findings.dropDuplicates(["id"]).select("doc_id", "issue_type", F.array_min("block_ids").alias("anchor"), (F.col("source") == "deterministic").alias("gold"))
    g = f.groupBy("doc_id", "issue_type", "anchor").agg(F.count_if("gold").alias("n_gold"), F.count_if(~F.col("gold")).alias("n_found"))
    return g.withColumn("n_matched", F.least("n_gold", "n_found"))


def largest_matching(golds: list, founds: list) -> int:
    """Size of the largest one-to-one matching of gold and found findings, each given by its blocks, that share a block, by augmenting paths."""
    on: dict[str, list[int]] = {}
    for k, blocks in enumerate(founds):
        for b in set(blocks):
            on.setdefault(b, []).append(k)
    owner: dict[int, int] = {}
    spent: set[str] = set()  # blocks that no path leads on from
    for start in range(len(golds)):
        seen, queue, came, mate, end = set(), [start], {}, {}, None
        while queue and end is None:
            g = queue.pop()
            for b in golds[g]:
                if b in seen or b in spent:
                    continue
                seen.add(b)
                for k in on.get(b, ()):
                    if k in came:
                        continue
                    came[k] = g
                    if k not in owner:
                        end = k
                        break
                    mate[owner[k]] = k
                    queue.append(owner[k])
                if end is not None:
                    break
        if end is None:
            spent |= seen
        while end is not None:
            g = came[end]
            owner[end], end = g, mate.get(g) if g != start else None
    return len(owner)


def matched_gold(findings: DataFrame) -> DataFrame:
    """(doc_id, issue_type, n_gold, n_found, n_matched): the largest one-to-one matching of gold (deterministic) and found findings of a document and issue that share a block.

    A gold finding without blocks may be matched with any. The matching is searched in each class of findings connected by blocks;
    where a class has one gold or one found finding it is one.
    """
    f = findings.dropDuplicates(["id"]).select("id", "doc_id", "issue_type", F.array_distinct(F.coalesce("block_ids", F.array().cast("array<string>"))).alias("block_ids"), F.coalesce(F.col("source") == "deterministic", F.lit(False)).alias("gold"))
    placed = f.where("size(block_ids) > 0")
    spot = F.to_json(F.struct("doc_id", "issue_type", "block"))
    at = placed.select("id", "gold", "doc_id", "issue_type", F.explode("block_ids").alias("block")).select("id", "gold", spot.alias("spot"))
    both = at.groupBy("spot").agg(F.bool_or("gold").alias("g"), F.bool_or(~F.col("gold")).alias("n")).where("g and n").select("spot")
    at = written(at.join(both, "spot").select("id", "spot"), "spots")
    c = linked_classes(at.select("id").distinct(), at)
    c = written(placed.join(c, "id"), "placed")
    sizes = c.groupBy("class_id", "doc_id", "issue_type").agg(F.least(F.count_if("gold"), F.count_if(~F.col("gold"))).alias("low"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        n = largest_matching([set(b) for b in group.loc[group["gold"], "block_ids"]], [set(b) for b in group.loc[~group["gold"], "block_ids"]])
        return pd.DataFrame({"class_id": [group["class_id"].iloc[0]], "best": [n]})

    many = c.join(sizes.where("low > 1").select("class_id"), "class_id").groupBy("class_id").applyInPandas(search, "class_id string, best long")
    m = sizes.join(many, "class_id", "left").groupBy("doc_id", "issue_type").agg(F.sum(F.coalesce("best", "low")).alias("m")).select(F.col("doc_id").alias("d"), F.col("issue_type").alias("i"), "m")
    n = f.groupBy("doc_id", "issue_type").agg(F.count_if("gold").alias("n_gold"), F.count_if(~F.col("gold")).alias("n_found"), F.count_if(F.col("gold") & (F.size("block_ids") == 0)).alias("anywhere"))
    n = n.join(m, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("issue_type").eqNullSafe(F.col("i")), "left")
    return n.select("doc_id", "issue_type", "n_gold", "n_found", F.least("n_found", F.coalesce("m", F.lit(0)) + F.col("anywhere")).alias("n_matched"))


def matched_scores(findings: DataFrame) -> DataFrame:
    """(issue_type, tp, fp, fn, precision, recall, f1): found against gold findings by the largest matching, by issue type and in all (null)."""
    s = matched_gold(findings).rollup("issue_type").agg(F.sum("n_matched").alias("tp"), F.sum(F.col("n_found") - F.col("n_matched")).alias("fp"), F.sum(F.col("n_gold") - F.col("n_matched")).alias("fn"))
    return rated(s)


def distinct_words(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, words): the words of a block, each once, in order of first appearance."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1))
    return blocks.dropDuplicates(["doc_id", "block_id"]).select("doc_id", "block_id", F.array_join(words, " ").alias("words"))


def section_paths(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, path): the headings that a heading of level 1 to 3 stands under, itself last.

    Headings form a stack that a heading of level k cuts to k - 1 titles before its own is put on; those of reference lists stand
    under the stack and are not put on it. The depth of the n-th heading is the least of n and, over all headings m up to it,
    level(m) + n - m: a running minimum, so that no manuscript is held whole.
    """
    h = blocks.dropDuplicates(["doc_id", "block_id"]).where("kind = 'heading' and heading_level between 1 and 3").select("doc_id", "block_id", "pos", F.trim("text").alias("title"), "heading_level")
    h = h.withColumn("own", ~F.coalesce(F.col("title").rlike(BIBLIOGRAPHY), F.lit(False)))
    h = running_sum(h, "doc_id", "pos", F.col("own").cast("int"), "n")
    h = running_min(h, "doc_id", "pos", F.when(F.col("own"), F.col("heading_level") - F.col("n")), "least")
    h = h.withColumn("depth", F.col("n") + F.least(F.lit(0), F.coalesce("least", F.lit(0))))
    for k in (1, 2, 3):
        h = running_last(h, "doc_id", "pos", F.when(F.col("own") & (F.col("depth") == k), F.struct("pos", "title")), f"h{k}")
    above = lambda k: F.when(F.col("depth") > k, F.col(f"h{k}.title"))
    under = lambda k: F.when(F.col("depth") >= k, F.col(f"h{k}.title"))
    path = F.when(F.col("own"), F.concat_ws(" > ", above(1), above(2), "title")).otherwise(F.concat_ws(" > ", under(1), under(2), under(3), "title"))
    return h.select("doc_id", "block_id", path.alias("path"))


def author_tokens(records: DataFrame) -> DataFrame:
    """(rec_id, token): the last word of the first author's family part, before a comma if there is one."""
    first = F.try_element_at("authors", F.lit(1))
    family = F.when(F.contains(first, F.lit(",")), F.substring_index(first, ",", 1)).otherwise(first)
    words = F.regexp_extract_all(F.lower(family), F.lit(r"([\p{L}]+)"), 1)
    return records.dropDuplicates(["rec_id"]).where("size(authors) > 0").select("rec_id", F.try_element_at(words, F.lit(-1)).alias("token"))
