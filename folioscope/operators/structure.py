"""Headings, sections, captions, cross-references and terms of manuscripts, from `blocks` keyed by (doc_id, block_id).

Order is the column pos; repeated rows of a block count once. Running values over a document come from `running`, which never
holds a whole document in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import norm_ws, slug, word_set
from folioscope.operators.citations import counted_out
from folioscope.operators.running import running_last, running_sum

#: Headings of reference lists and of the sections every manuscript needs (fixed values).
BIBLIOGRAPHY = r"(?i)^(?:\d+[.\s]*)?(?:references?|bibliography|literature cited|参考文献|literatur(?:verzeichnis)?|références|bibliographie|referencias|bibliografía)\s*$"
REQUIRED = {
    "background": r"(?i)研究背景|背景|引言|绪论|introduction|einleitung", "related work": r"(?i)研究现状|文献综述|相关工作|related work|国内外|stand der forschung|travaux antérieurs",
    "methods": r"(?i)研究内容|研究方法|方法|主要内容|方案|method", "references": r"(?i)参考文献|references|références|literatur",
}
#: Signs of the chapters of Chinese manuscripts, from one to ten (fixed values).
CHAPTERS = "一二三四五六七八九十"
#: Captions and references to figures and tables (fixed values).
CAPTION = r"(?i)^\s*(图|表|figure|table|fig\.?|abbildung|tabelle|tableau)\s*(\d+(?:[-.]\d+)*)\s*[.、:：]?\s*(.*)$"
REFERENCE = r"(?i)(图|表|figure|table|fig\.|abbildung|tabelle|tableau)\s*(\d+(?:[-.]\d+)*)"
TABLES = ["表", "table", "tabelle", "tableau"]
#: Capital words that are no acronyms in need of a definition (fixed values).
NO_ACRONYMS = "AI AND OR OF THE IN ON AT TO FOR BY IS IT AS BE DO IF NO SO UP US WE AN FIG TAB EQ REF NOTE NOTES APPENDIX TABLE DOI URL HTML XML PDF ET AL IE EG VS GB ISO ASTM JIS EN DIN ASME IEEE ACI AWWA MW GW KW KWH MWH GWH KPA MPA KG KM".split()
ACRONYM = r"(?<![\p{L}\p{N}\p{M}_\-])([A-Z][A-Z0-9]{1,5}(?:\.[0-9]+)?)(?![A-Za-z0-9/])"


def blocks_of(blocks: DataFrame) -> DataFrame:
    return blocks.dropDuplicates(["doc_id", "block_id"])


def headings(blocks: DataFrame) -> DataFrame:
    return blocks_of(blocks).where("kind = 'heading' and text is not null").select("doc_id", "pos", "block_id", "text", "heading_level")


def normalised(blocks: DataFrame) -> DataFrame:
    return blocks_of(blocks).select("doc_id", "block_id", norm_ws(F.col("text")).alias("norm"), slug(F.col("text"), 40).alias("slug"))


def tokens(blocks: DataFrame) -> DataFrame:
    w = word_set(F.col("text"))
    return blocks_of(blocks).select("doc_id", "block_id", F.size(w).alias("n_tokens"), F.array_join(w, " ").alias("tokens"))


def statistics(blocks: DataFrame) -> DataFrame:
    """Counts of a manuscript: blocks, words (Latin words and Han characters), headings, tables, captions, entries."""
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([A-Za-z]+|[\x{4e00}-\x{9fff}])"), 1))
    kinds = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("heading", "table", "caption", "biblio_entry", "list_item")]
    return blocks_of(blocks).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(words).cast("bigint").alias("n_words"), *kinds)


def passages(documents: DataFrame) -> DataFrame:
    """(doc_id, passage_no, n_chars): documents cut at blank lines, places without text not counted."""
    d = documents.dropDuplicates(["doc_id"]).where("text is not null")
    p = F.filter(F.split("text", r"(?:\r?\n){2,}"), lambda x: F.length(F.trim(x)) > 0)
    return d.select("doc_id", F.posexplode(p).alias("p", "passage")).select("doc_id", (F.col("p") + 1).alias("passage_no"), F.length("passage").alias("n_chars"))


def heading_levels(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, level, numbering): level by a dotted number, by name, by capitals, else 0."""
    number = F.regexp_extract("text", r"^\s*(\d+(?:[.\-]\d+)*)[\s、.]+", 1)
    dots = F.length(number) - F.length(F.regexp_replace(number, r"[.\-]", ""))
    capitals = (F.length("text") <= 90) & F.col("text").rlike(r"[A-Z]{2}") & (F.upper("text") == F.col("text"))
    level = F.when(F.col("text").rlike(BIBLIOGRAPHY), 1).when(number != "", dots + 1).when(capitals, 1).otherwise(0)
    return headings(blocks).select("doc_id", "block_id", level.cast("int").alias("level"), number.alias("numbering"))


def heading_like(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id): short body blocks that read like headings: numbered or named, without final punctuation."""
    t = F.trim("text")
    named = F.col("text").rlike(BIBLIOGRAPHY)
    numbered = t.rlike(r"^\d+(?:\.\d+)*[\s、.]+\S") & ~t.rlike(r"[.。;；:：,，!?！？]$")
    return blocks_of(blocks).where(F.col("kind").isin("paragraph", "list_item") & (F.length("text") <= 180) & (named | numbered)).select("doc_id", "block_id")


def heading_numbers(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, pos, parent, n): the number of a numbered heading and that of its parent; a Chinese chapter's sign counts as one number."""
    number = F.replace(F.regexp_extract("text", r"^\s*(\d{1,18}(?:[.\-]\d{1,18})*)[\s、.]+", 1), F.lit("-"), F.lit("."))
    chapter = F.instr(F.lit(CHAPTERS), F.regexp_extract("text", rf"^\s*第([{CHAPTERS}])[章节部分]", 1))
    chapter = F.when(F.col("text").rlike(rf"^\s*第[{CHAPTERS}][章节部分]"), chapter.cast("string")).otherwise("")
    h = headings(blocks).withColumn("number", F.when(number != "", number).otherwise(chapter)).where("number <> ''")
    parts = F.split("number", r"\.")
    return h.select("doc_id", "block_id", "pos", F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".").alias("parent"), F.element_at(parts, -1).cast("bigint").alias("n"))


def heading_gaps(blocks: DataFrame) -> DataFrame:
    """(doc_id, parent, missing): numbers missing between the first and the highest heading number under one parent, in documents of three headings or more."""
    enough = headings(blocks).where("heading_level > 0 and trim(text) <> ''").groupBy("doc_id").agg(F.count("*").alias("k")).where("k >= 3").select("doc_id")
    h = heading_numbers(blocks)
    g = h.groupBy("doc_id", "parent").agg(F.min_by("n", "pos").alias("low"), F.max("n").alias("high"), F.count("*").alias("k")).where("k >= 2 and low < high").join(enough, "doc_id", "left_semi")
    all_ = counted_out(g.select("doc_id", "parent", "low", "high"))
    return all_.join(h.select("doc_id", "parent", F.col("n").alias("number")).distinct(), ["doc_id", "parent", "number"], "left_anti").withColumnRenamed("number", "missing")


def bibliography_region(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, in_region): whether the last heading of level 3 or less before a block opens a reference list; headings never are inside."""
    opens = F.when((F.col("kind") == "heading") & (F.col("heading_level") <= 3), F.coalesce(F.col("text").rlike(BIBLIOGRAPHY), F.lit(False)))
    b = running_last(blocks_of(blocks).select("doc_id", "block_id", "pos", "kind", "heading_level", "text"), "doc_id", "pos", opens, "open")
    return b.select("doc_id", "block_id", ((F.col("kind") != "heading") & F.coalesce("open", F.lit(False))).alias("in_region"))


def numbered_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with section_no, the number of headings of level 2 or less up to and with each."""
    cut = ((F.col("kind") == "heading") & (F.col("heading_level") <= 2)).cast("int")
    b = running_sum(blocks_of(blocks).select("doc_id", "block_id", "pos", "kind", "text", "heading_level", "is_bibliography"), "doc_id", "pos", F.coalesce(cut, F.lit(0)), "section_no")
    return b.withColumn("section_no", F.col("section_no").cast("int"))


def sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, section_no, first_pos, n_blocks, n_chars): stretches between headings of level 2 or less; 0 is what precedes the first."""
    return numbered_sections(blocks).groupBy("doc_id", "section_no").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_blocks"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))


def outline(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_headings, outline): headings in order, one a line, indented by level."""
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("heading_level") - 1, F.lit(0))), norm_ws(F.col("text")))
    h = headings(blocks).groupBy("doc_id").agg(F.count("*").alias("n_headings"), F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("a"))
    return h.select("doc_id", "n_headings", F.array_join(F.transform("a", lambda x: x.line), "\n").alias("outline"))


def required_sections(blocks: DataFrame) -> DataFrame:
    """(doc_id, missing): required sections that no heading of a document names; documents that lack none have no row."""
    h = blocks_of(blocks).groupBy("doc_id").agg(*[F.coalesce(F.bool_or((F.col("kind") == "heading") & F.col("text").rlike(p)), F.lit(False)).alias(n) for n, p in REQUIRED.items()])
    gone = F.concat_ws(",", *[F.when(~F.col(n), n) for n in REQUIRED])
    return h.select("doc_id", gone.alias("missing")).where("missing <> ''")


def captions(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, kind, label, described) of caption-like blocks."""
    word = F.lower(F.regexp_extract("text", CAPTION, 1))
    b = blocks_of(blocks).where(F.col("kind").isin("paragraph", "caption") & F.col("text").rlike(CAPTION))
    return b.select("doc_id", "block_id", F.when(word.isin(TABLES), "table").otherwise("figure").alias("kind"), F.replace(F.regexp_extract("text", CAPTION, 2), F.lit("."), F.lit("-")).alias("label"), (F.trim(F.regexp_extract("text", CAPTION, 3)) != "").alias("described"))


def references(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, kind, label, n): figure and table references in body texts, captions apart."""
    b = blocks_of(blocks).where("not is_bibliography and kind in ('paragraph', 'list_item', 'table')")
    words, labels = (F.regexp_extract_all("text", F.lit(REFERENCE), k) for k in (1, 2))
    r = b.select("doc_id", "block_id", F.explode(F.zip_with(words, labels, lambda w, x: F.struct(F.when(F.lower(w).isin(TABLES), "table").otherwise("figure").alias("kind"), F.replace(x, F.lit("."), F.lit("-")).alias("label")))).alias("r"))
    return r.groupBy("doc_id", "block_id", F.col("r.kind").alias("kind"), F.col("r.label").alias("label")).agg(F.count("*").alias("n"))


def broken_references(blocks: DataFrame) -> DataFrame:
    """(doc_id, kind, label, n_blocks): references to figures and tables that no described caption of the document defines."""
    known = captions(blocks).where("described").select("doc_id", "kind", "label").distinct()
    return references(blocks).join(known, ["doc_id", "kind", "label"], "left_anti").groupBy("doc_id", "kind", "label").agg(F.count_distinct("block_id").alias("n_blocks"))


def acronyms(blocks: DataFrame) -> DataFrame:
    """(doc_id, acronym, first_block, n_blocks): capital words of two to six signs in paragraphs, common ones apart."""
    b = blocks_of(blocks).where("kind = 'paragraph' and not is_bibliography")
    a = b.select("doc_id", "pos", "block_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(ACRONYM), 1))).alias("acronym")).where(~F.col("acronym").isin(NO_ACRONYMS))
    return a.groupBy("doc_id", "acronym").agg(F.min_by("block_id", "pos").alias("first_block"), F.count("*").alias("n_blocks"))


def undefined_acronyms(blocks: DataFrame) -> DataFrame:
    """Acronyms that no body block of their document spells out: in brackets, or before a bracket."""
    b = blocks_of(blocks).where("not is_bibliography and text is not null")
    spelt = F.flatten(F.array(F.regexp_extract_all("text", F.lit(r"[（(][^（）()]*?\b([A-Z][A-Z0-9]{1,5}(?:\.[0-9]+)?)\b[^（）()]*[）)]"), 1), F.regexp_extract_all("text", F.lit(r"\b([A-Z][A-Z0-9]{1,5}(?:\.[0-9]+)?)\s*[（(]\s*[\x{4e00}-\x{9fff}A-Za-z]"), 1)))
    known = b.select("doc_id", F.explode(spelt).alias("acronym")).distinct()
    return acronyms(blocks).join(known, ["doc_id", "acronym"], "left_anti")


#: What gives a writer away (fixed values).
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IDENTITY = r"(?i)(?:作者|姓名|单位|机构|邮箱|通讯作者|author|affiliation|institution|corresponding\s+author|laboratory|lab)\s*[:：]"


def identity_hints(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, email, label): blocks that give away who wrote them."""
    b = blocks_of(blocks).where(F.col("text").rlike(EMAIL) | F.col("text").rlike(IDENTITY))
    return b.select("doc_id", "block_id", F.col("text").rlike(EMAIL).alias("email"), F.col("text").rlike(IDENTITY).alias("label"))


def structure_findings(blocks: DataFrame) -> DataFrame:
    """(doc_id, issue, n): numbering gaps, missing sections, broken references and undefined acronyms of a document."""
    parts = [
        heading_gaps(blocks).select("doc_id", F.lit("numbering").alias("issue")),
        required_sections(blocks).select("doc_id", F.lit("section").alias("issue")),
        broken_references(blocks).select("doc_id", F.lit("reference").alias("issue")),
        undefined_acronyms(blocks).select("doc_id", F.lit("term").alias("issue")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("doc_id", "issue").agg(F.count("*").alias("n"))
