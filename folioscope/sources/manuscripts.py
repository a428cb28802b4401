"""Manuscript files as blocks: DOCX and TEI, read from binary files, one row a block.

Files are opened with the standard library inside tasks, one file at a time. What can't be read becomes a row of errors, never
an exception: unknown suffixes, broken packages, entity declarations, parts above the size limit.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import written

BLOCK = "doc_id string, pos int, block_id string, kind string, text string, section_path array<string>, style_name string, heading_level int, is_bibliography boolean, cell_rows array<array<string>>, page int, bbox array<double>"
ERROR = "error string"
#: A part of a package or a TEI file above so many bytes is not parsed.
LIMIT = 100 << 20
BIBLIOGRAPHY = re.compile(r"^\s*(?:references?|bibliography|参考文献|literatur(?:verzeichnis)?|références)\s*$", re.IGNORECASE)


class Unreadable(ValueError):
    """What a file's error row says."""


def _xml(data: bytes) -> ET.Element:
    if len(data) > LIMIT:
        raise Unreadable("too large")
    if b"<!DOCTYPE" in data[:4096].upper() or b"<!ENTITY" in data.upper():
        raise Unreadable("entity declarations are not read")
    try:
        return ET.fromstring(data)
    except ET.ParseError as e:
        raise Unreadable(f"no XML: {e}") from None


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _kids(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (x for x in e.iter() if _local(x) in names)


def _value(e: ET.Element | None, name: str = "val") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), "") if e is not None else ""


class Blocks:
    """The rows of one manuscript in reading order; keeps the section stack and whether a reference list is open."""

    def __init__(self, doc_id: str) -> None:
        self.doc_id, self.rows, self.stack, self.open, self.counts = doc_id, [], [], False, {}

    def add(self, kind: str, text: str, prefix: str = "p", level: int = 0, style: str | None = None, cells=None, page=None, bbox=None, listed: bool = False) -> None:
        text = re.sub(r"\s+", " ", text).strip()
        if not text and not cells:
            return
        if kind == "heading":
            named = bool(BIBLIOGRAPHY.match(text))
            if level <= 3:
                self.open = named
                if not named:
                    self.stack = [*self.stack[: max(0, level - 1)], text]
        elif self.open and kind == "paragraph":
            kind = "biblio_entry"
        n = self.counts[prefix] = self.counts.get(prefix, 0) + 1
        inside = (self.open or listed) and kind != "heading"
        self.rows.append((self.doc_id, len(self.rows) + 1, f"{prefix}_{n:04d}", kind, text, list(self.stack), style, level, inside, cells, page, bbox))


def docx_blocks(doc_id: str, data: bytes) -> list[tuple]:
    """Blocks of a DOCX package: headings by outline level or style, tables with their cells, then footnotes and endnotes."""
    try:
        package = zipfile.ZipFile(io.BytesIO(data))
        body = _xml(package.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError) as e:
        raise Unreadable(f"no DOCX package: {e}") from None
    styles: dict[str, tuple[str, int, str]] = {}
    if "word/styles.xml" in package.namelist():
        for s in _kids(_xml(package.read("word/styles.xml")), "style"):
            part = {_local(x): x for x in s.iter()}
            outline = _value(part.get("outlineLvl"))
            styles[_value(s, "styleId")] = (_value(part.get("name")), int(outline) + 1 if outline.isdigit() else 0, _value(part.get("basedOn")))

    def level_of(style: str) -> int:
        seen: set[str] = set()
        while style and style not in seen:
            seen.add(style)
            name, outline, base = styles.get(style, (style, 0, ""))
            named = re.match(r"(?:heading|titre|überschrift|标题)\s*(\d)", name, re.IGNORECASE)
            if outline or named:
                return outline or int(named.group(1))
            style = base
        return 0

    def text_of(e: ET.Element) -> str:
        return "".join(x.text or "" if _local(x) == "t" else " " for x in e.iter() if _local(x) in ("t", "tab", "br"))

    out = Blocks(doc_id)
    top = next(_kids(body, "body"), None)
    for e in top if top is not None else []:
        if _local(e) == "p":
            style = _value(next(_kids(e, "pStyle"), None))
            outline = _value(next(_kids(e, "outlineLvl"), None))
            level = int(outline) + 1 if outline.isdigit() else level_of(style)
            text = text_of(e)
            name = styles.get(style, (style or None,))[0]
            caption = re.match(r"^\s*(?:figure|table|fig\.|图|表)\s*\d", text, re.IGNORECASE)
            kind = "heading" if level or BIBLIOGRAPHY.match(text) else "list_item" if next(_kids(e, "numPr"), None) is not None else "caption" if caption and len(text) < 300 else "paragraph"
            out.add(kind, text, level=level or (1 if kind == "heading" else 0), style=name)
        elif _local(e) == "tbl":
            cells = [[re.sub(r"\s+", " ", text_of(c)).strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            out.add("table", " ".join(c for r in cells for c in r), prefix="t", cells=cells)
    for part, note, prefix in (("word/footnotes.xml", "footnote", "fo"), ("word/endnotes.xml", "endnote", "en")):
        if part in package.namelist():
            out.open = False
            for e in _kids(_xml(package.read(part)), note):
                if not _value(e, "type") and not _value(e, "id").startswith("-"):
                    out.add("paragraph", text_of(e), prefix=prefix)
    return out.rows


def _place(coords: str) -> tuple[int | None, list[float] | None]:
    for part in coords.split(";"):
        v = part.split(",")
        try:
            page, (x, y, w, h) = int(v[0]), map(float, v[1:5])
            return page, [x, y, x + w, y + h]
        except (ValueError, IndexError):
            continue
    return None, None


def tei_blocks(doc_id: str, data: bytes) -> list[tuple]:
    """Blocks of a TEI text: heads, paragraphs, figures and tables in order, then the numbered reference list."""
    root, out = _xml(data), Blocks(doc_id)

    def visit(e: ET.Element, depth: int) -> None:
        for x in e:
            name, (page, bbox) = _local(x), _place(_value(x, "coords"))
            text = " ".join("".join(x.itertext()).split())
            if name == "head":
                number = _value(x, "n")
                out.add("heading", f"{number} {text}".strip(), level=min(9, number.rstrip(".").count(".") + 1 if number else max(1, depth)), page=page, bbox=bbox)
            elif name in ("p", "item"):
                out.add("paragraph" if name == "p" else "list_item", text, page=page, bbox=bbox)
            elif name == "table":
                cells = [[" ".join("".join(c.itertext()).split()) for c in r if _local(c) == "cell"] for r in x if _local(r) == "row"]
                out.add("table", " ".join(c for r in cells for c in r), prefix="t", cells=cells, page=page, bbox=bbox)
            elif name == "figure":
                tables = [t for t in x if _local(t) == "table"]
                label = " ".join(" ".join("".join(c.itertext()).split()) for c in x if _local(c) in ("head", "figDesc"))
                out.add("caption", label, page=page, bbox=bbox)
                for t in tables:
                    visit(_wrap(t), depth)
            elif name not in ("listBibl", "teiHeader"):
                visit(x, depth + (name == "div"))

    text = next(_kids(root, "text"), None)
    for part in text if text is not None else []:
        visit(part, 0)
    for k, b in enumerate(_kids(root, "biblStruct"), 1):
        raw = " ".join("".join(b.itertext()).split())
        out.add("biblio_entry", raw if raw.startswith("[") else f"[{k}] {raw}", prefix="r", listed=True)
    return out.rows


def _wrap(e: ET.Element) -> ET.Element:
    w = ET.Element("div")
    w.append(e)
    return w


READERS = {".docx": docx_blocks, ".xml": tei_blocks, ".tei": tei_blocks}


def read_manuscripts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of all files under a path or glob; doc_id is the file's name without suffix. errors has (doc_id, path, error)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in BLOCK.split(", ")]
        for b in batches:
            for where, data in zip(b["path"], b["content"]):
                name = where.rpartition("/")[2]
                doc_id, dot, suffix = name.rpartition(".")
                try:
                    reader = READERS.get(dot + suffix.lower())
                    if reader is None:
                        raise Unreadable("unknown suffix")
                    rows = [(*r, None, where) for r in reader(doc_id, bytes(data))]
                except Unreadable as e:
                    rows = [(doc_id or name, *[None] * 11, str(e)[:300], where)]
                yield pd.DataFrame(rows, columns=[*names, "error", "path"]).astype({"pos": "Int32", "heading_level": "Int32", "page": "Int32"})

    rows = written(files.mapInPandas(parse, f"{BLOCK}, {ERROR}, path string"), "manuscripts")  # every file is parsed once for both
    return rows.where("error is null").drop("error", "path"), rows.where("error is not null").select("doc_id", "path", "error")


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """(locator, passage_no, passage): text files under a path, cut at blank lines."""
    t = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_name").alias("file"))
    p = t.select("file", F.posexplode(F.filter(F.split("value", r"(?:\r?\n){2,}"), lambda x: F.length(F.trim(x)) > 0)).alias("p", "passage"))
    return p.select(F.concat("file", F.lit("#p"), (F.col("p") + 1).cast("string")).alias("locator"), (F.col("p") + 1).alias("passage_no"), F.trim("passage").alias("passage"))


FINDING = "id string, issue_type string, severity string, confidence double, block_ids array<string>, verbatim_quote string, rationale string, checklist_id string, suggested_fix string, broken string"


def read_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(findings, dead letters) of JSON lines written by reviewers; reviewer_id is what stands between the first two dots of the file's name."""
    rows = spark.read.schema(FINDING).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("recursiveFileLookup", "true").json(path)
    rows = rows.withColumn("reviewer_id", F.regexp_extract(F.col("_metadata.file_name"), r"^[^.]+\.([^.]+)\.", 1))
    reason = F.when(F.col("broken").isNotNull(), "no JSON object").when(F.coalesce(F.trim("id"), F.lit("")) == "", "no id").when(F.coalesce(F.size("block_ids"), F.lit(0)) < 1, "no block").when(~F.coalesce(F.col("severity").isin("major", "minor", "nit"), F.lit(False)), "unknown severity")
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("broken", "reason"), rows.where("reason is not null").select("reviewer_id", "id", "reason", "broken")
