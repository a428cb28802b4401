"""Who wrote a manuscript, as its package still tells: properties, comments, tracked changes, hidden text, headers, links, file names.

Reading gives one row for each trace found in a file; what is a risk is decided by Spark over these rows.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators.structure import EMAIL, IDENTITY
from folioscope.session import written
from folioscope.sources.manuscripts import Unreadable, _kids, _local, _value, _xml

#: Names that programs leave, elements of tracked changes, of identities in TEI headers, and file names that tell (fixed values).
PROGRAMS = ["python-docx", "microsoft office", "anonymous", "unknown"]
CHANGES = ("ins", "del", "moveFrom", "moveTo", "rPrChange", "sectPrChange")
PEOPLE = ("author", "email", "affiliation", "orgName", "institution")
TELLING = r"(?i)(?:author|姓名|作者|user|用户|[A-Z][a-z]+_[A-Z][a-z]+)"
LOCAL_PATH = r"(?i)^(?:file:|\\\\|/|[cd]:\\)|%5c"
#: Longest text shown of a finding, and of a TEI header (fixed values).
SHOWN, SHOWN_TEI = 160, 300
TRACE = "doc_id string, trace string, part string, name string, value string"


def _said(e: ET.Element | None) -> str:
    return " ".join(x for x in e.itertext() if x).strip() if e is not None else ""


def package_traces(data: bytes) -> Iterator[tuple[str, str, str, str]]:
    """(trace, part, name, value) of a DOCX package; parts that are no XML are passed over."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        raise Unreadable("no package") from None
    for part in z.namelist():
        base = part.rpartition("/")[2]
        if part.startswith(("word/media/", "word/embeddings/", "word/oleObject")):
            yield "embedded", part, "", base
        if not part.endswith((".xml", ".rels")):
            continue
        try:
            root = _xml(z.read(part))
        except Unreadable:
            continue
        if part == "docProps/core.xml":
            yield from (("core", part, _local(e), _said(e)) for e in root if _local(e) in ("creator", "lastModifiedBy"))
        elif part == "docProps/app.xml":
            yield from (("company", part, "", _said(e)) for e in root if _local(e) == "Company")
        elif part == "docProps/custom.xml":
            yield from (("custom", part, _value(e, "name") or "custom property", _said(e)) for e in root)
        elif part.endswith(".rels"):
            yield from (("link", part, "", _value(e, "Target")) for e in root if _value(e, "TargetMode").casefold() == "external")
        elif part.startswith("word/"):
            if part == "word/comments.xml":
                yield from (("comment", part, "", _value(e, "author").strip()) for e in root if _local(e) == "comment")
            if part.startswith(("word/header", "word/footer")):
                yield "header", part, "", _said(root)
            yield from (("change", part, "", _value(e, "author").strip()) for e in _kids(root, *CHANGES))
            for run in _kids(root, "r"):
                look = next((e for e in run if _local(e) == "rPr"), None)
                if look is not None and any(_local(e) in ("vanish", "specVanish") for e in look):
                    yield "hidden", part, "", "".join(run.itertext()).strip()


def tei_traces(data: bytes) -> Iterator[tuple[str, str, str, str]]:
    head = next(_kids(_xml(data), "teiHeader"), None)
    if head is not None:
        yield from (("tei", "teiHeader", _local(e), " ".join(x.strip() for x in e.itertext() if x and x.strip())) for e in _kids(head, *PEOPLE))


def traces(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, trace, part, name, value): every trace in the DOCX and TEI files under a path or glob; unreadable files have one row `unreadable`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").rlike(r"\.(docx|xml|tei)$")).select("path", "content")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, data in zip(b["path"], b["content"]):
                doc, _, suffix = where.rpartition("/")[2].rpartition(".")
                try:
                    found = list(package_traces(bytes(data)) if suffix.lower() == "docx" else tei_traces(bytes(data)))
                except Unreadable as e:
                    found = [("unreadable", "", "", str(e)[:SHOWN])]
                yield pd.DataFrame([(doc, *x) for x in found], columns=["doc_id", "trace", "part", "name", "value"])

    return files.mapInPandas(read, TRACE)


def privacy_risks(found: DataFrame) -> DataFrame:
    """(doc_id, issue, severity, part, detail) of traces: one row for all names of a kind in a document, for each hidden part, header, link, property and file name that tells.

    Names that programs leave are none; a header tells if it holds a name of the core properties, an address or a label such as "author:".
    """
    t = written(found.where("trim(value) <> ''").withColumn("value", F.trim("value")), "traces")
    core = t.where((F.col("trace") == "core") & ~F.lower("value").isin(PROGRAMS))
    listed = lambda d, issue, by, shown: d.groupBy("doc_id", *by).agg(F.substring(F.array_join(F.array_sort(F.collect_set("value")), ", "), 1, shown).alias("detail")).select("doc_id", F.lit(issue).alias("issue"), F.lit("major").alias("severity"), F.col("part") if by else F.lit("").alias("part"), "detail")
    single = lambda d, issue, severity, detail: d.select("doc_id", F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), "part", F.substring(detail, 1, SHOWN).alias("detail"))
    names = core.where(F.length("value") >= 2).select("doc_id", F.lower("value").alias("known")).groupBy("doc_id").agg(F.collect_set("known").alias("known"))  # two a document at most
    header = t.where("trace = 'header'").join(names, "doc_id", "left")
    told = F.coalesce(F.exists("known", lambda k: F.contains(F.lower("value"), k)), F.lit(False)) | F.col("value").rlike(EMAIL) | F.col("value").rlike(IDENTITY)
    parts = [
        listed(core, "core properties", [], SHOWN), listed(t.where("trace = 'company'"), "company", [], SHOWN), listed(t.where("trace = 'comment'"), "comment authors", [], SHOWN), listed(t.where("trace = 'change'"), "tracked changes", [], SHOWN),
        listed(t.where("trace = 'hidden'"), "hidden text", ["part"], SHOWN), listed(t.where("trace = 'tei'"), "header identities", [], SHOWN_TEI),
        single(t.where("trace = 'custom'"), "custom property", "minor", F.concat_ws(": ", "name", "value")), single(header.where(told), "header or footer", "major", F.col("value")),
        single(t.where(F.col("trace") == "link").where(F.col("value").rlike(LOCAL_PATH)), "local path", "major", F.col("value")), single(t.where(F.col("trace") == "embedded").where(F.col("value").rlike(EMAIL) | F.col("value").rlike(TELLING)), "file name", "minor", F.col("value")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows
