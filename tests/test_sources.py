import datetime as dt
import io
import json
import os
import zipfile

from folioscope.sources.manuscripts import read_findings, read_manuscripts, read_passages
from folioscope.sources.reports import json_rows, markdown, write_split
from folioscope.streaming import logs
from tests.test_operators import FI, finding

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return out.getvalue()


def p(text, style="", extra=""):
    mark = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{mark}{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


STYLES = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Mine"><w:name w:val="Mine"/><w:basedOn w:val="H1"/></w:style></w:styles>'
NOTES = f'<w:footnotes {W}><w:footnote w:id="-1" w:type="separator"><w:p/></w:footnote><w:footnote w:id="1">{p("A note")}</w:footnote></w:footnotes>'
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><p>skip</p></teiHeader><text><body><div><head n="1" coords="1,10,50,200,30">Intro</head><p coords="1,10,90,200,30">Text <ref>[1]</ref> here</p>
<figure><head>Table 1</head><table><row><cell>a</cell><cell>b</cell></row></table></figure></div></body><back><listBibl><biblStruct><title>T</title></biblStruct></listBibl></back></text></TEI>"""


def test_manuscripts(spark, tmp_path):
    table = "<w:tbl><w:tr><w:tc>" + p("n") + "</w:tc><w:tc>" + p("1") + "</w:tc></w:tr></w:tbl>"
    (tmp_path / "one.docx").write_bytes(docx(p("Start", "Mine") + p("Body text") + p("Sub", extra='<w:outlineLvl w:val="1"/>') + table + p("") + p("References") + p("[1] Entry"), styles=STYLES, footnotes=NOTES))
    (tmp_path / "two.XML").write_text(TEI)
    (tmp_path / "bad.docx").write_bytes(b"no package")
    (tmp_path / "evil.xml").write_text('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')
    (tmp_path / "other.txt").write_text("x")
    blocks, errors = read_manuscripts(spark, str(tmp_path))
    got = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.doc_id, r.pos)):
        got.setdefault(r.doc_id, []).append((r.block_id, r.kind, r.text, r.heading_level, r.is_bibliography))
    assert got["one"] == [
        ("p_0001", "heading", "Start", 1, False), ("p_0002", "paragraph", "Body text", 0, False), ("p_0003", "heading", "Sub", 2, False), ("t_0001", "table", "n 1", 0, False), ("p_0004", "heading", "References", 1, False),
        ("p_0005", "biblio_entry", "[1] Entry", 0, True), ("fo_0001", "paragraph", "A note", 0, False),
    ]
    assert [x[1:3] for x in got["two"]] == [("heading", "1 Intro"), ("paragraph", "Text [1] here"), ("caption", "Table 1"), ("table", "a b"), ("biblio_entry", "[1] T")]
    first = blocks.where("doc_id = 'two' and pos = 1").first()
    assert (first.page, first.bbox) == (1, [10.0, 50.0, 210.0, 80.0])
    assert {r.doc_id for r in errors.collect()} == {"bad", "evil", "other"}


def test_passages_and_findings(spark, tmp_path):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "a.txt").write_text("one\ntwo\n\n\nthree\r\n\r\n")
    assert sorted((r.locator, r.passage) for r in read_passages(spark, str(tmp_path / "texts")).collect()) == [("a.txt#p1", "one\ntwo"), ("a.txt#p2", "three")]
    (tmp_path / "rows").mkdir()
    good = {"id": "F1", "severity": "major", "block_ids": ["p1"], "confidence": 0.5}
    (tmp_path / "rows" / "findings.rev-1.json").write_text("\n".join([json.dumps(good), "{broken", json.dumps(good | {"id": " "}), json.dumps(good | {"severity": "huge"}), json.dumps(good | {"block_ids": []})]))
    ok, dead = read_findings(spark, str(tmp_path / "rows"))
    assert [(r.id, r.reviewer_id) for r in ok.collect()] == [("F1", "rev-1")] and sorted(r.reason for r in dead.collect()) == ["no JSON object", "no block", "no id", "unknown severity"]


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([finding(1, sev="nit"), finding(2, sev="major", blocks=("p1", "p2")), finding(3, doc="e", gate=None, why=None, quote=None, blocks=None), finding(1, sev="nit")], FI)
    r = {x.doc_id: x.report for x in markdown(f).collect()}
    assert r["d"] == "# d\n\n- **major** clarity (p1, p2): why\n- **nit** clarity (p1): why" and r["e"].startswith("# e\n\n- **minor**")
    assert json.loads(json_rows(f).where("doc_id = 'd'").first().value)["issue_type"] == "clarity"
    write_split(f, str(tmp_path / "out"))
    assert {x.gate_passed for x in spark.read.parquet(str(tmp_path / "out")).collect()} == {"true", "false"}


def test_streams(spark, tmp_path):
    t = lambda m: dt.datetime(2026, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    batches = [[(1, t(1), 7, "a", 1.0, ""), (2, t(50), 7, "b", 2.0, "")], [(2, t(50), 7, "b", 2.0, ""), (3, t(300), 8, "a", 3.0, "")], [(6, t(310), 9, "a", 1.0, "")], [(4, t(2), 7, "a", 9.0, ""), (5, t(600), 8, "c", 4.0, "")]]
    folder = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, logs.EVENTS).coalesce(1).write.parquet(str(folder / f"b{i}"))
    files = sorted(folder.glob("b*/*.parquet"))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, f in enumerate(files):
        (flat / f"{i}.parquet").write_bytes(f.read_bytes())
        os.utime(flat / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))  # the order of a file stream
    stream = logs.read_events(spark, str(flat))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name).collect()

    hours = {(r.start.hour, r.event_type): (r.n, r.total) for r in run(logs.windowed(stream), "append", "hours")}
    assert hours[0, "a"] == (1, 1.0) and hours[0, "b"][0] in (1, 2)  # the row that came ten hours late is left out
    assert sorted(r.event_id for r in run(logs.once(stream), "append", "once") if r.event_id != 4) == [1, 2, 3, 5, 6]
    last = {}
    for r in run(logs.running_last(stream), "update", "last"):
        last[r.user_id] = (r.event_type, r.value, r.n)
    assert last == {7: ("b", 2.0, 4), 8: ("c", 4.0, 2), 9: ("a", 1.0, 1)}
    q = logs.keep_last(stream, str(tmp_path / "table"), str(tmp_path / "keep"))
    q.processAllAvailable()
    q.stop()
    assert {r.user_id: r.event_type for r in spark.read.parquet(str(tmp_path / "table")).collect()} == {7: "b", 8: "c", 9: "a"}
