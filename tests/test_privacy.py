import io
import zipfile

from folioscope.sources.privacy import privacy_risks, traces

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
CORE = '<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:creator>{}</dc:creator><cp:lastModifiedBy>{}</cp:lastModifiedBy></cp:coreProperties>'


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_risks(spark, tmp_path):
    (tmp_path / "open.docx").write_bytes(
        package(**{
            "docProps__core_dot_xml": CORE.format("Rosa Abel", "python-docx"), "docProps__app_dot_xml": "<Properties><Company>Lab Ltd</Company></Properties>", "docProps__custom_dot_xml": '<Properties><property name="Path">x</property><property name="Blank"> </property></Properties>',
            "word__comments_dot_xml": f'<w:comments {W}><w:comment w:author="Ann"/><w:comment w:author="Bob"/><w:comment w:author="Ann"/></w:comments>', "word__document_dot_xml": f'<w:document {W}><w:body><w:p><w:ins w:author="Cy"/><w:r><w:rPr><w:vanish/></w:rPr><w:t>secret</w:t></w:r><w:r><w:t>seen</w:t></w:r></w:p></w:body></w:document>',
            "word__header1_dot_xml": f"<w:hdr {W}><w:t>draft of rosa abel</w:t></w:hdr>", "word__footer1_dot_xml": f"<w:ftr {W}><w:t>page 1</w:t></w:ftr>", "word___rels__document_dot_xml_dot_rels": r'<R><Relationship Target="file:C:\Users\rosa" TargetMode="External"/><Relationship Target="https://x.org" TargetMode="External"/></R>',
            "word__media__Rosa_Abel_dot_png": "x", "word__media__image1_dot_png": "x", "word__broken_dot_xml": "<x",
        })
    )
    (tmp_path / "clean.docx").write_bytes(package(**{"docProps__core_dot_xml": CORE.format("python-docx", " "), "word__document_dot_xml": f"<w:document {W}/>"}))
    (tmp_path / "head.xml").write_text("<TEI><teiHeader><author>Dee <x>Fox</x></author><title>t</title></teiHeader><text><author>not this</author></text></TEI>")
    (tmp_path / "bad.docx").write_bytes(b"no")
    found = traces(spark, str(tmp_path))
    assert [r.doc_id for r in found.where("trace = 'unreadable'").collect()] == ["bad"]
    got = sorted((r.doc_id, r.issue, r.severity, r.detail) for r in privacy_risks(found).collect() if r.doc_id != "bad")
    assert got == [
        ("head", "header identities", "major", "Dee Fox"), ("open", "comment authors", "major", "Ann, Bob"), ("open", "company", "major", "Lab Ltd"), ("open", "core properties", "major", "Rosa Abel"), ("open", "custom property", "minor", "Path: x"),
        ("open", "file name", "minor", "Rosa_Abel.png"), ("open", "header or footer", "major", "draft of rosa abel"), ("open", "hidden text", "major", "secret"), ("open", "local path", "major", r"file:C:\Users\rosa"), ("open", "tracked changes", "major", "Cy"),
    ]


def test_nothing(spark):
    assert privacy_risks(spark.createDataFrame([], "doc_id string, trace string, part string, name string, value string")).count() == 0
