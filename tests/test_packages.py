"""Package rules and extraction on files made here."""

from __future__ import annotations

import io
import zipfile

from wordloom.sources.packages import audit_packages, extract_docx

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
P = "<w:p>{style}<w:r><w:t>{text}</w:t></w:r></w:p>"


def package(body="", types="<Types/>", skip=(), extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in (("[Content_Types].xml", types), ("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>"), *extra):
            if name not in skip:
                z.writestr(name, data)
    return out.getvalue()


def test_verdicts_and_elements(spark):
    heading = P.format(style='<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>', text="Head")
    cell = "<w:tc>" + P.format(style="", text="a") + P.format(style="", text="b") + "</w:tc>"
    lower = '<w:tc><w:tcPr><w:vMerge/></w:tcPr>' + P.format(style="", text="twice") + "</w:tc>"
    body = heading + P.format(style="", text=" ") + f"<w:tbl><w:tr>{cell}</w:tr><w:tr>{lower}</w:tr></w:tbl>" + P.format(style="", text="End")
    files = {
        "ok.docx": package(body), "x.pdf": b"x", "empty.docx": b"", "null.docx": None, "big.docx": b"PK" * (6 << 20), "nozip.docx": b"hello", "cut.docx": package(body)[:60],
        "notypes.docx": package(skip=("[Content_Types].xml",)), "nodoc.docx": package(skip=("word/document.xml",)), "locked.docx": package(extra=[("EncryptedPackage", "x")]),
        "entity.docx": package(types="<!DOCTYPE x><Types/>"), "types.docx": package(types="<Types encrypted='package'/>"),
    }
    df = spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in files.items()], "path string, content binary")
    got = {r["path"]: r["code"] for r in audit_packages(df).collect()}
    assert got == {
        "ok.docx": "OK", "x.pdf": "DOC-001", "empty.docx": "DOC-002", "null.docx": "DOC-002", "big.docx": "DOC-005", "nozip.docx": "DOC-002", "cut.docx": "DOC-002", "notypes.docx": "DOC-003",
        "nodoc.docx": "DOC-003", "locked.docx": "DOC-004", "entity.docx": "DOC-003", "types.docx": "DOC-004",
    }
    rows = extract_docx(df).where("path = 'ok.docx'").orderBy("order").collect()
    assert [r["text"] for r in rows] == ["Head", "a", "b", "End"] and rows[0]["style"].endswith(":Heading1") and rows[2]["style"] == "table_paragraph_order:2:2:0:0:0:1"


def test_headers_and_footers(spark):
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sect = "<w:sectPr>{refs}</w:sectPr>"
    ref = '<w:{kind}Reference w:type="{variant}" r:id="{id}"/>'
    one = sect.format(refs=ref.format(kind="header", variant="default", id="rId1") + ref.format(kind="footer", variant="default", id="rId2"))
    two = sect.format(refs=ref.format(kind="header", variant="first", id="rId3") + ref.format(kind="header", variant="even", id="rId9"))
    body = P.format(style="", text="First") + f"<w:p><w:pPr>{one}</w:pPr></w:p>" + '<w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>Second</w:t></w:r></w:p>' + two
    part = lambda inner, kind: f"<w:{kind} {NS}>{inner}</w:{kind}>"
    links = "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in (("rId1", "header1.xml"), ("rId2", "/word/footer1.xml"), ("rId3", "header2.xml"), ("rId9", "gone.xml")))
    content = package(extra=[
        ("word/_rels/document.xml.rels", f"<Relationships>{links}</Relationships>"), ("word/styles.xml", f'<w:styles {NS}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>'),
        ("word/header1.xml", part(P.format(style="", text="Top") + P.format(style="", text=" ") + "<w:p><w:r><w:drawing/></w:r></w:p>", "hdr")),
        ("word/header2.xml", part("<w:sdt>" + P.format(style="", text="") + "</w:sdt>", "hdr")), ("word/footer1.xml", part(P.format(style="", text="Bottom"), "ftr")),
    ], skip=("word/document.xml",))
    out = io.BytesIO(content)
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("word/document.xml", f"<w:document {NS} {rel}><w:body>{body}</w:body></w:document>")
    df = spark.createDataFrame([("a.docx", bytearray(out.getvalue()))], "path string, content binary")
    got = [(r["order"], r["style"], r["text"]) for r in extract_docx(df).orderBy("order").collect()]
    assert got == [
        (0, "header_footer_order:0:0:header:0:default:0:rId1", "Top"), (1, "header_footer_order:1:1:header:0:default:2:rId1", ""), (2, "header_footer_order:2:2:header:1:first:0:rId3", ""),
        (3, "body_block_order:3:0:0:Normal", "First"), (4, "body_block_order:4:2:2:heading 1", "Second"), (5, "header_footer_order:5:6:footer:0:default:0:rId2", "Bottom"),
    ]
