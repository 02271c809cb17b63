import base64
import io
import json
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.plans import api
from folioflow.plans import options as O
from folioflow.sources import files as S
from folioflow.sources import ole, pdf, rtf, xlsx

ARTICLE = b"".join(b"\\" + b"u%d?" % ord(c) for c in "第一条")
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def make_zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return b.getvalue()


def make_docx():
    def p(text, style=""):
        return f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'

    table = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>' + p("wide") + "</w:tc></w:tr><w:tr><w:tc>" + p("c1") + "</w:tc><w:tc>" + p("c2") + "</w:tc></w:tr></w:tbl>"
    body = p("Top", "H1") + p("Text of the top section, which is long enough to be no heading, and ends with a stop.") + p("Sub", "H2") + p("More text under the second level, which also ends with a full stop.") + table
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
    return make_zip({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles})


def make_xlsx():
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return make_zip({
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="法规" sheetId="1" r:id="a"/><sheet name="Second" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{m}"><si><t>法规名称</t></si><si><r><t>条</t></r><r><t>文</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="3"><c r="B3"><v>12.0</v></c><c r="C3"/></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{m}"><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>inline</t></is></c><c r="B1" t="b"><v>1</v></c></row></sheetData></worksheet>',
    })


def make_xlsx_rows(rows):
    m, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{"ABC"[j]}{i}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(row)) + "</row>" for i, row in enumerate(rows, 1))
    return make_zip({
        "xl/workbook.xml": f'<workbook xmlns="{m}" xmlns:r="{r}"><sheets><sheet name="S" sheetId="1" r:id="a"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{m}"><sheetData>{body}</sheetData></worksheet>',
    })


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    for sub, name, data in (("law", "a.docx", make_docx()), ("law", "b.xlsx", make_xlsx()), ("contract", "c.TXT", "第一条 甲方。\n第二条 乙方。".encode("gbk")), ("rule", "d.rtf", rb"{\rtf1\ansi\ansicpg936{\fonttbl{\f0 X;}}" + ARTICLE + rb" one\par two}"), ("others", "e.pdf", b"%PDF"), ("others", "f.zip", b"x"), ("law", "h.docx", b"broken")):
        (d / sub).mkdir(exist_ok=True)
        (d / sub / name).write_bytes(data)
    return str(d)


def test_listing_validation_and_routes(spark, folder):
    rows = {r.name: r for r in S.validated(S.read_files(spark, folder)).collect()}
    assert rows["c.TXT"].format == "txt" and rows["b.xlsx"].route == "excel" and rows["b.xlsx"].file_type == "excel" and rows["a.docx"].dir == "law"
    none = S.read_files(spark, folder).limit(1).withColumn("length", F.lit(0).cast("bigint"))
    assert S.validated(none).first().error == "empty file"
    assert rows["f.zip"].error == "unsupported format: zip" and rows["a.docx"].error is None


def test_text_and_errors(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in S.extract_text(S.read_files(spark, folder), {"pdf": lambda data: "from pdf"}).collect()}
    assert rows["a.docx"].text.split("\n")[0] == "Top" and "c1 | c2" in rows["a.docx"].text
    assert rows["c.TXT"].text.startswith("第一条") and rows["d.rtf"].text == "第一条 one\ntwo" and rows["e.pdf"].text == "from pdf"
    assert rows["b.xlsx"].text.startswith("【工作表: 法规】\n法规名称 | 条文\n12")
    assert rows["h.docx"].text is None and "BadZipFile" in rows["h.docx"].error


def test_word_elements_and_document_chunks(spark, folder):
    files = S.read_files(spark, folder).where("name = 'a.docx'")
    e = S.docx_elements(files).orderBy("seq").collect()
    assert [(r.text[:4], r.is_heading, r.level) for r in e][:3] == [("Top", True, 1), ("Text", False, 0), ("Sub", True, 2)]
    assert [(r.type, r.table_info.row_index, r.table_info.cell_index, r.table_info.is_merged) for r in e][-3:] == [("table_cell", 0, 0, True), ("table_cell", 1, 0, False), ("table_cell", 1, 1, False)]
    chunks = api.split_document(files).collect()
    assert len(chunks) == 1 and chunks[0].content.startswith("Sub")
    both = api.split_document(files, O.Options(strategy="all_levels")).orderBy("chunk_id").collect()
    assert [c.content.split("\n")[0] for c in both] == ["Top", "Sub"]
    strict = api.split_document(files, O.Options(max_tokens=30, overlap=0, strict_max_tokens=True)).collect()
    assert len(strict) > 1
    assert api.flatten_sections(api.split_sections(files)).first().content.startswith("Top > Sub\n\n")


def test_cells(spark, folder):
    got = sorted(tuple(r)[1:-1] for r in S.xlsx_cells(S.read_files(spark, folder)).collect())
    assert got == [(1, "法规", 1, 1, "法规名称"), (1, "法规", 1, 3, "条文"), (1, "法规", 3, 2, "12"), (2, "Second", 1, 1, "inline"), (2, "Second", 1, 2, "True")]
    assert xlsx.column_number("AB3") == 28


def test_simple_chunk_file(spark, folder):
    rows = api.simple_chunk_file(S.read_files(spark, folder).where("format = 'txt'")).collect()
    assert [(r.source_file, r.file_type, r.total_chunks) for r in rows] == [("c.TXT", "txt", 1)]


def test_rtf():
    assert rtf.parse(rb"{\rtf1\ansicpg936 \'b5\'da\'d2\'bb\'cc\'f5}") == "第一条"
    assert rtf.parse(rb"{\rtf1 a\{b\}\~c\tab d{\*\x hidden}{\pict 00ff}}") == "a{b} c d"
    assert rtf.parse(rb"{\rtf1\uc2\u-10179??\u-8704??}") == "\U0001f600"
    long = rb"{\rtf1\ansicpg936 " + (ARTICLE + rb" text of the article goes here \par ") * 4 + b"}"
    assert rtf.extract(long).startswith("第一条")
    s = rtf.sections("某某管理办法\n\n第一条 甲甲甲甲甲甲甲甲甲。\n\n第二条 乙乙乙乙乙乙乙乙乙。")
    assert [x["heading"] for x in s] == ["某某管理办法", "第一条", "第二条"]
    assert [x["heading"] for x in rtf.sections("某某条例\n正文在这里")] == ["某某条例", ""]


def test_pages(spark):
    p = spark.createDataFrame([(1, 1, "x" * 60), (1, 2, "b"), (2, 4, "y" * 60), (3, 1, " ")], "doc_id int, page int, text string")
    assert S.pdf_page_text(p).where("doc_id = 1").first().text == "--- 第1页 ---\n" + "x" * 60 + "\n\n--- 第2页 ---\nb"
    assert {r.doc_id: r.digital for r in S.digital_pdf(p).collect()} == {1: True, 3: False}


def test_options(tmp_path, monkeypatch):
    f = tmp_path / "c.json"
    f.write_text(json.dumps({"document": {"max_tokens": 900, "overlap": 9, "unknown": 1}, "llm": {"enabled": True}}))
    monkeypatch.setenv("FOLIOFLOW_OVERLAP", "11")
    monkeypatch.setenv("FOLIOFLOW_MAX_TOKENS", "none")
    monkeypatch.setenv("FOLIOFLOW_STRICT_MAX_TOKENS", "yes")
    o, m = O.load(str(f))
    assert (o.max_tokens, o.overlap, o.strict_max_tokens, m.enabled) == (900, 11, True, True)
    assert O.load(str(f), overlap=5)[0].overlap == 5
    O.save(o, str(tmp_path / "d.json"))
    assert O.load(str(tmp_path / "d.json"))[0] == o
    assert O.for_domain("contract", "service").max_tokens == 1800 and O.for_domain("contract", "service", max_tokens=700).max_tokens == 700
    assert O.for_domain("regulation", "operation").strategy == "all_levels" and O.for_domain("legal").legal
    with pytest.raises(ValueError):
        O.Options(max_tokens=10, overlap=10)
    assert O.known(lambda a, b: 0, {"a": 1, "c": 2}) == {"a": 1}


def test_introspection_and_registry(spark, folder):
    assert {"docx", "pdf", "xlsx", "wps"} <= set(api.supported_formats()) and not api.capabilities()["pdf"]["needs_converter"] and api.dependencies()["pyspark"]
    api.register("zip", lambda files: files.select("path", F.lit(0).alias("seq"), F.lit("第一章").alias("text"), F.lit(False).alias("is_heading"), F.lit(0).alias("level")))
    try:
        got = api.split_document(S.read_files(spark, folder).where("format = 'zip'")).collect()
        assert [c.content for c in got] == ["第一章"]
    finally:
        api.SPLITTERS.clear()
    api.register("docx", lambda files: files.select("path", F.lit(0).alias("seq"), F.lit("mine").alias("text"), F.lit(False).alias("is_heading"), F.lit(0).alias("level")))
    try:
        got = api.split_document(S.read_files(spark, folder).where("format = 'docx'")).collect()
        assert [(c.content, c.error) for c in got] == [("mine", None)] * 2  # in place of the built-in one, which would fail on one of them
    finally:
        api.SPLITTERS.clear()


def make_pdf(pages, outline=(), encode=zlib.compress, filters="/FlateDecode"):
    """Pages are lists of (text, size)."""
    n = 3 + 2 * len(pages)
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    objects = {1: f"<< /Type /Catalog /Pages 2 0 R /Outlines {n} 0 R >>".encode(), 2: f"<< /Type /Pages /Kids [{kids}] /Resources << /Font << /F1 << /Type /Font /Subtype /Type1 >> /F2 << /Subtype /Type0 /ToUnicode {n + 20} 0 R >> >> >> >>".encode()}
    for i, lines in enumerate(pages):
        show = lambda t: f"({t}) Tj" if t.isascii() else "<" + "".join(f"{k:04x}" for k in range(1, len(t) + 1)) + "> Tj"
        body = "BT 50 700 Td 14 TL " + " ".join(f"/{'F1' if t.isascii() else 'F2'} {s} Tf {show(t)} T*" for t, s in lines) + " ET"
        z = encode(body.encode())
        objects[3 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>".encode()
        objects[4 + 2 * i] = f"<< /Length {len(z)} /Filter {filters} >>\nstream\n".encode() + z + b"\nendstream"
    objects[n] = f"<< /Type /Outlines /First {n + 1} 0 R >>".encode()
    for k, (title, page) in enumerate(outline):
        after = f"/Next {n + 2 + k} 0 R" if k + 1 < len(outline) else ""
        objects[n + 1 + k] = f"<< /Title ({title}) /Dest [{3 + 2 * page} 0 R /XYZ 0 0 0] {after} >>".encode()
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfrange <0001> <0002> <7b2c> endbfrange 1 beginbfchar <0002> <4e00> endbfchar"
    objects[n + 20] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(cmap), cmap)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % kv for kv in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pdf():
    body = [[("Chapter \\(one\\) \\101", 20), ("Body text here.", 10)], [], [("\u7b2c\u4e00", 10)]]
    for encode, filters in ((zlib.compress, "/FlateDecode"), (lambda b: base64.a85encode(b) + b"~>", "[/ASCII85Decode]"), (lambda b: b.hex().encode() + b">", "/ASCIIHexDecode")):
        got = pdf.spans(make_pdf(body, encode=encode, filters=filters))
        assert got == [(1, 0, "Chapter (one) A", 20.0), (1, 1, "Body text here.", 10.0), (2, 2, None, None), (3, 3, "\u7b2c\u4e00", 10.0)]
    assert pdf.outline(make_pdf(body, [("One", 0), ("Two", 2)])) == [(0, 1, "One", 1), (1, 1, "Two", 3)]
    for bad in (b"", b"%PDF-1.4 nothing", b"no"):
        with pytest.raises(ValueError):
            pdf.spans(bad)


def test_pdf_objects_in_streams():
    inner = {5: b"<< /Type /Catalog /Pages 6 0 R >>", 6: b"<< /Type /Pages /Kids [7 0 R] >>", 7: b"<< /Type /Page /Contents 8 0 R >>"}
    head, at = b"", 0
    for k, v in inner.items():
        head += b"%d %d " % (k, at)
        at += len(v) + 1
    rows = head + b" ".join(inner.values())
    z = zlib.compress(rows)
    body = b"BT /F 12 Tf 10 10 Td [(Sp) -10 (lit) -300 (words)] TJ 0 -14 Td (next) ' ET"
    data = b"%%PDF-1.5\n4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\n8 0 obj\n<< /Length 9 0 R >>\nstream\n%s\nendstream\nendobj\n9 0 obj %d endobj" % (len(head), len(z), z, body, len(body))
    assert [t for _, _, t, _ in pdf.spans(data)] == ["Split words", "next"]


def make_ole(parts):
    """A compound file; streams are padded to 4096 bytes and more, so that none is small."""
    fat, sectors, entries = [], [], []

    def put(body):
        first = len(sectors)
        n = max(1, -(-len(body) // 512))
        sectors.extend(body[512 * i : 512 * (i + 1)].ljust(512, b"\0") for i in range(n))
        fat.extend([*range(first + 1, first + n), 0xFFFFFFFE])
        return first

    def entry(name, kind, start, size):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HB", len(raw), kind) + bytes(49) + struct.pack("<IQ", start, size)

    for name, body in parts.items():
        body = body.ljust(4096, b"\0")
        entries.append(entry(name, 2, put(body), len(body)))
    directory = put(b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *entries]))
    place = len(sectors)
    fat.append(0xFFFFFFFD)
    sectors.append(struct.pack(f"<{len(fat)}I", *fat).ljust(512, b"\xff"))
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, 1, directory, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0) + struct.pack("<109I", place, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


def make_doc():
    """Two pieces, one of bytes and one of two-byte characters, with a field and a table row."""
    one, two = b"Plain text\rwith a \x13LINK x\x14shown\x15 part\r", "\u7b2c\u4e00\u6761 a\x07b\x07\x07"
    doc = bytearray(2048)
    struct.pack_into("<H", doc, 10, 0x200)
    struct.pack_into("<I", doc, 0x4C, len(one) + len(two))
    doc[1024 : 1024 + len(one)] = one
    doc[1536 : 1536 + 2 * len(two)] = two.encode("utf-16-le")
    pieces = struct.pack("<3I", 0, len(one), len(one) + len(two)) + struct.pack("<HIH", 0, 0x40000000 | 2048, 0) + struct.pack("<HIH", 0, 1536, 0)
    clx = b"\x01\x02\x00ab" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    struct.pack_into("<II", doc, 0x1A2, 0, len(clx))
    return make_ole({"WordDocument": bytes(doc), "1Table": clx})


def make_xls():
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    text = lambda s: struct.pack("<HB", len(s), 1) + s.encode("utf-16-le")
    sst = struct.pack("<II", 2, 2) + text("\u6cd5\u89c4") + struct.pack("<HB", 6, 0) + b"abc"  # goes on in the next record, in two-byte characters
    sheet = record(0x809, bytes(16)) + record(0xFD, struct.pack("<HHHI", 0, 0, 0, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 0, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 0, 2.5)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, 12 << 2 | 2)) + record(0xBD, struct.pack("<HHHIHIH", 2, 0, 0, 150 << 2 | 3, 0, 7 << 2 | 2, 1)) + record(0x06, struct.pack("<HHH", 3, 0, 0) + b"\0\0\0\0\0\0\xff\xff" + bytes(8)) + record(0x207, text("made")) + record(0x205, struct.pack("<HHHBB", 4, 0, 0, 1, 0)) + record(0x0A, b"")
    front = record(0x809, bytes(16)) + record(0xFC, sst) + record(0x3C, b"\1" + "d\u00e9f".encode("utf-16-le"))
    bound = lambda at: record(0x85, struct.pack("<IBBBB", at, 0, 0, 2, 0) + b"S1")
    start = len(front) + len(bound(0)) + len(record(0x0A, b""))
    return make_ole({"Workbook": front + bound(start) + record(0x0A, b"") + sheet})


def test_compound_files():
    assert ole.word_text(make_doc()) == "Plain text\nwith a shown part\n\u7b2c\u4e00\u6761 a | b"
    assert ole.workbook_cells(make_xls()) == [(1, "S1", 1, 1, "\u6cd5\u89c4"), (1, "S1", 1, 2, "abcd\u00e9f"), (1, "S1", 2, 1, "2.5"), (1, "S1", 2, 2, "12"), (1, "S1", 3, 1, "1.5"), (1, "S1", 3, 2, "7"), (1, "S1", 4, 1, "made"), (1, "S1", 5, 1, "True")]
    assert S.legacy_text(b"{\\rtf1 abc}") == "abc" and S.legacy_text(b"<p>a &amp; b</p><p>c</p>").split("\n") == ["a & b", "c"] and S.legacy_text("\u7b2c\u4e00\u6761".encode("gbk")) == "\u7b2c\u4e00\u6761"
    with pytest.raises(ValueError):
        S.legacy_text(b"\0\1\2\0")


def test_mixed_folder_with_broken_files(spark, tmp_path):
    law = make_xlsx_rows([["\u6cd5\u89c4\u540d\u79f0", "\u6761\u6587\u5185\u5bb9"], *[["\u67d0\u529e\u6cd5", f"\u7b2c{n}\u6761 \u5185\u5bb9\u3002"] for n in "\u4e00\u4e8c\u4e09"]])
    every = {"law/a.docx": make_docx(), "law/b.xlsx": law, "law/c.doc": make_doc(), "contract/d.wps": make_docx(), "contract/e.pdf": make_pdf([[("Terms", 24), ("All of the text stands in here, and it ends with a stop.", 10)]]), "contract/f.xls": make_xls(), "rule/g.txt": b"some text", "law/bad.docx": b"broken", "contract/bad.xlsx": b"PK\x03\x04", "rule/bad.pdf": b"no", "rule/none.txt": b""}
    for name, data in every.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = S.read_files(spark, str(tmp_path))
    out = {}
    for r in api.split_document(files).collect():
        out.setdefault(r.doc_id.rsplit("/", 1)[1], []).append((r.content, r.error))
    assert set(out) == {n.split("/")[1] for n in every} - {"none.txt"}  # Spark does not list empty files
    for name, rows in out.items():
        assert all((error is None) == (content is not None) for content, error in rows)
        assert (rows[0][1] is not None) == name.startswith("bad"), name
    assert "All of the text" in out["e.pdf"][0][0] and any("2.5" in c for c, _ in out["f.xls"])
    tree = {r.heading: r.error for r in api.split_sections(files).collect()}
    assert "Terms" in tree and sum(e is not None for e in tree.values()) >= 1
    chunks = api.split_directory(files)
    rows = chunks.collect()
    assert {r.domain for r in rows} == {"legal", "contract", "regulation"}
    assert [r.content for r in sorted((r for r in rows if r.doc_id.endswith("b.xlsx")), key=lambda r: r.chunk_id)] == [f"\u7b2c{n}\u6761\n\u7b2c{n}\u6761 \u5185\u5bb9\u3002" for n in "\u4e00\u4e8c\u4e09"]
    counters = {r["dir"]: (r["files"], r["success"], r["failed"]) for r in api.directory_counters(chunks).collect()}
    assert counters["law"] == (4, 3, 1) and counters["contract"] == (4, 3, 1) and counters["rule"] == (2, 1, 1) and counters[None] == (10, 7, 3)
    simple = {r.source_file: r.error for r in api.simple_chunk_file(files).collect()}
    assert simple["bad.docx"] and simple["g.txt"] is None


def test_token_counter(spark):
    import tiktoken

    from folioflow.functions import text as X
    from folioflow.functions import tokens

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    d = spark.createDataFrame([("Some words, and more of them.",), ("",), (None,)], "t string")
    got = [r[0] for r in d.select(X.count_tokens(F.col("t"), tokens.counter(path))).collect()]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    e = tiktoken.Encoding("x", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == [len(e.encode_ordinary("Some words, and more of them.")), 0, None]
    with pytest.raises(ValueError):
        X.count_tokens(F.col("t"), "tiktoken")


def test_word_file_that_is_no_whole_xml():
    from folioflow.sources import docx

    data = make_zip({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First &amp; only</w:t></w:r></w:p><w:p><w:r><w:t>cut"})
    assert docx.direct_text(data) == "First & only\ncut"
    assert [e[1] for e in docx.elements(data)] == ["First & only", "cut"]


def test_sinks_and_stream(spark, tmp_path):
    from folioflow.operators import splitting as C
    from folioflow.streaming import files as FS

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    chunks = C.pack_sentences(docs, 500, 50)
    for fmt in ("parquet", "json", "text"):
        api.write_chunks(chunks, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == chunks.count()
    src = tmp_path / "in"
    docs.repartition(3).write.parquet(str(src))
    q = FS.write_stream(FS.chunk_stream(FS.read_documents(spark, str(src), docs.schema, 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("length")
    assert got.exceptAll(chunks).count() == 0 and got.count() == chunks.count()


def test_converters(spark, folder):
    def to_docx(data):
        if data != b"%PDF":
            raise ValueError("no")
        return make_docx()

    c = S.converted(S.read_files(spark, folder).where("format in ('pdf', 'zip', 'txt')"), {"pdf": ("docx", to_docx), "zip": ("docx", to_docx)})
    got = {r.path.rsplit("/", 1)[1]: r for r in c.collect()}
    assert got["e.pdf"].format == "docx" and got["e.pdf"].metadata["original_format"] == "pdf" and got["f.zip"].error == "ValueError: no" and got["c.TXT"].metadata is None
    assert api.split_document(c.where("format = 'docx'")).count() == 1


def test_rtf_sections(spark):
    d = spark.createDataFrame([(1, "某某办法 第一条 甲甲甲甲甲甲甲甲甲。 第二条 乙乙乙乙乙乙乙乙乙。"), (2, None)], "doc_id int, text string")
    assert [r.heading for r in S.rtf_sections(d).orderBy("seq").collect()] == ["某某办法", "第一条", "第二条"]
