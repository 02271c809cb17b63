"""Files made from rows, so that readers can be tried on whole tables: Word, workbook, RTF and PDF as bytes."""

from __future__ import annotations

import html
import io
import zipfile
import zlib

from ..operators.splitting import fold

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def _zipped(parts: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), text)
    return b.getvalue()


def docx_bytes(lines: list[str], styles: list[str | None]) -> bytes:
    """A paragraph a line, with the style of that name."""
    names = sorted({s for s in styles if s})
    p = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val=\"s{names.index(s)}\"/></w:pPr>' if s else ''}<w:r><w:t>{html.escape(t, quote=False)}</w:t></w:r></w:p>" for t, s in zip(lines, styles))
    named = "".join(f'<w:style w:styleId="s{i}"><w:name w:val="{html.escape(n)}"/></w:style>' for i, n in enumerate(names))
    return _zipped({"word/document.xml": f"<w:document {_W}><w:body>{p}</w:body></w:document>", "word/styles.xml": f"<w:styles {_W}>{named}</w:styles>"})


def xlsx_bytes(cells: list[tuple[int, str, int, int, str]]) -> bytes:
    """(sheet number, name, row, column, value); sheets go by their numbers."""
    sheets: dict[tuple[int, str], dict[int, list[tuple[int, str]]]] = {}
    for n, name, row, col, value in sorted(cells):
        sheets.setdefault((n, name), {}).setdefault(row, []).append((col, value))
    letter = lambda k: chr(64 + k) if k <= 26 else letter((k - 1) // 26) + chr(65 + (k - 1) % 26)
    parts, listed, rels = {}, "", ""
    for i, ((_, name), rows) in enumerate(sorted(sheets.items()), 1):
        body = "".join(f'<row r="{r}">' + "".join(f'<c r="{letter(c)}{r}" t="inlineStr"><is><t>{html.escape(v, quote=False)}</t></is></c>' for c, v in row) + "</row>" for r, row in sorted(rows.items()))
        parts[f"xl/worksheets/sheet{i}.xml"] = f"<worksheet {_M}><sheetData>{body}</sheetData></worksheet>"
        listed += f'<sheet name="{html.escape(name)}" sheetId="{i}" r:id="r{i}"/>'
        rels += f'<Relationship Id="r{i}" Target="worksheets/sheet{i}.xml"/>'
    return _zipped({"xl/workbook.xml": f"<workbook {_M} {_R}><sheets>{listed}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>", **parts})


class _Escapes(dict):
    """A character's place in Unicode -> how RTF writes it."""

    def __missing__(self, n: int) -> str:
        c = chr(n)
        self[n] = out = f"\\u{n if n < 32768 else n - 65536}?" if n > 126 else "\\" + c if c in "\\{}" else c
        return out


_ESCAPES = _Escapes()


def rtf_bytes(lines: list[str]) -> bytes:
    escaped = "\\par ".join(line.translate(_ESCAPES) for line in lines)
    return ("{\\rtf1\\ansi\\ansicpg936{\\fonttbl{\\f0 A;}}" + escaped + "}").encode("ascii")


def pdf_bytes(pages: list[list[tuple[str, float]]]) -> bytes:
    """Lines of (text, font size), page by page; text is written in the one font's codes, which a map gives back."""
    chars = sorted({c for page in pages for t, _ in page for c in t})
    code = {c: i for i, c in enumerate(chars, 1)}
    text = lambda c: c.encode("utf-16-be").hex()
    cmap = "1 begincodespacerange <0000> <ffff> endcodespacerange\n" + "".join(f"1 beginbfchar <{i:04x}> <{text(c)}> endbfchar\n" for c, i in code.items())
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(len(pages)))}] /Resources << /Font << /F 3 0 R >> >> >>", "<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>"]
    out = [o.encode() for o in objects] + [_stream(cmap.encode())]
    for i, page in enumerate(pages):
        body = "BT 50 800 Td 16 TL " + " ".join(f"/F {size:g} Tf <{''.join(f'{code[c]:04x}' for c in t)}> Tj T*" for t, size in page) + " ET"
        out += [f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>".encode(), _stream(body.encode())]
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(out, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF\n"


def _stream(data: bytes) -> bytes:
    z = zlib.compress(data)
    return b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(z), z)


def _pages(spans: list[dict]) -> bytes:
    """Of (page, seq, text, font_size), pages from 1."""
    pages: list[list[tuple[str, float]]] = [[] for _ in range(max(s["page"] for s in spans))]
    for s in sorted(spans, key=lambda s: (s["page"], s["seq"])):
        pages[s["page"] - 1].append((s["text"], s["font_size"]))
    return pdf_bytes(pages)


docx = fold(docx_bytes, "binary")
rtf = fold(rtf_bytes, "binary")
xlsx = fold(lambda cells: xlsx_bytes([(c["sheet_idx"], c["sheet_name"], c["row_idx"], c["col_idx"], c["value"]) for c in cells]), "binary")
pdf = fold(_pages, "binary")
