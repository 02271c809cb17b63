"""Word files by the standard library: body elements in order, tables expanded in place."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == _W + "t":
            out.append(x.text or "")
        elif x.tag == _W + "tab":
            out.append("\t")
        elif x.tag in (_W + "br", _W + "cr"):
            out.append("\n")
    return "".join(out)


def _parts(data: bytes) -> tuple[ET.Element, dict[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        xml = z.read("word/document.xml")
        try:
            body = ET.fromstring(xml).find(_W + "body")
        except ET.ParseError:
            body = _mended(xml)
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).iter(_W + "style"):
                name = s.find(_W + "name")
                if name is not None:
                    names[s.get(_W + "styleId", "")] = name.get(_W + "val", "")
    return body, names


def _mended(xml: bytes) -> ET.Element:
    """A body of what can be read of a document that is no whole XML: the texts between paragraph ends, without styles."""
    body = ET.Element(_W + "body")
    for part in re.split(r"</w:p>", xml.decode("utf-8", "replace")):
        text = "".join(html.unescape(t) for t in re.findall(r"<w:t(?:\s[^>]*)?>([^<]*)", part))
        if text:
            ET.SubElement(ET.SubElement(ET.SubElement(body, _W + "p"), _W + "r"), _W + "t").text = text
    if not len(body):
        raise ValueError("no text in word/document.xml")
    return body


def _rows(table: ET.Element) -> Iterator[tuple[int, list[tuple[int, str, bool]]]]:
    """(row, [(cell, text, merged)]); what continues a vertical merge is left out."""
    for i, row in enumerate(table.findall(_W + "tr")):
        cells, j = [], 0
        for c in row.findall(_W + "tc"):
            pr = c.find(_W + "tcPr")
            span = pr.find(_W + "gridSpan") if pr is not None else None
            merge = pr.find(_W + "vMerge") if pr is not None else None
            wide = int(span.get(_W + "val", "1")) if span is not None else 1
            if merge is None or merge.get(_W + "val") == "restart":
                cells.append((j, "\n".join(_text(p) for p in c.iter(_W + "p")), wide > 1 or merge is not None))
            j += wide
        yield i, cells


def elements(data: bytes) -> list[tuple]:
    """(seq, text, style, type, row_index, cell_index, is_merged)"""
    body, names = _parts(data)
    out: list[tuple] = []
    for node in body if body is not None else ():
        if node.tag == _W + "p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(_W + "val", "") if style is not None else ""
            out.append((len(out), _text(node), names.get(key, key) or None, "paragraph", None, None, None))
        elif node.tag == _W + "tbl":
            for i, cells in _rows(node):
                for j, text, merged in cells:
                    if text.strip():
                        out.append((len(out), text, None, "table_cell", i, j, merged))
    return out


def direct_text(data: bytes) -> str:
    """Paragraphs, then tables with cells joined by " | "."""
    body, _ = _parts(data)
    if body is None:
        return ""
    lines = [t for p in body.findall(_W + "p") if (t := _text(p).strip())]
    for table in body.findall(_W + "tbl"):
        for _, cells in _rows(table):
            if row := " | ".join(t.strip() for _, t, _ in cells if t.strip()):
                lines.append(row)
    return "\n".join(lines)
