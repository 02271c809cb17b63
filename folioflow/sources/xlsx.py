"""Workbooks by the standard library: every non-empty cell as text."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

_M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]*", ref).group():
        n = n * 26 + ord(ch) - 64
    return n


def _number(v: str) -> str:
    try:
        f = float(v)
    except ValueError:
        return v
    return str(int(f)) if f.is_integer() and abs(f) < 1e15 else repr(f)


def cells(data: bytes) -> list[tuple[int, str, int, int, str]]:
    """(sheet_idx from 1, sheet_name, row, column, value)"""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(_M + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_M + "si")]
        rels = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for k, sheet in enumerate(ET.fromstring(z.read("xl/workbook.xml")).iter(_M + "sheet"), 1):
            target = rels.get(sheet.get(_R), "")
            path = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
            if path not in names:
                continue
            for i, row in enumerate(ET.fromstring(z.read(path)).iter(_M + "row"), 1):
                r = int(row.get("r", i))
                for j, c in enumerate(row.findall(_M + "c"), 1):
                    kind, v = c.get("t", "n"), c.find(_M + "v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(_M + "t"))
                    elif v is None or v.text is None:
                        continue
                    elif kind == "s":
                        value = shared[int(v.text)]
                    elif kind == "b":
                        value = "True" if v.text == "1" else "False"
                    else:
                        value = _number(v.text) if kind == "n" else v.text
                    out.append((k, sheet.get("name", ""), r, column_number(c.get("r", "")) or j, value))
    return out


def plain_text(data: bytes, cells=cells) -> str:
    """Rows as lines, sheets under their names; ``cells`` reads the workbook."""
    sheets: dict[tuple[int, str], dict[int, list[str]]] = {}
    for k, name, r, _, v in cells(data):
        if v.strip():
            sheets.setdefault((k, name), {}).setdefault(r, []).append(v.strip())
    return "\n\n".join(f"【工作表: {name}】\n" + "\n".join(" | ".join(vs) for _, vs in sorted(rows.items())) for (_, name), rows in sorted(sheets.items()))
