"""Compound files (doc, wps, xls) by the standard library: streams, Word text by its piece table, workbook cells by records."""

from __future__ import annotations

import re
import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFA  # sector numbers from here on are marks


def streams(data: bytes) -> dict[str, bytes]:
    """The streams of a compound file by their lower-cased names."""
    if data[:8] != MAGIC:
        raise ValueError("not a compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    directory, _, cutoff, mini_start = struct.unpack_from("<4I", data, 48)
    more = struct.unpack_from("<I", data, 68)[0]
    size = 1 << shift
    sector = lambda n: data[(n + 1) << shift : (n + 2) << shift]
    fats = [n for n in struct.unpack_from("<109I", data, 76) if n < _END]
    seen = set()
    while more < _END and more not in seen:
        seen.add(more)
        *part, more = struct.unpack(f"<{size // 4}I", sector(more).ljust(size, b"\xff"))
        fats += [n for n in part if n < _END]
    fat = [v for n in fats for v in struct.unpack(f"<{size // 4}I", sector(n).ljust(size, b"\xff"))]

    def chain(n: int, table: list[int]) -> list[int]:
        out, seen = [], set()
        while n < len(table) and n not in seen:
            seen.add(n)
            out.append(n)
            n = table[n]
        return out

    whole = lambda n: b"".join(map(sector, chain(n, fat)))
    entries = whole(directory)
    mini_table = whole(mini_start) if mini_start < _END else b""
    mini_fat = list(struct.unpack(f"<{len(mini_table) // 4}I", mini_table))
    out: dict[str, bytes] = {}
    root = b""
    for at in range(0, len(entries) - 127, 128):
        n, kind = struct.unpack_from("<H", entries, at + 64)[0], entries[at + 66]
        start, length = struct.unpack_from("<IQ", entries, at + 116)
        length &= 0xFFFFFFFF
        name = entries[at : at + max(0, min(n, 64) - 2)].decode("utf-16-le", "replace").lower()
        if kind == 5:
            root = whole(start)
        elif kind == 2:
            if length < cutoff:
                body = b"".join(root[k << mini_shift : (k + 1) << mini_shift] for k in chain(start, mini_fat))
            else:
                body = whole(start)
            out.setdefault(name, body[:length])
    return out


def word_text(data: bytes) -> str:
    """The main text of a Word file of 1997 or later: paragraphs as lines, table cells parted by " | "."""
    parts = streams(data)
    doc = parts.get("worddocument")
    if doc is None:
        raise ValueError("no Word text")
    flags = struct.unpack_from("<H", doc, 10)[0]
    if flags & 0x100:
        raise ValueError("the file is encrypted")
    table = parts.get("1table" if flags & 0x200 else "0table", b"")
    length = struct.unpack_from("<I", doc, 0x4C)[0]
    at, size = struct.unpack_from("<II", doc, 0x1A2)
    clx, i = table[at : at + size], 0
    while i < len(clx) and clx[i] == 1:
        i += 3 + struct.unpack_from("<H", clx, i + 1)[0]
    if i >= len(clx) or clx[i] != 2:
        raise ValueError("no piece table")
    n = (struct.unpack_from("<I", clx, i + 1)[0] - 4) // 12
    place = struct.unpack_from(f"<{n + 1}I", clx, i + 5)
    out = []
    for k in range(n):
        fc = struct.unpack_from("<I", clx, i + 5 + 4 * (n + 1) + 8 * k + 2)[0]
        chars = min(place[k + 1], length) - place[k]
        if chars <= 0:
            break
        start = fc & 0x3FFFFFFF
        out.append(doc[start // 2 : start // 2 + chars].decode("cp1252", "replace") if fc & 0x40000000 else doc[start : start + 2 * chars].decode("utf-16-le", "replace"))
    text = "".join(out)
    text = re.sub("\x13[^\x13\x14\x15]*\x14([^\x13\x15]*)\x15|\x13[^\x13\x15]*\x15", lambda m: m.group(1) or "", text)
    text = re.sub("\x07{2,}", "\n", text).replace("\x07", " | ")
    text = re.sub("[\r\x0b\x0c]", "\n", text)
    return re.sub("[\x00-\x08\x0e-\x1f]", "", text).strip()


class _Strings:
    """Reads strings that may go on in continued records, where the width of characters is told again."""

    def __init__(self, parts: list[bytes]):
        self.parts, self.at = parts, 0

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n and self.parts:
            got = self.parts[0][self.at : self.at + n - len(out)]
            out += got
            self.at += len(got)
            if self.at >= len(self.parts[0]) and len(out) < n:
                self.parts.pop(0)
                self.at = 0
        return out

    def string(self, sized: str = "<H") -> str:
        n = struct.unpack(sized, self.take(struct.calcsize(sized)))[0]
        flags = self.take(1)[0]
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out, wide = "", flags & 1
        while n and self.parts:
            left = len(self.parts[0]) - self.at
            if left <= 0:
                self.parts.pop(0)
                self.at = 0
                if self.parts:
                    wide = self.take(1)[0] & 1
                continue
            k = min(n, left // 2 if wide else left)
            if not k:
                raise ValueError("a character is cut")
            out += self.take(2 * k if wide else k).decode("utf-16-le" if wide else "latin-1", "replace")
            n -= k
        self.take(4 * runs + extra)
        return out


def _packed(v: int) -> float:
    x = float(struct.unpack("<i", struct.pack("<I", v))[0] >> 2) if v & 2 else struct.unpack("<d", b"\0\0\0\0" + struct.pack("<I", v & 0xFFFFFFFC))[0]
    return x / 100 if v & 1 else x


def _number(f: float) -> str:
    return str(int(f)) if f.is_integer() and abs(f) < 1e15 else repr(f)


def workbook_cells(data: bytes) -> list[tuple[int, str, int, int, str]]:
    """(sheet_idx from 1, sheet_name, row, column, value) of a workbook of 1997 to 2003."""
    parts = streams(data)
    book = parts.get("workbook")
    if book is None:
        raise ValueError("no workbook of 1997 or later")
    records: list[tuple[int, int, bytes]] = []
    at = 0
    while at + 4 <= len(book):
        kind, size = struct.unpack_from("<HH", book, at)
        records.append((at, kind, book[at + 4 : at + 4 + size]))
        at += 4 + size
    shared: list[str] = []
    sheets: list[tuple[int, str]] = []
    for i, (_, kind, body) in enumerate(records):
        if kind == 0x2F:
            raise ValueError("the file is encrypted")
        if kind == 0x85 and len(body) > 7 and body[5] == 0:
            sheets.append((struct.unpack_from("<I", body)[0], _Strings([body[6:]]).string("<B")))
        elif kind == 0xFC:
            more = [body[8:]]
            for _, k, b in records[i + 1 :]:
                if k != 0x3C:
                    break
                more.append(b)
            reader = _Strings(more)
            shared = [reader.string() for _ in range(struct.unpack_from("<I", body, 4)[0])]
    starts = {place: (k, name) for k, (place, name) in enumerate(sheets, 1)}
    out: list[tuple[int, str, int, int, str]] = []
    sheet, waiting = None, None
    for place, kind, body in records:
        if kind == 0x809:
            sheet = starts.get(place, sheet)
        elif kind == 0x0A:
            sheet = None
        if sheet is None:
            continue
        found: list[tuple[int, int, str]] = []
        if kind == 0x207 and waiting:
            found = [(*waiting, _Strings([body]).string())]
            waiting = None
        elif kind in (0xFD, 0x203, 0x27E, 0x204, 0x205, 0x06):
            r, c = struct.unpack_from("<HH", body)
            if kind == 0xFD:
                found = [(r, c, shared[struct.unpack_from("<I", body, 6)[0]])]
            elif kind == 0x203:
                found = [(r, c, _number(struct.unpack_from("<d", body, 6)[0]))]
            elif kind == 0x27E:
                found = [(r, c, _number(_packed(struct.unpack_from("<I", body, 6)[0])))]
            elif kind == 0x204:
                found = [(r, c, _Strings([body[6:]]).string())]
            elif kind == 0x205 and not body[7]:
                found = [(r, c, "True" if body[6] else "False")]
            elif kind == 0x06:
                if body[12:14] != b"\xff\xff":
                    found = [(r, c, _number(struct.unpack_from("<d", body, 6)[0]))]
                elif body[6] == 0:
                    waiting = (r, c)
                elif body[6] == 1:
                    found = [(r, c, "True" if body[8] else "False")]
        elif kind == 0xBD:
            r, c = struct.unpack_from("<HH", body)
            found = [(r, c + k, _number(_packed(struct.unpack_from("<I", body, 4 + 6 * k + 2)[0]))) for k in range((len(body) - 6) // 6)]
        out += [(*sheet, r + 1, c + 1, v) for r, c, v in found if v != ""]
    return out
