"""Order-dependent folds over one document, as plain Python. Operators run them in Arrow batches."""

from __future__ import annotations

import re

from . import patterns as P

_SENTENCE = re.compile(rf"[^{P.SENTENCE_ENDS}]*[{P.SENTENCE_ENDS}][{re.escape(P.CLOSERS)}]*|[^{P.SENTENCE_ENDS}]+")
_ARTICLE, _CHAPTER = re.compile(P.ARTICLE), re.compile(P.CHAPTER)


def sentences(text: str) -> list[str]:
    return [s for s in (m.strip() for m in _SENTENCE.findall(text)) if len(s) > 2]


def pack(parts: list[str], limit: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the sentences of each chunk.

    A chunk is closed before the sentence that would make it longer than ``limit``; the next starts with the longest run of
    its last sentences that is no longer than ``overlap``. A sentence alone and longer than 1.5 x limit is closed at once.
    """
    out: list[tuple[int, int]] = []
    first = size = 0
    for i, part in enumerate(parts):
        n = len(part)
        if first < i and size + n > limit:
            out.append((first, i))
            j, kept = i, 0
            while overlap > 0 and j > first and kept + len(parts[j - 1]) <= overlap:
                j -= 1
                kept += len(parts[j])
            first, size = j, kept
        size += n
        if first == i and 2 * size > 3 * limit:
            out.append((i, i + 1))
            first, size = i + 1, 0
    if first < len(parts):
        out.append((first, len(parts)))
    return out


def pack_sentences(text: str, limit: int, overlap: int) -> list[str]:
    s = sentences(text)
    return [" ".join(s[a:b]) for a, b in pack(s, limit, overlap)] if s else [text]


def natural_breaks(text: str, limit: int) -> list[str]:
    """Paragraphs; those over the limit packed by sentences, without overlap."""
    out = []
    for p in filter(None, (p.strip() for p in text.split("\n\n"))):
        out += [p] if len(p) <= limit else [" ".join(s[a:b]) for s in [sentences(p)] for a, b in pack(s, limit, 0)]
    return out


def windows(text: str, limit: int, step: int) -> list[str]:
    return [text[i : i + limit] for i in range(0, len(text), step)]


_LISTED = re.compile("|".join(P.LIST_MARKERS))


def marker_sections(text: str) -> list[str]:
    """The text cut before every list marker, without loss; else paragraphs, else lines."""
    at = [m.start() for m in _LISTED.finditer(text)]
    if at:
        cuts = [0, *at, len(text)]
        return [s for a, b in zip(cuts, cuts[1:]) if (s := text[a:b].strip())]
    for mark in ("\n\n", "\n"):
        parts = [p.strip() for p in text.split(mark) if p.strip()]
        if len(parts) > 1 or mark == "\n":
            return parts
    return []


def sentence_overlap(text: str, overlap: int) -> str:
    """The longest run of last sentences whose joint length is at most ``overlap``."""
    if len(text) <= overlap:
        return text
    kept: list[str] = []
    size = 0
    for s in reversed(sentences(text)):
        if size + len(s) + bool(kept) > overlap:
            break
        size += len(s) + bool(kept)
        kept.insert(0, s)
    return " ".join(kept)


def pack_structure(text: str, limit: int, overlap: int) -> list[str]:
    out, now = [], ""
    for s in marker_sections(text):
        if now and len(now) + len(s) > limit:
            out.append(now.strip())
            tail = sentence_overlap(now, overlap) if overlap > 0 else ""
            now = f"{tail} {s}" if tail else s
        else:
            now = f"{now} {s}" if now else s
    return out + [now.strip()] if now.strip() else out


def has_structure(text: str) -> bool:
    return sum(m in text for m in P.STRUCTURE_MARKERS) >= 3


def slide(text: str, limit: int, overlap: int, by_sentence: bool = True, structure: bool = True) -> list[str]:
    """The size-control dispatcher: whole, by structure, by sentences, or by windows."""
    if len(text) <= limit:
        return [text]
    if structure and has_structure(text):
        return pack_structure(text, limit, overlap)
    return pack_sentences(text, limit, overlap) if by_sentence else windows(text, limit, limit - overlap)


def cursor(text: str, limit: int, ratio: float, drop_contained: bool = False) -> list[tuple[int, int, str]]:
    """(start, end, content) of chunks that end at the last end sign in reach and begin after one in the overlap."""
    ends, n, at, out = P.CURSOR_ENDS, len(text), 0, []
    if not text.strip():
        return out
    while at < n:
        top = min(at + limit, n)
        last = max(text.rfind(e, at + 1, top) for e in ends)
        end = last + 1 if last > at else top
        if content := text[at:end].strip():
            out.append((at, end, content))
        if end >= n:
            break
        lap = min(int(limit * ratio), (end - at) // 2)
        low = max(at, end - lap)
        found = [k for e in ends if (k := text.find(e, max(low - 1, 0), end - 1)) >= 0]
        nxt = min(found) + 1 if found else low
        while found and nxt < n and text[nxt].isspace():
            nxt += 1
        at = nxt
    if drop_contained:
        out = [c for i, c in enumerate(out) if not any(o[0] <= c[0] and c[1] <= o[1] and o is not c for o in out[max(0, i - 1) : i])]
    return out


def split_oversized(chunk: str, limit: int, overlap: int) -> list[str]:
    """Sentences packed into lines under the chunk's path heading, which is repeated and counted."""
    head, body = "", chunk
    first, _, rest = chunk.partition("\n")
    if " > " in first:
        head, body = first + "\n\n", re.sub(r"\A(?:\s*\n)*", "", rest)
    parts = [s.strip() for s in re.findall(rf"[^{P.SENTENCE_ENDS}]*[{P.SENTENCE_ENDS}]|[^{P.SENTENCE_ENDS}]+", body)]
    parts = [s for s in parts if s]
    if not parts:
        return [chunk]
    out, now = [], ""
    for s in parts:
        longer = f"{now}\n{s}" if now else s
        if len(head) + len(longer) <= limit:
            now = longer
        elif now:
            out.append(head + now)
            tail = char_overlap(now, overlap) if overlap > 0 else ""
            now = f"{tail}\n{s}" if tail else s
        else:
            out.append(head + s)
    return out + [head + now] if now else out


def char_overlap(text: str, n: int) -> str:
    if len(text) <= n:
        return text
    last = text[-n:]
    m = re.search(f"[{P.SENTENCE_ENDS}]", last)
    return last[m.end() :].strip() if m else last.strip()


def share_run(a: str, b: str, least: int) -> bool:
    """Whether a run of ``least`` characters stands in both. Such a run holds a whole block of half its length of ``a``."""
    if least < 2:
        return not set(a).isdisjoint(b) if least == 1 else True
    half = least // 2
    for i in range(0, len(a) - half + 1, half):
        at = b.find(a[i : i + half])
        if at >= 0 and any(a[k : k + least] in b for k in range(max(0, i + half - least), min(i, len(a) - least) + 1)):
            return True
    return False


def strict(chunks: list[str], limit: int, overlap: int) -> list[str]:
    return [p for c in chunks for p in ([c] if len(c) <= limit else split_oversized(c, limit, overlap))]


def greedy_distinct(prints: list[str], threshold: float = 0.7) -> list[bool]:
    """Whether each chunk stays: no chunk that stayed before shares so many of the characters of its fingerprint.

    Sets of characters are bits of whole numbers; one that is equal to an earlier set needs no comparison.
    """
    bit: dict[str, int] = {}
    kept: list[tuple[int, int]] = []
    known: dict[int, bool] = {0: False}
    out = []
    for p in prints:
        s = 0
        for c in set(p.lower()):
            s |= bit.setdefault(c, 1 << len(bit))
        if (dup := known.get(s)) is None:
            n = s.bit_count()
            dup = any((both := (s & k).bit_count()) >= threshold * (n + m - both) for k, m in kept)
            if not dup:
                kept.append((s, n))
            known[s] = True
        out.append(not dup)
    return out


def repair(chunks: list[str]) -> list[str]:
    """Joins an article that was cut with the chunk after it; what was joined isn't looked at again."""
    out, i = [], 0
    while i < len(chunks):
        now, after = chunks[i], chunks[i + 1] if i + 1 < len(chunks) else None
        i += 1
        if after is not None:
            if now.endswith("应当对本办法") and re.search(rf"{P.ARTICLE}[^\n]*?的内容进行", after):
                now, i = now + after, i + 1
            elif len(now) < 100 and _ARTICLE.search(now) and not _ARTICLE.match(after):
                now, i = f"{now}\n\n{after}", i + 1
        out.append(now)
    return out


def articles_advanced(text: str) -> list[str]:
    """Articles and chapters; a chapter close before an article goes with it."""
    marks = sorted([(m.start(), "c") for m in _CHAPTER.finditer(text)] + [(m.start(), "a") for m in _ARTICLE.finditer(text)])
    paragraphs = lambda t: [p.strip() for p in t.split("\n\n") if p.strip()]
    if not marks:
        return [p for p in paragraphs(text) if len(p) > 20]
    out = [p for p in paragraphs(text[: marks[0][0]].strip()) if len(p) > 10]
    place = [*(m[0] for m in marks), len(text)]
    i = 0
    while i < len(marks):
        own = text[place[i] : place[i + 1]].strip()
        step = 1
        if len(own) > 10:
            if marks[i][1] == "c" and i + 1 < len(marks) and marks[i + 1][1] == "a" and place[i + 1] - place[i] < 200:
                own, step = text[place[i] : place[i + 2]].strip(), 2
            out.append(own)
        i += step
    return out


def articles_by_chapter(text: str) -> list[str]:
    """Chapter marks alone; in between, articles as mark, empty line, text."""
    out: list[str] = []
    for part in re.split(f"({P.CHAPTER})", text):
        if not (part := part.strip()):
            continue
        if _CHAPTER.match(part):
            out.append(part)
            continue
        now = ""
        for x in filter(None, (x.strip() for x in re.split(f"({P.ARTICLE})", part))):
            if _ARTICLE.match(x):
                if now:
                    out.append(now)
                now = x
            else:
                now = f"{now}\n\n{x}" if now else x
        if now:
            out.append(now)
    return out


def tree_columns(headings: list[bool], levels: list[int]) -> dict[str, list]:
    """The sections of a document's elements in order, a list a field: the heading's place (-1: before any), its parent's
    (-1: root), the elements [first, stop), the places of the headings from the root down, and whether no section is below it."""
    n = len(headings)
    at = [i for i, h in enumerate(headings) if h]
    out: dict[str, list] = {k: [] for k in ("element", "parent", "first", "stop", "path", "is_leaf")}
    element, parent, first, stop, path, leaf = out.values()
    ends = [*at[1:], n]
    if n and not (at and at[0] == 0):
        at, ends = [-1, *at], [at[0] if at else n, *(ends if at else ())]
    stack: list[int] = []
    for i, end in zip(at, ends):
        if i < 0:
            up, deeper, way = -1, False, [-1]
        else:
            while stack and levels[i] <= levels[stack[-1]]:
                stack.pop()
            up = stack[-1] if stack else -1
            deeper = end < n and levels[end] > levels[i]
            stack.append(i)
            way = stack[:]
        element.append(i)
        parent.append(up)
        first.append(max(i, 0))
        stop.append(end)
        path.append(way)
        leaf.append(not deeper)
    return out


def tree(headings: list[bool], levels: list[int]) -> list[dict]:
    """The same, a dict a section, numbered from 1."""
    c = tree_columns(headings, levels)
    return [{"seq": k, **dict(zip(c, s))} for k, s in enumerate(zip(*c.values()), 1)]


def pack_lines(lines: list[str], limit: int) -> list[str]:
    out, now = [], ""
    for line in filter(None, (x.strip() for x in lines)):
        if len(now) + len(line) > limit:
            if now.strip():
                out.append(now)
            now = line + "\n"
        else:
            now += line + "\n"
    return out + [now] if now.strip() else out


def batches(texts: list[str], most: int = 20, tokens: int = 3000) -> list[list[int]]:
    """Indices of texts in order, in batches bounded in number and estimated tokens."""
    out: list[list[int]] = []
    size = 0
    for i, t in enumerate(texts):
        n = len(t) + len(t.split()) // 2
        if not out or len(out[-1]) >= most or size + n > tokens:
            out.append([])
            size = 0
        out[-1].append(i)
        size += n
    return out


_DANGLING = tuple("本 根据 按照 违反 依据 遵循".split())


#: Marks with a unit begin at the same sign and none holds another, so that one pattern finds those of all levels.
_MARKED = [re.compile(f"({p})") for p in (f"第{P.NUM}[{P.UNITS}]", *(p for _, ps in list(P.LEVELS.values())[len(P.UNITS) :] for p in ps))]
_LEGAL = re.compile(P.any_legal())
_REFERENCES = [(w, re.compile(f"({p})")) for w, p in (("（", f"（[{P.HAN}0-9]+）"), ("(", rf"\([{P.HAN}0-9]+\)"), ("前款", r"(?<!\w)前款"), ("本条", r"(?<!\w)本条"))]


def reflow_lines(text: str) -> str:
    """Breaks before structure marks, dangling lines joined, breaks before references, at most one empty line."""
    for p in _MARKED:
        text = p.sub(r"\n\n\1", text)
    lines, out, i = [x.strip() for x in text.split("\n")], [], 0
    while i < len(lines):
        now = lines[i]
        i += 1
        if now.endswith(_DANGLING) and i < len(lines) and lines[i] and not _LEGAL.match(lines[i]):
            now += lines[i]
            i += 1
        out.append(now)
    text = "\n".join(out)
    for w, p in _REFERENCES:
        if w in text:
            text = p.sub(r"\n\1", text)
    text = re.sub(r"\n\s*\n\s*\n", "\n\n", text)
    return "\n".join(x.strip() for x in text.split("\n")).strip()
