"""RTF: escapes are decoded in runs before control words go, then candidates compete by CJK characters and lines."""

from __future__ import annotations

import re
from functools import lru_cache

from ..functions import kernels as K

_SKIP = "fonttbl colortbl stylesheet info listtable listoverridetable generator pict themedata datastore latentstyles xmlnstbl".split()
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'((?i:[\da-f]{2}))|\\(\*|[^a-zA-Z])|([{}])|([^\\{}]+)", re.S)
#: The same, with characters that one sign each stands for, and plain ASCII among them, as one token.
_RUNS = re.compile(rb"((?:\\u-?\d+\?[ -\[\]-z|~]*)+)|" + _TOKEN.pattern, re.S)
_CJK = re.compile("[\u4e00-\u9fff]+")
_BREAKS = {"par": "\n", "line": "\n", "tab": "\t", "sect": "\n", "page": "\n", "row": "\n", "cell": " | "}


@lru_cache(1 << 16)
def _char(number: str) -> str:
    return chr(int(number) % 65536)


def parse(data: bytes) -> str:
    """Text by groups and control words; bytes in a row decode together, so that two-byte characters survive."""
    out: list[str] = []
    run = bytearray()
    stack: list[tuple[bool, int]] = []
    skip, uc, owed, page = False, 1, 0, "cp1252"

    def flush() -> None:
        if run:
            try:
                text = run.decode("gbk" if page == "gbk" or any(b > 127 for b in run) else page)
            except UnicodeDecodeError:
                text = run.decode("cp1252", "replace")
            out.append(text)
            run.clear()

    plain_runs = not re.search(rb"\\uc(?!1?(?![-\d]))", data)
    for many, word, number, code, sign, brace, plain in _RUNS.findall(data) if plain_runs else ((b"", *t) for t in _TOKEN.findall(data)):
        if many:
            if not skip:
                flush()
                out.extend([_char(n) + more for n, _, more in [x.partition("?") for x in many.decode("ascii")[2:].split("\\u")]])
                owed = 0
        elif brace == b"{":
            stack.append((skip, uc))
        elif brace == b"}":
            flush()
            skip, uc = stack.pop() if stack else (False, 1)
        elif sign == b"*":
            skip = True
        elif word:
            w = word.decode("latin-1")
            if w in _SKIP:
                skip = True
            elif w == "ansicpg":
                page = "gbk" if number == b"936" else page
            elif w == "uc":
                uc = int(number or 1)
            elif skip:
                continue
            elif w == "u" and number:
                flush()
                out.append(chr(int(number) % 65536))
                owed = uc
            elif w in _BREAKS:
                flush()
                out.append(_BREAKS[w])
        elif skip:
            continue
        elif code:
            if owed:
                owed -= 1
            else:
                run.append(int(code, 16))
        elif sign:
            if sign in rb"\{}":
                run += sign
            elif sign == b"~":
                run += b" "
        elif plain:
            p = plain.replace(b"\r", b"").replace(b"\n", b"")
            n = min(owed, len(p))
            owed -= n
            run += p[n:]
    flush()
    text = "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return re.sub(r"[ \t]+", " ", text).strip()


def direct(data: bytes) -> str:
    """What is left if only readable characters stay."""
    text = re.sub(rb"(?i:\\'[\da-f]{2})+", lambda m: bytes.fromhex(m.group().decode().replace("\\'", "")), data).decode("gbk", "ignore")
    return re.sub(r"\s+", " ", re.sub(r"[^\u4e00-\u9fff\w\s，。；：！？、（）()《》.,;:!?-]+", "", re.sub(r"\\[a-z]+-?\d* ?|[{}]", "", text))).strip()


def score(text: str) -> int:
    return len(text) - len(_CJK.sub("", text)) + 2 * text.count("\n")


def extract(data: bytes) -> str:
    """The best candidate by score, the first of equals; a text without CJK is taken as parsed. Where no byte of CJK stands
    for itself, what readable characters leave has a score of 0 and can't be better than a parsed text."""
    parsed = parse(data)
    plain = data.isascii() and b"\\'" not in data
    tried = [t for t in (parsed, *(() if plain and len(parsed) > 50 else (direct(data),))) if len(t.strip()) > 50]
    if not tried:
        return parsed
    cleaned = [K.reflow_lines(t) if score(t) else t for t in tried]
    return cleaned[0] if len(cleaned) == 1 else max(cleaned, key=score)


def sections(text: str) -> list[dict]:
    """Title and articles; else the first paragraph that names a regulation, and the rest."""
    found = articles(text)
    if len(found) > 2:
        return found
    paragraphs = [p.strip() for p in text.split("\n") if p.strip()]
    title = next((p for p in paragraphs if re.search("管理办法|条例|规定", p)), None)
    rest = list(paragraphs)
    if title is not None:
        rest.remove(title)
    out = [{"heading": title, "content": title}] if title else []
    return out + ([{"heading": "", "content": "\n\n".join(rest)}] if rest else [])


def articles(text: str) -> list[dict]:
    m = re.search(r"[^\n]*?(?:管理办法|条例|规定|办法|细则|规则)", text)
    title = m.group().strip() if m else ""
    out = [{"heading": title, "content": title}] if title else []
    marks = list(re.finditer(K.P.any_legal(), text))
    cuts = [*(x.start() for x in marks), len(text)]
    arts = [(x.group(), f"{x.group()}\n{text[a:b].strip()}".strip()) for x, a, b in zip(marks, cuts, cuts[1:]) if re.fullmatch(K.P.ARTICLE, x.group())]
    arts = [{"heading": h, "content": c} for h, c in arts if len(c) > 10]
    paragraphs = lambda t: [p.strip() for p in t.split("\n\n") if p.strip()]
    if len(arts) == 1 and len(arts[0]["content"]) > 500 and len(ps := paragraphs(arts[0]["content"])) > 3:
        return out + [{"heading": f"{arts[0]['heading']} - 段落 {i}", "content": p} for i, p in enumerate(ps, 1) if len(p) > 20]
    if arts:
        return out + arts
    ps = paragraphs(text)
    if len(ps) <= 2:
        return out
    alike = [{"heading": p.split("\n")[0] if re.match(f"{K.P.ARTICLE}|{K.P.CHAPTER}", p) else f"段落 {i}", "content": p} for i, p in enumerate(ps, 1) if re.match(f"{K.P.ARTICLE}|{K.P.CHAPTER}", p) or len(p) > 50]
    if len(alike) >= 2:
        return out + alike
    return out + ([{"heading": "主要内容", "content": "\n\n".join(ps[1:])}] if title else [{"heading": "文档内容", "content": "\n\n".join(ps)}])
