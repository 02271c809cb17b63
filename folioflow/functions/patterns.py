"""Structure patterns as data. Built from numeral classes; valid in Java, Python and RE2 regular expressions."""

from __future__ import annotations

import re

HAN = "一二三四五六七八九十"
BIG = HAN + "百千万"
NUM = f"[{BIG}0-9]+"
MARKS = "[、．.]"

#: The units of levels 1 to 8, by place.
UNITS = "编篇章节条款项目"
#: Level -> (type, patterns without anchor). 9 (paragraph) has no pattern.
LEVELS: dict[int, tuple[str, tuple[str, ...]]] = {
    n: (name, (f"第{NUM}{unit}",))
    for n, name, unit in zip(range(1, 9), "book part chapter section article clause item subitem".split(), UNITS)
}
LEVELS[10] = ("enumeration", (f"（{NUM}）", rf"\({NUM}\)", f"[{BIG}]+{MARKS}"))
LEVELS[11] = ("numbering", (f"[0-9]+{MARKS}", rf"[0-9]+\.[0-9]+{MARKS}?", r"[0-9]+\)"))

GENERAL: dict[str, tuple[str, ...]] = {
    "chinese_numbering": (f"[{HAN}0-9]+{MARKS}", f"（[{HAN}0-9]+）"),
    "english_numbering": (*(rf"(?i:{w})\s+[0-9]+" for w in ("chapter", "section", "article")), r"[0-9]+\.?\s+", r"[0-9]+\.[0-9]+\.?\s+"),
}

ARTICLE, CHAPTER = LEVELS[5][1][0], LEVELS[3][1][0]
CONTENT_WORDS = tuple("内容 规定 说明 包含 详细".split())
ARTICLE_WORDS = CONTENT_WORDS + tuple("很长 多".split())
STRUCTURE_MARKERS = tuple(f"{h}、" for h in HAN) + tuple(f"（{h}）" for h in HAN[:5]) + tuple(f"{d}、" for d in range(1, 6))
LIST_MARKERS = tuple(f"{h}、" for h in HAN[:8])
SENTENCE_ENDS, CLOSERS = "。！？；.!?;", '"）)】]》>'
CURSOR_ENDS = "\n。！？.!?"
SHEET_KEYWORDS = tuple("条款项章节编篇") + tuple("规定 办法 条例 法律 法规".split())
GENERIC_SHEETS = tuple(f"{p}{n}" for p, k in (("Sheet", 5), ("工作表", 3), ("Worksheet", 2)) for n in ("", *range(1, k + 1)))
LAW_HEADERS = tuple("法规名称 条文 内容 法律名称 条款 条文号 第几条 法规条文".split())
CLAUSE_WORDS = tuple("违约 终止 争议 赔偿 责任 保密 breach termination dispute compensation liability confidential".split())
PROCESS_WORDS = tuple("步骤 程序 流程 process procedure step".split())
FILE_WORDS = tuple("law 法律 法规 条例 办法 规定 管理 监督 证券 银行 金融".split())
CONTEXT_WORDS = tuple("law legal regulation rule act 法 条例 规定 办法 法律".split())


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def clean_pattern(pattern: str) -> str:
    """For search anywhere: without a leading ^ and a trailing white-space run; "" if it is no valid pattern."""
    short = pattern.removeprefix("^").removesuffix(r"\s*")
    for p in (short, pattern):
        try:
            re.compile(p)
            return p
        except re.error:
            continue
    return ""


def by_priority(legal_first: bool = True, custom: dict[str, list[str]] | None = None) -> list[str]:
    """All anchored patterns, legal or general ones first, custom ones last."""
    legal = [f"^{p}" for _, ps in LEVELS.values() for p in ps]
    general = [f"^{p}" for ps in GENERAL.values() for p in ps]
    extra = [p for ps in (custom or {}).values() for p in ps]
    return (legal + general if legal_first else general + legal) + extra


def any_legal() -> str:
    return "|".join(p for _, ps in LEVELS.values() for p in ps)
