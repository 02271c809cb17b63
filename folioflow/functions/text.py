"""Scalar expressions, all inside Catalyst. White space, letters and digits are Unicode's, by (?U)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


_BLANK = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def contains_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))


def starts_any(c: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(w) for w in words))


def file_format(path: Column) -> Column:
    """Lower-case suffix without its dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_type_name(fmt: Column) -> Column:
    return F.when(fmt.isin("xlsx", "xls", "xlsm", "xltx", "xltm"), "excel").otherwise(fmt)


def count_tokens(c: Column, counter="character") -> Column:
    """Length in code points, or tokens by a function of columns, such as ``tokens.counter(path of a vocabulary)``."""
    if callable(counter):
        return counter(c)
    if counter == "character":
        return F.length(c)
    raise ValueError(f"token counter {counter}: give 'character' or tokens.counter(path)")


def clean_text(c: Column) -> Column:
    """Blanks collapsed and dropped around CJK signs and between CJK characters; lines stay."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, r"[ \t]+", " ")
        x = F.regexp_replace(x, r"(?U)\s*([、。！？，：；】）}])\s*", "$1")
        x = F.regexp_replace(x, r"(?U)\s*([{【（])\s*", "$1")
        x = F.regexp_replace(x, rf"(?U)(\d)\s+([{P.HAN}])", "$1$2")
        x = F.regexp_replace(x, rf"(?U)([{P.HAN}])\s+(\d)", "$1$2")
        x = F.regexp_replace(x, r"(?U)([\x{4e00}-\x{9fff}])\s+([\x{4e00}-\x{9fff}])", "$1$2")
        return strip(x)

    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def heading_level(c: Column) -> Column:
    """1 chapter, 2 section, 3 number, 4 number in brackets or of two parts; 3 by default."""
    t = strip(c)
    h = f"[{P.HAN}0-9]+"
    unit = F.regexp_extract(t, f"^第{h}([章节])", 1)
    return F.when(unit != "", F.position(unit, F.lit("章节"))).when(t.rlike(rf"^(?:（{h}）|[0-9]+\.[0-9]+)"), 4).when(t.rlike(r"^(?i)chapter\s+[0-9]+"), 1).when(t.rlike(r"^(?i)section\s+[0-9]+"), 2).otherwise(3)


def word_heading_level(style: Column, text: Column) -> Column:
    own = F.regexp_extract(F.lower(style), r"heading\s*([0-9]+)", 1)
    return F.when(F.coalesce(own, F.lit("")) != "", own.try_cast("int")).otherwise(heading_level(text))


def word_heading(style: Column, text: Column) -> Column:
    """A style that says so, a heading's pattern, or a short line without a sentence end."""
    h = f"[{P.HAN}0-9]+"
    pattern = rf"^(?i)(第{h}[章节]|{h}{P.MARKS}|（{h}）|(chapter|section)\s+[0-9]+|[0-9]+\.?\s+|[0-9]+\.[0-9]+\.?\s+)"
    named = F.coalesce(F.lower(style).rlike("heading|title"), F.lit(False))
    return named | text.rlike(pattern) | ((F.length(text) < 100) & ~text.rlike("[。.！!？?]$"))


def _plain_level(t: Column, article: Column | int = 5) -> Column:
    """By one pattern for the units and one a level beyond: a pattern a level makes methods that the JVM does not compile."""
    unit = F.regexp_extract(t, f"^第{P.NUM}([{P.UNITS}])", 1)
    out = F.when(unit == P.UNITS[4], article).when(unit != "", F.position(unit, F.lit(P.UNITS)))
    for n, (_, ps) in list(P.LEVELS.items())[len(P.UNITS) :]:
        out = out.when(t.rlike(f"^(?:{'|'.join(ps)})"), n)
    return out


def _content_article(t: Column) -> Column:
    return (F.length(t) > 50) | t.rlike(P.any_of(P.ARTICLE_WORDS))


def legal_level(c: Column) -> Column:
    """Level of the first matching kind; 10 for an article that is body text, and by default."""
    t = strip(c)
    return F.coalesce(_plain_level(t, F.when(_content_article(t), 10).otherwise(5)), F.lit(10))


def legal_type(c: Column) -> Column:
    names = [P.LEVELS.get(k, (None,))[0] for k in range(max(P.LEVELS) + 1)]
    return F.get(F.array(*map(F.lit, names)), _plain_level(strip(c)))


def legal_heading(c: Column, legal: bool = True, fuzzy: bool = True, custom: tuple[str, ...] = ()) -> Column:
    """Whether a line of 2 to 200 characters is a heading. An article must not look like body text."""
    t = strip(c)
    n = F.length(t)
    out = _plain_level(t, F.when(_content_article(t), 0).otherwise(5)) > 0
    for p in custom:
        out = out | t.rlike(p)
    if not legal:
        out = out | t.rlike("^(?:" + "|".join(p for ps in P.GENERAL.values() for p in ps) + ")")
        if fuzzy:
            out = out | ((n < 30) & ~t.rlike("[。.！!？?；;：:]$") & ~t.rlike("[，,、]") & ~contains_any(t, P.CONTENT_WORDS))
    return F.coalesce((n >= 2) & (n <= 200) & out, F.lit(False))


def has_structure(c: Column) -> Column:
    return reduce(lambda a, b: a + b, (c.contains(m).cast("int") for m in P.STRUCTURE_MARKERS)) >= 3


def sentence_complete(c: Column) -> Column:
    return c.rlike(rf"(?U)[{P.SENTENCE_ENDS}]\s*$")


def sentences(c: Column) -> Column:
    """Each end sign ends a sentence and takes the closing signs that follow; two characters or less are dropped."""
    e = P.SENTENCE_ENDS
    closers = r'["）)】\]》>]'
    parts = F.regexp_extract_all(c, F.lit(f"(?s)[^{e}]*[{e}]{closers}*|[^{e}]+"), F.lit(0))
    return F.filter(F.transform(parts, strip), lambda s: F.length(s) > 2)


def repair_truncation(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)(制定|根据|按照|违反)本(?!\w)", "$1本办法")


def clean_legal_text(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " ")
    t = F.regexp_replace(t, r"（征求意见稿）\s*>\s*", "")
    t = F.regexp_replace(t, r"[^第]*?>\s*(?=第)", "")
    return strip(repair_truncation(t))


def distinct_lines(c: Column, prefix: str | None = None) -> Column:
    """Stripped lines without ``prefix``, each once, parted by an empty line."""
    lines = F.transform(F.split(c, "\n"), strip)
    if prefix:
        lines = F.transform(lines, lambda x: strip(F.regexp_replace(F.regexp_replace(x, r"^（征求意见稿）\s*>\s*", ""), prefix, "")))
    return F.array_join(F.array_distinct(F.filter(lines, lambda x: x != "")), "\n\n")


def clean_legal_advanced(c: Column) -> Column:
    t = F.regexp_replace(c, r"（征求意见稿）\s*>\s*", "")
    return distinct_lines(F.regexp_replace(t, r"[^第]*?>\s*(?=第)", ""))


def clean_legal_simple(c: Column) -> Column:
    return distinct_lines(c, r"^[^第]*?>\s*")


def clean_legal_chunk(c: Column) -> Column:
    return distinct_lines(c, r"^.*?>\s*")


def overlap_text(c: Column, n: int) -> Column:
    """The last n characters, from after the first sentence end among them."""
    last = F.substring(c, -n, n) if n else F.lit("")
    e = P.SENTENCE_ENDS
    return F.when(F.length(c) <= n, c).when(last.rlike(f"[{e}]"), strip(F.regexp_replace(last, f"(?s)^[^{e}]*[{e}]", ""))).otherwise(strip(last))


def fingerprint(c: Column, size: int = 300) -> Column:
    t = F.regexp_replace(c, r"【Chunk [0-9]+】[^\n]*?\n", "")
    for p in ("={50,}", "-{20,}", r"\(长度: [0-9]+ 字符\)", r"立项申请表 > [^\n]*? > [^\n]*? \(Part [0-9]+\)"):
        t = F.regexp_replace(t, p, "")
    return F.substring(strip(F.regexp_replace(t, r"(?U)\s+", " ")), 1, size)


def article_number(c: Column) -> Column:
    none = F.lit(None).cast("string")
    tried = [F.regexp_extract(c, f"^{p}", 0) for p in (P.ARTICLE, P.LEVELS[6][1][0], P.LEVELS[7][1][0], r"[0-9]+\.", r"\([0-9]+\)")]
    return F.coalesce(*(F.when(t != "", t).otherwise(none) for t in tried), F.lit(""))


def table_text(rows: Column) -> Column:
    """array<array<string>> as lines of cells."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | ")), "\n")


def rule_heading(c: Column) -> Column:
    """struct<is_heading, level, confidence> by prefix and length."""
    t = strip(c)
    n = F.length(t)
    calm = ~t.rlike("[：:，]")

    def verdict(yes: Column, level: int, good: float, bad: float) -> Column:
        return F.struct(yes.alias("is_heading"), F.when(yes, level).otherwise(0).alias("level"), F.when(yes, good).otherwise(bad).alias("confidence"))

    digits = [str(i) for i in range(1, 11)]
    return (
        F.when(starts_any(t, [f"{h}、" for h in P.HAN]), verdict(n <= 100, 1, 0.9, 0.8))
        .when(starts_any(t, [f"（{h}）" for h in P.HAN]), verdict((n <= 20) & calm & ~t.contains("。"), 2, 0.7, 0.8))
        .when(starts_any(t, [f"{d}、" for d in digits]), verdict((n <= 15) & calm, 3, 0.6, 0.7))
        .when(starts_any(t, [f"({d})" for d in digits]), verdict((n <= 15) & calm, 4, 0.5, 0.6))
        .otherwise(verdict(F.lit(False), 0, 0.0, 0.9))
    )


def is_important(c: Column) -> Column:
    return contains_any(F.lower(c), P.CLAUSE_WORDS)


def is_process(c: Column) -> Column:
    return contains_any(F.lower(c), P.PROCESS_WORDS)


def party_tags(c: Column) -> Column:
    """What a contract's chunk speaks of."""
    tags = {"当事人": contains_any(c, ("甲方", "乙方")), "合同条款": c.contains("第") & c.contains("条"), "权利义务": contains_any(c, ("权利", "义务")), "违约责任": contains_any(c, ("违约", "责任"))}
    return F.filter(F.array(*(F.when(yes, tag) for tag, yes in tags.items())), lambda x: x.isNotNull())


def legal_filename(path: Column) -> Column:
    p = F.lower(path)
    stem = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    return p.contains("/law/") | contains_any(stem, P.FILE_WORDS)


def legal_context(path: Column, explicit: bool = False) -> Column:
    return F.lit(explicit) | contains_any(F.lower(path), P.CONTEXT_WORDS)


def show_sheet(name: Column, sheets: Column) -> Column:
    return (sheets > 1) & ~name.isin(*P.GENERIC_SHEETS)


def sheet_heading(name: Column, kind: Column, sheets: Column) -> Column:
    plain = strip(F.regexp_replace(name, "^【工作表: (.*)】$", "$1"))
    return F.when(show_sheet(plain, sheets), F.concat_ws(" - ", plain, kind)).otherwise(kind)


def clean_sheet_text(c: Column) -> Column:
    for p, r in (("【工作表:[^】]*】", ""), ("表头:", ""), ("-{10,}", ""), (r"(?U)★\s*", ""), (r"(?U)\n\s*\n", "\n")):
        c = F.regexp_replace(c, p, r)
    return strip(c)


def excel_content(fmt: Column, content: Column) -> Column:
    return fmt.isin("xlsx", "xls", "xlsm", "xltx", "xltm") | (F.hex(F.substring(content, 1, 4)) == "504B0304") | (F.hex(F.substring(content, 1, 2)) == "D0CF")


def mark_split(c: Column, pattern: str) -> Column:
    """The text before the first match, then each match with what follows it."""
    return F.split(F.regexp_replace(c, f"({pattern})", "\u0001$1"), "\u0001")


def reflow(c: Column) -> Column:
    """Text of a flattened document with breaks before structure marks again; dangling lines are joined in kernels."""
    t = repair_truncation(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.regexp_replace(t, rf"应当对\s*本办法\s*第({P.NUM})条到\s*第({P.NUM})条的内容", "应当对本办法第$1条到第$2条的内容")
