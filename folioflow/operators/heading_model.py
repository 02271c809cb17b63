"""Heading detection by a function of the user's, in batches, with rules where it fails. No service is called from here."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from ..functions.slices import slices, values

#: Answers that a task remembers at most; of these the longest known go first.
REMEMBERED = 20_000
_NONE = dict(is_heading=False, level=0, confidence=0.0)


def prompt(texts: list[str]) -> str:
    listed = "\n".join(f"{i}. {t[:200]}" for i, t in enumerate(texts, 1))
    return f"Which of these {len(texts)} lines are headings? Answer with a JSON list of {len(texts)} objects with is_heading, level (1 to 4, 0 for none) and confidence.\n{listed}"


def answer(reply: str, n: int) -> list[dict]:
    """The first JSON list in a reply if it has n entries, else nothing is a heading."""
    m = re.search(r"\[.*\]", reply, re.S)
    try:
        got = json.loads(m.group()) if m else []
    except ValueError:
        got = []
    if len(got) != n or not all(isinstance(x, dict) for x in got):
        return [dict(_NONE) for _ in range(n)]
    return [{"is_heading": bool(x.get("is_heading")), "level": int(x.get("level") or 0), "confidence": float(x.get("confidence") or 0)} for x in got]


def ask(call: Callable[[str], str], texts: list[str], attempts: int = 3, pause: float = 1.0) -> list[dict] | None:
    for k in range(attempts):
        try:
            return answer(call(prompt(texts)), len(texts))
        except Exception:  # noqa: BLE001 whatever a caller's client raises is tried again
            if k + 1 < attempts:
                time.sleep(pause * 2**k)
    return None


def detect(lines: DataFrame, call: Callable[[str], str], most: int = 20, tokens: int = 3000, attempts: int = 3, pause: float = 1.0, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, seq, text, is_heading, level, confidence); a text equal to one of the last ``remembered`` of a task isn't asked again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple | None] = {}
        for b in batches:
            for part in slices(tuple(b.columns)):
                texts = values(part[2])
                fresh = [t for t in dict.fromkeys(texts) if t is not None and t not in cache]
                for group in K.batches(fresh, most, tokens):
                    asked = [fresh[i] for i in group]
                    got = ask(call, asked, attempts, pause)
                    cache.update(zip(asked, [None] * len(asked) if got is None else [tuple(g.values()) for g in got]))
                rated = [cache.get(t) or (None, None, None) for t in texts]
                for t in list(cache)[: max(0, len(cache) - remembered)]:
                    del cache[t]
                cols = [pa.array(c, t) for c, t in zip(zip(*rated), (pa.bool_(), pa.int32(), pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part, *cols], ["doc_id", "seq", "text", "h", "l", "c"])

    out = lines.select("doc_id", "seq", "text").mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in lines.select('doc_id', 'seq', 'text').schema)}, h boolean, l int, c double")
    rule = X.rule_heading(F.col("text"))
    return out.select("doc_id", "seq", "text", F.coalesce("h", rule["is_heading"]).alias("is_heading"), F.coalesce("l", rule["level"]).alias("level"), F.coalesce("c", rule["confidence"]).alias("confidence"))
