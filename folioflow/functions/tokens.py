"""Token counts by a public byte-level vocabulary that lies in a file; nothing is fetched."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def counter(path: str, pattern: str = PATTERN) -> Callable[[Column], Column]:
    """For ``text.count_tokens``: a function from texts to their numbers of tokens by the ranks in ``path``, which all
    executors can read. Texts count in Arrow batches; a null text has no number."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(path, pattern)
        return pd.Series([None if t is None else len(encoding.encode_ordinary(t)) for t in texts], dtype="Int32")

    return count


_KNOWN: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _KNOWN:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _KNOWN[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _KNOWN[path, pattern]
