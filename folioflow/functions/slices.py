"""Arrow batches in slices: Python holds the values of one slice at a time, however many rows Spark puts in a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

ROWS, BYTES = 512, 2 << 20


def slices(batch: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of a batch in runs of at most ``ROWS`` rows and about ``BYTES``; a row is never cut."""
    n = len(batch[0])
    step = max(1, min(ROWS, n * BYTES // max(1, sum(c.nbytes for c in batch))))
    for i in range(0, n, step):
        yield tuple(c.slice(i, step) for c in batch)


def values(a: pa.Array) -> list:
    """As ``to_pylist``, without a scalar object for each value of lists, strings and whole numbers."""
    if pa.types.is_list(a.type):
        flat, out, at = values(a.flatten()), [], 0
        for n in a.value_lengths().to_pylist():
            out.append(None if n is None else flat[at : at + n])
            at += n or 0
        return out
    fast = pa.types.is_string(a.type) or pa.types.is_binary(a.type) or (not a.null_count and (pa.types.is_integer(a.type) or pa.types.is_boolean(a.type)))
    return a.to_numpy(zero_copy_only=False).tolist() if fast else a.to_pylist()
