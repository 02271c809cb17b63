"""Substring dedup by hashing of lines, cut after sentence ends.

A unit is the words between two of line feed, ``.``, ``!`` and ``?``. Whole lines alone would miss a passage that was
put into the middle of a line, so lines are cut at sentence ends. Units are normalised to the sequence of their
lower-cased words and digested to 128 bits. Units of fewer than ``min_words`` words are left alone. Of the occurrences
of a digest, the one with the smallest (doc_id, start) stays; all others are removed.

``removed`` leaves the short units of a repeated passage. ``removed_passages`` takes them too: a short unit is also digested
together with all units from the nearest long unit before it, and with all up to the nearest long unit behind it; if either
digest has an earlier occurrence, it goes. So a short unit only goes with a long neighbour that is repeated at the same place.
A first or last sentence that shares its unit with the host text stays, as does a passage without a sentence end.

A removed span runs from the unit's first word to the first word of the next unit or the end of the text, in code
points of the original text.

Defined cases: null and empty texts have no units; rows with a null doc_id are neither compared nor changed; rows that
repeat a doc_id are one document: an occurrence that has the rank of the earliest stays; an empty table gives no rows;
other columns, of any name, are kept as they are by ``clean`` and ignored by ``removed``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K


@dataclass(frozen=True)
class Params:
    min_words: int = 6


def unit_table(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(a, b, doc_id, start, stop, n_words) of every unit long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            u = K.units(K.column(x, "text"))
            k = np.flatnonzero(u["words"] >= p.min_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u["a"][k].view(np.int64)), pa.array(u["b"][k].view(np.int64)), x.column(0).take(pa.array(u["text"][k])), *(pa.array(u[c][k].astype(np.int32)) for c in ("start", "stop", "words"))],
                ["a", "b", "doc_id", "start", "stop", "n_words"],
            )

    return K.narrow(docs).where("doc_id is not null and text is not null").mapInArrow(run, "a bigint, b bigint, doc_id bigint, start int, stop int, n_words int")


def removed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, start, stop, n_words, keep_doc_id, keep_start) of each occurrence that goes."""
    return _later(unit_table(docs, p))


def _later(units: DataFrame) -> DataFrame:
    first = units.groupBy("a", "b").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.max(F.struct("doc_id", "start")).alias("last")).where("first != last").select("a", "b", "first")
    return (
        units.join(first, ["a", "b"])
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("start") != F.col("first.start")))
        .select("doc_id", "start", "stop", "n_words", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.start").alias("keep_start"))
        .distinct()
    )


def passage_table(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """As ``unit_table``, with two more rows of each short unit: its digests with the long unit before it and behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in K.slices(batches):
            u = K.units(K.column(x, "text"))
            n, text = len(u["words"]), u["text"]
            i, long = np.arange(n), u["words"] >= p.min_words
            before = np.maximum.accumulate(np.where(long, i, -1)) if n else i
            behind = np.minimum.accumulate(np.where(long, i, n)[::-1])[::-1] if n else i
            left = np.flatnonzero(~long & (before >= 0) & (text[np.maximum(before, 0)] == text))
            right = np.flatnonzero(~long & (behind < n) & (text[np.minimum(behind, n - 1)] == text))
            own = np.flatnonzero(long)
            k = np.concatenate([own, left, right])
            a, b = (np.concatenate([u[c][own], K._run_hashes(u[c], before[left], left + 1), K._run_hashes(u[c], right, behind[right] + 1)]) for c in "ab")
            yield pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), x.column(0).take(pa.array(text[k])), *(pa.array(u[c][k].astype(np.int32)) for c in ("start", "stop", "words"))],
                ["a", "b", "doc_id", "start", "stop", "n_words"],
            )

    return K.narrow(docs).where("doc_id is not null and text is not null").mapInArrow(run, "a bigint, b bigint, doc_id bigint, start int, stop int, n_words int")


def removed_passages(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """As ``removed``, with the short units of repeated passages; of two places that a short unit repeats, the first is named."""
    found = _later(passage_table(docs, p))
    first = F.min(F.struct("keep_doc_id", "keep_start")).alias("first")
    return found.groupBy("doc_id", "start", "stop", "n_words").agg(first).select("doc_id", "start", "stop", "n_words", "first.*")


def cut_spans(text: str, starts: list[int], stops: list[int]) -> str:
    out, at = [], 0
    for a, b in sorted(zip(map(int, starts), map(int, stops))):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def clean(docs: DataFrame, p: Params = Params(), find: Callable[[DataFrame, Params], DataFrame] = removed) -> DataFrame:
    """``docs`` without the spans that ``find`` (``removed`` or ``removed_passages``) gives, with the same columns and rows; n_chars, if there, follows the text."""
    cols = docs.columns
    spans = find(docs, p).groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))
    joined = docs.select(F.struct(*(F.col(f"`{c}`") for c in cols)).alias("__row"), F.col("doc_id").cast("bigint").alias("__id")).join(spans, "__id", "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        return pd.Series([cut_spans(*x) for x in zip(text, starts, stops)], dtype=object)

    changed = joined.where("__spans is not null").withColumn("__text", cut("__row.text", F.col("__spans.start"), F.col("__spans.stop")))
    same = joined.where("__spans is null").withColumn("__text", F.col("__row.text"))

    def column(c):
        if c == "text":
            return F.col("__text").alias("text")
        if c == "n_chars":
            return F.when(F.col("__spans").isNull(), F.col("__row.n_chars")).otherwise(F.length("__text").cast(docs.schema[c].dataType)).alias(c)
        return F.col(f"__row.`{c}`").alias(c)

    return changed.unionByName(same).select(*(column(c) for c in cols))


ORACLE_SQL = r"""
with pieces as (
  select doc_id, unnest(regexp_extract_all(text, '[^\n.!?]+|[\n.!?]')) as piece, generate_subscripts(regexp_extract_all(text, '[^\n.!?]+|[\n.!?]'), 1) as i
  from documents where doc_id is not null and text is not null and text <> ''),
placed as (
  select doc_id, i, piece, coalesce(sum(length(piece)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as pos,
         sum(length(piece)) over (partition by doc_id) as total from pieces),
units as (
  select doc_id, total, i, pos + length(regexp_extract(piece, '^[^\p{L}\p{N}]*')) as start,
         trim(regexp_replace(lower(piece), '[^\p{L}\p{N}]+', ' ', 'g')) as norm
  from placed where regexp_matches(piece, '[\p{L}\p{N}]')),
whole as (
  select doc_id, start, norm, coalesce(lead(start) over (partition by doc_id order by i), total) as stop, length(norm) - length(replace(norm, ' ', '')) + 1 as n_words from units),
ranked as (
  select *, min_by(doc_id, (doc_id, start)) over (partition by norm) as keep_doc_id, min_by(start, (doc_id, start)) over (partition by norm) as keep_start from whole where n_words >= 6)
select doc_id, cast(start as int) as start, cast(stop as int) as stop, cast(n_words as int) as n_words, keep_doc_id, cast(keep_start as int) as keep_start
from ranked where doc_id <> keep_doc_id or start <> keep_start
"""

PASSAGES_SQL = (
    ORACLE_SQL[: ORACLE_SQL.index("ranked as (")]
    + r"""
marks as (
  select *, n_words >= 6 as long, sum((n_words >= 6)::int) over (partition by doc_id order by start) as l,
         sum((n_words >= 6)::int) over (partition by doc_id order by start desc) as r from whole),
keys as (
  select doc_id, start, stop, n_words, 0 as kind, norm as key from marks where long
  union all
  select doc_id, start, stop, n_words, 1, key from (select *, string_agg(norm, '|') over (partition by doc_id, l order by start) as key from marks where l > 0) where not long
  union all
  select doc_id, start, stop, n_words, 2, key from (select *, string_agg(norm, '|') over (partition by doc_id, r order by start desc) as key from marks where r > 0) where not long),
ranked as (
  select *, min_by(doc_id, (doc_id, start)) over (partition by kind, key) as keep_doc_id, min_by(start, (doc_id, start)) over (partition by kind, key) as keep_start from keys)
select doc_id, cast(start as int) as start, cast(stop as int) as stop, cast(n_words as int) as n_words,
       min_by(keep_doc_id, (keep_doc_id, keep_start)) as keep_doc_id, cast(min_by(keep_start, (keep_doc_id, keep_start)) as int) as keep_start
from ranked where doc_id <> keep_doc_id or start <> keep_start group by doc_id, start, stop, n_words
"""
)
