"""Shared pieces: column picking, word hashes, settled intermediates."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.plans.session import settle

#: ASCII white space as the contracts state it.
SPACE = r"[\x20\x09-\x0D]+"

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_RADIX = 0x9E3779B97F4A7C15
_INVERSE = pow(_RADIX, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: White space and ASCII punctuation.
_IS_BREAK = _IS_SPACE.copy()
_IS_BREAK[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other
    columns of the input cannot clash with the operator's."""
    return df.select(*(F.col(source).alias(name) for name, source in columns.items()))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``limit`` bytes of the text column,
    or elements of a list column (one row at least); zero-copy."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        lengths = np.asarray(measure(values).fill_null(0))
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _S33)
    h = h * _MIX1
    h ^= h >> _S33
    h = h * _MIX2
    return h ^ (h >> _S33)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def word_hashes(texts: list[str | None], lower: bool = True, letters: bool = False, prefixes: tuple[int, ...] = ()) -> tuple:
    """64-bit hashes of all words of all texts, and the number of words of each
    text. Words are separated by white space, with ``letters`` by ASCII
    punctuation as well. Only A-Z are lower-cased. For ``prefixes`` a third
    item: per length, hashes of the words' first bytes, 0 for shorter words."""
    data = [(t or "").encode() for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    if lower:
        joined = _LOWER[joined]
    space = (_IS_BREAK if letters else _IS_SPACE)[joined]
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(_RADIX, len(joined)))))
    # a word's polynomial, shifted back to the start, so that equal words agree wherever they stand
    back = _powers(_INVERSE, len(joined))[starts]
    hashes = mix((sums[ends] - sums[starts]) * back ^ (ends - starts).astype(np.uint64))
    limits = np.cumsum([len(d) + 1 for d in data])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, limits))))
    if not prefixes:
        return hashes, counts
    heads = [np.where(ends - starts >= k, (sums[np.minimum(starts + k, ends)] - sums[starts]) * back, np.uint64(0)) for k in prefixes]
    return hashes, counts, heads


def release() -> None:
    """Called at the end of a task that used much memory: its worker lives on
    for other stages, and what it no longer needs goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def distribute(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over the session's shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


__all__ = ["SPACE", "distribute", "mix", "pick", "release", "settle", "slices", "text_or_empty", "unused", "word_hashes"]
