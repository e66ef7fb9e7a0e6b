"""Substring dedup: sliding sentence spans, hashed and joined over all texts.

A text is cut into sentences; a sentence of more than ``LONG`` words is cut
behind its commas, and what is longer still before words whose hash, with the
next word's, is the least among ``NEAR`` words on either side. Such a cut
depends on those words only, so a passage is cut alike behind any lead-in, but
for its edges. Stretches without such a word (periodic text) are cut every
``MOST`` words. Every run of ``RUN`` consecutive units with
at least ``LEAST_WORDS`` words is a span; spans with equal words (white space
apart) are equal. Of all equal spans, the one with the smallest (id, place)
is the first; the units that any other one covers are removed.

Spans carry 96 bits of hash. Their first occurrences come from a partial
aggregate, and only hashes that occur more than once are joined back, so a
passage in a third of all texts is an ordinary skewed join of narrow rows.

Defined results: a null text counts as empty; texts with fewer units than a
run keep them all; rows with a null id come after all others; rows that repeat
id and text are one document, so both keep their text; a text may become
empty. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import mix, pick, settle, slices, text_or_empty

RUN = 3
LEAST_WORDS = 12
LONG = 16
#: Words on either side that a cut inside a clause depends on; three units of
#: NEAR + 1 words, the shortest between two such cuts, have LEAST_WORDS.
NEAR = 3
MOST = 60

_SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
_CLAUSES = re.compile(r"[^,;:]*[,;:]+\s*|[^,;:]+")
_WORD = re.compile(r"\S+\s*|\s+")
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_B = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _cuts(words: list[str]) -> list[int]:
    """Where a long clause is cut: places of the words that begin a unit."""
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    pair = own[:-1] * _A[0] + own[1:] * _A[1]
    pair ^= pair >> np.uint64(32)
    n = len(pair) - 2 * NEAR
    middle = pair[NEAR : NEAR + n]
    least = np.ones(n, bool)
    for k in range(1, NEAR + 1):
        # of equal ones the first
        least &= (middle < pair[NEAR - k : NEAR - k + n]) & (middle <= pair[NEAR + k : NEAR + k + n])
    out = [0]
    for place in [*(np.flatnonzero(least) + NEAR).tolist(), len(words)]:
        out += range(out[-1] + MOST, place, MOST)
        out.append(place)
    return out


def units(text: str) -> Iterator[str]:
    """The text's units; joined together they are the text."""
    for sentence in _SENTENCES.findall(text):
        if len(sentence) <= 2 * LONG or len(sentence.split()) <= LONG:
            yield sentence
            continue
        for clause in _CLAUSES.findall(sentence):
            words = clause.split()
            if len(words) <= LONG:
                yield clause
                continue
            pieces = _WORD.findall(clause)
            if len(pieces) > len(words):  # leading space
                pieces[:2] = [pieces[0] + pieces[1]]
            cuts = _cuts(words)
            for start, stop in zip(cuts, cuts[1:]):
                yield "".join(pieces[start:stop])


def spans(text: str) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of units; places, 64-bit and 32-bit hashes of the spans."""
    hashes, lengths = [], []
    for unit in units(text):
        words = unit.split()
        hashes.append(xxhash.xxh3_64_intdigest(" ".join(words)))
        lengths.append(len(words))
    n = len(hashes)
    if n < RUN:
        return n, np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int32)
    own, size = np.array(hashes, np.uint64), np.array(lengths)
    wide = np.lib.stride_tricks.sliding_window_view(own, RUN)
    place = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(size, RUN).sum(axis=1) >= LEAST_WORDS)
    first = mix((wide[place] * _A).sum(axis=1, dtype=np.uint64)).view(np.int64)
    second = (mix((wide[place] * _B).sum(axis=1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return n, place.astype(np.int32), first, second


def covered(places: list[int]) -> set[int]:
    return {unit for p in places for unit in range(p, p + RUN)}


def document_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans (array<struct<place, h1, h2>>)."""

    def run(batches):
        for batch in slices(batches, "text"):
            found = [spans(t) for t in batch.column("text").to_pylist()]
            at = pa.array(np.concatenate(([0], np.cumsum([len(f[1]) for f in found]))).astype(np.int32))
            columns = [pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2, 3)]
            rows = pa.StructArray.from_arrays(columns, ["place", "h1", "h2"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.ListArray.from_arrays(at, rows)], ["doc_id", "key", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, key long, spans array<struct<place:int,h1:long,h2:int>>")


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences, n_removed, spans (places of
    the removed runs, ascending), text (what is left)."""
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text", text_or_empty())
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    held = settle(document_spans(rows.select("doc_id", "key", "text")))
    each = held.select("doc_id", "key", F.explode("spans").alias("s")).select("s.h1", "s.h2", "doc_id", "key", "s.place")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key", "place")
    repeated = settle(each.groupBy("h1", "h2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("h1", "h2", "first.key", "first.place").toDF("h1", "h2", "first_key", "first_place"))
    later = each.join(repeated, ["h1", "h2"]).where("key <> first_key OR place <> first_place")
    cuts = settle(later.groupBy("key").agg(F.array_sort(F.collect_set("place")).alias("places")))
    joined = rows.join(cuts, "key", "left").select("doc_id", "text", "places")

    def run(batches):
        for batch in slices(batches, "text"):
            texts, places = batch.column("text").to_pylist(), batch.column("places").to_pylist()
            numbers, removed, left = [], [], []
            for text, cut in zip(texts, places):
                parts = list(units(text))
                gone = covered(cut or [])
                numbers.append(len(parts))
                removed.append(len(gone))
                left.append("".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
            spans = pa.array([p or [] for p in places], pa.list_(pa.int32()))
            columns = [batch.column("doc_id"), pa.array(numbers, pa.int64()), pa.array(removed, pa.int64()), spans, pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_sentences", "n_removed", "spans", "text"])

    kind = dict(rows.dtypes)["doc_id"]
    return joined.mapInArrow(run, f"doc_id {kind}, n_sentences long, n_removed long, spans array<int>, text string")
