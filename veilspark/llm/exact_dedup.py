"""Exact dedup over a cuckoo-filter index of live text digests.

The index is sharded by digest. A shard holds a cuckoo filter (16-bit
fingerprints in buckets of four) and, as its bucketed content, one stored row
per live digest: SHA-256 of the normalised text, the smallest id that has it,
and how many live rows do. A filter miss proves a digest new; a hit is
verified against the stored digest, since fingerprints collide. Deleting a row
lowers the count; the last one takes the fingerprint out of the filter. A
filter that overflows is doubled and refilled from the shard's stored keys.

Defined results: a null text counts as empty; rows with a null id take part,
sort last as keepers and never replace an id; rows repeating the keeper's id
share its decision; ids are of any type that has an order; an empty table
gives an empty index. Input columns other than the id and the text are never
read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import SPACE, distribute, pick, settle, text_or_empty, unused

SLOTS = 4
KICKS = 500
#: Distinct digests aimed at for one shard when an index is made.
SHARD_ROWS = 32_768
#: Ids and digests of dropped rows up to this size go to every executor; beyond it the texts are shuffled.
BROADCAST_BYTES = 32_000_000
#: Pre-aggregated rows a digest brings at most in one batch.
SALTS = 16


class CuckooFilter:
    """Partial-key cuckoo filter. ``insert`` returns False on overflow; the
    filter is then unchanged but for one displaced fingerprint, so the caller
    must rebuild it at twice the size from its own keys."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = array("H", cells) if cells else array("H", bytes(2 * SLOTS * buckets))

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1
        while buckets * SLOTS * 0.85 < keys:
            buckets *= 2
        return cls(buckets)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[8:16], "big") & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def _slot(self, bucket: int, mark: int) -> int:
        cells, start = self.cells, bucket * SLOTS
        for i in range(start, start + SLOTS):
            if cells[i] == mark:
                return i
        return -1

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        return self._slot(a, mark) >= 0 or self._slot(b, mark) >= 0

    def insert(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if (i := self._slot(bucket, 0)) >= 0:
                self.cells[i] = mark
                return True
        bucket = b
        for kick in range(KICKS):
            i = bucket * SLOTS + (mark + kick) % SLOTS
            mark, self.cells[i] = self.cells[i], mark
            bucket = self._other(bucket, mark)
            if (i := self._slot(bucket, 0)) >= 0:
                self.cells[i] = mark
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self._places(digest)
        for bucket in (a, b):
            if (i := self._slot(bucket, mark)) >= 0:
                self.cells[i] = 0
                return True
        return False


class Shard:
    """One shard's filter and stored keys; values are [keep_id, live rows]."""

    def __init__(self, keys: dict[bytes, list], cuckoo: CuckooFilter | None):
        self.keys = keys
        self.filter = cuckoo or self._refilled(CuckooFilter.sized(len(keys)).buckets)

    def _refilled(self, buckets: int) -> CuckooFilter:
        while True:
            cuckoo = CuckooFilter(buckets)
            if all(cuckoo.insert(k) for k in self.keys):
                return cuckoo
            buckets *= 2

    def insert(self, digest: bytes, doc_id: int | None, rows: int) -> None:
        if digest in self.filter and (entry := self.keys.get(digest)):
            entry[0] = doc_id if entry[0] is None else entry[0] if doc_id is None else min(entry[0], doc_id)
            entry[1] += rows
            return
        self.keys[digest] = [doc_id, rows]
        if not self.filter.insert(digest):
            self.filter = self._refilled(self.filter.buckets * 2)

    def delete(self, digest: bytes, rows: int) -> None:
        if digest not in self.filter or not (entry := self.keys.get(digest)):
            return
        entry[1] -= rows
        if entry[1] <= 0:
            del self.keys[digest]
            self.filter.delete(digest)


#: Rows of a shard in the order in which they are taken.
_KINDS = ("filter", "key", "delete", "insert")
_COLUMNS = ["shard", "kind", "digest", "keep_id", "live", "buckets", "cells"]


def _state(id_type: str) -> str:
    return f"shard long, kind int, digest binary, keep_id {id_type}, live long, buckets long, cells binary"


def _applied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard by shard of sorted rows: the stored filter and keys, then the
    batch, deletions first. Ids are never numbers of another type on the way."""
    number, shard, held, stored = None, None, [], None
    for batch in batches:
        id_type, done = batch.column("keep_id").type, []
        for row in zip(*(batch.column(c).to_pylist() for c in _COLUMNS)):
            if row[0] != number:
                if number is not None:
                    done.append((number, shard or Shard(dict(held), stored)))
                number, shard, held, stored = row[0], None, [], None
            kind, (digest, doc_id, live, buckets, cells) = _KINDS[row[1]], row[2:]
            if kind == "filter":
                stored = CuckooFilter(buckets, cells)
            elif kind == "key":
                held.append((digest, [doc_id, live]))
            else:
                shard = shard or Shard(dict(held), stored)
                if kind == "delete":
                    shard.delete(digest, live)
                else:
                    shard.insert(digest, doc_id, live)
        for ready in done:
            yield _rows_of(*ready, id_type)
    if number is not None:
        yield _rows_of(number, shard or Shard(dict(held), stored), id_type)


def _rows_of(number: int, shard: Shard, id_type: pa.DataType) -> pa.RecordBatch:
    rows = [(number, _KINDS.index("filter"), None, None, None, shard.filter.buckets, shard.filter.cells.tobytes())]
    rows += [(number, _KINDS.index("key"), d, i, live, None, None) for d, (i, live) in shard.keys.items()]
    kinds = [pa.int64(), pa.int32(), pa.binary(), id_type, pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _COLUMNS)


@dataclass(frozen=True)
class ExactIndex:
    """``state`` holds the stored keys and the filters, one table."""

    state: DataFrame
    shards: int

    @property
    def keys(self) -> DataFrame:
        """digest, keep_id, live: one row per live digest."""
        return self.state.where(F.col("kind") == _KINDS.index("key")).select("digest", "keep_id", "live")

    def update(self, inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> ExactIndex:
        """A new index with the rows (doc_id, digest) of ``deletes`` taken out
        and those of ``inserts`` put in. A deleted keeper's id stays the
        group's name until ``rename_keepers``."""
        parts = [self.state]
        for kind, rows in (("delete", deletes), ("insert", inserts)):
            if rows is not None:
                # at most SALTS rows of a digest reach its shard, whatever the size of its group
                salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)) if kind == "insert" else F.lit(0)
                batch = rows.groupBy("digest", salt.alias("salt")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("live"))
                parts.append(
                    batch.select(
                        F.pmod(F.xxhash64("digest"), F.lit(self.shards)).alias("shard"), F.lit(_KINDS.index(kind)).alias("kind"), "digest", "keep_id", "live",
                        F.lit(None).cast("long").alias("buckets"), F.lit(None).cast("binary").alias("cells"),
                    )
                )
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        dealt = distribute(rows, "shard").sortWithinPartitions("shard", "kind").select(_COLUMNS)
        return replace(self, state=settle(dealt.mapInArrow(_applied, _state(dict(self.state.dtypes)["keep_id"]))))

    def rename_keepers(self, live: DataFrame) -> ExactIndex:
        """Keepers recomputed from the live rows (doc_id, digest)."""
        least = live.groupBy("digest").agg(F.min("doc_id").alias("least"))
        state = self.state.join(least, "digest", "left").withColumn("keep_id", F.when(F.col("kind") == _KINDS.index("key"), F.col("least")))
        return replace(self, state=settle(state.select(*self.state.columns)))

    def decide(self, rows: DataFrame) -> DataFrame:
        """doc_id, digest, keep_id, group_size, kept for rows (doc_id, digest)
        that are in the index. Only digests with several rows are joined."""
        groups = settle(self.keys.where("live > 1"))
        joined = rows.join(groups, "digest", "left")
        return joined.select(
            "doc_id", "digest",
            F.when(F.col("live").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("live", F.lit(1)).cast("long").alias("group_size"),
        ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 (binary) of the text with runs of ASCII white
    space replaced by one space."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.select("doc_id", F.unhex(F.sha2(F.regexp_replace(text_or_empty(), SPACE, " "), 256)).alias("digest"))


def empty_index(spark: SparkSession, expected_rows: int, id_type: str = "bigint") -> ExactIndex:
    return ExactIndex(spark.createDataFrame([], _state(id_type)), max(1, -(-expected_rows // SHARD_ROWS)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept. Of
    equal texts the row with the smallest id stays."""
    rows = settle(digests(docs, id_col, text_col))
    index = empty_index(docs.sparkSession, rows.count(), dict(rows.dtypes)["doc_id"])
    return index.update(inserts=rows).decide(rows)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns with one row of each text: the one of the
    smallest id (a null id only where no row has one); of rows that repeat it,
    one."""
    verdict = settle(exact_dedup(docs, id_col, text_col).where("group_size > 1"))
    id_, digest = unused(docs, "gone_id"), unused(docs, "gone_digest")
    gone = settle(verdict.where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("digest").alias(digest)))
    again = settle(verdict.where("kept").groupBy(F.col("digest").alias(digest)).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    width = F.octet_length(F.coalesce(F.col(id_).cast("string"), F.lit(""))) + 64
    if (gone.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    own = docs.withColumn(unused(docs, "own_digest"), F.unhex(F.sha2(F.regexp_replace(text_or_empty(text_col), SPACE, " "), 256)))
    name = own.columns[-1]
    kept = own.join(gone, F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(name) == F.col(digest)), "left_anti")
    if not again.isEmpty():
        same = F.col(name) == F.col(digest)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([name]))
    return kept.select(*docs.columns)
