"""Global row numbers by range partitioning, and whole runs of sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle


def ranked(df: DataFrame, *order: str, out: str = "rank") -> DataFrame:
    """Rows with their 0-based place in the order of the named columns (nulls
    first, strings bytewise), as a table. Spark samples the keys and cuts them
    into ranges, each sorted by its own task; only one count per range is
    brought together. Where many rows may be alike the last column should
    tell them apart, so that a range can end among them. ``df`` is read twice
    and should be a written table."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = settle(placed.withColumns({"range_no": F.spark_partition_id(), "range_row": inside}))
    ends = placed.groupBy("range_no").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("range_start"))
    # one row a range, so it is sent to all
    whole = placed.join(F.broadcast(starts), "range_no")
    return whole.select(*df.columns, (F.col("range_start") + F.col("range_row")).alias(out))


def whole_runs(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys (integers, not null) of sorted
    batches; a run is held until its last row has come."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[-1].as_py() for k in keys]
        same = np.logical_and.reduce([np.asarray(batch.column(k)) == v for k, v in zip(keys, last)])
        start = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if start == 0 and held and all(held[-1].column(k)[-1].as_py() == v for k, v in zip(keys, last)):
            held.append(batch)
            continue
        ready = pa.Table.from_batches([*held, batch.slice(0, start)] if start else held) if held or start else None
        if ready is not None and ready.num_rows:
            yield ready.combine_chunks()
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def edges(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end of the last."""
    n = len(columns[0])
    change = np.zeros(n, bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.concatenate(([0], np.flatnonzero(change), [n])) if n else np.zeros(1, np.int64)
