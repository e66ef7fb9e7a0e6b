"""Row numbers inside groups of any size.

``row_number() over (partition by group)`` puts a whole group into one task.
Here a group is cut into blocks by columns that are monotone in the order (for
example ``floor(position / 65536)``); rows are numbered inside their block and
each block starts where the blocks before it ended. Only one small row per
block is ever brought together per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 65_536


def block_of(position: Column | str, width: int = BLOCK) -> Column:
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / width).cast("bigint")


def with_ordinal(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    blocks: Sequence[Column],
    out: str = "ordinal",
    total: str | None = None,
    levels: int = 0,
) -> DataFrame:
    """1-based rank of each row in its group by ``order``.

    ``blocks`` must be non-decreasing along ``order``; ``order`` must be unique
    inside a group. ``total`` optionally names a column for the group size.
    ``levels`` gathers the blocks themselves so many times into blocks of
    ``BLOCK``, for positions that may be far apart (hashes), where the blocks
    of one group are nearly as many as its rows.
    """
    names = [f"_b{i}" for i in range(len(blocks))]
    keyed = df.select("*", *[b.alias(n) for b, n in zip(blocks, names)])
    cell = [*group, *names]
    sizes = keyed.groupBy(*cell).agg(F.count("*").alias("_n"))
    starts = _starts(sizes, list(group), names, levels)
    if total:
        whole = sizes.groupBy(*group).agg(F.sum("_n").alias(total))
        starts = starts.join(whole.toDF(*[f"_g{i}" for i in range(len(group))], total), _same(starts, group, [f"_g{i}" for i in range(len(group))])).select(*cell, "_start", total)
    numbered = keyed.withColumn("_k", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
    same = [numbered[c].eqNullSafe(starts[c]) for c in cell]
    condition = same[0]
    for s in same[1:]:
        condition = condition & s
    joined = numbered.join(starts, condition).select(
        *[numbered[c] for c in df.columns],
        (F.col("_start") + F.col("_k")).alias(out),
        *([starts[total]] if total else []),
    )
    return joined


def _same(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> Column:
    condition = F.lit(True)
    for a, b in zip(left, right):
        condition = condition & df[a].eqNullSafe(F.col(b))
    return condition


def _starts(sizes: DataFrame, group: list[str], names: list[str], levels: int) -> DataFrame:
    """group, names, _start: the rows of the group in the blocks before."""
    cell = [*group, *names]
    if not levels:
        upto = Window.partitionBy(*group).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
        return sizes.select(*cell, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    above = [*names[:-1], f"_up{levels}"]
    keyed = sizes.withColumn(above[-1], block_of(names[-1]))
    outer = _starts(keyed.groupBy(*group, *above).agg(F.sum("_n").alias("_n")), group, above, levels - 1)
    renamed = [f"_o{levels}_{i}" for i in range(len(group) + len(above))]
    upto = Window.partitionBy(*group, *above).orderBy(names[-1]).rowsBetween(Window.unboundedPreceding, -1)
    inner = keyed.withColumn("_in", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    joined = inner.join(outer.toDF(*renamed, "_out"), _same(inner, [*group, *above], renamed))
    return joined.select(*cell, (F.col("_in") + F.col("_out")).alias("_start"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key: a partial aggregate, so copies of one key never
    meet in one task beyond a single candidate per upstream partition."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min_by(F.struct(*[F.col(c) for c in [*order, *rest]]), F.struct(*[F.col(c) for c in order]))
    picked = df.groupBy(*keys).agg(best.alias("_best"))
    return picked.select(
        *[F.col(f"_best.{c}").alias(c) if c not in keys else F.col(c) for c in df.columns]
    )
