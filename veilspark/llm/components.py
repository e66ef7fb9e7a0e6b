"""Connected components of a graph given as edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import settle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _star(pairs: DataFrame, keep: Column, own: bool) -> DataFrame:
    """Neighbours of each u that pass ``keep`` are tied to the least of them
    and u. The least is a partial aggregate; a u with very many neighbours is
    an ordinary skewed join, which the session splits."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.where(keep).join(settle(least), "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if own:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """node, component for every node that has an edge; the component is its
    least node. Self edges and repeated edges do no harm; no edges, no rows."""
    now = settle(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    )
    before = None
    for _ in range(max_rounds):
        state = _state(now)
        if state == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = settle(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = settle(_star(both, F.col("v") > F.col("u"), own=True))
        now = settle(_star(large, F.col("v") <= F.col("u"), own=True))
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")
