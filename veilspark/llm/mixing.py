"""Mixing sources to target weights by a multivariate-hypergeometric tree.

Every source's documents are hashed into blocks of a few documents. A source
whose target is r times its size passes its blocks floor(r) times whole, and
once more in part; each pass permutes the blocks anew. The part ends at the
block where its words reach the target, found by two rounds of bin sums. The
gap is closed by single documents: those that fit are taken along the
permutation in the same way, the next ones largest first, and again from what
remains, until no document of the source that was not taken fits the gap.

The number of blocks each source gives is then exact. A binary tree deals
these quotas to the output shards: a node draws how many blocks of each source
go left from the multivariate hypergeometric law, as if all blocks had been
shuffled together. Draws depend on the node alone, so every leaf replays its own
path and nothing passes through the driver. A shard takes the next unused
blocks of each source's permutation and shuffles its documents locally.

Rows are named by a digest of id, source and text, and rows that are alike by
their number among them, so that draws and ties depend on content alone, not
on partitions. Totals, targets and quotas are tables by source. The tree deals
the ``POOL`` sources of the largest quotas one by one; the blocks of all others
are first shuffled into one sequence, which is dealt like one more source: of
blocks shuffled together any run is a draw from the same law. Blocks grow with
the table, so that there are always fewer than the law's generator can take.

Defined results: null text has size 0; a null source is a source, ordered last;
sources of size 0 get target 0; rows that repeat are rows of their own; ids may
be null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.operators.ordinal import with_ordinal

from .common import pick, settle, text_or_empty, unused
from .runs import ranked

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
#: Sources that the tree deals one by one; the others' blocks are pooled.
POOL = 4096
#: Documents of a block; more where there would be over MOST_BLOCKS blocks.
BLOCK_DOCS = 8
MOST_BLOCKS = 500_000_000
#: Rows that are alike are numbered in chunks of so many.
ALIKE = 10_000
#: Bytes of the table of sources that every executor may get.
BROADCAST_BYTES = 16_000_000
SHARD_WORDS = 4_000_000
#: Bins of a source's permuted blocks in each of two rounds.
BINS = 1024
#: Blocks behind a boundary whose documents are tried largest first.
CLOSING = 8
SEED = 20_240_607


def key_of(doc_id: Column, source: Column, text: Column) -> Column:
    """Digest of a row's id, source and text."""
    given = [F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in (doc_id, source, text)]
    return F.unhex(F.md5(F.concat(*given)))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, key, size in words."""
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    words = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    return rows.select("doc_id", "source", key_of(F.col("doc_id"), F.col("source"), F.col("text")).alias("key"), words.alias("size"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``copies`` (how many are alike), ``copy`` (0 for the first of
    them) and ``row``, a name made of both: counted and spread again, so that no
    order among them is asked for."""
    alike = rows.groupBy("key").agg(*[F.any_value(c).alias(c) for c in ("doc_id", "source", "size")], F.count("*").alias("copies"))
    chunks = alike.withColumn("from_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(ALIKE).cast("long"))))
    upto = F.least(F.col("from_copy") + ALIKE, F.col("copies")) - 1
    each = chunks.withColumn("copy", F.explode(F.sequence(F.col("from_copy"), upto))).drop("from_copy")
    return each.withColumn("row", F.unhex(F.md5(F.concat(F.hex("key"), F.lit(":"), F.col("copy").cast("string")))))


def targeted(totals: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS) -> DataFrame:
    """``totals(source, size, ...)`` with number (place in code-point order,
    null last) and target, in words: shares of the whole by weight (the weights
    repeat over the sources), at most ``most`` times the source's size; what is
    cut off is shared anew until none is above.

    A share only grows when others are cut off, so the sources cut off are
    those above their limit at the last unit, and each round is one aggregate.
    """
    order = settle(totals.withColumn("none", F.col("source").isNull()))
    rows = ranked(order, "none", "source", out="number").drop("none")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = settle(rows.withColumn("weight", weight))
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(38,10)")), F.lit(0))
    unit, before = 0.0, -1
    while True:
        cut = F.lit(unit) * F.col("weight") > most * F.col("size")
        n, words, open_ = rows.agg(F.coalesce(F.sum(cut.cast("long")), F.lit(0)), exact(F.when(cut, F.col("size") * most).otherwise(0)), exact(F.when(~cut, F.col("weight")).otherwise(0))).first()
        if n == before or not open_:
            break
        before, whole = n, rows.agg(exact(F.col("size"))).first()[0]
        unit = float(whole - words) / float(open_)
    return rows.withColumn("target", F.when(cut, F.col("size") * float(most)).otherwise(F.lit(unit) * F.col("weight"))).drop("weight")


def _permutation(number: int, round_: int, blocks: int) -> tuple[int, int]:
    """factor, shift of the permutation b -> (factor * b + shift) mod blocks."""
    rng = np.random.default_rng([SEED, number, round_])
    factor = int(rng.integers(1, blocks + 1))
    while gcd(factor, blocks) != 1:
        factor = factor % blocks + 1
    return factor, int(rng.integers(0, blocks))


_TURNS = "number long, factors array<long>, shifts array<long>"


def _plan(rows: DataFrame, weights, most) -> DataFrame:
    """One row per source: number, source, source_size, target, blocks, passes,
    part (words of the partial pass), factors and shifts of all passes."""
    totals = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    whole = totals.agg(F.sum("n")).first()[0] or 0
    block_docs = max(BLOCK_DOCS, -(-int(whole * (most + 1)) // MOST_BLOCKS))
    goal = targeted(totals, weights, most).withColumnRenamed("size", "source_size")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = goal.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("n") / block_docs)).cast("long"), "passes": passes})
    goal = settle(goal.withColumn("part", F.col("target") - F.col("passes") * F.col("source_size")).drop("n"))

    def turns(batches):
        for batch in batches:
            drawn = [[_permutation(number, p, blocks) for p in range(n + 1)] for number, blocks, n in zip(*(batch.column(c).to_pylist() for c in ("number", "blocks", "passes")))]
            lists = [pa.array([[t[k] for t in row] for row in drawn], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("number"), *lists], ["number", "factors", "shifts"])

    drawn = goal.select("number", "blocks", "passes").mapInArrow(turns, _TURNS)
    return settle(goal.join(drawn, "number"))


def _small(plan: DataFrame) -> bool:
    """Whether one row per source may go to every executor."""
    return (plan.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 200)).first()[0] or 0) <= BROADCAST_BYTES


def _hint(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def _place(turn: Column) -> Column:
    """The permuted place of a row's block in a pass."""
    at = lambda c: F.element_at(c, (turn + 1).cast("int"))
    product = at("factors").cast("decimal(38,0)") * F.col("block") + at("shifts")
    return F.pmod(product, F.col("blocks").cast("decimal(38,0)")).cast("long")


def _boundary(binned: DataFrame, bin_col: str, start: str) -> DataFrame:
    """Per source the bin in which the words so far, from ``start`` on, pass
    the part, and the words before it. A source has BINS bins at most."""
    per = binned.groupBy("number", bin_col).agg(F.sum("size").alias("words"), F.first("part").alias("part"), F.first(start).alias("start"))
    run = Window.partitionBy("number").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    before = per.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(run), F.lit(0)))
    return before.where("before <= part").groupBy("number").agg(F.max(bin_col).alias("edge"), F.max("before").alias("before"))


def _edges(rows: DataFrame, small: bool) -> DataFrame:
    """number, fine1 (the fine bin in which a source's words pass its part),
    before2 (the words before it)."""
    one = settle(_boundary(rows, "bin", "zero").select("number", F.col("edge").alias("bin1"), F.col("before").alias("before1")))
    inside = rows.join(_hint(one, small), "number").where("bin = bin1")
    return settle(_boundary(inside, "fine", "before1").select("number", F.col("edge").alias("fine1"), F.col("before").alias("before2")))


def _closing(rows: DataFrame, small: bool) -> DataFrame:
    """row of the documents that close the gaps. Every round takes one document
    of a source at least, and one that it tried and left is above the new gap,
    so those that fit halve on average."""

    def close(frame: pd.DataFrame) -> pd.DataFrame:
        gap = float(frame["part"].iloc[0] - frame["before2"].iloc[0])
        taken = set()
        for row, size in frame.sort_values(["size", "fine", "row"], ascending=[False, True, True])[["row", "size"]].itertuples(index=False):
            if size <= gap:
                taken.add(row)
                gap -= size
        # looked up one by one: arrays of bytes would lose zeros at the end
        return frame[[row in taken for row in frame["row"]]][["row", "number", "size"]]

    rest = rows.where("part > 0 AND NOT whole AND size > 0").withColumn("part", F.col("part") - F.col("before2"))
    rest = settle(rest.where("size <= part").select("number", "row", "size", "blocks", "fine", "bin", "zero", "part"))
    out = rest.select("row").limit(0)
    while not rest.isEmpty():
        placed = rest.join(_hint(_edges(rest, small), small), "number")
        width = F.greatest(F.lit(1.0), F.ceil(F.lit(float(BINS * BINS)) / F.col("blocks"))) * CLOSING
        near = placed.where((F.col("fine") >= F.col("fine1")) & (F.col("fine") < F.col("fine1") + width))
        last = near.select("number", "row", "size", "fine", "part", "before2").groupBy("number").applyInPandas(close, "row binary, number long, size long")
        taken = settle(placed.where("fine < fine1").select("row", "number", "size").unionByName(last))
        out = out.unionByName(taken.select("row"))
        words = taken.groupBy("number").agg(F.sum("size").alias("words"))
        rest = rest.join(taken.select("row"), "row", "left_anti").join(_hint(words, small), "number").withColumn("part", F.col("part") - F.col("words"))
        rest = settle(rest.where("size <= part").drop("words"))
    return out


def draw(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: row, key, copy, copies, doc_id, number, source,
    size, source_size, target, block, blocks, passes, factors, shifts, whole
    (its block is in the partial pass), extra (it closes the gap)."""
    first = settle(_numbered(sizes(docs, id_col, text_col, source_col)))
    plan = _plan(first, weights, most)
    small = _small(plan)
    rows = first.join(_hint(plan.withColumnRenamed("source", "source_"), small), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "row"), F.col("blocks")))
    rows = settle(rows.withColumn("place", _place(F.col("passes"))))
    # a place among BINS * BINS fine bins of its source
    fine = F.floor(F.col("place") * F.lit(float(BINS * BINS)) / F.col("blocks")).cast("long")
    rows = rows.withColumn("fine", fine).withColumn("bin", F.floor(fine / BINS)).withColumn("zero", F.lit(0).cast("long"))
    rows = rows.join(_hint(_edges(rows, small), small), "number", "left").withColumn("whole", F.coalesce(F.col("fine") < F.col("fine1"), F.lit(False)))

    extra = _closing(rows, small)
    rows = rows.join(extra.withColumn("extra", F.lit(True)), "row", "left").withColumn("extra", F.coalesce("extra", F.lit(False)))
    keep = ["row", "key", "copy", "copies", "doc_id", "number", "source", "size", "source_size", "target", "block", "blocks", "passes", "factors", "shifts", "whole", "extra", "fine1"]
    return settle(rows.select(*keep))


def quotas(rows: DataFrame) -> DataFrame:
    """number, quota: the exact number of blocks each source gives in all its
    passes; blocks count whether or not a document fell into them."""
    per = rows.groupBy("number").agg(F.max("blocks").alias("blocks"), F.max("passes").alias("passes"), F.max("fine1").alias("fine1"))
    part = F.ceil(F.col("fine1") * F.col("blocks") / float(BINS * BINS)).cast("long")
    return per.select("number", (F.col("passes") * F.col("blocks") + F.coalesce(part, F.lit(0))).alias("quota"))


def _split(rng: np.random.Generator, quota: np.ndarray, left: int) -> np.ndarray:
    """Blocks of each source among ``left`` ones drawn from all: one
    hypergeometric draw per source, given those before."""
    out, rest = np.zeros_like(quota), int(quota.sum())
    for i, q in enumerate(quota.tolist()):
        rest -= q
        out[i] = rng.hypergeometric(q, rest, left) if left and q else 0
        left -= int(out[i])
    return out


def leaf(quota: np.ndarray, shard: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of every source for one shard: the
    path from the root of a tree of 2**depth leaves, replayed."""
    begin = np.zeros_like(quota)
    for level in range(depth):
        node = shard >> (depth - level)
        left = _split(np.random.default_rng([SEED, level, node]), quota, int(quota.sum()) // 2)
        if shard >> (depth - level - 1) & 1:
            begin, quota = begin + left, quota - left
        else:
            quota = left
    return begin, quota


def _pooled(quota: DataFrame) -> DataFrame:
    """number, index, pooled: the blocks of the quotas in one shuffled sequence."""
    blocks = quota.select("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("index"))
    blocks = settle(blocks.withColumn("drawn", F.xxhash64(F.lit(SEED), "number", "index")))
    return ranked(blocks, "drawn", "number", "index", out="pooled").drop("drawn")


def deal(rows: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every document the mix takes, once per time it is taken: row, key, copy,
    copies, doc_id, source, size, turn, shard, position (inside the shard)."""
    spark = rows.sparkSession
    per = settle(quotas(rows).where("quota > 0"))
    # POOL + 1 rows at most come to the driver
    largest = sorted((r["number"], r["quota"]) for r in per.orderBy(F.desc("quota"), "number").limit(POOL).collect())
    others = per.where(~F.col("number").isin([n for n, _ in largest])) if len(largest) == POOL else per.limit(0)
    rest = others.agg(F.sum("quota")).first()[0] or 0
    numbers = [n for n, _ in largest] + [-1]
    counts = np.array([q for _, q in largest] + [rest], np.int64)
    words = rows.agg(F.sum(F.col("size") * (F.col("passes") + (F.col("whole") | F.col("extra")).cast("int")))).first()[0] or 0
    depth = max(0, int(np.ceil(np.log2(max(1, words / shard_words)))))

    def leaves(batches):
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                begin, n = leaf(counts, shard, depth)
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(begin), pa.array(n), pa.array([shard] * len(numbers), pa.int64())], ["number", "begin", "n", "shard"])

    ranges = spark.range(0, 1 << depth).mapInArrow(leaves, "number long, begin long, n long, shard long").where("n > 0")
    blocks = ranges.select("number", "shard", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("index"))
    if rest:
        pool = blocks.where("number = -1").select(F.col("index").alias("pooled"), "shard")
        blocks = blocks.where("number >= 0").unionByName(_pooled(others).join(pool, "pooled").select("number", "shard", "index"))
    own = ["row", "key", "copy", "copies", "doc_id", "source", "size"]
    turns = rows.select(
        *own, "number", "block", "blocks", "factors", "shifts",
        F.explode(F.filter(F.sequence(F.lit(0), F.col("passes")), lambda t: (t < F.col("passes")) | F.col("whole"))).alias("turn"),
    )
    turns = turns.select(*own, "number", "turn", (F.col("turn") * F.col("blocks") + _place(F.col("turn"))).alias("index"))
    dealt = turns.join(blocks, ["number", "index"]).drop("number", "index")
    closing = rows.where("extra").select(*own, F.col("passes").alias("turn"), F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(1 << depth)).alias("shard"))
    return dealt.unionByName(closing).withColumn("position", F.xxhash64(F.lit(SEED), "shard", "turn", "row"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, times,
    taken (words), shards (those it was dealt to)."""
    rows = draw(docs, weights, most, id_col, text_col, source_col)
    taken = deal(rows).groupBy("row").agg(F.count("*").alias("times"), F.sum("size").alias("taken"), F.array_sort(F.collect_list("shard")).alias("shards"))
    out = rows.join(taken, "row", "left")
    return out.select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("times", F.lit(0)).cast("long").alias("times"),
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards"),
    )


#: Dealt rows (about 60 bytes each) sent to every executor; more are joined by shuffle.
SMALL_ROWS = 250_000


def remix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the input's columns, each row as often as it is taken,
    shards together and shuffled inside. Rows are told apart by id, source and
    text; of rows alike in these each is taken as often as its number says."""
    dealt = settle(deal(draw(docs, weights, most, id_col, text_col, source_col)).select("key", "copy", "copies", "shard", "position"))
    key, copy, shard, position = (unused(docs, f"mix_{c}") for c in ("key", "copy", "shard", "position"))
    own = docs.withColumn(key, key_of(F.col(id_col), F.col(source_col), F.col(text_col)))
    where = [F.col("key").alias(key), F.col("shard").alias(shard), F.col("position").alias(position)]
    single = dealt.where("copies = 1").select(*where)
    if single.count() <= SMALL_ROWS:
        single = F.broadcast(single)
    out = own.join(single, key)
    several = dealt.where("copies > 1").select(*where, F.col("copy").alias(copy))
    if not several.isEmpty():
        alike = own.join(several.select(key).distinct(), key, "left_semi").withColumn(unused(docs, "mix_place"), F.monotonically_increasing_id())
        place = F.col(alike.columns[-1])
        # numbered partition by partition, so that many rows alike need not meet
        alike = with_ordinal(alike, [key], [place], [F.shiftright(place, 33)], out=copy).withColumn(copy, F.col(copy) - 1).drop(alike.columns[-1])
        out = out.unionByName(alike.join(several, [key, copy]).select(*out.columns))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt_out = out.repartition(parts, shard, F.pmod(position, F.lit(16))).sortWithinPartitions(shard, position)
    return dealt_out.select(*docs.columns)
