"""Near-duplicate texts by SetSketch registers, banded, estimated, verified.

1. Every document's shingle set becomes registers; equal sets become one node,
   whose copies only count as membership.
2. Nodes meet in buckets of equal bands. Each bucket's least node is compared
   with all others (a star); estimates by likelihood drop pairs that are far
   from the limit, full sets confirm the rest, and links are joined to
   components.
3. In buckets that still hold several components, every pair across components
   is compared in the same way, block against block for large buckets. A pair
   is taken up in the first band that both share. So a large group of copies
   costs time in proportion to its size, and pairs are tried exhaustively only
   where no link has been found yet; none is dropped.

A pair at the limit shares no band with probability (1 - J**ROWS)**BANDS, below
3e-7 at J = 0.75 if registers were independent; the estimate spreads by 0.034
there (measured), so its margin of 0.2 is about six standard errors.

Rows are named by a digest of id and text, so that null or repeated ids are
told apart: a row's set is sent once to each task that wants it, and rows are
dropped one by one. A bucket whose members hardly link (pages that share a
template) is compared pair by pair, exactly, in blocks: its time grows with the
square of its members.

Defined results: a null, empty or blank text has an empty set, links with
nothing, and is its own component. A row with a null id belongs to its set's
component; its own component is null where no row of it has an id. Repeated
rows are copies. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import setsketch as S
from .common import distribute, pick, release, settle, slices, unused
from .components import components

PERCENT = 75
#: Estimated similarities this far below the limit are not verified.
MARGIN = 0.2
#: Members of a bucket compared in one piece.
BLOCK = 1024
#: Shingles (8 bytes each) of the sets that one task holds, about.
TASK_SHINGLES = 1_000_000
#: Row digests (16 bytes each, with task numbers about 50) sent to every executor to pick texts; more are joined by shuffle.
SMALL_IDS = 500_000

_SKETCH = "spot binary, node binary, n_shingles long, registers binary, bands array<long>"


def spot_of(doc_id: Column, text: Column) -> Column:
    """Digest of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.coalesce(text, F.lit("")))))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spot (digest of id and text), node (digest of the shingle set),
    n_shingles, registers, bands; the last three are null or 0 for an empty set."""

    def run(batches):
        yield from sketched(batches)
        release()

    def sketched(batches):
        for batch in slices(batches, "text"):
            sets = S.shingle_sets(batch.column("text").to_pylist())
            full = [i for i, s in enumerate(sets) if len(s)]
            rows: list = [None] * len(sets)
            keys: list = [None] * len(sets)
            if full:
                registers = S.sketch([sets[i] for i in full])
                for i, r, k in zip(full, registers, S.band_keys(registers)):
                    rows[i], keys[i] = r.tobytes(), k
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("spot"),
                    pa.array([S.digest(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(rows, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "spot", "node", "n_shingles", "registers", "bands"],
            )

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("spot", spot_of(F.col("doc_id"), F.col("text")))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {_SKETCH}")


def _task_sets(docs: DataFrame, nodes: DataFrame, where: DataFrame) -> DataFrame:
    """task, node, members (sorted hashes, 8 bytes each): the text of a row of
    each node is read again and its set sent to the tasks that want it."""

    def run(batches):
        seen = set()
        for batch in slices(batches, "text"):
            # rows that repeat id and text would bring a set again
            first = [i for i, x in enumerate(batch.column("spot").to_pylist()) if not (x in seen or seen.add(x))]
            batch = batch.take(pa.array(first, pa.int64()))
            sets = S.shingle_sets(batch.column("text").to_pylist()) if first else []
            columns = [batch.column("tasks"), pa.array([S.digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["tasks", "node", "members"])
        release()

    wanted = settle(nodes.join(where, "node").groupBy("spot").agg(F.collect_set("task").alias("tasks")))
    if nodes.count() <= SMALL_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.withColumn("spot", spot_of(F.col("doc_id"), F.col("text"))).join(wanted, "spot").select("spot", "text", "tasks")
    sets = texts.mapInArrow(run, "tasks array<long>, node binary, members binary")
    return sets.select(F.explode("tasks").alias("task"), "node", "members")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(-1, S.REGISTERS)


def _promising(regs: tuple, rows: tuple, sizes: tuple, percent: int) -> np.ndarray:
    """Places of the pairs whose registers let them reach the limit. ``rows``
    are the pairs' rows in the two matrices ``regs``."""
    small, large = np.minimum(*sizes), np.maximum(*sizes)
    left = np.flatnonzero(100 * small >= percent * large)
    out = []
    for start in range(0, len(left), 10_000):
        part = left[start : start + 10_000]
        near = S.estimate(regs[0][rows[0][part]], regs[1][rows[1][part]], sizes[0][part], sizes[1][part])
        out.append(part[near >= percent / 100 - MARGIN])
    return np.concatenate(out) if out else left


def _tasks(firsts: list[bytes], seconds: list[bytes], sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs packed so that a task needs sets of about TASK_SHINGLES shingles."""
    start, nodes, held = 0, set(), 0
    for i in range(len(firsts) + 1):
        if i == len(firsts) or held >= TASK_SHINGLES:
            if i > start:
                a, b = firsts[start:i], seconds[start:i]
                task = int.from_bytes(hashlib.blake2b(a[0] + b[0] + a[-1] + b[-1], digest_size=8).digest(), "big", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([a], pa.list_(pa.binary())), pa.array([b], pa.list_(pa.binary()))], ["task", "firsts", "seconds"])
            start, nodes, held = i, set(), 0
        if i < len(firsts):
            for node, size in ((firsts[i], sizes[0][i]), (seconds[i], sizes[1][i])):
                if node not in nodes:
                    nodes.add(node)
                    held += int(size)


def _links(pairs_of: list[tuple[bytes, list[bytes]]], sets: dict[bytes, np.ndarray], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """Links that join what earlier ones have not, found on the full sets: each
    first node is compared with all its mates at once."""
    root: dict[bytes, bytes] = {}

    def find(x):
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for first, mates in pairs_of:
        mates = [m for m in mates if find(m) != find(first)]
        for start in range(0, len(mates), BLOCK):
            part = mates[start : start + BLOCK]
            own, others = sets[first], [sets[m] for m in part]
            flat = np.concatenate(others)
            places = np.searchsorted(own, flat)
            places[places == len(own)] = 0
            lengths = np.array([len(o) for o in others])
            shared = np.add.reduceat((own[places] == flat).astype(np.int64), np.cumsum(lengths) - lengths)
            for i in np.flatnonzero(100 * shared >= percent * (len(own) + lengths - shared)):
                a, b = find(first), find(part[i])
                if a != b:
                    root[a] = b
                    yield first, part[i]


_PAIRS = "task long, firsts array<binary>, seconds array<binary>"


def _verify(pairs: DataFrame, docs: DataFrame, where: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among tasks' candidate pairs. A task's nodes bring their
    sets to it once, however many pairs they are in."""
    nodes = settle(pairs.select("task", F.explode(F.array_distinct(F.concat("firsts", "seconds"))).alias("node")))
    none = F.lit(None)
    rows = _task_sets(docs, nodes, where).select("task", "node", "members", none.cast("array<binary>").alias("firsts"), none.cast("array<binary>").alias("seconds"))
    rows = rows.unionByName(pairs.select("task", none.cast("binary").alias("node"), none.cast("binary").alias("members"), "firsts", "seconds"))

    def run(batches):
        task, sets, mates = None, {}, {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("task", "node", "members", "firsts", "seconds"))):
                if row[0] != task:
                    yield from _batches(_links(list(mates.items()), sets, percent))
                    task, sets, mates = row[0], {}, {}
                if row[1] is not None:
                    sets[row[1]] = np.frombuffer(row[2], np.uint64)
                else:
                    for a, b in zip(row[3], row[4]):
                        mates.setdefault(a, []).append(b)
        yield from _batches(_links(list(mates.items()), sets, percent))
        release()

    dealt = distribute(rows, "task").sortWithinPartitions("task", F.col("node").isNull())
    return settle(dealt.mapInArrow(run, "a binary, b binary"))


def _batches(links: Iterator[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
    found = list(links)
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*found)], ["a", "b"])


def _star_pairs(members: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Each node with the leaders of its buckets, once, where promising. Tasks
    are blocks of one leader's mates."""
    left = nodes.select("node", "n_shingles", "registers")
    right = nodes.select(F.col("node").alias("leader"), F.col("n_shingles").alias("n2"), F.col("registers").alias("registers2"))
    edges = settle(members.where("node <> leader").select("node", "leader").distinct())
    rows = edges.join(left, "node").join(right, "leader")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = tuple(np.asarray(batch.column(c), np.int64) for c in ("n_shingles", "n2"))
                regs = tuple(_matrix(batch.column(c).to_pylist()) for c in ("registers", "registers2"))
                place = np.arange(batch.num_rows)
                fit = _promising(regs, (place, place), sizes, percent)
                near = batch.take(pa.array(fit))
                yield from _tasks(near.column("leader").to_pylist(), near.column("node").to_pylist(), (sizes[1][fit], sizes[0][fit]))

    return rows.sortWithinPartitions("leader").mapInArrow(run, _PAIRS)


def _rest_pairs(members: DataFrame, nodes: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """Pairs across components in buckets that hold several, each in the first
    band the pair shares."""
    named = members.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    named = settle(named)
    split = named.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2").select("key")
    open_rows = settle(named.join(settle(split), "key"))
    per = open_rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = settle(per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("n_main")))
    # members outside a bucket's main component meet all members, block by block
    rows = open_rows.join(main, "key").withColumn("outside", F.col("component") != F.col("main"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    wide, high = blocks(F.col("n")), blocks(F.col("n") - F.col("n_main"))
    as_x = rows.select("key", "node", "component", F.lit(False).alias("first"), mine(wide).alias("xb"), F.explode(F.sequence(F.lit(0), high - 1)).alias("yb"))
    as_y = rows.where("outside").select("key", "node", "component", F.lit(True).alias("first"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("xb"), mine(high).alias("yb"))
    dealt = settle(as_x.unionByName(as_y))
    full = dealt.join(nodes.select("node", "n_shingles", "registers"), "node")
    parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "xb", "yb"]
    full = full.repartition(parts, *order).sortWithinPartitions(*order)

    def compare(t: pa.Table) -> tuple:
        """All promising pairs of some whole groups."""
        nodes_, comps_ = t.column("node").to_pylist(), t.column("component").to_pylist()
        number: dict = {}
        comp = np.array([number.setdefault(c, len(number)) for c in comps_])
        first = np.asarray(t.column("first").to_numpy(zero_copy_only=False), bool)
        size = np.asarray(t.column("n_shingles"), np.int64)
        keys = np.asarray(t.column("key"))
        regs = _matrix(t.column("registers").to_pylist())
        bands = S.band_keys(regs)
        group = np.zeros(len(keys), np.int64)
        group[1:] = np.cumsum((keys[1:] != keys[:-1]) | (np.diff(np.asarray(t.column("xb"))) != 0) | (np.diff(np.asarray(t.column("yb"))) != 0))
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=group[-1] + 1))
        a, b = [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            ys, xs = lo + np.flatnonzero(first[lo:hi]), lo + np.flatnonzero(~first[lo:hi])
            for y in ys:
                mates = xs[comp[xs] != comp[y]]
                if len(mates):
                    shared = (bands[mates] == bands[y]).argmax(axis=1)
                    mates = mates[bands[y][shared] == keys[lo]]
                    a.append(np.full(len(mates), y))
                    b.append(mates)
        if not a:
            return [], [], (size[:0], size[:0])
        a, b = np.concatenate(a), np.concatenate(b)
        fit = _promising((regs, regs), (a, b), (size[a], size[b]), percent)
        a, b = a[fit], b[fit]
        return [nodes_[i] for i in a], [nodes_[i] for i in b], (size[a], size[b])

    def run(batches):
        def out(table: pa.Table):
            yield from _tasks(*compare(table))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            last = [table.column(c)[-1].as_py() for c in order]
            same = np.logical_and.reduce([np.asarray(table.column(c)) == v for c, v in zip(order, last)])
            cut = int(np.argmax(same))
            if cut:
                yield from out(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held).combine_chunks())

    return full.select(*order, "node", "component", "first", "n_shingles", "registers").mapInArrow(run, _PAIRS)


def _labelled(source: DataFrame, percent: int) -> DataFrame:
    """doc_id, spot, n_shingles, component (null for an empty set),
    component_id of every row (doc_id, text)."""
    sketched = settle(sketches(source))
    # what rows of one set have in common is the same in all of them
    common = F.max(F.struct("n_shingles", "registers", "bands")).alias("s")
    least = [F.min("doc_id").alias("doc_id"), F.min("spot").alias("spot")]
    nodes = settle(sketched.where("n_shingles > 0").groupBy("node").agg(*least, common).select("node", "doc_id", "spot", "s.*"))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = settle(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader"))
    members = settle(keyed.join(shared, "key"))

    where = nodes.select("node", "spot")
    star = _verify(settle(_star_pairs(members, nodes, percent)), source, where, percent)
    comps = settle(components(star, "a", "b"))
    rest = _verify(settle(_rest_pairs(members, nodes, comps, percent)), source, where, percent)
    comps = settle(components(star.unionByName(rest), "a", "b"))

    member = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    member = settle(member)
    named = settle(member.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = settle(member.join(named, "component").select("node", "component", "component_id"))
    out = sketched.select("doc_id", "spot", "node", "n_shingles").join(named, "node", "left")
    alone = F.col("n_shingles") == 0
    return out.select("doc_id", "spot", "n_shingles", F.when(~alone, F.col("component")).alias("component"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id of the
    component), kept (the row has that id)."""
    out = _labelled(pick(docs, doc_id=id_col, text=text_col), percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The input's rows and columns with one row of each component: the one of
    the smallest id (a null id last, then by the digest of id and text); of
    rows that repeat its id and text, one. Rows with empty sets all stay."""
    rows = settle(_labelled(pick(docs, doc_id=id_col, text=text_col), percent).where("component IS NOT NULL").select("doc_id", "spot", "component"))
    best = rows.groupBy("component").agg(F.min_by("spot", F.struct(F.col("doc_id").isNull(), "doc_id", "spot")).alias("best"), F.count("*").alias("n"))
    best = settle(best.where("n > 1").select("component", "best"))
    of = rows.join(best, "component")
    spot = unused(docs, "spot")
    gone = settle(of.where("spot <> best").select(F.col("spot").alias(spot)).distinct())
    again = settle(of.where("spot = best").groupBy(F.col("spot").alias(spot)).agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    if gone.count() <= SMALL_IDS:
        gone = F.broadcast(gone)
    kept = docs.withColumn(spot, spot_of(F.col(id_col), F.col(text_col))).join(gone, spot, "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, spot, "left_anti").unionByName(kept.join(again, spot, "left_semi").dropDuplicates([spot]))
    return kept.select(*docs.columns)
