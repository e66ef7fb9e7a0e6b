"""Near-duplicate embeddings of one label by spherical-cap filters.

Equal vectors of a label are one node with a number of copies. Every node is
list-decoded to the cap filters it exceeds (``caps``); nodes meet in filters
(label, filter), and each pair is verified by cosine in double precision in
the first filter both share, block against block where a filter is crowded.
A task reports how many vectors each node is linked with and only those links
that join what the task's other links have not, so links of a large group are
counted without being listed.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components, and rows with a null label, link with nothing and are
their own components. Vectors of different lengths never link. A row with a
null id counts as a link of others and has its component's id. Repeated rows
are copies that link with each other. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .caps import ProductCodes, share_for
from .common import pick, settle
from .components import components

LIMIT = 0.98
#: Nodes of one filter compared in one piece.
BLOCK = 1024

#: Filters of two blocks' vectors compared in one piece.
FILTERS = 2048

_FORESTS = "a binary, b binary, links long"
_CODES: dict[tuple[int, float], ProductCodes] = {}


def _codes(dimensions: int, share: float) -> ProductCodes:
    """Made once per worker, from the seed alone."""
    if (dimensions, share) not in _CODES:
        _CODES[dimensions, share] = ProductCodes(dimensions, share)
    return _CODES[dimensions, share]


def _node():
    """Equal vectors of one label have one node; rows that may not link have
    one as well, but nothing is known of it."""
    return F.unhex(F.md5(F.to_json(F.struct("label", "vector"))))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, vector of doubles) that may link, with their node."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    rows = vectors.where(F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite & some)
    return rows.withColumn("node", _node())


def filters(nodes: DataFrame, share: float) -> DataFrame:
    """node, label, vector, copies, filters of every node."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                lists: list = [None] * part.num_rows
                values = part.column("vector").to_pylist()
                for d in set(map(len, values)):
                    at = [i for i, v in enumerate(values) if len(v) == d]
                    x = np.array([values[i] for i in at])
                    for i, f in zip(at, _codes(d, share).filters(_unit(x))):
                        lists[i] = f
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("node", "label", "vector", "copies")), pa.array(lists, pa.list_(pa.int64()))], ["node", "label", "vector", "copies", "filters"])

    kind = dict(nodes.dtypes)["label"]
    return nodes.select("node", "label", "vector", "copies").mapInArrow(run, f"node binary, label {kind}, vector array<double>, copies long, filters array<long>")


def _unit(x: np.ndarray) -> np.ndarray:
    # scaled first, so that very large or small components neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(filter_: int, nodes: list[bytes], vectors: np.ndarray, copies: np.ndarray, lists: list[np.ndarray], block: np.ndarray, within: bool, limit: float) -> Iterator[tuple]:
    """Numbers of links and a spanning forest of one block pair of a filter."""
    left = np.arange(len(nodes)) if within else np.flatnonzero(block == block.min())
    right = left if within else np.flatnonzero(block != block.min())
    if not len(right):
        return
    unit = _unit(vectors)
    near = unit[left] @ unit[right].T >= limit
    if within:
        near = np.triu(near, 1)
    if not near.any():
        return
    # a pair belongs to the first filter it shares; only vectors that are near another one matter
    rows, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    earlier = {i: f[f < filter_] for i in {*left[rows].tolist(), *right[columns].tolist()} for f in (lists[i],)}
    numbers = np.unique(np.concatenate([*earlier.values()]))
    met = np.zeros((len(rows), len(columns)), bool)
    for start in range(0, len(numbers), FILTERS):
        part = numbers[start : start + FILTERS]
        member = {i: np.isin(part, f).astype(np.float32) for i, f in earlier.items()}
        met |= np.array([member[i] for i in left[rows].tolist()]) @ np.array([member[i] for i in right[columns].tolist()]).T > 0
    near[np.ix_(rows, columns)] &= ~met
    links = np.zeros(len(nodes), np.int64)
    np.add.at(links, left, near @ copies[right])
    np.add.at(links, right, near.T @ copies[left])
    for i in np.flatnonzero(links):
        yield nodes[i], None, int(links[i])
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*(x.tolist() for x in np.nonzero(near))):
        a, b = find(int(left[i])), find(int(right[j]))
        if a != b:
            root[a] = b
            yield nodes[left[i]], nodes[right[j]], 0


def _compare(table: pa.Table, limit: float) -> pa.RecordBatch | None:
    """All whole (label, filter, block pair) groups of a sorted table."""
    columns = {c: np.asarray(table.column(c)) for c in ("label", "filter", "dims", "i", "j", "block", "copies")}
    change = np.zeros(table.num_rows, bool)
    for c in ("label", "filter", "dims", "i", "j"):
        change[1:] |= columns[c][1:] != columns[c][:-1]
    edges = np.append(np.flatnonzero(change), table.num_rows)
    nodes, vectors = table.column("node").to_pylist(), table.column("vector").combine_chunks()
    lists = table.column("filters").combine_chunks()
    out, lo = [], 0
    for hi in edges.tolist():
        if hi - lo > 1:
            part = vectors.slice(lo, hi - lo).flatten().to_numpy().reshape(hi - lo, -1)
            held = [x.values.to_numpy() for x in lists.slice(lo, hi - lo)]
            within = columns["i"][lo] == columns["j"][lo]
            out += _forest(int(columns["filter"][lo]), nodes[lo:hi], part, columns["copies"][lo:hi], held, columns["block"][lo:hi], within, limit)
        lo = hi
    if not out:
        return None
    a, b, n = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "links"])


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", limit: float = LIMIT) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    source = pick(vectors, vec_id=id_col, vector=vector_col, label=label_col)
    source = source.withColumn("vector", F.col("vector").cast("array<double>"))
    marked = usable(source)
    copies = marked.groupBy("node").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.max(F.struct("label", "vector")).alias("s"))
    copies = settle(copies)
    # vectors meet inside their label only, so the largest label sets the size of the caps
    largest = copies.groupBy("s.label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    nodes = settle(filters(copies.select("node", "s.*", "copies"), share_for(largest)).withColumn("dims", F.size("vector")))
    names = copies.select("node", "copies", "least")

    met = nodes.select("node", "label", "dims", F.explode("filters").alias("filter"))
    key = ["label", "filter", "dims"]
    crowds = settle(met.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = met.join(crowds, key).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = settle(dealt.select("node", *key, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    full = dealt.join(nodes.select("node", "vector", "copies", "filters"), "node")
    order = [*key, "i", "j"]
    full = full.repartition(int(full.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last group may go on in the next batch
            held.append(batch)
            table = pa.Table.from_batches(held).combine_chunks()
            last = np.logical_and.reduce([np.asarray(table.column(c)) == table.column(c)[-1].as_py() for c in order])
            cut = int(np.argmax(last))
            if cut and (out := _compare(table.slice(0, cut), limit)):
                yield out
            held = table.slice(cut).to_batches()
        if held and (out := _compare(pa.Table.from_batches(held).combine_chunks(), limit)):
            yield out

    found = settle(full.select(*order, "node", "block", "vector", "copies", "filters").mapInArrow(run, _FORESTS))
    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    comps = components(found.where("b IS NOT NULL"), "a", "b")
    facts = names.join(links, "node", "left").join(comps, "node", "left")
    facts = settle(facts.withColumn("component", F.coalesce("component", "node")))
    least = facts.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = settle(facts.join(settle(least), "component").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    return _answer(source, facts)


def _answer(source: DataFrame, facts: DataFrame) -> DataFrame:
    rows = source.select("vec_id", _node().alias("node"))
    out = rows.join(facts, "node", "left")
    none = F.col("n_links").isNull()
    out = out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(none, F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
