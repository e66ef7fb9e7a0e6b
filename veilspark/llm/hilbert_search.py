"""Nearest neighbours by inner product along shifted space-filling curves.

Vectors are lifted onto a sphere, where a larger inner product is a smaller
distance: a candidate x gets sqrt(M^2 - |x|^2) as one more component, M being
the greatest norm, and a query is scaled to norm M with 0 there. Each curve
projects the sphere onto ``AXES`` random directions, shifts and quantises the
projections, and orders the points by their Hilbert index. Every vector is on
every curve; Spark sorts each curve by ranges and numbers its points.

A query's neighbours are sought in the windows around its places on all
curves. Curves are cut into blocks; a query visits the blocks that its window
touches, where it is compared with all vectors by exact inner products, and
the best of all blocks are merged and reranked. The reach of the windows is
fitted, so that a recall is met whatever the data: up to ``PROBES`` queries
are compared with all vectors, and the windows are made so wide that a share
``AIM`` of their true neighbours lies inside one. Data of few dimensions need
narrow windows; on vectors without any structure windows must be a share of
the table, and no order of them does better.

Equal vectors are one point of a curve; of their ids the ``K + 1`` smallest
stand for them, as no others can be among the K nearest.

Defined results: null, empty and zero vectors, and those with null or
non-finite components, take no part; vectors of different lengths never meet;
a row that repeats an id and its vector counts once; a query finds no row of
its own id; a row with a null id is no query, and the last among equals; ties
go to the smaller id; with fewer candidates than K all are returned; other
columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import distribute, pick, settle
from .runs import edges, ranked, whole_runs

K = 20
CURVES = 4
AXES = 6
BITS = 10
#: Queries compared with all vectors to fit the windows, and rows used to scale the curves.
PROBES, SCALE_ROWS = 256, 4096
#: Share of the probes' true neighbours that the windows must hold.
AIM = 0.97
#: Bounds of a block's rows: a task holds one block and slices of its visitors.
LEAST_BLOCK, MOST_BLOCK = 256, 32_768
QUERY_MOD = 20


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of cell numbers (n x axes)."""
    x = [c.astype(np.int64) for c in cells.T]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            # where the bit is set the first axis is flipped, elsewhere exchanged with this one
            swap = np.where(x[i] & q, 0, (x[0] ^ x[i]) & (q - 1))
            flip = np.where(x[i] & q, q - 1, 0)
            x[0] = x[0] ^ swap ^ flip
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | ((axis ^ turn) >> b & 1)
    return place


@lru_cache(maxsize=64)
def _directions(dimensions: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([dimensions, curve])
    axes = min(AXES, dimensions)
    return np.linalg.qr(draw.normal(size=(dimensions, axes)))[0], draw.random(axes)


def curve_keys(points: np.ndarray, curve: int, scale: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Hilbert index of lifted points; ``scale`` has per curve the centre and
    spread of the projections."""
    axes, shift = _directions(points.shape[1], curve)
    centre, spread = scale[curve]
    even = 1 / (1 + np.exp(-1.702 * np.clip((points @ axes - centre) / spread, -20, 20)))
    cells = ((even + shift) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert_index(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def lifted(x: np.ndarray, most: float, query: bool) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if query:
        return np.hstack((x / norm, np.zeros_like(norm)))
    return np.hstack((x / most, np.sqrt(np.maximum(0, 1 - (norm / most) ** 2))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, vector of doubles, dims, node) that take part; equal vectors have one node."""
    rows = pick(vectors, vec_id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vector").isNotNull()).where(finite & F.exists("vector", lambda x: x != 0))
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    return rows.withColumns({"dims": F.size("vector"), "node": F.unhex(F.md5(F.to_json(F.struct("vector"))))})


def _keyed(nodes: DataFrame, norms: dict[int, float], scales: dict[int, dict]) -> DataFrame:
    """dims, curve, key, node, query of every point of every curve."""

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                if not part.num_rows:
                    continue
                dims, queries = np.asarray(part.column("dims")), np.asarray(part.column("queries"))
                for d in np.unique(dims):
                    for query in (False, True):
                        own = np.flatnonzero((dims == d) & (queries if query else True))
                        if not len(own):
                            continue
                        points = lifted(_matrix(part.column("vector").take(pa.array(own))), norms[int(d)], query)
                        names = part.column("node").take(pa.array(own))
                        for curve in range(CURVES):
                            keys = curve_keys(points, curve, scales[int(d)])
                            columns = [np.full(len(own), d, np.int32), np.full(len(own), curve, np.int32), keys]
                            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), names, pa.array([query] * len(own))], ["dims", "curve", "key", "node", "query"])

    return nodes.mapInArrow(run, "dims int, curve int, key long, node binary, query boolean")


def _best(scores: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest scores of each row, smaller ``least`` first
    among equals (to about 12 digits; they are reranked exactly)."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    cut = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for row, (s, c) in enumerate(zip(scores, cut)):
        near = np.flatnonzero(s >= c - abs(c) * 1e-12)
        if len(near) > k:
            near = near[np.lexsort((least[near], -np.round(s[near] / (abs(c) or 1), 11)))][:k]
        out[row] = near
    return out


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def _search(queries: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int):
    """Slices (first query, row of each pair's query, column, exact score)."""
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        found = _best(part @ vectors.T, least, k)
        rows = np.repeat(np.arange(len(part)), found.shape[1])
        columns = found.ravel()
        yield start + rows, columns, _exact(part[rows], vectors[columns])


_PAIRS = "query binary, node binary, least long, score double"


def _pairs(asked: pa.Array, nodes: pa.Array, least: np.ndarray, rows, columns, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [asked.take(pa.array(rows)), nodes.take(pa.array(columns)), pa.array(least[columns]), pa.array(scores)], ["query", "node", "least", "score"]
    )


def _top(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    return pairs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def true_neighbours(nodes: DataFrame, probes: list, k: int) -> DataFrame:
    """query, node, least, score: the k best nodes for each of a bounded list
    of probes (node, vector), by comparing them with all nodes."""
    by_dims: dict[int, tuple[pa.Array, np.ndarray]] = {}
    for d in {len(p["vector"]) for p in probes}:
        own = [p for p in probes if len(p["vector"]) == d]
        by_dims[d] = pa.array([bytes(p["node"]) for p in own], pa.binary()), np.array([p["vector"] for p in own])

    def run(batches):
        for batch in batches:
            dims, least = np.asarray(batch.column("dims")), np.asarray(batch.column("least"))
            for d, (asked, queries) in by_dims.items():
                own = np.flatnonzero(dims == d)
                if len(own):
                    vectors, names = _matrix(batch.column("vector").take(pa.array(own))), batch.column("node").take(pa.array(own))
                    for rows, columns, scores in _search(queries, vectors, least[own], k):
                        yield _pairs(asked, names, least[own], rows, columns, scores)

    return _top(nodes.select("dims", "vector", "node", "least").mapInArrow(run, _PAIRS), k)


def _reach(nodes: DataFrame, places: DataFrame, k: int) -> int:
    """Places on each side of a query that its windows must cover."""
    probes = nodes.where("queries").orderBy(F.xxhash64("node"), "node").limit(PROBES).select("node", "vector").collect()
    if not probes:
        return 0
    near = settle(true_neighbours(nodes, probes, k).where("query <> node").select("query", F.col("node").alias("near")))
    # at most PROBES * K pairs
    at = places.where("query").select(F.col("node").alias("query"), "curve", F.col("place").alias("here"))
    to = places.where("NOT query").select(F.col("node").alias("near"), F.col("curve").alias("on"), F.col("place").alias("there"))
    both = at.join(F.broadcast(near), "query").join(to, "near").where("curve = on")
    gaps = both.groupBy("query", "near").agg(F.min(F.abs(F.col("here") - F.col("there"))).alias("gap"))
    return gaps.agg(F.percentile("gap", F.lit(AIM))).first()[0] or 0


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_mod: int = QUERY_MOD) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for every row whose
    id is divisible by ``query_mod``."""
    rows = settle(usable(vectors, id_col, vector_col))
    asks = F.col("vec_id").isNotNull() & (F.col("vec_id") % query_mod == 0)
    nodes = settle(
        rows.groupBy("node").agg(
            F.any_value("dims").alias("dims"), F.any_value("vector").alias("vector"), F.coalesce(F.min("vec_id"), F.lit(2**63 - 1)).alias("least"), F.max(asks).alias("queries")
        )
    )
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    norms = {r["dims"]: r["most"] for r in nodes.groupBy("dims").agg(F.max(norm).alias("most")).collect()}
    places = settle(_places(nodes, norms))
    window = _reach(nodes, places, k)
    block = int(min(max(-(-window // 4), LEAST_BLOCK), MOST_BLOCK))
    reach = -(-int(np.ceil(window)) // block)

    held = F.floor(F.col("place") / block)
    visits = F.explode(F.sequence(F.greatest(F.floor((F.col("place") - reach * block) / block), F.lit(0)), F.floor((F.col("place") + reach * block) / block)))
    spots = places.where("NOT query").select("node", "dims", "curve", "query", held.alias("block"))
    spots = spots.unionByName(places.where("query").select("node", "dims", "curve", "query", visits.alias("block")))
    full = spots.join(nodes.select("node", "vector", "least"), "node")
    key = ["dims", "curve", "block"]
    full = distribute(full, *key).sortWithinPartitions(*key, "query").select(*key, "query", "node", "least", "vector")

    def run(batches):
        for table in whole_runs(batches, *key):
            at = edges(*(np.asarray(table.column(c)) for c in key)).tolist()
            for i, j in zip(at[:-1], at[1:]):
                rows = table.slice(i, j - i).combine_chunks().to_batches()[0]
                visiting = np.asarray(rows.column("query"))
                n = int(np.argmax(visiting)) if visiting.any() else len(visiting)
                if 0 < n < len(visiting):
                    x, names, least = _matrix(rows.column("vector")), rows.column("node"), np.asarray(rows.column("least"))
                    for found, columns, scores in _search(x[n:], x[:n], least[:n], k + 1):
                        yield _pairs(names.slice(n), names, least, found, columns, scores)

    found = _top(full.mapInArrow(run, _PAIRS).dropDuplicates(["query", "node"]), k + 1)
    return _expanded(rows, settle(found), asks, k)


def _places(nodes: DataFrame, norms: dict[int, float]) -> DataFrame:
    """dims, curve, node, query, place on the curve of every point."""
    scales = {}
    for d, most in norms.items():
        sample = nodes.where(F.col("dims") == d).orderBy(F.xxhash64("node")).limit(SCALE_ROWS).select("vector").collect()
        points = lifted(np.array([r["vector"] for r in sample]), most, False)
        projected = [points @ _directions(d + 1, c)[0] for c in range(CURVES)]
        scales[d] = {c: (p.mean(axis=0), np.maximum(p.std(axis=0), 1e-12)) for c, p in enumerate(projected)}
    keyed = settle(_keyed(nodes.select("dims", "vector", "node", "queries"), norms, scales))
    order = ranked(keyed, "dims", "curve", "key", "node", "query")
    starts = order.groupBy("dims", "curve").agg(F.min("rank").alias("from_rank"))
    # one row for each curve of each length
    return order.join(F.broadcast(starts), ["dims", "curve"]).select("dims", "curve", "node", "query", (F.col("rank") - F.col("from_rank")).alias("place"))


def _expanded(rows: DataFrame, found: DataFrame, asks, k: int) -> DataFrame:
    """From nodes to ids: the k + 1 smallest ids of a node, then the k best
    rows of each query without its own."""
    last = F.asc_nulls_last("vec_id")
    ids = rows.select("node", "vec_id").distinct()
    few = ids.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(last))).where(F.col("n") <= k + 1).drop("n")
    near = found.select("query", "node", "score").join(few, "node")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), last))).where(F.col("n") <= k + 1)
    queries = ids.where(asks).select(F.col("node").alias("query"), F.col("vec_id").alias("query_id"))
    pairs = queries.join(near.select("query", "score", "vec_id"), "query").where(~F.col("vec_id").eqNullSafe(F.col("query_id")))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), last)
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
