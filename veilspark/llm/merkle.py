"""Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields, each ``-`` if null and else
its UTF-8 length, ``:`` and its value. The rows of a group (a language) make a
binary tree in the order of their ids, and the groups' roots, in the order of
the groups, make the tree above. A last node without a partner is hashed
alone.

Trees are built in rounds of ``HEIGHT`` levels: aligned runs of 2^HEIGHT nodes
are hashed upwards by one task each, so the largest group is spread over all
tasks. The manifest is a written table of nodes (tree, level, idx, digest).

Leaves are proved partition by partition, ``PART`` consecutive leaves each. A
partition works out the union of the coordinates that its leaves' paths need
and that it cannot derive itself, fetches each once from the manifest, derives
the interior nodes its paths share, and expands every leaf's own proof from
them. Its requests grow with the height of the trees, not with its leaves.

Defined results: nulls are fields like others; rows of a null group come
first; null ids sort first, rows sharing an id by their leaf, and rows that
are alike are leaves of their own, one after another; a text is never cut;
only the named columns are read; an empty table has no leaves and no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import distribute, pick, settle
from .runs import edges, ranked, whole_runs

#: Levels built in one round; a task holds 2^HEIGHT digests at a time.
HEIGHT = 12
#: Consecutive leaves proved together.
PART = 1024
#: The tree above the groups' trees, which are numbered from 0.
TOP = -1

_NODE = "tree long, level int, idx long, size long, digest string"
_STEPS = "steps array<struct<left:boolean,digest:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def _join(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Manifest:
    """``leaves``: row_id, group, the columns carried along, digest, rank,
    tree, idx, size. ``nodes``: the nodes of all trees, leaves included.
    ``trees``: number of groups; ``root``: None without rows."""

    leaves: DataFrame
    nodes: DataFrame
    trees: int
    root: str | None


def build(rows: DataFrame) -> Manifest:
    """Manifest of rows (row_id, group, digest, and columns to carry along)."""
    carried = [c for c in rows.columns if c not in ("row_id", "group", "digest")]
    # rows that are alike are told apart, so that many of them need not share a range
    rows = settle(rows.withColumn("twin", F.monotonically_increasing_id()))
    placed = ranked(rows, "group", "row_id", "digest", "twin")
    groups = settle(placed.groupBy("group").agg(F.min("rank").alias("start"), F.count("*").alias("size")))
    groups = settle(ranked(groups, "group", out="tree"))
    own = placed.join(groups.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of")))
    leaves = settle(
        own.select("row_id", "group", *carried, "digest", "rank", "tree", (F.col("rank") - F.col("start")).alias("idx"), "size")
    )
    below = _grow(leaves)
    trees = groups.count()
    tops = below.where("size = 1").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), "digest")
    nodes = below.unionByName(_grow(settle(tops)))
    top = nodes.where((F.col("tree") == TOP) & (F.col("size") == 1)).select("digest").first()
    return Manifest(leaves, nodes, trees, top[0] if top else None)


def _grow(leaves: DataFrame) -> DataFrame:
    """All nodes over rows (tree, idx, size, digest)."""
    now = leaves.select("tree", F.lit(0).alias("level"), "idx", "size", "digest")
    nodes, largest, base = now, leaves.agg(F.max("size")).first()[0] or 0, 0
    while largest > 1:
        near = distribute(now.where("size > 1").withColumn("chunk", F.shiftright("idx", HEIGHT)), "tree", "chunk")
        made = settle(near.sortWithinPartitions("tree", "chunk", "idx").mapInArrow(_build_run(base), _NODE))
        nodes = nodes.unionByName(made)
        base += HEIGHT
        largest = -(-largest >> HEIGHT)
        now = made.where(F.col("level") == base)
    return nodes


def _build_run(base: int) -> Callable:
    def run(batches):
        for table in whole_runs(batches, "tree", "chunk"):
            tree, idx, size = (np.asarray(table.column(c)) for c in ("tree", "idx", "size"))
            digests = table.column("digest").to_pylist()
            for level in range(base + 1, base + HEIGHT + 1):
                up = np.flatnonzero(size > 1)
                if not len(up):
                    break
                at = edges(tree[up], idx[up] >> 1)
                digests = [digests[i] for i in up]
                digests = [_join(digests[i:j]) for i, j in zip(at[:-1], at[1:])]
                first = up[at[:-1]]
                tree, idx, size = tree[first], idx[first] >> 1, (size[first] + 1) >> 1
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(np.full(len(tree), level, np.int32)), pa.array(idx), pa.array(size), pa.array(digests, pa.string())], ["tree", "level", "idx", "size", "digest"])

    return run


def climb(tree: np.ndarray, idx: np.ndarray, size: np.ndarray, trees: int, digests: list[str] | None, fetch: Callable) -> tuple:
    """From leaves, sorted by tree and idx, level by level to the root.

    ``fetch(tree, level, idx)`` gives the digests of nodes that the leaves
    cannot derive; every coordinate is asked for once. Without digests only
    the coordinates are worked out. Returns all digests known, per level the
    side of each leaf's sibling (-1 above the leaf's root, 0 none, 1 left, 2
    right) and its place among the digests, and the place of each leaf's root
    of its own tree."""
    known = list(digests) if digests is not None else [""] * len(tree)
    at, path = np.arange(len(tree)), np.arange(len(tree))
    sides, siblings, subroot, level = [], [], path, 0
    while True:
        inner = size > 1
        if not inner.any():
            if tree[0] == TOP:
                return known, sides, siblings, subroot
            subroot = at[path]
            idx, tree, size, level = tree, np.full(len(tree), TOP), np.full(len(tree), trees), 0
            continue
        twins = (tree[1:] == tree[:-1]) & (idx[1:] >> 1 == idx[:-1] >> 1)
        other = np.full(len(tree), -1)
        other[:-1][twins] = at[1:][twins]
        other[1:][twins] = at[:-1][twins]
        ask = np.flatnonzero(inner & (other < 0) & (idx ^ 1 < size))
        other[ask] = len(known) + np.arange(len(ask))
        known += fetch(tree[ask], level, idx[ask] ^ 1)
        side = np.where(~inner, -1, np.where(other < 0, 0, np.where(idx & 1, 1, 2)))
        sides.append(side[path])
        siblings.append(other[path])
        first = np.concatenate(([True], ~twins))
        keep = np.flatnonzero(first)
        above = at[keep].copy()
        for k, i in enumerate(keep):
            if side[i] >= 0:
                above[k] = len(known)
                if digests is None:
                    known.append("")
                else:
                    own, sibling = known[at[i]], known[other[i]]
                    known.append(_join({0: (own,), 1: (sibling, own), 2: (own, sibling)}[int(side[i])]))
        path = (np.cumsum(first) - 1)[path]
        at, tree, idx, size, level = above, tree[keep], idx[keep] >> 1, (size[keep] + 1) >> 1, level + 1


def _parts(table: pa.Table):
    part = np.asarray(table.column("part"))
    at = edges(part)
    for i, j in zip(at[:-1], at[1:]):
        yield int(part[i]), table.slice(i, j - i)


def _coordinates(table: pa.Table) -> list[np.ndarray]:
    return [np.asarray(table.column(c)) for c in ("tree", "idx", "size")]


def prove(manifest: Manifest, leaves: DataFrame | None = None) -> DataFrame:
    """The columns of the given leaves (all, or any rows of
    ``manifest.leaves``) with ``steps``, their proofs from the leaf to the
    root, and ``subroot``. A step without digest is a node hashed alone."""
    trees = manifest.trees
    leaves = manifest.leaves if leaves is None else leaves
    leaves = leaves.withColumn("part", F.floor(F.col("rank") / PART))

    def wanted(batches):
        for table in whole_runs(batches, "part"):
            for part, rows in _parts(table):
                asked: list[tuple] = []

                def note(tree, level, idx):
                    asked.extend((part, int(t), level, int(i)) for t, i in zip(tree, idx))
                    return [""] * len(tree)

                climb(*_coordinates(rows), trees, None, note)
                if asked:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*asked), (pa.int64(), pa.int64(), pa.int32(), pa.int64()))], ["part", "tree", "level", "idx"])

    places = distribute(leaves.select("part", "tree", "idx", "size"), "part").sortWithinPartitions("part", "tree", "idx")
    asked = settle(places.mapInArrow(wanted, "part long, tree long, level int, idx long"))
    fetched = asked.join(manifest.nodes.select("tree", "level", "idx", "digest"), ["tree", "level", "idx"])
    both = leaves.withColumn("level", F.lit(None).cast("int")).unionByName(fetched, allowMissingColumns=True)
    both = distribute(both, "part").sortWithinPartitions("part", F.col("level").isNull(), "tree", "idx")
    names = [c for c in leaves.columns if c != "part"]
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names)

    def expand(batches):
        for table in whole_runs(batches, "part"):
            for _, rows in _parts(table):
                given = rows.num_rows - rows.column("level").null_count
                held, rows = rows.slice(0, given), rows.slice(given)
                place = zip(*(held.column(c).to_pylist() for c in ("tree", "level", "idx")))
                fetched = dict(zip(place, held.column("digest").to_pylist()))
                fetch = lambda tree, level, idx: [fetched[int(t), level, int(i)] for t, i in zip(tree, idx)]
                known, sides, siblings, subroot = climb(*_coordinates(rows), trees, rows.column("digest").to_pylist(), fetch)
                known = pa.array(known, pa.string())
                shape = (len(sides), rows.num_rows)
                side, sibling = (np.array(x, np.int64).reshape(shape).T for x in (sides, siblings))
                there = side >= 0
                side, sibling = side[there], sibling[there]
                steps = pa.StructArray.from_arrays([pa.array(side == 1, mask=side == 0), known.take(pa.array(sibling, mask=sibling < 0))], ["left", "digest"])
                ends = pa.array(np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype(np.int32))
                rows = rows.select(names).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(ends, steps), known.take(pa.array(subroot))], [*names, "steps", "subroot"])

    return both.mapInArrow(expand, f"{schema}, {_STEPS}, subroot string")


def fold(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(own: Column, step: Column) -> Column:
        both = F.when(step["left"], F.concat(step["digest"], own)).when(~step["left"], F.concat(own, step["digest"]))
        return F.sha2(both.otherwise(own), 256)

    return F.aggregate(steps, digest, up)


def proof_text(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s: s["digest"]), "")


#: The columns that a document's leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One row in so many is tampered with when proofs are tried.
TAMPER_MOD = 7


def audited_documents(docs: DataFrame) -> DataFrame:
    """Leaves, proofs and what they fold to for all documents, where the
    tampered rows (chosen by the checksum of their id) gain one character in
    ``n_chars``; a row without an id is never tampered with."""
    source = pick(docs, **{c: c for c in FIELDS})
    own = {c: F.col(c) for c in FIELDS}
    tampered = (F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % TAMPER_MOD == 0) & F.col("n_chars").isNotNull()
    forged = F.when(tampered, leaf(*(own | {"n_chars": F.col("n_chars") + 1}).values()))
    rows = source.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("group"), leaf(*own.values()).alias("digest"), forged.alias("forged"))
    manifest = build(rows)
    proved = prove(manifest)
    folded = fold(F.coalesce("forged", "digest"), F.col("steps"))
    out = proved.select(
        F.col("row_id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).cast("string").alias("root"),
        F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
