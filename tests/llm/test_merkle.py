"""Manifest and proofs against a tree built leaf by leaf."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F, types as T

from veilspark.llm import merkle

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("text", T.StringType()),
        # names that the operator uses itself
        T.StructField("digest", T.StringType()),
        T.StructField("tree", T.StringType()),
        T.StructField("rank", T.StringType()),
        T.StructField("range_no", T.StringType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "t", "r", "n") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def grow(digests):
    """Root, and per leaf its steps (texts before, texts behind)."""
    steps, under = [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(digests) > 1:
        above, over = [], []
        for i in range(0, len(digests), 2):
            run = digests[i : i + 2]
            for j in range(len(run)):
                for x in under[i + j]:
                    steps[x].append(("".join(run[:j]), "".join(run[j + 1 :])))
            above.append(sha("".join(run)))
            over.append(sum(under[i : i + 2], []))
        digests, under = above, over
    return digests[0], steps


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: grow([leaf(r) for r in held[x]]) for x in langs}
    root, tops = grow([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        for r, steps in zip(held[x], trees[x][1]):
            steps = steps + top
            tampered = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            own = leaf((*r[:3], r[3] + 1, r[4]) if tampered else r)
            for before, behind in steps:
                own = sha(before + own + behind)
            out.append((r[0], leaf(r), trees[x][0], root, sha("".join(a + b for a, b in steps)), own, own == root))
    return sorted(out, key=repr)


def answers(spark, rows):
    return sorted((tuple(r) for r in merkle.audited_documents(table(spark, rows)).collect()), key=repr)


MIXED = [(i * 7 - 50, f"s{i % 3}", ("en", "de", None, "é", "z")[i * i % 5], i % 11 or None, f"text {i} ü" * (i % 4)) for i in range(60)]


@pytest.mark.parametrize("height, part", [(12, 1024), (2, 4)])
def test_proofs_are_those_of_the_whole_tree(spark, monkeypatch, height, part):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "PART", part)
    found = answers(spark, MIXED)
    assert found == brute(MIXED)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 5])
def test_small_trees(spark, n):
    rows = [(i, "s", "en", 5, "x") for i in range(n)]
    assert answers(spark, rows) == brute(rows)
    rows = [(i, "s", f"l{i}", 5, "x") for i in range(n)]
    assert answers(spark, rows) == brute(rows)


def test_nulls_repeated_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 4)
    rows = [(None,) * 5, (None, "s", "en", 1, "a"), (7, None, "en", None, None), (7, None, "en", None, None), (7, "s", "en", 2, ""), (9, "s", None, 3, "é" * 300_000)]
    assert answers(spark, rows * 2) == brute(rows * 2)


def test_no_rows(spark):
    assert answers(spark, []) == []


def test_a_part_asks_for_each_missing_node_once_and_for_few(spark):
    asked = []

    def fetch(tree, level, idx):
        asked.extend(zip(tree.tolist(), [level] * len(tree), idx.tolist()))
        return [""] * len(tree)

    import numpy as np

    here = np.arange(5000, 6000)
    merkle.climb(np.zeros(1000, np.int64), here, np.full(1000, 1 << 20), 3, None, fetch)
    assert len(asked) == len(set(asked)) <= 2 * 20 + 2


def test_proofs_of_some_leaves(spark, monkeypatch):
    monkeypatch.setattr(merkle, "PART", 16)
    rows = table(spark, MIXED).select(F.col("doc_id").alias("row_id"), F.col("lang").alias("group"), merkle.leaf(*(F.col(c) for c in merkle.FIELDS)).alias("digest"))
    manifest = merkle.build(rows)
    some = merkle.prove(manifest, manifest.leaves.where("row_id % 3 = 0"))
    some = some.select("row_id", merkle.fold(F.col("digest"), F.col("steps")).alias("root")).collect()
    assert {r.root for r in some} == {manifest.root}
    assert sorted(r.row_id for r in some) == sorted(r[0] for r in MIXED if r[0] % 3 == 0)
