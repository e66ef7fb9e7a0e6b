import numpy as np
import pytest

from veilspark.llm import embedding_dedup as E
from veilspark.llm.caps import ProductCodes, share_for

SCHEMA = "vec_id long, embedding array<float>, label int, node string, links long"


def brute(rows, limit=0.98):
    ok = [e is not None and l is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e, l in rows]
    unit = [np.array(e, float) / np.linalg.norm(np.array(e, float)) if k else None for (_, e, _), k in zip(rows, ok)]
    near = lambda a, b: a != b and ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= limit
    links = [[b for b in range(len(rows)) if near(a, b)] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        least = min((rows[b][0] for b in seen if rows[b][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), least, rows[a][0] == least))
    return sorted(out, key=repr)


def made(rng, n, spread, label, first):
    base = rng.normal(size=64)
    return [(first + i, [float(np.float32(x)) for x in base + spread * rng.normal(size=64)], label) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, e, l, "n", 1) for i, e, l in rows], SCHEMA)


def test_equals_brute_force(spark, rows_of, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(5)
    rows = []
    for k in range(12):
        rows += made(rng, 8, rng.choice([0.05, 0.1, 0.14, 0.2]), k % 3, 100 * k)
    rows += made(rng, 50, 0.12, 1, 5000)
    rows += [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [None] + [1.0] * 63, 1), (9003, [float("nan")] + [1.0] * 63, 1), (9004, [float("inf")] + [1.0] * 63, 1)]
    rows += [(9005, rows[0][1], None), (9006, rows[0][1], rows[0][2]), (9007, rows[0][1], rows[0][2]), (None, rows[0][1], rows[0][2]), (9008, [], 1), (9009, [1.0, 2.0], 1), (9010, [2.0, 4.0], 1), (9000, None, 1)]
    assert rows_of(E.near_vectors(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert E.near_vectors(table(spark, [])).count() == 0


@pytest.mark.parametrize("vectors", [100, 50_000, 10**6])
def test_pairs_at_the_limit_share_filters(vectors):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * side
    codes = ProductCodes(64, share_for(vectors))
    shared = [len(np.intersect1d(a, b)) for a, b in zip(codes.filters(x), codes.filters(y))]
    assert min(shared) > 0 and np.mean(shared) > 15


def test_few_dimensions():
    for d in (1, 2, 3, 5, 9):
        x = np.random.default_rng(d).normal(size=(50, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = ProductCodes(d).filters(x)
        assert 0 < min(map(len, found)) and max(map(len, found)) < 1000


def test_filters_are_all_that_exceed():
    codes = ProductCodes(10, 2.0**-4, codes=2, filters=9)
    x = np.random.default_rng(7).normal(size=(20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for row, got in zip(x, codes.filters(x)):
        want = []
        for code, (first, second) in enumerate(codes.tables):
            sums = (row @ first)[:, None] + (row @ second)[None, :]
            want += [(code * codes.size + a) * codes.size + b for a, b in np.argwhere(sums >= codes.least)]
        assert got.tolist() == sorted(want)
