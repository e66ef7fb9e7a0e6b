"""Search along curves against all inner products."""

import numpy as np
import pytest

from veilspark.llm import hilbert_search as H

SCHEMA = "vec_id long, embedding array<float>, node string, place int, query int, least int"


def table(spark, rows):
    rows = [(i, v and [x if x is None else float(x) for x in v], "n", 1, 2, 3) for i, v in rows]
    return spark.createDataFrame(rows, SCHEMA)


def found(spark, rows, **more):
    out = {}
    for r in sorted(H.nearest(table(spark, rows), **more).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def brute(rows, k=20):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for q, x in good:
        if q is not None and q % 20 == 0:
            near = [(float(np.add.accumulate(x * y)[-1]), i) for i, y in good if i != q and len(y) == len(x)]
            near.sort(key=lambda p: (-p[0], p[1] is None, p[1]))
            if near:
                out[q] = [(n + 1, i, s) for n, (s, i) in enumerate(near[:k])]
    return out


@pytest.mark.parametrize("axes, bits", [(1, 3), (2, 4), (3, 2), (4, 2)])
def test_the_curve_visits_every_cell_by_single_steps(axes, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
    place = H.hilbert_index(cells, bits)
    assert sorted(place.tolist()) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_searched_whole(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist()) for i in range(100)]
    rows += [(200 + i, [1.0, 0, 0, 0, 0, 0, 0, 0]) for i in range(50)] + [(220, [1.0, 0, 0, 0, 0, 0, 0, 0])]
    rows += [(301, None), (302, []), (303, [0.0] * 8), (304, [None] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (306, [float("nan")] * 8), (320, [0.0] * 8)]
    rows += [(None, [0.5] * 8), (340, [1.0, 2.0, 3.0]), (341, [3.0, 2.0, 1.0]), (360, [1.0]), (380, [-0.0, 1.0, 1.0]), (381, [0.0, 1.0, 1.0])]
    assert found(spark, rows) == brute(rows)


def test_few_candidates_and_none(spark):
    assert found(spark, [(20, [1.0, 0.0]), (21, [0.0, 1.0]), (22, [1.0, 1.0])]) == {20: [(1, 22, 1.0), (2, 21, 0.0)]}
    assert found(spark, [(20, [1.0])]) == {}
    assert found(spark, []) == {}


@pytest.mark.parametrize("shape", ["plane", "ball"])
def test_recall_beyond_one_block(spark, monkeypatch, shape):
    monkeypatch.setattr(H, "LEAST_BLOCK", 16)
    draw = np.random.default_rng(2)
    n = 4000
    x = draw.normal(size=(n, 2)) @ draw.normal(size=(2, 32)) if shape == "plane" else draw.normal(size=(n, 32)) * draw.uniform(0.5, 2, size=(n, 1))
    x += 0.01 * draw.normal(size=x.shape)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    got, want = found(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    exact = {(q, i): s for q, near in brute(rows, n).items() for _, i, s in near}
    assert all(s == exact[q, i] for q, near in got.items() for _, i, s in near)
    assert all([r for r, _, _ in near] == list(range(1, 21)) for near in got.values())
