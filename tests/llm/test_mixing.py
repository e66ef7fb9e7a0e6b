import numpy as np
import pytest

from veilspark.llm import mixing as M


def rows_for(rng, spread):
    return [(i, " ".join(["w"] * int(rng.integers(1, 80))), spread[i % len(spread)]) for i in range(600)]


def shares(totals, weights=(1, 2, 3), most=3):
    """Targets source by source, round by round."""
    order = sorted((s for s, _ in totals if s is not None)) + [None] * any(s is None for s, _ in totals)
    weight, size = {s: weights[i % len(weights)] for i, s in enumerate(order)}, dict(totals)
    left, open_, out = float(sum(size.values())), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * size[s]]
        out.update({s: most * size[s] if above else unit * weight[s] for s in above or open_})
        left -= sum(out[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def test_targets_share_and_stop(spark):
    def got(totals):
        rows = M.targeted(spark.createDataFrame(totals, "source string, size long")).collect()
        return {r.source: r.target for r in rows}

    # null weighs 3 and stops at 30; a and b share the rest 1 : 2; b stops at 300
    assert got([("b", 100), (None, 10), ("a", 1000)]) == {None: 30.0, "b": 300.0, "a": 780.0}
    assert got([]) == {}
    assert got([("x", 0), ("y", 10)]) == {"x": 0.0, "y": 10.0}
    rng = np.random.default_rng(4)
    many = [(f"s{i}", int(10 ** rng.uniform(0, 6))) for i in range(200)]
    assert got(many) == pytest.approx(shares(many))


def test_taken_words_come_near_the_targets(docs):
    rng = np.random.default_rng(8)
    rows = rows_for(rng, ["a", "a", "a", "a", "a", "b", "c", None])
    rows += [(1000, None, "a"), (1001, "", "zero"), (None, "one two", "a"), (3, rows[3][1], "a"), (3, rows[3][1], "a")]
    out = M.mix(docs(*rows)).collect()
    assert len(out) == len(rows)
    per = {}
    for r in out:
        per.setdefault(r.source, [0, 0, r.target, []])
        per[r.source][0] += r["size"]
        per[r.source][1] += r.taken
        per[r.source][3].append((r.times, r["size"]))
        assert r.taken <= 3 * r["size"] and r.taken == r.times * r["size"] and r.taken % max(1, r["size"]) == 0
        assert len(r.shards) == r.times
    want = shares([(s, v[0]) for s, v in per.items()])
    for s, (size, taken, target, mine) in per.items():
        assert target == pytest.approx(want[s])
        # the gap is smaller than every document that could still be taken
        left = [n for times, n in mine if n and times == min(t for t, m in mine if m)]
        assert taken <= target and target - taken < min(left, default=1), (s, size, taken, target)
        assert target - taken <= 0.02 * target


def test_reruns_agree_and_empty_table(docs, rows_of):
    rows = rows_for(np.random.default_rng(9), ["a", "b"])
    once, again = (rows_of(M.mix(docs(*rows))) for _ in range(2))
    assert once == again
    # the same rows in other partitions, some of them alike
    rows += rows[:50] + rows[:20]
    spread = [rows_of(M.mix(df)) for df in (docs(*rows).coalesce(1), docs(*rows[::-1]).repartition(5), docs(*rows).repartition(3, "text"))]
    assert spread[0] == spread[1] == spread[2] and len(spread[0]) == len(rows)
    assert M.mix(docs()).count() == 0
    assert M.remix(docs()).count() == 0


def test_leaves_split_the_quotas_exactly():
    quota = np.array([1000, 17, 0, 333], np.int64)
    leaves = [M.leaf(quota, s, 4) for s in range(16)]
    sizes = [int(n.sum()) for _, n in leaves]
    assert max(sizes) - min(sizes) <= 1
    for source, q in enumerate(quota):
        spans = sorted((int(b[source]), int(n[source])) for b, n in leaves if n[source])
        assert sum(n for _, n in spans) == q
        at = 0
        for b, n in spans:
            assert b == at
            at += n


def test_split_follows_the_hypergeometric_law():
    quota = np.array([40, 60], np.int64)
    draws = np.array([M._split(np.random.default_rng([1, i]), quota, 50)[0] for i in range(4000)])
    assert abs(draws.mean() - 20) < 0.2
    assert abs(draws.var() - 50 * 0.4 * 0.6 * 50 / 99) < 0.5


def test_permutations_are_bijective():
    for blocks in (1, 2, 7, 64, 1000):
        factor, shift = M._permutation(3, 1, blocks)
        assert sorted((factor * b + shift) % blocks for b in range(blocks)) == list(range(blocks))


def test_pooled_sources_are_dealt_whole(docs, monkeypatch):
    monkeypatch.setattr(M, "POOL", 3)
    monkeypatch.setattr(M, "SHARD_WORDS", 900)
    monkeypatch.setattr(M, "BLOCK_DOCS", 2)
    rows = rows_for(np.random.default_rng(12), ["a", "a", "b", "c", "d", "e", "f", None])
    drawn = M.draw(docs(*rows))
    dealt = M.deal(drawn, 900).collect()
    times = {}
    for r in dealt:
        times[r.row] = times.get(r.row, 0) + 1
    assert times == {r.row: n for r in drawn.collect() if (n := r.passes + (r.whole or r.extra))}
    shards = {}
    for r in dealt:
        shards[r.shard] = shards.get(r.shard, 0) + r["size"]
    assert len(shards) >= 16 and max(shards.values()) < 2.5 * np.mean(list(shards.values()))


def test_more_sources_than_the_driver_should_see(spark, monkeypatch):
    monkeypatch.setattr(M, "POOL", 16)
    monkeypatch.setattr(M, "BROADCAST_BYTES", 1000)
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w ', 5 + cast(id % 7 AS int)) AS text", "concat('s', id % 1500) AS source")
    out = M.mix(df).collect()
    per = {}
    for r in out:
        per.setdefault(r.source, []).append(r)
    assert len(out) == 3000 and len(per) == 1500
    for mine in per.values():
        # documents are taken whole, so the gap is smaller than the least that is left
        gap = mine[0].target - sum(r.taken for r in mine)
        left = [r["size"] for r in mine if r.times == int(r.target // r.source_size)]
        assert 0 <= gap < min(left, default=12)


def test_rows_alike_are_remixed_one_by_one(docs):
    rows = rows_for(np.random.default_rng(13), ["a", "b"])
    df = docs(*rows, *rows[:40], *rows[:40], (None, "x y z", None), (None, "x y z", None))
    taken = sum(r.taken for r in M.mix(df).collect())
    assert sum(len(r.text.split()) for r in M.remix(df).collect()) == taken


def test_remix_names_may_clash(spark):
    df = spark.createDataFrame([(i, "a b", "s", 1, 2, 3, 4) for i in range(4)], "doc_id long, text string, source string, mix_key int, mix_shard int, _shard int, _position int")
    assert sorted(r.doc_id for r in M.remix(df).collect()) == [0, 1, 2, 3]


def test_remix_returns_documents(docs):
    rows = rows_for(np.random.default_rng(10), ["a", "a", "b"])
    df = docs(*rows)
    times = {r.doc_id: r.times for r in M.mix(df).collect()}
    out = M.remix(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in times.items() if n}


def test_long_documents_leave_no_gap_that_others_could_fill(docs):
    rng = np.random.default_rng(11)
    sizes = {s: [*rng.integers(20, 60, 400).tolist(), 15_000, 20_000, 25_000] for s in "abcdefghijklmnopqr"}
    rows = [(1000 * k + i, " ".join(["w"] * n), s) for k, (s, of) in enumerate(sizes.items()) for i, n in enumerate(of)]
    out = M.mix(docs(*rows)).collect()
    for s, of in sizes.items():
        mine = [r for r in out if r.source == s]
        gap = mine[0].target - sum(r.taken for r in mine)
        passes = int(mine[0].target // sum(of))
        left = [r["size"] for r in mine if r.times == passes]
        assert gap >= 0 and {r.times for r in mine} <= {passes, passes + 1}
        assert all(size > gap for size in left), (s, gap, min(left))
        assert all(len(r.shards) == r.times for r in mine)
