import random
import re

import numpy as np
import pytest

from veilspark.llm import near_dedup as N, setsketch as S
from veilspark.llm.components import components

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def brute(rows, percent=75):
    sets = []
    for _, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for i, (doc, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [doc]
        least = min((x for x in ids if x is not None), default=None)
        out.append((doc, len(sets[i]), least, doc == least))
    return sorted(out, key=repr)


def varied(rng, words, share):
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else w for w in words)


VOCABULARY = [f"w{i}" for i in range(3000)]


def test_equals_brute_force(docs, rows_of):
    rng = random.Random(1)
    rows, i = [], 0
    for size in (30, 60, 200):
        for _ in range(6):
            base = [rng.choice(VOCABULARY) for _ in range(size)]
            for _ in range(6):
                rows.append((i, varied(rng, base, rng.choice([0, 0.005, 0.02, 0.03, 0.06])), "s"))
                i += 1
    rows += [(900, None, "s"), (901, "", "s"), (902, " \t ", "s"), (903, "One two", "s"), (904, "one TWO", "s"), (905, "two one", "s"), (None, "one two", None), (None, "only this one here now", "s"), (5, rows[5][1], "s"), (906, "a b c d e", "s"), (907, "a b c d é", "s"), (908, "a b c d É", "s")]
    assert rows_of(N.near_dedup(docs(*rows))) == brute(rows)


def test_large_group_of_unlike_near_copies(docs, rows_of, monkeypatch):
    # more members than a block, most pairs below the limit, several components
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "TASK_SHINGLES", 2_000)
    rng = random.Random(2)
    base = [rng.choice(VOCABULARY) for _ in range(120)]
    rows = [(i, varied(rng, base, 0.035), "s") for i in range(90)]
    want = brute(rows)
    assert 1 < len({w[2] for w in want}) < 90
    assert rows_of(N.near_dedup(docs(*rows))) == want


def test_empty_table(docs):
    assert N.near_dedup(docs()).count() == 0


def test_drop_near_copies(docs, rows_of):
    text = " ".join(VOCABULARY[:80])
    kept = N.drop_near_copies(docs((3, text, "s"), (2, text + " more", "s"), (4, "else", "t"), (None, text, "s")))
    assert kept.columns == docs().columns
    assert sorted(kept.select("doc_id").collect(), key=repr) == [(2,), (4,)]


def test_null_and_repeated_ids_are_decided_row_by_row(docs, rows_of):
    one, two = " ".join(VOCABULARY[:80]), " ".join(VOCABULARY[40:130])
    rows = [(None, one, "a"), (None, one, "b"), (None, one + " more", "c"), (None, two, "d"), (5, two + " end", "e"), (5, "else", "f"), (7, "alone", "g"), (7, "alone", "h"), (None, None, "i"), (None, None, "j")]
    kept = rows_of(N.drop_near_copies(docs(*rows)).select("doc_id", "source"))
    assert (5, "e") in kept and (5, "f") in kept and {(None, "i"), (None, "j")} < set(kept) and len(kept) == 6
    assert len({(7, "g"), (7, "h")} & set(kept)) == 1 and len({(None, x) for x in "abc"} & set(kept)) == 1 and (None, "d") not in kept


def test_sets_are_sent_once_to_each_task(spark, docs):
    text = " ".join(VOCABULARY[:80])
    rows = [(None, f"{text} {i % 50}", "s") for i in range(200)]
    source = docs(*rows).select("doc_id", "text")
    nodes = N.sketches(source).groupBy("node").agg(N.F.min("spot").alias("spot"))
    nodes = N.settle(nodes.withColumn("task", N.F.explode(N.F.array(N.F.lit(1), N.F.crc32("node") % 3 + 2))))
    sent = N._task_sets(source.coalesce(1), nodes.select("node", "task"), nodes.select("node", "spot").distinct())
    assert sent.count() == nodes.count() == 100


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "a b c", 1, 2, 3)], "doc_id long, text string, spot int, best int, component int")
    assert [r.doc_id for r in N.drop_near_copies(docs).collect()] == [1]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(3)
    errors = []
    for share in (0.2, 0.5, 0.75, 0.9):
        for _ in range(30):
            both, own = int(300 * share), int(300 * (1 - share) / 2)
            pool = rng.integers(0, 1 << 63, both + 2 * own, np.uint64) * np.uint64(2)
            a, b = np.sort(pool[: both + own]), np.sort(np.concatenate((pool[:both], pool[both + own :])))
            ra, rb = S.sketch([a, b])
            assert (S.merge(ra, rb) == S.sketch([np.sort(pool)])[0]).all()
            j = both / (both + 2 * own)
            errors.append(S.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - j)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06 and np.min(errors) > -N.MARGIN


def test_word_hashes_do_not_depend_on_the_batch():
    texts = ["Aa b  c", None, "", "\t", "c b aA", "é É"]
    together, counts = S.word_hashes(texts)
    assert counts.tolist() == [3, 0, 0, 0, 3, 2]
    alone = np.concatenate([S.word_hashes([t])[0] for t in texts])
    assert (together == alone).all()
    assert together[0] == together[5] and together[6] != together[7]


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_paths_and_stars(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n + 1)] + [(7000, 7000)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect())
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n + 1)}}
