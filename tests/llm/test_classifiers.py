import random

import numpy as np
import pytest

from veilspark.llm import quality as Q, toxicity as X

WORDS = [f"word{i}" for i in range(400)]


@pytest.fixture(scope="module")
def corpus(spark, docs):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(900):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(20, 120)))
        good, toxic = rng.random() < 0.7, rng.random() < 0.4
        if not good:
            text = rng.choice([text.replace(" ", " | "), " ".join(w for w in text.split()[:10] for _ in range(8))])
        if toxic:
            for _ in range(rng.randrange(2, 12)):
                text += " " + rng.choice(["grubble", "snarf", "blorp" + rng.choice(["en", "ing", "ed", "ish"])])
        rows.append((i, text, "s"))
        labels.append((i, int(good), int(toxic), "extra"))
    rows += [(None, "word1 word2", None), (5000, None, "s"), (5001, "", "s"), (5002, "word3 " * 60_000, "s"), (3, rows[3][1], "s")]
    labels += [(None, 1, 1, "x"), (5000, None, None, "x"), (0, 7, 7, "x"), (1, labels[1][1], labels[1][2], "again")]
    return docs(*rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), {l[0]: l for l in labels[:900]}


def test_quality_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    out = Q.score(docs, Q.fit(docs, labels)).withColumn("held", Q.held_out()).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held and r.doc_id in truth]
    assert len(held) > 100
    right = sum((r.score >= 0.3) == (truth[r.doc_id][1] == 1) for r in held)
    assert right / len(held) > 0.97


def test_toxicity_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    out = X.severity(docs, X.fit(docs, labels)).withColumn("held", Q.held_out()).collect()
    assert len(out) == docs.count() and all(0 <= r.expected_severity <= X.GRADES for r in out)
    held = [r for r in out if r.held and r.doc_id in truth]
    right = sum((r.p_toxic >= 0.5) == (truth[r.doc_id][2] == 1) for r in held)
    assert right / len(held) > 0.97
    # severity rises with the number of hits
    severe = [r.expected_severity for r in held if truth[r.doc_id][2] == 1]
    assert max(severe) > 2 and min(severe) < 2


def test_empty_tables(docs, spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.score(docs(), Q.fit(docs(), none)).count() == 0
    assert X.severity(docs(), X.fit(docs(), none)).count() == 0
    assert [r.score for r in Q.score(docs((1, "a b", "s")), Q.fit(docs(), none)).collect()] == [pytest.approx(0.5, abs=0.2)]
    assert [r.expected_severity for r in X.severity(docs((1, "a b", "s")), X.fit(docs(), none)).collect()] == [pytest.approx(0, abs=1e-6)]


def test_rejects_keep_rows_and_columns(corpus):
    docs, labels, truth = corpus
    machine = Q.fit(docs, labels)
    marks = {(r.doc_id): r.score for r in Q.score(docs, machine).collect()}
    kept = Q.rejects(docs, machine, 0.3)
    assert kept.columns == docs.columns
    assert sorted(map(repr, {r.doc_id for r in kept.collect()})) == sorted(repr(i) for i, s in marks.items() if s >= 0.3)


def test_factor_scores_equal_all_pairs():
    rng = np.random.default_rng(12)
    machine = Q.FactorisationMachine(0.3, rng.normal(size=Q.DIMENSIONS), rng.normal(size=(Q.DIMENSIONS, Q.RANK)) * 0.1)
    starts, cols, vals = Q.features(["some words here here", "", "x"])
    got = machine.scores(starts, cols, vals)
    ends = np.append(starts, len(cols))
    for row in range(3):
        c, v = cols[ends[row] : ends[row + 1]], vals[ends[row] : ends[row + 1]].astype(float)
        total = 0.3 + machine.linear[c] @ v
        for i in range(len(c)):
            for j in range(i):
                total += machine.factors[c[i]] @ machine.factors[c[j]] * v[i] * v[j]
        assert got[row] == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)


def test_ordinal_levels_fall_with_the_grade():
    rng = np.random.default_rng(13)
    model = X.OrdinalModel(np.arange(3, dtype=np.uint64), np.zeros(3, bool), np.zeros(3), np.zeros(X.GRADES))
    x = rng.normal(size=2000)
    grades = np.digitize(2 * x + rng.logistic(size=2000), [-1, 0.5, 3])
    model.fit(np.arange(2000), np.zeros(2000, int), x, grades, rate=0.3, decay=0)
    assert model.weights[0] == pytest.approx(2, abs=0.25)
    assert np.allclose(model.thresholds, [-1, 0.5, 3], atol=0.3)
