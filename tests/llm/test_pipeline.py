"""The stages one by one against brute force, on the smallest tables."""

import corpus_pipeline as P
import pytest
from test_exact_dedup import brute as exact_brute
from test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((before, docs))
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_columns_stay(stages):
    want = stages[0][0].columns
    assert [after.columns for _, after in stages[:-1]] == [want] * 4


def test_clean_documents_pass_the_classifier(spark, stages):
    before, after = stages[0]
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & set(ids(after))) >= 0.97 * len(good)
    assert set(ids(after)) <= set(ids(before))


def test_exact_copies_go(stages):
    before, after = stages[1]
    assert ids(after) == sorted(i for i, _, _, kept in exact_brute(rows(before)) if kept)


def test_near_copies_go(stages):
    before, after = stages[2]
    assert ids(after) == sorted(i for i, _, _, kept in near_brute(rows(before)) if kept)


def test_mix_takes_documents_up_to_three_times(stages):
    before, after = stages[3]
    texts, taken = {i: t for i, t, _ in rows(before)}, {}
    for i, t, _ in rows(after):
        assert texts[i] == t
        taken[i] = taken.get(i, 0) + 1
    assert max(taken.values()) <= 3
    words = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(texts[i].split()) * n for i, n in taken.items()) - words) < 0.02 * words


def test_encoding_round_trips(stages):
    before, after = stages[4]
    assert sorted(map(tuple, after.select("doc_id", "text").collect())) == sorted((i, t) for i, t, _ in rows(before))


def test_run_equals_its_stages(spark, stages):
    assert ids(P.run(spark, SF)) == ids(stages[-1][1])
