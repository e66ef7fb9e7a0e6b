"""Work is done once per row, on all cores, with the same results."""

from pyspark.sql import functions as F

from veilspark.functions import patterns as P, text as X
from veilspark.plans.session import spread
from veilspark.sources.readers import read_pd_responses
from veilspark.streaming import page_stream as S


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_address_is_searched_once_per_row(spark):
    rows = spark.createDataFrame([("обл., с. Село, ул. Мира, д. 5",), ("ничего",), (None,)], "v string")
    shown = rows.select(P.address_pattern("v").alias("p"))
    assert plan_of(shown).count(P.STREET[4:]) == 1
    got = [r.p for r in shown.collect()]
    assert got[0].count("Мира") == 4 and got[0].count("Село") == 6
    assert got[1:] == ["ничего", None]


def test_answers_are_parsed_once_per_branch(spark):
    raw = '{"persons":[{"id":"p1","fullName":"A B","mentions":["A"]}],"otherPD":[{"id":"o1","type":"phone","value":"1"}]}'
    answers = spark.createDataFrame([("q", 1, raw), ("q", 2, "none"), ("q", 3, None)], "project_id string, doc_id long, raw string")
    entries, ambiguous = read_pd_responses(answers)
    assert plan_of(entries).count("from_json") + plan_of(entries).count("jsontostructs") == 2
    assert sorted((r.doc_id, r.pd_id, r.value) for r in entries.collect()) == [(1, "o1", "1"), (1, "p1", "A B")]
    assert ambiguous.count() == 0


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "rows.parquet")
    spark.range(20000).selectExpr("id", "sha2(cast(id AS string), 512) AS text").coalesce(1).write.parquet(path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "64k")
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = spread(scan, "id")
        held = dealt.groupBy(F.spark_partition_id().alias("s")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["count"] for r in held) == 20000 and max(r["count"] for r in held) < 10000


def test_session_steps_by_time_of_either_kind(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:02.5", 2, 'p"\\', 3, None), (1, "2024-01-01 00:00:02.25", 3, "failed", 4, "old"), (2, None, 1, "failed", 1, 'last "x"'), (2, "2024-01-01 00:00:00", 9, None, 2, "")]
    for kind in ("timestamp", "timestamp_ntz"):
        given = spark.createDataFrame(rows, "session_id long, at string, seq long, status string, page_to long, error string")
        folder, log = str(tmp_path / kind), str(tmp_path / f"{kind}-log")
        progress = given.selectExpr("session_id", f"cast(at AS {kind}) AS ts", "seq", "status", "page_to", "10L AS total_pages", "error")
        progress.coalesce(1).write.parquet(folder)
        steps = S.session_lifecycle(S.read_pages(spark, folder, progress.schema))
        assert "step#" in steps._jdf.queryExecution().analyzed().toString()
        S.run_available(steps, S.session_step(log), f"{log}/checkpoint", mode="update")
        got = sorted((r.session_id, r.page_to, r.next_page, r.status, r.error) for r in S.current_sessions(spark, log).collect())
        assert got == [(1, 4, 5, 'p"\\', ""), (2, 2, 3, "failed", 'last "x"')]


def test_echoes_are_found_once_per_word(spark):
    # runs of letters give nothing back: a long word without a mark costs no square of its length
    mark = "⚠️[НЕТОЧНО: "
    cases = [
        (f"xx dog {mark}dog] z", f"xx {mark}dog] z"), (f"dog {mark}cat] z", f"dog {mark}cat] z"), (f"]ab {mark}ab|cd]de \t{mark}DE ]", f"]{mark}ab|cd]{mark}DE ]"),
        (f"a {mark}a]", f"a {mark}a]"), ("no mark", "no mark"), (None, None), (f"{'w' * 60000} dog {mark}dog]", f"{'w' * 60000} {mark}dog]"),
    ]
    given = spark.createDataFrame(cases, "s string, want string")
    shown = given.select(X.fold_uncertain_echo("s").alias("got"), "want")
    assert [r.got == r.want for r in shown.collect()] == [True] * len(cases)
    assert "{2,}+)" in plan_of(shown)
