"""Skew, arrival order and partitioning must not change results."""

from pyspark.sql import Window, functions as F

from veilspark.operators import corpus as C
from veilspark.operators.ordinal import block_of, first_per_key, with_ordinal
from veilspark.plans.session import scratch_dir
from veilspark.streaming import page_stream as S


def test_ordinal_equals_one_window(spark):
    # one group holds most rows
    df = spark.range(5000).select(F.when(F.col("id") % 5 < 4, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"), (F.col("id") * 7 % 5003).alias("k"))
    got = with_ordinal(df, ["g"], [F.col("k")], [block_of("k", 64)], total="n")
    want = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("g").orderBy("k"))).withColumn("n", F.count("*").over(Window.partitionBy("g")))
    assert got.select("g", "k", "ordinal", "n").exceptAll(want).count() == 0
    assert got.count() == 5000


def test_ordinal_of_far_apart_positions(spark):
    # positions like the hashes that detected entries have; one project holds all
    df = spark.range(4000).select(F.lit("p").alias("g"), F.shiftrightunsigned(F.xxhash64("id"), 4).alias("k"))
    want = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("g").orderBy("k")))
    got = with_ordinal(df, ["g"], [F.col("k")], [block_of("k")], levels=2)
    assert got.exceptAll(want).count() == 0 and got.count() == 4000
    nulls = df.withColumn("g", F.lit(None).cast("string"))
    assert with_ordinal(nulls, ["g"], [F.col("k")], [block_of("k")], total="n", levels=2).filter("n = 4000").count() == 4000


def test_first_per_key_is_a_partial_aggregate(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "id AS seq", "id * 2 AS v")
    picked = first_per_key(df, ["k"], ["seq"])
    assert sorted(tuple(r) for r in picked.collect()) == [(0, 0, 0), (1, 1, 2), (2, 2, 4)]
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan and "Window" not in plan


def test_filter_reaches_the_scan(spark):
    plan = C.tenant_filter(spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "user_id"), 7)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in text and "props" not in text


def pages(spark, order):
    rows = [("p", f"f{f}", n, 0, f"d{f}-{n}", f"t{f}", f"text {f} {n}", 4) for f in range(3) for n in range(1, 5)]
    return spark.createDataFrame([rows[i] for i in order], S.PAGES)


def test_stream_in_any_order_equals_batch(spark):
    want_facts, want_text = C.append_pages(pages(spark, range(12)))
    for order in ([*range(12)], [7, 3, 11, 0, 5, 9, 1, 10, 2, 8, 4, 6]):
        root = scratch_dir(spark, "arrival")
        # every page a file of its own, the first one delivered twice
        for i, p in enumerate([*order, order[0]]):
            pages(spark, [p]).coalesce(1).write.parquet(f"{root}/in/step={i:02d}")
        stream = spark.readStream.schema(S.PAGES).option("maxFilesPerTrigger", 3).parquet(f"{root}/in/*")
        for _run in range(2):
            S.run_available(stream, S.page_step(f"{root}/log"), f"{root}/checkpoint")
        facts, text = S.current_documents(spark, f"{root}/log")
        assert sorted(map(tuple, facts.collect())) == sorted(map(tuple, want_facts.collect()))
        assert sorted(map(tuple, text.collect())) == sorted(map(tuple, want_text.collect()))
