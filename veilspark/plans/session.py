"""Session settings, shared scratch space and checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "veilspark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder. Only a
    local session that names none gets a temporary folder, which goes with the
    process; any other session without a shared folder is an error."""
    return f"{_checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def _checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """Write an intermediate that several branches read, once, as a table in
    the shared checkpoint folder: lineage is cut, the loss of any executor is
    survived, and readers still prune columns."""
    path = scratch_dir(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# A scan whose longest split holds more than so many fair shares is dealt out anew.
UNEVEN = 2


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all cores when the scan leaves cores idle: a few small files,
    or large ones of few row groups, whose splits are mostly empty. Rows are
    counted from the file's own figures; an even table stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        held = df.select(F.spark_partition_id().alias("split")).groupBy("split").agg(F.count("*").alias("n"))
        longest, total = held.agg(F.max("n"), F.sum("n")).first()
        if (longest or 0) * cores <= UNEVEN * (total or 0):
            return df
    return df.repartition(cores, *keys)
