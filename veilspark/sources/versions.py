"""Several tables kept as one versioned set.

A commit writes its part of every table it changes and then one marker. Readers
see the parts of marked commits alone, so none of them finds one table ahead
of another. The caller names a commit by a number (of a batch, of a request):
written again before its marker, its parts are replaced; once it is marked it
is done, and writing it again changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

MARKERS = "commits"


class VersionedTables:
    """Tables ``{name: schema}`` below ``path``. ``by`` names columns of a
    table that are folders below each commit, so that readers can skip."""

    def __init__(self, spark: SparkSession, path: str, schemas: Mapping[str, str], by: Mapping[str, Sequence[str]] | None = None):
        self.spark, self.path, self.schemas, self.by = spark, path, dict(schemas), dict(by or {})

    def _root(self, name: str, number: int | None = None) -> str:
        return f"{self.path}/{name}" + ("" if number is None else f"/commit={number}")

    def commits(self) -> DataFrame:
        """One row per finished commit."""
        self.spark.createDataFrame([], "done boolean").write.mode("ignore").parquet(self._root(MARKERS, -1))
        rows = self.spark.read.schema("done boolean, commit bigint").parquet(self._root(MARKERS))
        return rows.filter("done").select("commit")

    def is_done(self, number: int) -> bool:
        return not self.commits().filter(F.col("commit") == number).isEmpty()

    def put(self, name: str, rows: DataFrame, number: int) -> None:
        """Write a part without showing it to readers."""
        fields = self.spark.createDataFrame([], self.schemas[name]).schema.fields
        by = self.by.get(name, ())
        rows.select(*[F.col(f.name).cast(f.dataType) for f in fields]).write.mode("overwrite").partitionBy(*by).parquet(self._root(name, number))

    def finish(self, number: int) -> None:
        self.spark.range(1).select(F.lit(True).alias("done")).coalesce(1).write.mode("ignore").parquet(self._root(MARKERS, number))

    def commit(self, number: int, **parts: DataFrame) -> bool:
        """Write parts and marker; False where the commit was done before."""
        if self.is_done(number):
            return False
        for name, rows in parts.items():
            self.put(name, rows, number)
        self.finish(number)
        return True

    def read(self, name: str) -> DataFrame:
        """Rows of all finished commits, with the column ``commit``."""
        # an empty first part makes the table readable from the start; the marker folder is small next to the parts
        self.spark.createDataFrame([], self.schemas[name]).write.mode("ignore").partitionBy(*self.by.get(name, ())).parquet(self._root(name, -1))
        rows = self.spark.read.schema(f"{self.schemas[name]}, commit bigint").option("basePath", self._root(name)).parquet(self._root(name))
        return rows.join(self.commits(), "commit", "left_semi")
