"""Portable files, exports and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import export_spans

# ---- fixed values -----------------------------------------------------------
PORTABLE_VERSION = 1
# ---- end of fixed values ----------------------------------------------------


def _zero_as_null(name: str) -> Column:
    return F.nullif(F.col(name).cast("bigint"), F.lit(0))


def portable_json(docs: DataFrame) -> Column:
    """The portable JSON object of a document: fixed fields, nulls kept."""
    names = {
        "id": F.col("doc_id").cast("string"),
        "title": F.col("title"),
        "originalFileName": F.coalesce("original_file_name", F.lit("")),
        "text": F.coalesce("text", F.lit("")),
        "editedHtml": F.coalesce("edited_html", F.lit("")),
        "personalData": F.col("personal_data"),
        "anonymized": F.col("anonymized"),
        "source": F.col("source"),
        "pageFrom": _zero_as_null("page_from"),
        "pageTo": _zero_as_null("page_to"),
        "totalPages": _zero_as_null("total_pages"),
        "chunkIndex": _zero_as_null("chunk_index"),
        "chunkSize": _zero_as_null("chunk_size"),
        "batchFileName": F.coalesce("batch_file", F.lit("")),
        "pageMetadata": F.col("page_metadata"),
        "savedAt": F.date_format(F.coalesce("saved_at", F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    }
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(
        F.struct(
            F.lit(PORTABLE_VERSION).alias("version"),
            stamp.alias("exportedAt"),
            *[c.alias(n) for n, c in names.items()],
        ),
        {"ignoreNullFields": "false"},
    )


def write_portable_json(docs: DataFrame, path: str) -> None:
    """One JSON object per line (``read_portable_json(multi_line=False)``)."""
    docs.select(portable_json(docs).alias("value")).write.mode("errorifexists").text(path)


#: Files of one project at most.
EXPORT_FILES = 64


def export_redacted(docs: DataFrame, path: str, fmt: str = "html", column: str = "html") -> None:
    """Redacted texts or HTML by project, one document per record."""
    if fmt not in ("html", "text"):
        raise ValueError(f"unknown format: {fmt}")
    body = export_spans(column) if fmt == "html" else F.col(column)
    # a project's documents meet in a few tasks, so that it gets few files; a large one still spreads over EXPORT_FILES
    dealt = docs.repartition("project_id", F.pmod(F.xxhash64("doc_id"), F.lit(EXPORT_FILES)))
    dealt.select("project_id", "doc_id", body.alias("content")).write.mode("errorifexists").partitionBy(
        "project_id"
    ).json(path)


def upsert_documents(target: DataFrame, delta: DataFrame, key: str = "doc_id", now: Column | None = None, seq: str | None = None) -> DataFrame:
    """Insert-or-replace by id. Where a delta holds an id more than once, the
    last by ``seq`` counts (a partial aggregate). ``now`` stamps ``saved_at``.
    Where the target has ``created_at``, a row keeps it through updates, so that
    lists by creation keep its place; a new one gets ``now``."""
    fresh = delta
    if seq:
        rest = [c for c in delta.columns if c not in (key, seq)]
        fresh = delta.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(
            key, *[F.col(f"_r.{c}").alias(c) for c in rest]
        )
    stamp = F.current_timestamp() if now is None else now
    if "saved_at" in target.columns:
        fresh = fresh.withColumn("saved_at", stamp)
    if "created_at" in target.columns:
        first = target.select(F.col(key).alias("_k"), F.col("created_at").alias("_first"), F.lit(True).alias("_known"))
        fresh = fresh.drop("created_at").join(first, F.col(key) == F.col("_k"), "left")
        fresh = fresh.withColumn("created_at", F.when(F.col("_known"), F.col("_first")).otherwise(stamp)).drop("_k", "_first", "_known")
    return target.join(fresh.select(key), key, "left_anti").select(*target.columns).unionByName(
        fresh, allowMissingColumns=True
    ).select(*target.columns)
