"""Incremental page processing with Structured Streaming.

Every micro-batch writes its own ``batch=N`` folder of each log, replacing it
when the batch is replayed, so a restart can neither lose nor double a page.
Current documents and registries are views over the logs; no table is
rewritten per batch. The stream's checkpoint is the resume point.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.corpus import append_pages
from ..operators.ordinal import first_per_key, with_ordinal
from ..operators.registry import assign_letters, merge_others, merge_persons
from ..sources.versions import VersionedTables


def read_pages(
    spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files_per_step: int = 1
) -> DataFrame:
    """Page files as they arrive, a few per step."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_step)
        .parquet(folder)
    )


def run_available(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived and stop; the next run goes on from there."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _put(df: DataFrame, log: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")


def _names(ddl: str) -> list[str]:
    """Column names of a flat DDL list."""
    return [item.split()[0] for item in ddl.split(",")]


def _log(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """A log table: the newest compaction and the batches behind it. Empty
    first parts make both readable from the start."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{log}/batch=-1")
    spark.createDataFrame([], f"{schema}, batch bigint").write.mode("ignore").parquet(f"{log}-compact/upto=-1")
    parts = spark.read.schema(f"{schema}, batch bigint, upto bigint").parquet(f"{log}-compact")
    upto = parts.agg(F.max("upto")).first()[0]
    upto = -1 if upto is None else upto
    rows = spark.read.schema(f"{schema}, batch bigint").parquet(log).filter(F.col("batch") > upto)
    return rows.unionByName(parts.filter(F.col("upto") == upto).drop("upto"))


def compact(spark: SparkSession, log: str, schema: str, upto: int) -> None:
    """Gather all batches up to ``upto`` (one that is complete) into one part,
    which readers use from then on. The parts it replaces can be deleted once
    no reader is left that began before."""
    rows = _log(spark, log, schema).filter(F.col("batch") <= upto)
    rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).write.mode("overwrite").parquet(f"{log}-compact/upto={upto}")


PAGES = (
    "project_id string, file_key string, page_no bigint, seq bigint, doc_id string, title string, text string, total_pages bigint"
)
ENTRIES = (
    "project_id string, pd_id string, seq bigint, kind string, category string, pd_type string, value string, role string, "
    "letter string, replacement string, mentions array<string>"
)


def page_step(log: str) -> Callable[[DataFrame, int], None]:
    """Append the batch's pages to the page log."""
    def step(batch: DataFrame, batch_id: int) -> None:
        _put(batch.select(*_names(PAGES)), f"{log}/pages", batch_id)

    return step


def current_documents(spark: SparkSession, log: str) -> tuple[DataFrame, DataFrame]:
    """Documents as far as their pages have arrived. A page delivered again
    counts once, whatever batch it came with; arrival order does not matter."""
    pages = _log(spark, f"{log}/pages", PAGES)
    return append_pages(pages.drop("batch"))


MEMBERS = "project_id string, file_key string, page_no bigint, seq bigint"


def document_tables(spark: SparkSession, path: str) -> VersionedTables:
    """Page log and membership log with one marker per micro-batch."""
    return VersionedTables(spark, path, {"pages": PAGES, "members": MEMBERS})


def document_step(tables: VersionedTables) -> Callable[[DataFrame, int], None]:
    """A batch's pages, and its files that no batch brought before as members
    of their projects: one commit, so that no reader finds pages of a document
    that its project does not list, nor the other way round. A batch that was
    interrupted between its writes is written anew."""
    def step(batch: DataFrame, batch_id: int) -> None:
        if tables.is_done(batch_id):
            return
        tables.put("pages", batch, batch_id)
        pages = tables.spark.read.schema(PAGES).parquet(f"{tables.path}/pages/commit={batch_id}")
        first = first_per_key(pages.select("project_id", "file_key", "page_no", "seq"), ["project_id", "file_key"], ["page_no", "seq"])
        known = tables.read("members").select("project_id", "file_key")
        tables.put("members", first.join(known, ["project_id", "file_key"], "left_anti"), batch_id)
        tables.finish(batch_id)

    return step


def documents_with_places(tables: VersionedTables) -> tuple[DataFrame, DataFrame]:
    """(document facts with ``pos``, their place in the project by arrival, and
    text segments) of all finished batches."""
    facts, segments = append_pages(tables.read("pages").drop("commit"))
    # files that arrive together are listed by key; a block holds what one batch brought
    members = tables.read("members").select("project_id", "file_key", "commit")
    placed = with_ordinal(members, ["project_id"], [F.col("commit"), F.col("file_key")], [F.col("commit")], out="pos")
    return facts.join(placed.drop("commit"), ["project_id", "file_key"], "left"), segments


def registry_step(log: str) -> Callable[[DataFrame, int], None]:
    """Append the batch's registry rows, persons and other values, as they
    are: merging is left to the view, so that later roles and spellings count."""
    def step(batch: DataFrame, batch_id: int) -> None:
        _put(batch.select(*_names(ENTRIES)), f"{log}/entries", batch_id)

    return step


def current_registry(spark: SparkSession, log: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons with letters, other values, mention rows) as far as rows have
    arrived: the batch merge of the log, whatever the order of arrival. Stored
    letters stay; the other persons are numbered by ``seq``."""
    entries = _log(spark, f"{log}/entries", ENTRIES).drop("batch")
    persons, person_rows = merge_persons(entries.filter(F.col("kind") == "person"))
    others, other_rows = merge_others(entries.filter(F.col("kind") != "person"))
    known = persons.filter(F.coalesce("letter", F.lit("")) != "")
    cols = ["project_id", "pd_id", "mention", "m_seq", "m_pos"]
    return assign_letters(persons, known), others, person_rows.select(*cols).unionByName(other_rows.select(*cols))


def stream_dedupe(stream: DataFrame, keys: list[str], stamp: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Deliveries without repeated keys; with a time column the remembered keys
    are forgotten after ``delay``."""
    if stamp is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark(keys)


def session_state(progress: DataFrame) -> DataFrame:
    """State per session from progress rows ``(session_id, ts, status,
    page_to, total_pages, error)``, batch or streaming alike.

    Completed once the last page is reached; else the latest status; the next
    page follows the last one done.
    """
    done = F.max("page_to")
    total = F.max("total_pages")
    at = F.struct("ts", "page_to")
    status = F.max_by("status", at)
    return progress.groupBy("session_id").agg(
        done.alias("page_to"),
        total.alias("total_pages"),
        (done + 1).alias("next_page"),
        F.when(done >= total, "completed").otherwise(status).alias("status"),
        F.when(done >= total, "").when(status == "failed", F.max_by("error", at)).otherwise("").alias("error"),
    )


_OPEN = "page_to long, total_pages long, status string, error string"


def _micros(ts: str, zoneless: bool) -> Column:
    """Microseconds since 1970; a time without zone is counted as it reads."""
    if not zoneless:
        return F.unix_micros(ts)
    seconds = F.unix_date(F.col(ts).cast("date")) * F.lit(86400).cast("bigint") + F.hour(ts) * 3600 + F.minute(ts) * 60
    return seconds * 1000000 + (F.extract(F.lit("SECOND"), ts) * 1000000).cast("bigint")


def session_lifecycle(progress: DataFrame) -> DataFrame:
    """Sessions one after another under the same id: a session that reaches its
    last page leaves the state, and progress behind it begins a new one. The
    state holds open sessions only, however many have been completed.

    ``progress(session_id, ts, seq, status, page_to, total_pages, error)``,
    delivered in order of time; inside a batch rows are ordered by ts and seq.
    """
    # a session sees few rows per batch: plain values, one small frame out
    def advance(key, frames, state):
        now = tuple(state.get) if state.exists else None
        steps = [json.loads(step) for f in frames for step in f["step"].tolist()]
        steps.sort(key=lambda step: step[:2])
        for _at, _seq, done, total, status, error in steps:
            if now is not None and now[2] != "completed":
                done, total = max(done, now[0]), max(total, now[1])
            now = (done, total, "completed", "") if done >= total else (done, total, status, error if status == "failed" else "")
        if now[2] == "completed":
            if state.exists:
                state.remove()
        else:
            state.update(now)
        done, total, status, error = now
        yield pd.DataFrame({"session_id": [key[0]], "page_to": [done], "total_pages": [total], "next_page": [done + 1], "status": [status], "error": [error]})

    known = progress.filter("page_to IS NOT NULL AND total_pages IS NOT NULL")
    # unknown times and numbers come last
    last = F.lit(2**63 - 1)
    at = _micros("ts", isinstance(progress.schema["ts"].dataType, T.TimestampNTZType))
    text = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    numbers = F.concat_ws(",", F.coalesce(at, last), F.coalesce("seq", last), F.col("page_to").cast("bigint"), F.col("total_pages").cast("bigint"))
    step = F.concat(F.lit("["), numbers, *(part for c in ("status", "error") for part in (F.lit(","), F.substr(text(c), F.lit(2), F.length(text(c)) - 2))), F.lit("]"))
    # one packed column: handing a session's rows over costs by the column
    known = known.select("session_id", step.alias("step"))
    return known.groupBy("session_id").applyInPandasWithState(advance, SESSIONS, _OPEN, "update", GroupStateTimeout.NoTimeout)


SESSIONS = (
    "session_id bigint, page_to bigint, total_pages bigint, next_page bigint, status string, error string"
)


def session_step(log: str) -> Callable[[DataFrame, int], None]:
    """Log the sessions a batch changed (update mode)."""
    def step(batch: DataFrame, batch_id: int) -> None:
        _put(batch.select(*_names(SESSIONS)), f"{log}/sessions", batch_id)

    return step


def current_sessions(spark: SparkSession, log: str, keep_completed: bool = False) -> DataFrame:
    """Latest state per session; completed sessions are cleared."""
    rows = _log(spark, f"{log}/sessions", SESSIONS)
    rest = [c for c in _names(SESSIONS) if c != "session_id"]
    latest = rows.groupBy("session_id").agg(F.max_by(F.struct(*rest), "batch").alias("s")).select("session_id", "s.*")
    return latest if keep_completed else latest.filter(F.col("status") != "completed")
