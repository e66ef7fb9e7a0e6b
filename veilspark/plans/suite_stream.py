"""Streaming runs, each checked against the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.corpus import document_texts
from ..streaming import page_stream as S
from .session import scratch_dir
from .suite import query
from .suite_text import PERSONS, table
from .suite_registry import sql_norm


#: Files that a table arrives in, one per micro-batch.
ARRIVALS = 5


def stream_of(spark, sf, name: str) -> DataFrame:
    """The table's rows in shuffled order, a few micro-batches of them."""
    rows = table(spark, sf, name)
    folder = scratch_dir(spark, f"arriving-{name}")
    rows.repartition(ARRIVALS, F.xxhash64(*rows.columns)).write.parquet(folder)
    return S.read_pages(spark, folder, rows.schema)


def page_rows(stream: DataFrame) -> DataFrame:
    return stream.select(
        F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("project_id"),
        F.col("conv_id").cast("string").alias("file_key"),
        (F.col("turn") + 1).alias("page_no"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("d"), "conv_id", F.lit("-"), "turn").alias("doc_id"),
        F.concat(F.lit("t"), "conv_id").alias("title"),
        "text",
        F.lit(8).cast("bigint").alias("total_pages"),
    )


@query("r1_page_stream", "SELECT CAST(conv_id AS VARCHAR) AS file_key, turn + 1 AS page_no, text FROM conversations")
def _(spark, sf):
    log = scratch_dir(spark, "pages")
    stream = page_rows(stream_of(spark, sf, "conversations"))
    # the second run finds nothing new: the checkpoint is the resume point
    for _run in range(2):
        S.run_available(stream, S.page_step(log), f"{log}/checkpoint")
    return S._log(spark, f"{log}/pages", S.PAGES).select("file_key", "page_no", "text")


@query(
    "r3_document_stream",
    """WITH p AS (SELECT conv_id, CASE WHEN conv_id % 7 = 2 THEN turn * 400 ELSE turn END AS turn, CASE WHEN conv_id % 10 = 3 THEN '' ELSE text END AS text FROM conversations),
    f AS (SELECT conv_id, min(turn) + 1 AS page_from, max(turn) + 1 AS page_to FROM p GROUP BY ALL),
    s AS (SELECT conv_id, turn // 1000 AS segment_no, string_agg(text, chr(10) ORDER BY turn) AS text FROM p WHERE text <> '' GROUP BY ALL)
    SELECT CAST(conv_id AS VARCHAR) AS file_key, 'd' || conv_id || '-0' AS doc_id, page_from, page_to, coalesce(segment_no, 0) AS segment_no, coalesce(text, '') AS text
    FROM f LEFT JOIN s USING (conv_id)""",
)
def _(spark, sf):
    log = scratch_dir(spark, "documents")
    stream = page_rows(stream_of(spark, sf, "conversations"))
    # some files reach over 1,000 pages, some have blank pages only
    far = F.when(F.col("file_key").cast("bigint") % 7 == 2, (F.col("page_no") - 1) * 400 + 1).otherwise(F.col("page_no"))
    stream = stream.withColumn("page_no", far).withColumn("text", F.when(F.col("file_key").cast("bigint") % 10 == 3, "").otherwise(F.col("text")))
    S.run_available(stream, S.page_step(log), f"{log}/checkpoint")
    whole = document_texts(*S.current_documents(spark, log))
    return whole.select("file_key", "doc_id", "page_from", "page_to", "segment_no", "text")


@query(
    "r3_project_membership",
    """SELECT 'p' || (conv_id % 3) AS project_id, CAST(conv_id AS VARCHAR) AS file_key, 'd' || conv_id || '-' || min(turn) AS doc_id,
      min(turn) + 1 AS page_from, max(turn) + 1 AS page_to, count(*) AS n_pages, true AS listed,
      CAST(count(*) OVER (PARTITION BY conv_id % 3) AS BIGINT) AS n_docs FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    path = scratch_dir(spark, "membership")
    tables = S.document_tables(spark, path)
    S.run_available(page_rows(stream_of(spark, sf, "conversations")), S.document_step(tables), f"{path}/checkpoint")
    facts, _segments = S.documents_with_places(tables)
    # places are 1..n in every project, so the last one is its number of documents
    last = facts.groupBy("project_id").agg(F.max("pos").cast("bigint").alias("n_docs"))
    rows = facts.join(last, "project_id").select("project_id", "file_key", "doc_id", "page_from", "page_to", "n_pages", F.col("pos").isNotNull().alias("listed"), "n_docs")
    return rows


@query(
    "r2_registry_stream",
    f"""WITH {PERSONS},
    k AS (SELECT *, lower(value) AS nk, min(seq) OVER (PARTITION BY project_id, lower(value)) AS bseq FROM persons),
    base AS (SELECT * FROM k WHERE seq = bseq),
    role AS (SELECT project_id, nk, arg_min(role, seq) AS r FROM k WHERE role <> '' GROUP BY ALL),
    m AS (SELECT project_id, nk, seq, bseq, unnest(mentions) AS raw, unnest(range(len(mentions))) AS pos FROM k),
    n AS (SELECT m.project_id, m.nk, m.seq, m.bseq, pos, {sql_norm("raw")} AS mention, lower({sql_norm("base.value")}) AS bv
        FROM m JOIN base USING (project_id, nk)),
    d AS (SELECT project_id, nk, arg_min(mention, seq * 100 + pos) AS mention, min(seq) AS fs, min(bseq) AS bseq
        FROM n WHERE mention <> '' AND (seq = bseq OR lower(mention) <> bv) GROUP BY project_id, nk, lower(mention)),
    added AS (SELECT DISTINCT project_id, nk FROM d WHERE fs > bseq),
    l AS (SELECT project_id, nk, mention FROM d SEMI JOIN added USING (project_id, nk)
        UNION ALL SELECT project_id, nk, unnest(mentions) FROM base ANTI JOIN added USING (project_id, nk)),
    s AS (SELECT *, CASE WHEN category = 'private' THEN 'private' ELSE 'professional' END AS series FROM base),
    a AS (SELECT *, row_number() OVER (PARTITION BY project_id, series ORDER BY seq) AS no FROM s)
    SELECT a.project_id, a.pd_id, coalesce(role.r, a.role) AS role, l.mention,
      CASE WHEN series <> 'private' THEN '[ФИО ' || no || ']' WHEN no <= 29 THEN substr('АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ', CAST(no AS INT), 1) || '.' ELSE 'Л-' || no END AS letter
    FROM a JOIN l USING (project_id, nk) LEFT JOIN role USING (project_id, nk)""",
)
def _(spark, sf):
    log = scratch_dir(spark, "registry")
    # the same select list on the stream
    stream = stream_of(spark, sf, "customer").selectExpr(*_person_select())
    S.run_available(stream, S.registry_step(log), f"{log}/checkpoint")
    S.compact(spark, f"{log}/entries", S.ENTRIES, ARRIVALS // 2)
    people, _others, mentions = S.current_registry(spark, log)
    return people.select("project_id", "pd_id", "role", "letter").join(mentions.select("project_id", "pd_id", "mention"), ["project_id", "pd_id"])


def _person_select() -> list[str]:
    from .suite_text import PERSON_MENTIONS, PERSON_SQL, _split_select

    return [*_split_select(PERSON_SQL), f"array({PERSON_MENTIONS}) AS mentions"]


@query("r4_stream_dedupe", "SELECT DISTINCT user_id, event_type, CAST(event_id % 3 AS BIGINT) AS page_no FROM events")
def _(spark, sf):
    log = scratch_dir(spark, "deliveries")
    events = stream_of(spark, sf, "events").selectExpr("user_id", "event_type", "event_id % 3 AS page_no")
    once = S.stream_dedupe(events, ["user_id", "event_type", "page_no"])

    def step(batch: DataFrame, batch_id: int) -> None:
        S._put(batch, f"{log}/once", batch_id)

    S.run_available(once, step, f"{log}/checkpoint")
    return spark.read.schema("user_id bigint, event_type string, page_no bigint").parquet(f"{log}/once").select("user_id", "event_type", "page_no")


PROGRESS = """user_id AS session_id, ts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'paused' ELSE 'running' END AS status,
 (event_id * 31) % 997 AS page_to, 960 + user_id % 40 AS total_pages, CASE WHEN event_type = 'error' THEN 'e' || event_id ELSE '' END AS error"""


@query(
    "r5_session_state",
    f"""WITH p AS (SELECT {PROGRESS} FROM events), g AS (SELECT session_id, max(page_to) AS page_to, max(total_pages) AS total_pages,
      arg_max(status, (epoch_us(ts), page_to)) AS st, arg_max(error, (epoch_us(ts), page_to)) AS er FROM p GROUP BY ALL)
    SELECT session_id, page_to, total_pages, page_to + 1 AS next_page, st AS status, CASE WHEN st = 'failed' THEN er ELSE '' END AS error FROM g WHERE page_to < total_pages""",
)
def _(spark, sf):
    log = scratch_dir(spark, "sessions")
    from .suite_text import _split_select

    progress = stream_of(spark, sf, "events").selectExpr(*_split_select(PROGRESS))
    S.run_available(S.session_state(progress), S.session_step(log), f"{log}/checkpoint", mode="update")
    return S.current_sessions(spark, log)


def in_order(spark, df: DataFrame, *order: str) -> DataFrame:
    """The rows as a stream of ``ARRIVALS`` files that arrive in the order of
    the columns, one per micro-batch."""
    cut = scratch_dir(spark, "cut")
    df.repartitionByRange(ARRIVALS, *order).withColumn("_file", F.spark_partition_id()).write.parquet(cut)
    folder = scratch_dir(spark, "in-order")
    for k in range(ARRIVALS):
        spark.read.parquet(cut).filter(F.col("_file") == k).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    return S.read_pages(spark, folder, df.schema)


@query("r4_redelivered_pages", "SELECT event_id, user_id, event_type FROM events")
def _(spark, sf):
    # every event is delivered one to three times within two minutes; keys are forgotten after ten
    log = scratch_dir(spark, "redelivered")
    again = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")))
    sent = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts", again.alias("k"))
    sent = sent.select("event_id", "user_id", "event_type", (F.col("ts").cast("timestamp") + F.col("k") * F.expr("INTERVAL 1 MINUTE")).alias("ts"))
    once = S.stream_dedupe(in_order(spark, sent, "ts", "event_id"), ["event_id"], "ts", "10 minutes")
    S.run_available(once, lambda batch, number: S._put(batch, f"{log}/once", number), f"{log}/checkpoint")
    return spark.read.schema("event_id bigint, user_id bigint, event_type string").parquet(f"{log}/once").select("event_id", "user_id", "event_type")


@query(
    "r5_session_lifecycle",
    f"""WITH p AS (SELECT {PROGRESS}, event_id AS seq FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS n FROM p),
    c AS (SELECT session_id, coalesce(max(n) FILTER (page_to >= total_pages), 0) AS closed FROM o GROUP BY ALL),
    g AS (SELECT session_id, max(page_to) AS page_to, max(total_pages) AS total_pages, arg_max(status, n) AS status, arg_max(error, n) AS error
      FROM o JOIN c USING (session_id) WHERE n > closed GROUP BY ALL)
    SELECT session_id, page_to, total_pages, page_to + 1 AS next_page, status, CASE WHEN status = 'failed' THEN error ELSE '' END AS error FROM g""",
)
def _(spark, sf):
    log = scratch_dir(spark, "lifecycle")
    from .suite_text import _split_select

    progress = table(spark, sf, "events").selectExpr(*_split_select(PROGRESS), "event_id AS seq")
    S.run_available(S.session_lifecycle(in_order(spark, progress, "ts", "seq")), S.session_step(log), f"{log}/checkpoint", mode="update")
    return S.current_sessions(spark, log)
