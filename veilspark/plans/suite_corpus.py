"""Sources and sinks, projects, pages, ordering and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import corpus as C, lines as L, pages as G, reports
from ..sources import readers, writers
from .flows import recognize
from .session import scratch_dir
from .suite import query
from .suite_text import LINES_CTE, WS_CHARS, docs, lines_of, sql_trim, table


# --- sources and sinks ------------------------------------------------------

ROW = """CAST(doc_id AS string) AS id, 'u' || (doc_id % 7) AS user_id, nullif(source, 'src0') AS project_id, 'T' || doc_id AS title,
 text, nullif(lang, 'en') AS source, doc_id % 10 = 0 AS is_project_summary,
 CASE WHEN doc_id % 4 = 0 THEN doc_id % 5 ELSE CAST(NULL AS bigint) END AS page_from, doc_id % 11 AS page_to, doc_id % 6 AS total_pages,
 TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id AS int) * INTERVAL '1' SECOND AS saved_at"""


def document_rows(spark, sf) -> DataFrame:
    t = table(spark, sf, "documents")
    meta = F.from_json(
        F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct((F.col("doc_id") % 3).alias("pageFrom"), (F.col("doc_id") % 8).alias("pageTo"))).alias("sources"))),
        G.PAGE_METADATA,
    )
    return t.selectExpr(
        "CAST(doc_id AS string) AS id", "'u' || (doc_id % 7) AS user_id", "nullif(source, 'src0') AS project_id", "'T' || doc_id AS title",
        "text", "nullif(lang, 'en') AS source", "doc_id % 10 = 0 AS is_project_summary",
        "CASE WHEN doc_id % 4 = 0 THEN doc_id % 5 END AS page_from", "doc_id % 11 AS page_to", "doc_id % 6 AS total_pages",
        "TIMESTAMP '2024-01-01 00:00:00' + CAST(doc_id AS int) * INTERVAL '1' SECOND AS saved_at", "doc_id AS n",
    ).join(t.select(F.col("doc_id").alias("n"), F.when(F.col("doc_id") % 2 == 0, meta).alias("page_metadata")), "n").drop("n")


@query(
    "s1_read_documents",
    f"""WITH r AS (SELECT {ROW}, doc_id % 2 = 0 AS has_meta, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS m_from, CASE WHEN doc_id % 8 > 0 THEN doc_id % 8 END AS m_to FROM documents),
    f AS (SELECT *, nullif(page_from, 0) AS pf, nullif(page_to, 0) AS pt, nullif(total_pages, 0) AS tp FROM r),
    -- effective range of the first source: its own values, else the row's
    s AS (SELECT *, CASE WHEN has_meta THEN coalesce(m_from, pf) ELSE pf END AS sf, CASE WHEN has_meta THEN coalesce(m_to, pt) ELSE pt END AS st FROM f)
    SELECT id AS doc_id, user_id, project_id, title, coalesce(text, '') AS text, coalesce(source, 'ocr') AS source, is_project_summary AS is_summary,
      coalesce(pf, sf) AS page_from, coalesce(pt, st) AS page_to, tp AS total_pages, strftime(saved_at, '%Y-%m-%d %H:%M:%S') AS saved_at FROM s""",
)
def _(spark, sf):
    d = readers.read_documents(document_rows(spark, sf))
    return d.select(
        "doc_id", "user_id", "project_id", "title", "text", "source", "is_summary", "page_from", "page_to", "total_pages",
        F.date_format("saved_at", "yyyy-MM-dd HH:mm:ss").alias("saved_at"),
    )


@query(
    "s2_read_projects",
    """SELECT 'p' || c_custkey AS project_id, 'u' || c_nationkey AS user_id, c_name AS title,
      CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 2 END AS BIGINT) AS n_ids, 0::BIGINT AS n_shared FROM customer""",
)
def _(spark, sf):
    rows = table(spark, sf, "customer").selectExpr(
        "'p' || c_custkey AS id", "'u' || c_nationkey AS user_id", "c_name AS title",
        "CASE WHEN c_custkey % 3 > 0 THEN array('a' || c_custkey, 'b') END AS document_ids",
        "TIMESTAMP '2024-01-01 00:00:00' AS created_at", "TIMESTAMP '2024-01-01 00:00:00' + CAST(c_custkey AS int) * INTERVAL '1' SECOND AS updated_at",
    )
    p = readers.read_projects(rows)
    return p.select(
        "project_id", "user_id", "title", F.size("document_ids").cast("bigint").alias("n_ids"),
        F.size("shared_pd.persons").cast("bigint").alias("n_shared"),
    )


# written by s4 and read back by s3: one document per line
ROUND_TRIP = """SELECT 'T' || doc_id AS title, text, coalesce(nullif(lang, 'en'), 'ocr') AS source,
  nullif(doc_id % 11, 0) AS page_to FROM documents"""


@query("s3_read_portable_json", ROUND_TRIP)
def _(spark, sf):
    path = scratch_dir(spark, "portable")
    writers.write_portable_json(readers.read_documents(document_rows(spark, sf).drop("page_metadata"), ordered=False), path)
    back = readers.read_portable_json(spark, path, multi_line=False)
    return back.filter("error IS NULL").select("title", "text", "source", "page_to")


@query(
    "s4_write_portable_json",
    """SELECT CAST(doc_id AS VARCHAR) AS id, 18::BIGINT AS n_fields, 'T' || doc_id AS title, 1::BIGINT AS version FROM documents""",
)
def _(spark, sf):
    d = readers.read_documents(document_rows(spark, sf), ordered=False)
    j = d.select(writers.portable_json(d).alias("j"))
    return j.select(
        F.get_json_object("j", "$.id").alias("id"),
        F.size(F.json_object_keys("j")).cast("bigint").alias("n_fields"),
        F.get_json_object("j", "$.title").alias("title"),
        F.get_json_object("j", "$.version").cast("bigint").alias("version"),
    )


@query(
    "s5_read_source_files",
    """WITH f AS (SELECT url || (CASE page_id % 6 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.docx' WHEN 2 THEN '/c.jpeg' WHEN 3 THEN '/d.txt' WHEN 4 THEN '/e.webp' ELSE '/pdf' END) AS path,
      page_id FROM pages)
    SELECT path, regexp_extract(path, '([^/]*)$', 1) AS file_name, CASE page_id % 6 WHEN 1 THEN 'docx' WHEN 3 THEN 'rejected' WHEN 5 THEN 'rejected' ELSE 'page-batch' END AS route,
      CASE WHEN page_id % 6 IN (3, 5) THEN 'unsupported file type' END AS error FROM f""",
)
def _(spark, sf):
    files = table(spark, sf, "pages").selectExpr(
        "url || (CASE page_id % 6 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.docx' WHEN 2 THEN '/c.jpeg' WHEN 3 THEN '/d.txt' WHEN 4 THEN '/e.webp' ELSE '/pdf' END) AS path",
        "CAST(1 AS bigint) AS length", "TIMESTAMP '2024-01-01 00:00:00' AS modificationTime",
    )
    return readers.classify_sources(files).select("path", "file_name", "route", "error")


#: Files of a folder, each written from a share of the pages.
FILES = ("scan.pdf", "PHOTO.JPG", "note.docx", "list.txt", "pic.webp", "x.png", "pdf", "old.doc")


@query(
    "s5_list_files",
    f"""WITH f AS (SELECT page_id % {len(FILES)} AS k, CAST(sum(strlen(html) + 1) AS BIGINT) AS file_size FROM pages GROUP BY ALL)
    SELECT ([{", ".join(repr(x) for x in FILES)}])[k + 1] AS file_name, file_size, CASE WHEN k IN (0, 1, 4, 5) THEN 'page-batch' WHEN k = 2 THEN 'docx' ELSE 'rejected' END AS route,
      CASE WHEN k IN (3, 6, 7) THEN 'unsupported file type' END AS error FROM f""",
)
def _(spark, sf):
    folder = scratch_dir(spark, "files")
    shares = table(spark, sf, "pages").select("html", (F.col("page_id") % len(FILES)).cast("int").alias("k"))
    shares.repartition(len(FILES), "k").write.partitionBy("k").text(f"{folder}/written")
    # the writer chooses its files' names; a few files, renamed by the driver
    paths = spark._jvm.org.apache.hadoop.fs
    system = paths.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(paths.Path(f"{folder}/given"))
    for k, name in enumerate(FILES):
        for found in system.globStatus(paths.Path(f"{folder}/written/k={k}/part-*")) or []:
            system.rename(found.getPath(), paths.Path(f"{folder}/given/{name}"))
    return readers.read_source_files(spark, f"{folder}/given").select("file_name", "file_size", "route", "error")


@query(
    "s6_unify_sources",
    f"""SELECT 'd' || doc_id AS id, text, lang, 'ocr' AS source FROM documents
    UNION ALL SELECT 'b' || item_id, text, NULL, 'docx' FROM benchmark
    UNION ALL SELECT 'c' || conv_id || '-' || turn, {sql_trim("CASE WHEN turn % 3 = 0 THEN '  ' ELSE ' ' || text || chr(10) END")}, NULL, 'paste' FROM conversations WHERE turn % 3 <> 0""",
)
def _(spark, sf):
    return readers.unify_sources(
        ocr=table(spark, sf, "documents").selectExpr("'d' || doc_id AS id", "text", "lang"),
        docx=table(spark, sf, "benchmark").selectExpr("'b' || item_id AS id", "text"),
        paste=table(spark, sf, "conversations").select(
            F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"),
            F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n"))).alias("text"),
        ),
    )


@query(
    "s8_upsert_documents",
    """SELECT doc_id, CASE WHEN d.k IS NULL THEN documents.source ELSE 'e' || d.last END AS source,
      CASE WHEN d.k IS NULL THEN 'old' ELSE 'now' END AS saved_at FROM documents LEFT JOIN
      (SELECT user_id AS k, max(event_id) AS last FROM events GROUP BY ALL) d ON doc_id = k
    UNION ALL SELECT user_id, 'e' || max(event_id), 'now' FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents) GROUP BY user_id""",
)
def _(spark, sf):
    target = table(spark, sf, "documents").select("doc_id", "source", F.lit("old").alias("saved_at"))
    delta = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.concat(F.lit("e"), "event_id").alias("source"), "event_id")
    return writers.upsert_documents(target, delta, now=F.lit("now"), seq="event_id")


# --- projects and membership ------------------------------------------------


@query(
    "j1_project_documents",
    """WITH p AS (SELECT 'p' || doc_id AS project_id, [doc_id + 2, doc_id, doc_id + 1, doc_id + 1000000000] AS ids FROM documents),
    m AS (SELECT project_id, unnest(range(4)) AS pos, unnest(ids) AS doc_id FROM p)
    SELECT project_id, pos, doc_id, lang FROM m JOIN documents USING (doc_id) WHERE doc_id % 10 <> 0""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", (F.col("doc_id") % 10 == 0).alias("is_summary"))
    ids = F.array(*[F.col("doc_id") + k for k in (2, 0, 1, 1000000000)])
    members = C.membership(d.select(F.concat(F.lit("p"), "doc_id").alias("project_id"), ids.alias("document_ids")))
    return C.project_documents(members, d).select("project_id", F.col("pos").cast("bigint").alias("pos"), "doc_id", "lang")


def members_of(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("pos"), "doc_id")


@query(
    "w7_part_numbers",
    """SELECT source AS project_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS part_no,
      count(*) OVER (PARTITION BY source) AS n_parts FROM documents""",
)
def _(spark, sf):
    return C.part_numbers(members_of(spark, sf)).drop("pos")


@query("t4_last_document", "SELECT source AS project_id, max(doc_id) AS doc_id FROM documents GROUP BY ALL")
def _(spark, sf):
    return C.last_document(members_of(spark, sf))


@query(
    "a12_build_project_summary",
    """WITH o AS (SELECT source AS project_id, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS part_no FROM documents),
    p AS (SELECT project_id, part_no, doc_id, CASE WHEN part_no = 1 THEN text ELSE chr(10) || '[PART:' || part_no || ']' || chr(10) || text END AS part_text FROM o)
    SELECT project_id, part_no, doc_id, part_text,
      CAST(coalesce(sum(length(part_text)) OVER (PARTITION BY project_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM p""",
)
def _(spark, sf):
    return C.build_project_summary(members_of(spark, sf), table(spark, sf, "documents").select("doc_id", "text")).drop("n_parts")


@query(
    "a12_project_summary",
    """WITH d AS (SELECT source AS project_id, doc_id, text FROM documents WHERE doc_id % 7 > 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY doc_id) AS part_no FROM d),
    p AS (SELECT project_id, part_no, doc_id, CASE WHEN part_no = 1 THEN text ELSE chr(10) || '[PART:' || part_no || ']' || chr(10) || text END AS part_text FROM o),
    l AS (SELECT project_id, max(doc_id) AS doc_id FROM d GROUP BY ALL),
    s AS (SELECT project_id, 'k' || (doc_id % 3) AS source_key, min(nullif(doc_id % 7, 0)) AS f, max(nullif(doc_id % 9, 0)) AS t, arg_min(nullif(doc_id % 4, 0), doc_id) AS n FROM d GROUP BY ALL),
    g AS (SELECT DISTINCT project_id, 'k' || (doc_id % 3) AS source_key, unnest(range(1, doc_id % 4 + 1)) AS page_no FROM d)
    SELECT 'part' AS kind, project_id, CAST(doc_id AS VARCHAR) AS key, part_no AS a,
      CAST(coalesce(sum(length(part_text)) OVER (PARTITION BY project_id ORDER BY part_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b, CAST(NULL AS BIGINT) AS c, part_text AS text FROM p
    UNION ALL SELECT 'entry', project_id, 'e' || doc_id || k, NULL, NULL, NULL, NULL FROM l, (VALUES ('a'), ('b')) AS t(k)
    UNION ALL SELECT DISTINCT 'flag', project_id, 'q' || quality, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR FROM labels JOIN d USING (doc_id) WHERE toxic = 1
    UNION ALL SELECT 'source', project_id, source_key, f, t, n, NULL FROM s
    UNION ALL SELECT 'page', project_id, source_key, page_no, row_number() OVER (PARTITION BY project_id, source_key ORDER BY page_no), NULL, NULL FROM g
    UNION ALL SELECT 'document', source, CAST(doc_id AS VARCHAR), 0, NULL, NULL, NULL FROM documents WHERE doc_id % 7 > 0
    UNION ALL SELECT 'document', source, CAST(doc_id AS VARCHAR), 1, NULL, NULL, NULL FROM documents WHERE doc_id % 7 = 0 AND source NOT IN (SELECT project_id FROM l)
    UNION ALL SELECT 'document', project_id, 'summary', 1, NULL, NULL, NULL FROM l""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("project_id"), "doc_id", "text", (F.col("doc_id") % 7 == 0).alias("is_summary"))
    entries = d.select("project_id", "doc_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("k")).withColumn("pd_id", F.concat(F.lit("e"), "doc_id", "k"))
    flags = table(spark, sf, "labels").select("doc_id", F.concat(F.lit("q"), "quality").alias("pd_id"), (F.col("toxic") == 1).alias("flag"))
    key = F.concat(F.lit("k"), F.col("doc_id") % 3).alias("source_key")
    number = F.col("doc_id")
    sources = d.select("doc_id", key, number.alias("seq"), (number % 7).alias("page_from"), (number % 9).alias("page_to"), (number % 4).alias("total_pages"))
    pages = d.filter(number % 4 > 0).select("doc_id", key, number.alias("seq"), F.explode(F.sequence(F.lit(1), (number % 4).cast("int"))).alias("page_no"))
    made = C.project_summaries(members_of(spark, sf), d, entries, flags, sources, pages)
    fresh = made["parts"].select("project_id").distinct().select("project_id", F.lit("summary").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(True).alias("is_summary"))
    kept = C.replace_summaries(d.withColumn("doc_id", F.col("doc_id").cast("string")), fresh)
    none = F.lit(None)

    def rows(kind, df, key, a=none, b=none, c=none, text=none):
        long = [x.cast("bigint").alias(n) for n, x in (("a", a), ("b", b), ("c", c))]
        return df.select(F.lit(kind).alias("kind"), "project_id", key.cast("string").alias("key"), *long, text.cast("string").alias("text"))

    col = F.col
    return (
        rows("part", made["parts"], col("doc_id"), col("part_no"), col("char_start"), text=col("part_text"))
        .unionByName(rows("entry", made["registry"], col("pd_id")))
        .unionByName(rows("flag", made["flags"], col("pd_id")))
        .unionByName(rows("source", made["sources"], col("source_key"), col("page_from"), col("page_to"), col("total_pages")))
        .unionByName(rows("page", made["pages"], col("source_key"), col("page_no"), col("chunk_page_index")))
        .unionByName(rows("document", kept, col("doc_id"), col("is_summary").cast("int")))
    )


@query(
    "u4_project_membership",
    """WITH m AS (SELECT source AS project_id, doc_id AS pos, doc_id FROM documents),
    a AS (SELECT 'src' || (doc_id % 25) AS project_id, doc_id, min(event_id) AS s FROM (SELECT event_id, user_id AS doc_id FROM events) GROUP BY ALL),
    f AS (SELECT a.project_id, a.doc_id, row_number() OVER (PARTITION BY a.project_id ORDER BY s) + coalesce(max(e.pos), -1) AS pos
        FROM a ANTI JOIN m USING (project_id, doc_id) LEFT JOIN (SELECT project_id, max(pos) AS pos FROM m GROUP BY ALL) e ON e.project_id = a.project_id GROUP BY a.project_id, a.doc_id, s)
    SELECT project_id, pos, doc_id FROM m WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
    UNION ALL SELECT project_id, pos, doc_id FROM f WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def _(spark, sf):
    m = members_of(spark, sf)
    added = table(spark, sf, "events").select(
        F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("project_id"), F.col("user_id").alias("doc_id"), F.col("event_id").alias("a_seq")
    )
    grown = C.add_documents(m, added)
    gone = grown.join(table(spark, sf, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select("project_id", "doc_id")
    return C.remove_documents(grown, gone).select("project_id", "pos", "doc_id")


@query(
    "j12_referential_actions",
    """SELECT doc_id, 'u' || (doc_id % 30) AS user_id, CASE WHEN source NOT IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 2) THEN source END AS project_id
    FROM documents WHERE doc_id % 30 NOT IN (SELECT r_regionkey FROM region) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("u"), (F.col("doc_id") % 30).cast("string")).alias("user_id"), F.col("source").alias("project_id")
    )
    projects = table(spark, sf, "nation").filter("n_regionkey = 2").selectExpr("'src' || n_nationkey AS project_id")
    users = table(spark, sf, "region").selectExpr("'u' || r_regionkey AS user_id")
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    left, _members = C.referential_actions(d, members_of(spark, sf), projects, users, gone)
    return left


@query(
    "j7_manifest_diff",
    """WITH s AS (SELECT event_id AS session_id, CASE WHEN event_id % 9 = 0 THEN 'image' WHEN event_id % 2 = 0 THEN 'pdf' END AS source_kind, nullif('f' || user_id, 'f3') AS file_name,
        event_id % 5 AS file_size, nullif(event_id % 2, 0) AS modified, event_id % 50 AS next_page FROM events),
    k AS (SELECT coalesce(file_name, '') AS n, file_size AS z, coalesce(modified, 0) AS t, max(session_id) AS session_id, arg_max(next_page, session_id) AS next_page
        FROM s WHERE coalesce(source_kind, 'pdf') = 'pdf' GROUP BY ALL),
    f AS (SELECT event_id AS file_id, nullif('f' || user_id, 'f3') AS file_name, event_id % 5 AS file_size, nullif(event_id % 2, 0) AS modified FROM events)
    SELECT file_id, k.session_id, k.next_page FROM f LEFT JOIN k ON n = coalesce(file_name, '') AND z = file_size AND t = coalesce(modified, 0)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").selectExpr(
        "event_id", "event_type", "nullif('f' || user_id, 'f3') AS file_name", "event_id % 5 AS file_size", "nullif(event_id % 2, 0) AS modified"
    )
    sessions = e.selectExpr(
        "event_id AS session_id", "CASE WHEN event_id % 9 = 0 THEN 'image' WHEN event_id % 2 = 0 THEN 'pdf' END AS source_kind",
        "file_name", "file_size", "modified", "event_id % 50 AS next_page",
    )
    files = e.selectExpr("event_id AS file_id", "file_name", "file_size", "modified")
    return C.manifest_diff(sessions, files).select("file_id", "session_id", "next_page")


@query(
    "j7_same_image_set",
    """SELECT conv_id AS set_id, NOT bool_or(conv_id % 3 = 0 AND turn = 0) AND NOT bool_or(conv_id % 5 = 1 AND turn >= 2) AS same FROM conversations GROUP BY conv_id""",
)
def _(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("set_id"), F.col("turn").alias("pos"), F.concat(F.lit("i"), "turn").alias("file_name"), F.length("text").alias("file_size"),
        F.lit(None).cast("bigint").alias("modified"),
    )
    changed = c.withColumn("file_size", F.when((F.col("set_id") % 3 == 0) & (F.col("pos") == 0), F.col("file_size") + 1).otherwise(F.col("file_size")))
    return C.same_image_set(c, changed.filter("NOT (set_id % 5 = 1 AND pos >= 2)"))


@query(
    "w2_dedupe_chunks",
    """WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS batch_file, doc_id % 4 AS page_from, doc_id % 3 + 1 AS page_to, doc_id % 10 = 0 AS is_summary FROM documents),
    k AS (SELECT *, CASE WHEN NOT is_summary AND batch_file <> '' AND page_from <> 0 THEN row_number() OVER (
        PARTITION BY source, batch_file, page_from, page_to, is_summary OR batch_file = '' OR page_from = 0 ORDER BY doc_id) ELSE 1 END AS rn FROM d)
    SELECT doc_id FROM k WHERE rn = 1""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").selectExpr(
        "doc_id", "source AS project_id", "doc_id AS pos", "CASE WHEN doc_id % 13 = 0 THEN '' ELSE lang END AS batch_file", "doc_id % 4 AS page_from",
        "doc_id % 3 + 1 AS page_to", "doc_id % 10 = 0 AS is_summary",
    )
    return C.dedupe_chunks(d).select("doc_id")


@query(
    "a11_merge_source_files",
    """WITH f AS (SELECT user_id AS doc_id, event_id AS pos, CASE WHEN event_id % 3 = 0 THEN 'path' || (event_id % 7) WHEN event_id % 3 = 1 THEN '' END AS storage_path,
      CASE WHEN event_id % 4 < 3 THEN event_type ELSE '' END AS name FROM events),
    k AS (SELECT *, coalesce(nullif(storage_path, ''), nullif(name, ''), 'file_' || pos) AS key FROM f)
    SELECT doc_id, key AS file_key, min(pos) AS pos FROM k GROUP BY ALL""",
)
def _(spark, sf):
    f = table(spark, sf, "events").selectExpr(
        "user_id AS doc_id", "event_id AS pos", "CASE WHEN event_id % 3 = 0 THEN 'path' || (event_id % 7) WHEN event_id % 3 = 1 THEN '' END AS storage_path",
        "CASE WHEN event_id % 4 < 3 THEN event_type ELSE '' END AS name",
    )
    return C.merge_source_files(f).select("doc_id", "file_key", "pos")


@query(
    "t1_latest_documents",
    "SELECT doc_id, stamp FROM (SELECT doc_id, (doc_id * 7919) % 1009 AS stamp FROM documents) ORDER BY stamp DESC, doc_id DESC LIMIT 50",
)
def _(spark, sf):
    d = table(spark, sf, "documents").selectExpr("doc_id", "(doc_id * 7919) % 1009 AS stamp")
    return C.latest_documents(d, stamp="stamp")


@query(
    "t1_latest_per_user",
    """SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return C.latest_documents(e, stamp="ts", tie="event_id", per="user_id").select("user_id", "event_id")


@query(
    "t1_latest_after_updates",
    """SELECT doc_id, stamp AS created_at FROM (SELECT doc_id, (doc_id * 7919) % 1009 AS stamp FROM documents
      UNION ALL SELECT DISTINCT user_id, CAST(500 AS BIGINT) FROM events WHERE user_id NOT IN (SELECT doc_id FROM documents)) ORDER BY created_at DESC, doc_id DESC LIMIT 50""",
)
def _(spark, sf):
    target = table(spark, sf, "documents").select("doc_id", F.lit(0).cast("bigint").alias("saved_at"), (F.col("doc_id") * 7919 % 1009).alias("created_at"))
    delta = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id")
    return C.latest_documents(writers.upsert_documents(target, delta, now=F.lit(500).cast("bigint"), seq="event_id"), stamp="created_at").select("doc_id", "created_at")


@query("t2_latest_projects", "SELECT c_custkey AS project_id FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 30")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_acctbal").alias("updated_at"))
    return C.latest_projects(c).select("project_id")


@query(
    "a13_project_rollup",
    """SELECT 'src' || n_nationkey AS project_id, CAST(coalesce(n, 0) AS BIGINT) AS n_docs, n_regionkey AS updated_at, count(*) OVER () AS n_projects FROM nation LEFT JOIN (SELECT source, count(*) AS n FROM documents GROUP BY ALL) ON source = 'src' || n_nationkey""",
)
def _(spark, sf):
    projects = table(spark, sf, "nation").selectExpr("'src' || n_nationkey AS project_id", "n_regionkey AS updated_at")
    return reports.project_rollup(projects, members_of(spark, sf)).select("project_id", "n_docs", "updated_at", "n_projects")


@query(
    "a8_remaining_chunks",
    """SELECT CAST(greatest(sum(ceil(greatest(0, event_id % 40 - CASE WHEN user_id % 30 = 0 THEN 1 ELSE user_id % 30 END + 1) / 3.0)), 1) AS BIGINT) AS remaining FROM events""",
)
def _(spark, sf):
    jobs = table(spark, sf, "events").selectExpr("event_id % 40 AS total_pages", "user_id % 30 AS next_page")
    return reports.remaining_chunks(jobs, chunk=3)


# --- pages ------------------------------------------------------------------

PAGE_TEXT = "replace(replace(text, '. ', '-' || chr(10)), ', ', chr(10) || ' 12 ' || chr(10))"


def page_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("file_key"),
        (F.col("turn") + 1).alias("page_no"),
        F.replace(F.replace("text", F.lit(". "), F.lit("-\n")), F.lit(", "), F.lit("\n 12 \n")).alias("text"),
    )


CLEAN_CTE = f"""raw AS (SELECT conv_id AS file_key, turn + 1 AS page_no,
      regexp_replace(regexp_replace({PAGE_TEXT}, '([А-яЁёa-zA-Z])-\\r?\\n([а-яёa-z])', '\\1\\2', 'g'), '([А-яЁёa-zA-Z])- ([а-яёa-z])', '\\1\\2', 'g') AS x FROM conversations),
    clean AS (SELECT file_key, page_no, {sql_trim("array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT regexp_matches("
      + sql_trim("l") + ", '^[0-9]{1,3}$')), chr(10))")} AS text FROM raw)"""


@query(
    "a1_assemble_pages",
    f"""WITH {CLEAN_CTE} SELECT file_key, (page_no - 1) // 4 AS segment_no, min(page_no) AS page_from, max(page_no) AS page_to, count(*) AS n_pages,
      string_agg('[PAGE:' || page_no || ']' || chr(10) || text, chr(10) ORDER BY page_no) AS text FROM clean GROUP BY ALL""",
)
def _(spark, sf):
    # every page delivered twice: it must count once
    pages = page_rows(spark, sf).withColumn("seq", F.lit(1))
    return G.assemble_pages(pages.unionByName(pages.withColumn("seq", F.lit(2)).withColumn("text", F.lit("late copy"))), segment=4)


@query(
    "j9_apply_revision",
    f"""WITH c AS (SELECT CASE WHEN conv_id % 4 = 0 THEN -1000 * conv_id - turn - 1 ELSE conv_id END AS conv_id, turn, role, text FROM conversations),
    p AS (SELECT conv_id, turn + 1 AS page_no, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN NULL ELSE '[PAGE:' || (turn + 1) || ']' END AS marker,
        CASE WHEN turn = 3 THEN ' ' || chr(10) ELSE chr(10) || {PAGE_TEXT} END AS text, count(*) OVER (PARTITION BY conv_id) AS n,
        CASE WHEN role = 'assistant' THEN CASE WHEN turn % 3 = 0 THEN role ELSE replace(text, 'e', 'E') || '-' || chr(10) || 'x' END END AS rev FROM c),
    r AS (SELECT *, coalesce(length(rev) > CASE WHEN n = 1 THEN 50 ELSE 30 END, false) AS ok FROM p),
    t AS (SELECT conv_id, page_no, n, marker, text, ok, CASE WHEN ok THEN rev ELSE {sql_trim("text")} END AS b FROM r),
    d AS (SELECT *, regexp_replace(regexp_replace(b, '([А-яЁёa-zA-Z])-\\r?\\n([а-яёa-z])', '\\1\\2', 'g'), '([А-яЁёa-zA-Z])- ([а-яёa-z])', '\\1\\2', 'g') AS j FROM t),
    f AS (SELECT conv_id, page_no, ok, CASE WHEN n = 1 AND NOT ok THEN NULL WHEN n > 1 AND {sql_trim("text")} = '' THEN text ELSE j END AS body, text, marker FROM d)
    SELECT conv_id AS file_key, page_no, ok AS accepted, CASE WHEN body IS NULL THEN coalesce(marker, '') || text
      WHEN marker IS NULL THEN body ELSE chr(10) || marker || chr(10) || body END AS text FROM f""",
)
def _(spark, sf):
    # every page of a quarter of the files is a file of its own
    lone = F.when(F.col("conv_id") % 4 == 0, -1000 * F.col("conv_id") - F.col("turn") - 1).otherwise(F.col("conv_id"))
    c = table(spark, sf, "conversations").withColumn("conv_id", lone)
    page_no = F.col("turn") + 1
    body = F.replace(F.replace("text", F.lit(". "), F.lit("-\n")), F.lit(", "), F.lit("\n 12 \n"))
    pages = c.select(
        F.col("conv_id").alias("file_key"),
        page_no.alias("page_no"),
        F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") == 0), None).otherwise(F.concat(F.lit("[PAGE:"), page_no.cast("string"), F.lit("]"))).alias("marker"),
        F.when(F.col("turn") == 3, " \n").otherwise(F.concat(F.lit("\n"), body)).alias("text"),
    )
    revised = c.filter("role = 'assistant'").select(
        F.col("conv_id").alias("file_key"),
        page_no.alias("page_no"),
        F.when(F.col("turn") % 3 == 0, F.col("role")).otherwise(F.concat(F.replace("text", F.lit("e"), F.lit("E")), F.lit("-\nx"))).alias("revised"),
    )
    return G.apply_revision(pages, revised)


@query(
    "w3_dedupe_pages",
    """WITH p AS (SELECT user_id AS source_key, event_id % 20 AS page_no, min(event_id) AS seq FROM events WHERE event_id % 20 > 0 GROUP BY ALL)
    SELECT source_key, page_no, seq, row_number() OVER (PARTITION BY source_key ORDER BY page_no) AS chunk_page_index FROM p""",
)
def _(spark, sf):
    return G.dedupe_pages(table(spark, sf, "events").selectExpr("user_id AS source_key", "event_id % 20 AS page_no", "event_id AS seq"))


@query(
    "a6_merge_page_metadata",
    """WITH s AS (SELECT user_id % 5 AS scope, event_type AS source_key, event_id AS seq, nullif(event_id % 7, 0) AS f, nullif(event_id % 31, 0) AS t, nullif(event_id % 3, 0) AS n FROM events),
    g AS (SELECT scope, source_key, min(f) AS page_from, max(t) AS page_to, arg_min(n, seq) AS total_pages FROM s GROUP BY ALL),
    p AS (SELECT user_id % 5 AS scope, event_type AS source_key, count(DISTINCT event_id % 40) FILTER (event_id % 40 > 0) AS n_pages FROM events GROUP BY ALL)
    SELECT * FROM g JOIN p USING (scope, source_key)""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    key = [(F.col("user_id") % 5).alias("scope"), F.col("event_type").alias("source_key"), F.col("event_id").alias("seq")]
    sources = e.select(*key, (F.col("event_id") % 7).alias("page_from"), (F.col("event_id") % 31).alias("page_to"), (F.col("event_id") % 3).alias("total_pages"))
    merged, pages = G.merge_page_metadata(sources, e.select(*key, (F.col("event_id") % 40).alias("page_no")))
    counts = pages.groupBy("scope", "source_key").agg(F.max("chunk_page_index").alias("n_pages"))
    return merged.join(counts, ["scope", "source_key"]).drop("seq")


@query(
    "m9_append_page",
    """WITH s AS (SELECT conv_id, turn // 3 AS segment_no, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations
        WHERE turn <> 2 AND conv_id % 10 <> 3 GROUP BY ALL),
    f AS (SELECT conv_id, arg_min('d' || conv_id || '-' || turn, turn) AS doc_id, min(turn) + 1 AS page_from, max(turn) + 1 AS page_to,
        arg_max(nullif(turn % 4, 0), turn) AS total_pages FROM conversations GROUP BY ALL)
    SELECT conv_id AS file_key, doc_id, page_from, page_to, total_pages, coalesce(segment_no, (page_from - 1) // 3) AS segment_no, coalesce(text, '') AS text
    FROM f LEFT JOIN s USING (conv_id)""",
)
def _(spark, sf):
    pages = table(spark, sf, "conversations").select(
        F.lit("p").alias("project_id"),
        F.col("conv_id").alias("file_key"),
        (F.col("turn") + 1).alias("page_no"),
        F.col("turn").alias("seq"),
        F.concat(F.lit("d"), "conv_id", F.lit("-"), "turn").alias("doc_id"),
        F.lit("t").alias("title"),
        # some pages, and all pages of some files, are blank
        F.when((F.col("turn") == 2) | (F.col("conv_id") % 10 == 3), "").otherwise(F.col("text")).alias("text"),
        (F.col("turn") % 4).alias("total_pages"),
    )
    facts, segments = C.append_pages(pages, segment=3)
    whole = C.document_texts(facts, segments, segment=3)
    return whole.select("file_key", "doc_id", "page_from", "page_to", "total_pages", "segment_no", "text")


@query(
    "m9_growing_document",
    """WITH s AS (SELECT conv_id, turn // 3 AS segment_no, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn <> 2 GROUP BY ALL),
    m AS (SELECT conv_id, 's' || (turn % 2) AS k, min(turn) AS seq, min(turn) + 1 AS f, max(turn + 1 + turn % 3) AS t, arg_min(nullif(turn % 5, 0), turn) AS n FROM conversations GROUP BY ALL),
    first AS (SELECT conv_id, arg_min(n, seq) AS n FROM (SELECT conv_id, seq, coalesce(n, -1) AS n FROM m) GROUP BY ALL),
    f AS (SELECT conv_id, arg_min('d' || conv_id || '-' || turn, turn) AS doc_id, min(turn) + 1 AS page_from, max(turn) + 1 AS page_to, arg_max(nullif(turn % 4, 0), turn) AS n FROM conversations GROUP BY ALL),
    g AS (SELECT DISTINCT conv_id, 's' || (turn % 2) AS k, unnest(range(turn + 1, turn + 2 + turn % 3)) AS page_no FROM conversations),
    z AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'path' || (turn % 4) ELSE '' END AS path, CASE WHEN turn % 3 = 0 THEN 'n' || (turn % 3) ELSE '' END AS name FROM conversations)
    SELECT 'fact' AS kind, conv_id, doc_id AS key, page_from AS a, page_to AS b, coalesce(f.n, nullif(first.n, -1)) AS c, CAST(NULL AS VARCHAR) AS text FROM f JOIN first USING (conv_id)
    UNION ALL SELECT 'segment', conv_id, CAST(segment_no AS VARCHAR), NULL, NULL, NULL, text FROM s
    UNION ALL SELECT 'flag', conv_id, role, CAST(arg_max(length(text) % 2, turn) AS BIGINT), NULL, NULL, NULL FROM conversations GROUP BY ALL
    UNION ALL SELECT 'file', conv_id, coalesce(nullif(path, ''), nullif(name, ''), 'file_' || turn), min(turn), NULL, NULL, NULL FROM z GROUP BY ALL
    UNION ALL SELECT 'source', conv_id, k, f, t, n, NULL FROM m
    UNION ALL SELECT 'page', conv_id, k, page_no, row_number() OVER (PARTITION BY conv_id, k ORDER BY page_no), NULL, NULL FROM g""",
)
def _(spark, sf):
    t = table(spark, sf, "conversations").withColumn("project_id", F.lit("p"))
    file, turn = [F.col("project_id"), F.col("conv_id").alias("file_key")], F.col("turn")
    pages = t.select(
        *file, (turn + 1).alias("page_no"), turn.alias("seq"), F.concat(F.lit("d"), "conv_id", F.lit("-"), "turn").alias("doc_id"), F.lit("t").alias("title"),
        F.when(turn == 2, "").otherwise(F.col("text")).alias("text"), (turn % 4).alias("total_pages"),
    )
    flags = t.select(*file, (turn + 1).alias("page_no"), F.col("role").alias("pd_id"), (F.length("text") % 2 == 1).alias("flag"))
    files = t.select(
        *file, turn.alias("pos"), F.when(turn % 3 == 0, F.concat(F.lit("n"), turn % 3)).otherwise("").alias("name"),
        F.when(turn % 2 == 0, F.concat(F.lit("path"), turn % 4)).otherwise("").alias("storage_path"),
    )
    sources = t.select(
        *file, F.concat(F.lit("s"), turn % 2).alias("source_key"), turn.alias("seq"), (turn + 1).alias("page_from"), (turn + 1 + turn % 3).alias("page_to"), (turn % 5).alias("total_pages")
    )
    made, none, col = C.growing_documents(pages, flags, files, sources, segment=3), F.lit(None), F.col

    def rows(kind, df, key, a=none, b=none, c=none, text=none):
        long = [x.cast("bigint").alias(n) for n, x in (("a", a), ("b", b), ("c", c))]
        return df.select(F.lit(kind).alias("kind"), col("file_key").alias("conv_id"), key.cast("string").alias("key"), *long, text.cast("string").alias("text"))

    return (
        rows("fact", made["facts"], col("doc_id"), col("page_from"), col("page_to"), col("total_pages"))
        .unionByName(rows("segment", made["segments"], col("segment_no"), text=col("text")))
        .unionByName(rows("flag", made["flags"], col("pd_id"), col("flag").cast("int")))
        .unionByName(rows("file", made["files"], col("source_name"), col("pos")))
        .unionByName(rows("source", made["sources"], col("source_key"), col("page_from"), col("page_to"), col("total_pages")))
        .unionByName(rows("page", made["pages"], col("source_key"), col("page_no"), col("chunk_page_index")))
    )


LINES_EXTRA = """CASE (doc_id + line_no) % 11 WHEN 0 THEN '' WHEN 1 THEN '## ' || line WHEN 2 THEN '   ' || line WHEN 3 THEN '[PAGE:' || (line_no + 1) || ']' WHEN 4 THEN line || '  ' ELSE line END"""


@query(
    "w4_merge_broken_lines",
    f"""WITH {LINES_CTE}, x AS (SELECT doc_id, line_no, {LINES_EXTRA} AS s FROM lines),
    y AS (SELECT doc_id, line_no, s, {sql_trim("s")} AS t FROM x),
    z AS (SELECT *, t = '' OR starts_with(t, '## ') OR starts_with(t, '### ') OR t = '---' OR regexp_matches(t, '^\\[PAGE:[0-9]+\\]$') OR starts_with(t, '[CENTER]')
        OR starts_with(t, '[LEFTRIGHT:') OR starts_with(t, '[RIGHT-BLOCK]') OR starts_with(t, '[INDENT]') AS special FROM y),
    b AS (SELECT *, line_no = 0 OR special OR regexp_matches(s, '^[ \\t]{{2,}}') OR lag(special) OVER w AS opens FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
    g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM b),
    n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, grp) AS size FROM g),
    p AS (SELECT doc_id, grp, string_agg(CASE WHEN size = 1 THEN s WHEN opens THEN rtrim(s) ELSE t END, ' ' ORDER BY line_no) AS para FROM n GROUP BY ALL)
    SELECT doc_id, string_agg(para, chr(10) ORDER BY grp) AS text FROM p GROUP BY doc_id""",
)
def _(spark, sf):
    lines = lines_of(spark, sf).withColumn("s", F.expr(LINES_EXTRA))
    texts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "s"))).alias("l")).select(
        "doc_id", F.array_join(F.transform("l", lambda x: x["s"]), "\n").alias("text")
    )
    return texts.select("doc_id", L.merge_broken_lines("text").alias("text"))


@query(
    "w8_page_of_line",
    f"""WITH {LINES_CTE}, x AS (SELECT doc_id, line_no, {LINES_EXTRA} AS s FROM lines),
    y AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(s, '^\\[PAGE:[0-9]+\\]$') THEN CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT) END AS p FROM x)
    SELECT doc_id, line_no, last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page_no,
      last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_page FROM y""",
)
def _(spark, sf):
    lines = lines_of(spark, sf).withColumn("line", F.expr(LINES_EXTRA))
    return L.page_of_line(lines).select("doc_id", "line_no", "page_no", "last_page")


# heads that become structural once a line is glued to them
LINES_HEADS = """CASE (doc_id + line_no) % 9 WHEN 0 THEN '' WHEN 1 THEN '##' WHEN 2 THEN ' ###' WHEN 3 THEN '**РЕШИЛ' WHEN 4 THEN '**РЕШИЛИ' WHEN 5 THEN '## ' || line ELSE line END"""
SPECIAL_SQL = """(t = '' OR starts_with(t, '## ') OR starts_with(t, '### ') OR t = '---' OR regexp_matches(t, '^\\[PAGE:[0-9]+\\]$') OR starts_with(t, '[CENTER]')
        OR starts_with(t, '[LEFTRIGHT:') OR starts_with(t, '[RIGHT-BLOCK]') OR starts_with(t, '[INDENT]') OR regexp_matches(t, '^\\*\\*(УСТАНОВИЛ|ПОСТАНОВИЛ|РЕШИЛ|ОПРЕДЕЛИЛ|ПРИГОВОРИЛ)[:\\s*]'))"""


@query(
    "w4_glued_headings",
    f"""WITH RECURSIVE {LINES_CTE}, x AS (SELECT doc_id, line_no, {LINES_HEADS} AS s FROM lines),
    y AS (SELECT doc_id, line_no, s, {sql_trim("s")} AS t FROM x),
    z AS (SELECT *, {SPECIAL_SQL} AS special, regexp_matches(s, '^[ \\t]{{2,}}') AS indented FROM y),
    walk AS (SELECT doc_id, line_no, CAST(0 AS BIGINT) AS para, s AS whole, special AS closed, s, t FROM z WHERE line_no = 0
      UNION ALL SELECT doc_id, line_no, para, whole, {SPECIAL_SQL.replace("(t ", "(u ").replace("starts_with(t,", "starts_with(u,").replace("OR t ", "OR u ").replace("regexp_matches(t,", "regexp_matches(u,")}, s, t
      FROM (SELECT z.doc_id, z.line_no, z.s, z.t, CASE WHEN w.closed OR z.special OR z.indented THEN w.para + 1 ELSE w.para END AS para,
              CASE WHEN w.closed OR z.special OR z.indented THEN z.s ELSE rtrim(w.whole, {WS_CHARS}) || ' ' || z.t END AS whole,
              {sql_trim("CASE WHEN w.closed OR z.special OR z.indented THEN z.s ELSE rtrim(w.whole, " + WS_CHARS + ") || ' ' || z.t END")} AS u
            FROM walk w JOIN z ON z.doc_id = w.doc_id AND z.line_no = w.line_no + 1)),
    done AS (SELECT doc_id, para, arg_max(whole, line_no) AS whole FROM walk GROUP BY ALL)
    SELECT doc_id, string_agg(whole, chr(10) ORDER BY para) AS text FROM done GROUP BY doc_id""",
)
def _(spark, sf):
    lines = lines_of(spark, sf).withColumn("s", F.expr(LINES_HEADS))
    texts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "s"))).alias("l"))
    return texts.select("doc_id", L.merge_broken_lines(F.array_join(F.transform("l", lambda x: x["s"]), "\n")).alias("text"))


@query(
    "w8_page_of_segments",
    f"""WITH {LINES_CTE}, x AS (SELECT doc_id, line_no, CASE WHEN doc_id % 4 = 0 THEN '' ELSE {LINES_EXTRA} END AS s FROM lines),
    y AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(s, '^\\[PAGE:[0-9]+\\]$') THEN CAST(regexp_extract(s, '([0-9]+)', 1) AS BIGINT) END AS p FROM x)
    SELECT doc_id, line_no, last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS page_no,
      coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),
        nullif(doc_id % 3, 0), nullif(doc_id % 5, 0)) AS last_page FROM y""",
)
def _(spark, sf):
    # a document's lines in segments of seven
    lines = lines_of(spark, sf).withColumn("line", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.expr(LINES_EXTRA)))
    segments = lines.withColumn("segment_no", F.floor(F.col("line_no") / 7))
    totals = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("total_pages"), (F.col("doc_id") % 5).alias("page_to"))
    return L.page_of_line(segments, segment="segment_no", totals=totals).select("doc_id", "line_no", "page_no", "last_page")


@query(
    "a5_export_gate",
    """WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', ' ⚠️[НЕЧИТАЕМО] ') WHEN 1 THEN replace(text, ', ', chr(10) || '[PART:2]' || chr(10)) ELSE text END AS x FROM documents)
    SELECT doc_id, len(regexp_extract_all(x, '(?i)⚠️\\[(?:НЕТОЧНО: [^\\]]*|НЕЧИТАЕМО)\\]')) AS n_uncertain, len(regexp_extract_all(x, '\\[PART:[0-9]+\\]')) AS n_parts,
      len(regexp_extract_all(x, '(?i)⚠️\\[(?:НЕТОЧНО: [^\\]]*|НЕЧИТАЕМО)\\]')) + len(regexp_extract_all(x, '\\[PART:[0-9]+\\]')) > 0 AS blocked FROM t""",
)
def _(spark, sf):
    x = F.expr("CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', ' ⚠️[НЕЧИТАЕМО] ') WHEN 1 THEN replace(text, ', ', '\\n[PART:2]\\n') ELSE text END")
    return reports.export_gate(docs(spark, sf).select("doc_id", x.alias("text")))


@query(
    "p1_recognize",
    "SELECT page_id, length(html) AS n_chars FROM pages",
)
def _(spark, sf):
    def sizes(batches):
        for b in batches:
            yield b.assign(n_chars=b["html"].str.len())[["page_id", "n_chars"]]

    return recognize(table(spark, sf, "pages").select("page_id", "html"), sizes, "page_id bigint, n_chars bigint")
