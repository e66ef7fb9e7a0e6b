"""Changes to stored results: renamed entries, documents that join projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import corpus as C, matching as M, registry as R
from ..operators.spans import SpanStore
from .session import scratch_dir, settle
from .suite import query
from . import flows
from .suite_redaction import ALL_UNITS, FOLDED_UNITS as FOLDED, gaps_cte, kept_cte, matches_cte, phrase_units, rebuilt_cte, text_docs
from .suite_text import LINES_CTE, WS, sql_trim, table

# --- pairs of neighbouring words of the passages as entries ------------------


def mentions_cte(name: str, rows: str) -> str:
    """SQL: mention rows from ``rows(pd_no, mention)``."""
    return f"""{name} AS (SELECT 'all' AS project_id, 'w' || pd_no AS pd_id, pd_no, mention, -length(mention) AS r1, pd_no AS r2,
      '(?i)' || array_to_string(list_transform(string_split(mention, ' '), lambda w: regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '{WS}+') AS pattern FROM ({rows}))"""


PAIRS_CTE = f"""places AS (SELECT item_id, unnest(range(1, len(w))) AS i, w FROM (SELECT item_id, string_split_regex({sql_trim("text")}, '{WS}+') AS w FROM benchmark)),
    named AS (SELECT item_id * 100 + i AS pd_no, i, len(w) AS n, w[i] || ' ' || w[i + 1] AS mention, w[i + 2] || ' ' || w[i + 3] AS later FROM places WHERE i % 4 = 1)"""
PAIR_PROBE = "contains(u.folded, lower(string_split(m.mention, ' ')[2]))"


def word_pairs(spark, sf) -> DataFrame:
    """Entries from the 1st, 5th, ... pair of words of every passage; ``later``
    is the pair two words behind it."""
    words = F.split(X.js_trim("text"), WS + "+", -1)
    at = table(spark, sf, "benchmark").select("item_id", words.alias("w")).select(
        "item_id", "w", F.explode(F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i % 4 == 1) & (i < F.size("w")))).alias("i")
    )
    pair = lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i))
    number = F.col("item_id") * 100 + F.col("i")
    none = F.lit(None).cast("string")
    return at.select(
        F.lit("all").alias("project_id"), F.concat(F.lit("w"), number.cast("string")).alias("pd_id"), number.alias("seq"), F.lit("other").alias("kind"),
        none.alias("category"), F.lit("other").alias("pd_type"), pair(F.col("i")).alias("value"), none.alias("role"), none.alias("letter"),
        F.lit("[ПД]").alias("replacement"), F.lit(None).cast("array<string>").alias("mentions"),
        F.when(F.size("w") >= F.col("i") + 3, pair(F.col("i") + 2)).alias("later"),
    )


@query(
    "u6_rematch",
    f"""WITH RECURSIVE {PAIRS_CTE}, {mentions_cte("mentions", "SELECT pd_no, mention FROM named")},
    {mentions_cte("edited", "SELECT pd_no, later AS mention FROM named WHERE pd_no % 3 = 0 AND i + 3 <= n")},
    {LINES_CTE}, {ALL_UNITS}, {FOLDED}, {matches_cte("folded", PAIR_PROBE)}, {kept_cte("r1, r2")}, {gaps_cte()},
    folded2 AS (SELECT *, lower(text) AS folded FROM gaps), {matches_cte("folded2", PAIR_PROBE, "edited", "2")}, {kept_cte("length(hit) DESC, r1, r2", "2")}
    SELECT doc_id, unit_no, s AS start, e AS "end", pd_id FROM kept
    UNION ALL SELECT doc_id, unit_no // 1000000, unit_no % 1000000 + s, unit_no % 1000000 + e, pd_id FROM kept2""",
)
def _(spark, sf):
    entries, units = settle(word_pairs(spark, sf)), phrase_units(spark, sf)
    store = SpanStore(spark, scratch_dir(spark, "marks"), parts=8, slots=8)
    entry = entries.drop("later")
    store.add(0, units, M.resolve_overlaps(M.match_dictionary(units, R.explode_registry(entry)).repartition("doc_id"), "registry"))
    edits = entries.filter("seq % 3 = 0 AND later IS NOT NULL").select("project_id", "pd_id", F.col("later").alias("new_value"), F.lit(None).cast("string").alias("new_role"))
    renamed = R.rename_entries(entry, edits).join(edits.select("project_id", "pd_id"), ["project_id", "pd_id"], "left_semi")
    store.rematch(1, renamed)
    spots = [F.col(c).cast("bigint").alias(c) for c in ("unit_no", "start", "end")]
    return store.marks().select("doc_id", *spots, "pd_id")


# --- documents join their projects ------------------------------------------
# Five projects. Entries of even number are theirs; those of odd number come with the joining documents, which
# have marks of every second of them already.


def project_mentions_cte(name: str, rows: str) -> str:
    """SQL: mention rows from ``rows(project_id, pd_id, seq, mention)``."""
    return f"""{name} AS (SELECT *, seq AS r1,
      '(?i)' || array_to_string(list_transform(string_split(mention, ' '), lambda w: regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '{WS}+') AS pattern FROM ({rows}))"""


JOIN_CTE = f"""{PAIRS_CTE}, projects AS (SELECT 'q' || k AS project_id FROM range(5) AS t(k)),
    top AS (SELECT max(pd_no) AS top FROM named WHERE pd_no % 2 = 0),
    entries AS (SELECT project_id, 'w' || pd_no AS pd_id, pd_no AS seq, mention FROM named, projects WHERE pd_no % 2 = 0
      UNION ALL SELECT project_id, 'x' || pd_no, pd_no + coalesce(top, -1) + 1, mention FROM named, projects, top WHERE pd_no % 2 = 1),
    registry AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY project_id, lower(mention) ORDER BY seq) = 1),
    units AS (SELECT 'q' || (doc_id % 5) AS project_id, doc_id, line_no AS unit_no, line AS text FROM lines WHERE doc_id % 3 = 1)"""


@query(
    "m10_join_project",
    f"""WITH RECURSIVE {LINES_CTE}, {JOIN_CTE}, {FOLDED},
    {project_mentions_cte("own", "SELECT * FROM entries WHERE pd_id[1] = 'x' AND seq % 4 = 1")}, {matches_cte("folded", PAIR_PROBE, "own", "1")}, {kept_cte("r1", "1")},
    {gaps_cte(kept="kept1")}, folded2 AS (SELECT *, lower(text) AS folded FROM gaps),
    {project_mentions_cte("merged", "SELECT * FROM registry")}, {matches_cte("folded2", PAIR_PROBE, "merged", "0")},
    matches2 AS (SELECT * FROM matches0 ANTI JOIN (SELECT DISTINCT doc_id, pd_id FROM kept1) USING (doc_id, pd_id)), {kept_cte("r1", "2")}
    SELECT 'document' AS kind, 'q' || (doc_id % 5) AS project_id, CAST(doc_id AS VARCHAR) AS key, CAST(length(text) AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS pd_id
      FROM documents WHERE doc_id % 3 < 2
    UNION ALL SELECT 'member', 'q' || (doc_id % 5), CAST(doc_id AS VARCHAR), row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id % 3, doc_id) - 1, NULL, NULL FROM documents WHERE doc_id % 3 < 2
    UNION ALL SELECT 'entry', project_id, mention, seq, NULL, pd_id FROM registry
    UNION ALL SELECT 'mark', project_id, doc_id || ':' || unit_no, s, e, pd_id FROM kept1
    UNION ALL SELECT 'mark', project_id, doc_id || ':' || (unit_no // 1000000), unit_no % 1000000 + s, unit_no % 1000000 + e, pd_id FROM kept2""",
)
def _(spark, sf):
    pairs = settle(word_pairs(spark, sf).drop("later"))
    five = F.explode(F.array(*[F.lit(f"q{k}") for k in range(5)]))
    spread = settle(pairs.withColumn("project_id", five))
    own = spread.filter("seq % 2 = 0")
    fresh = spread.filter("seq % 2 = 1").withColumn("pd_id", F.concat(F.lit("x"), "seq"))
    docs = text_docs(spark, sf).withColumn("project_id", F.concat(F.lit("q"), F.col("doc_id") % 5))
    old, joining = docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1")

    tables = C.project_tables(spark, scratch_dir(spark, "projects"))
    no_members = spark.createDataFrame([], "project_id string, pos bigint, doc_id bigint")
    members = C.add_documents(no_members, old.select("project_id", "doc_id", F.col("doc_id").alias("a_seq")))
    tables.commit(0, documents=old, members=members, registry=own, mentions=spark.createDataFrame([], tables.schemas["mentions"]), marks=spark.createDataFrame([], tables.schemas["marks"]))
    # marks that the joining documents bring, of every second of their entries
    top = own.agg(F.max("seq")).first()[0]
    base = -1 if top is None else top
    marked = R.explode_registry(fresh.filter((F.col("seq") + base + 1) % 4 == 1))
    marks = settle(M.resolve_overlaps(M.match_dictionary(flows.line_units(joining), marked), "merge"))
    for _replay in range(2):
        C.join_documents(tables, 1, joining, fresh, marks)

    none = F.lit(None)
    long = lambda kind, df, key, a, b, pd_id: df.select(
        F.lit(kind).alias("kind"), "project_id", key.cast("string").alias("key"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), pd_id.cast("string").alias("pd_id")
    )
    doc = F.col("doc_id")
    place = F.concat(doc.cast("string"), F.lit(":"), F.col("unit_no").cast("string"))
    return (
        long("document", C.current(tables, "documents"), doc, F.length("text"), none, none)
        .unionByName(long("member", C.current(tables, "members"), doc, F.col("pos"), none, none))
        .unionByName(long("entry", C.current(tables, "registry"), F.col("value"), F.col("seq"), none, F.col("pd_id")))
        .unionByName(long("mark", C.current(tables, "marks"), place, F.col("start"), F.col("end"), F.col("pd_id")))
    )


# --- from registries to documents ready for export ---------------------------
# Projects 0 to 2 share entries of even number; the others have those of their last document only.


@query(
    "s7_publish_documents",
    f"""WITH RECURSIVE {LINES_CTE}, {PAIRS_CTE}, last AS (SELECT doc_id % 5 AS k, max(doc_id) AS doc_id FROM documents GROUP BY ALL),
    entries AS (SELECT 'q' || k AS project_id, pd_no, mention FROM named, range(3) AS t(k) WHERE pd_no % 2 = 0
      UNION ALL SELECT 'q' || k, pd_no, mention FROM named, last WHERE k > 2 AND (pd_no + doc_id) % 3 = 0),
    registry AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY project_id, lower(mention) ORDER BY pd_no) = 1),
    units AS (SELECT 'q' || (doc_id % 5) AS project_id, doc_id, line_no AS unit_no, line AS text FROM lines
      WHERE doc_id IN (SELECT doc_id FROM documents WHERE NOT (doc_id % 4 = 0 AND contains(text, '. ')))), {FOLDED},
    {project_mentions_cte("hidden", "SELECT project_id, 'w' || pd_no AS pd_id, pd_no AS seq, mention FROM registry")}, {matches_cte("folded", PAIR_PROBE, "hidden")}, {kept_cte("-length(mention), seq")},
    {rebuilt_cte("CASE WHEN seq % 3 < 2 THEN '[ПД]' ELSE hit END")}
    SELECT n.project_id, n.doc_id, n.text, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hidden
    FROM docs_new n LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept WHERE seq % 3 < 2 GROUP BY ALL) h USING (doc_id)""",
)
def _(spark, sf):
    pairs = settle(word_pairs(spark, sf).drop("later"))
    docs = text_docs(spark, sf).withColumn("project_id", F.concat(F.lit("q"), F.col("doc_id") % 5))
    # some documents have readings that are still open
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit(". "), F.lit(" ⚠️[НЕЧИТАЕМО] "))).otherwise(F.col("text")))
    members = docs.select("project_id", F.col("doc_id").alias("pos"), "doc_id")
    project = lambda ks: F.explode(F.array(*[F.lit(f"q{k}") for k in ks]))
    shared = pairs.filter("seq % 2 = 0").withColumn("project_id", project(range(3)))
    last = C.last_document(members).filter("project_id IN ('q3', 'q4')")
    # every document of a project brings entries of its own
    brought = pairs.withColumn("project_id", project(range(5))).join(last, "project_id").filter((F.col("seq") + F.col("doc_id")) % 3 == 0)
    older = brought.withColumns({"doc_id": F.col("doc_id") - 5, "value": F.concat(F.lit("never "), "value")})
    flags = brought.select("project_id", "pd_id", "seq").unionByName(shared.select("project_id", "pd_id", "seq")).filter("seq % 3 < 2").select("project_id", "pd_id")
    return flows.publish_documents(docs, members, shared, brought.unionByName(older), flags)
