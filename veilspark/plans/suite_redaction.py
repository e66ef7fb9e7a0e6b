"""Detection, matching, overlaps, redaction, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..operators import corpus as C, detection as D, matching as M, redaction as Z, registry as R, reports
from ..sources import writers
from . import flows
from .session import scratch_dir, settle, spread
from .suite import query
from .suite_text import LINES_CTE, MARKED_TEXT, WS, WS_CHARS, docs, marked, persons, sql_trim, table

# --- detection --------------------------------------------------------------

# The rules again for the SQL side: (type, pattern, shown), with plain ASCII word edges.
SQL_RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "[email]"),
    ("phone", r"(?:\+7|\b8)[ -]?\(?[0-9]{3}\)?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}\b", "[телефон]"),
    ("card", r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[карта]"),
    ("imei", r"\b[0-9]{15}\b", "[IMEI]"),
    ("inn", r"\b[0-9]{12}\b", "[ИНН]"),
    ("snils", r"\b[0-9]{3}-[0-9]{3}-[0-9]{3}[ -][0-9]{2}\b", "[СНИЛС]"),
    ("passport", r"\b[0-9]{2} ?[0-9]{2} (?:№ ?)?[0-9]{6}\b", "[паспорт]"),
    ("social_id", r"\bid[0-9]{6,}\b", "[id пользователя]"),
    ("other", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "[ПД]"),
]
FOUND_CTE = LINES_CTE + ", found AS (" + " UNION ALL ".join(
    f"SELECT project_id, '{t}' AS pd_type, '{shown}' AS replacement, unnest(regexp_extract_all(line, '{p}')) AS raw FROM lines"
    for t, p, shown in SQL_RULES
) + f""" UNION ALL SELECT project_id, 'vehicle_vin', '[VIN]', v FROM (SELECT project_id, unnest(regexp_extract_all(line, '\\b[0-9]*[A-HJ-NPR-Z][A-HJ-NPR-Z0-9]*\\b')) AS v FROM lines)
      WHERE length(v) = 17 AND regexp_matches(v, '[0-9]')),
    detected AS (SELECT project_id, pd_type, min({sql_trim("raw")}) AS value, min(replacement) AS replacement, count(*) AS n_hits
      FROM found GROUP BY project_id, pd_type, lower({sql_trim("raw")})),
    registry AS (SELECT *, sha256(project_id || '|' || pd_type || '|' || lower(value)) AS pd_id FROM detected),
    mentions AS (SELECT project_id, pd_id, pd_type, value AS mention, replacement, -length(value) AS r1, pd_id AS r2,
      '(?i)' || array_to_string(list_transform(string_split_regex(value, '{WS}+'), lambda w: regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '{WS}+') AS pattern FROM registry)"""


def matches_cte(units: str, probe: str, mentions: str = "mentions", tag: str = "") -> str:
    """SQL: ``matches``, all hits of ``mentions`` in ``units(project_id,
    doc_id, unit_no, text)``; ``probe`` is a cheap necessary condition. A
    ``tag`` tells a second use apart."""
    return f"""pairs{tag} AS (SELECT u.*, m.*  EXCLUDE (project_id) FROM {units} u JOIN {mentions} m ON u.project_id = m.project_id AND {probe}),
    cut{tag} AS (SELECT * EXCLUDE (text, pattern), regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps FROM pairs{tag}),
    spot{tag} AS (SELECT * EXCLUDE (hits, gaps), unnest(hits) AS hit, unnest(range(1, len(hits) + 1)) AS i, hits, gaps FROM cut{tag} WHERE len(hits) > 0),
    matches{tag} AS (SELECT * EXCLUDE (hits, gaps, i), CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g)))
      + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda h: length(h))), 0) AS BIGINT) AS s FROM spot{tag})"""


def kept_cte(order: str, tag: str = "") -> str:
    """SQL: greedy choice over ``matches`` by ``s`` and the given tie order."""
    return f"""numbered{tag} AS (SELECT *, s + length(hit) AS e, row_number() OVER (PARTITION BY doc_id, unit_no ORDER BY s, {order}) AS rn FROM matches{tag}),
    walk{tag} AS (SELECT doc_id, unit_no, rn, e AS upto, true AS keep FROM numbered{tag} WHERE rn = 1
      UNION ALL SELECT n.doc_id, n.unit_no, n.rn, CASE WHEN n.s >= w.upto THEN n.e ELSE w.upto END, n.s >= w.upto
      FROM walk{tag} w JOIN numbered{tag} n ON n.doc_id = w.doc_id AND n.unit_no = w.unit_no AND n.rn = w.rn + 1),
    kept{tag} AS (SELECT n.* FROM numbered{tag} n JOIN walk{tag} USING (doc_id, unit_no, rn) WHERE keep)"""


def gaps_cte(units: str = "units", kept: str = "kept", out: str = "gaps") -> str:
    """SQL: the texts between kept spans, ``unit_no`` being unit * 10^6 + offset."""
    return f"""{out} AS (SELECT project_id, doc_id, unit_no * 1000000 + begins AS unit_no, substr(text, CAST(begins + 1 AS BIGINT), CAST(upto - begins AS BIGINT)) AS text FROM (
      SELECT u.project_id, u.doc_id, u.unit_no, u.text, coalesce(lag(k.e) OVER (PARTITION BY u.doc_id, u.unit_no ORDER BY k.s, k.e NULLS LAST), 0) AS begins, k.s AS upto
      FROM {units} u JOIN (SELECT doc_id, unit_no, s, e FROM {kept} UNION ALL SELECT doc_id, unit_no, length(text), NULL FROM {units}) k USING (doc_id, unit_no)) WHERE upto > begins)"""


def rebuilt_cte(shown: str) -> str:
    """SQL: documents with the kept spans replaced by ``shown``."""
    return f"""pieces AS (SELECT k.doc_id, k.unit_no, s, e, {shown} AS shown, coalesce(lag(e) OVER w, 0) AS prev, lead(e) OVER w IS NULL AS final
      FROM kept k WINDOW w AS (PARTITION BY doc_id, unit_no ORDER BY s)),
    lines_new AS (SELECT u.project_id, u.doc_id, u.unit_no, coalesce(string_agg(substr(u.text, prev + 1, s - prev) || shown || CASE WHEN final THEN substr(u.text, e + 1) ELSE '' END, '' ORDER BY s), any_value(u.text)) AS text,
      count(s) AS n FROM units u LEFT JOIN pieces p ON p.doc_id = u.doc_id AND p.unit_no = u.unit_no GROUP BY ALL),
    docs_new AS (SELECT project_id, doc_id, string_agg(text, chr(10) ORDER BY unit_no) AS text, CAST(sum(n) AS BIGINT) AS n FROM lines_new GROUP BY ALL)"""


LINE_UNITS = "units AS (SELECT project_id, doc_id, line_no AS unit_no, line AS text FROM lines)"
DETECT_PROBE = "contains(lower(u.text), lower(string_split(m.mention, ' ')[1]))"


def text_docs(spark, sf) -> DataFrame:
    return docs(spark, sf).select("project_id", "doc_id", "text")


@query("m8_detect_pd", f"WITH {FOUND_CTE} SELECT project_id, pd_type, pd_id, value, replacement, n_hits FROM registry")
def _(spark, sf):
    found = D.detect_pd(flows.line_units(text_docs(spark, sf)))
    return found.select("project_id", "pd_type", "pd_id", "value", "replacement", "n_hits")


@query(
    "m3_redact",
    f"""WITH RECURSIVE {FOUND_CTE}, {LINE_UNITS}, {matches_cte("units", DETECT_PROBE)}, {kept_cte("r1, r2")}, {rebuilt_cte("replacement")}
    SELECT project_id, doc_id, text, n AS n_hidden FROM docs_new""",
)
def _(spark, sf):
    return flows.redact_documents(text_docs(spark, sf), D.RULES)


# --- a dictionary taken from the benchmark passages --------------------------
# All pairs and triples of neighbouring words of every passage, for one project that holds all documents.

PHRASES_CTE = f"""w AS (SELECT item_id, string_split_regex({sql_trim("text")}, '{WS}+') AS w FROM benchmark),
    places AS (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM w),
    phrases AS (SELECT item_id * 1000000 + i * 10 + 1 - i % 2 AS pd_no, w[i] || ' ' || w[i + 1] AS mention FROM places
      UNION ALL SELECT item_id * 1000000 + i * 10 + 2, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 2 <= len(w)),
    mentions AS (SELECT 'all' AS project_id, pd_no, 'b' || pd_no AS pd_id, mention, '[' || (pd_no % 10) || ']' AS replacement, -length(mention) AS r1, pd_no AS r2,
      lower(string_split(mention, ' ')[1]) AS w1, lower(string_split(mention, ' ')[2]) AS w2,
      '(?i)' || array_to_string(list_transform(string_split(mention, ' '), lambda w: regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '{WS}+') AS pattern FROM phrases)"""
ALL_UNITS = "units AS (SELECT 'all' AS project_id, doc_id, line_no AS unit_no, line AS text FROM lines)"
FOLDED_UNITS = "folded AS (SELECT *, lower(text) AS folded FROM units)"
PHRASE_PROBE = "contains(u.folded, m.w2) AND contains(u.folded, m.w1)"
PHRASE_MATCHES = f"{PHRASES_CTE}, {LINES_CTE}, {ALL_UNITS}, {FOLDED_UNITS}, {matches_cte('folded', PHRASE_PROBE)}"


def phrases(spark, sf) -> DataFrame:
    words = F.split(X.js_trim("text"), WS + "+", -1)
    places = spread(table(spark, sf, "benchmark"), "item_id").select("item_id", words.alias("w")).filter(F.size("w") > 1)
    places = places.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    places = places.select("item_id", "w", "i", F.explode(F.array(F.lit(2), F.lit(3))).alias("n")).filter(F.col("i") + F.col("n") - 1 <= F.size("w"))
    kind = F.when(F.col("n") == 3, 2).otherwise(1 - F.col("i") % 2)
    number = F.col("item_id") * 1000000 + F.col("i") * 10 + kind
    none = F.lit(None).cast("string")
    return places.select(
        F.lit("all").alias("project_id"),
        F.concat(F.lit("b"), number.cast("string")).alias("pd_id"),
        number.alias("seq"),
        F.lit("other").alias("kind"),
        none.alias("category"),
        F.concat(F.lit("t"), kind.cast("string")).alias("pd_type"),
        F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("value"),
        none.alias("role"),
        none.alias("letter"),
        F.concat(F.lit("["), kind.cast("string"), F.lit("]")).alias("replacement"),
        F.lit(None).cast("array<string>").alias("mentions"),
    )


def phrase_units(spark, sf) -> DataFrame:
    """Lines of all documents."""
    return flows.line_units(text_docs(spark, sf).withColumn("project_id", F.lit("all")))


def phrase_matches(spark, sf, strategy: str = "auto") -> DataFrame:
    return M.match_dictionary(phrase_units(spark, sf), R.explode_registry(phrases(spark, sf)), strategy)


def phrase_kept(spark, sf, policy: str = "registry", hit: bool = False) -> DataFrame:
    """Hits are dealt out by document, with the columns that are read again:
    what is then grouped by document or line is not shuffled once more."""
    found = phrase_matches(spark, sf).drop("kind", "mention", *([] if hit else ["hit"]))
    return M.resolve_overlaps(found.repartition("doc_id"), policy)


def spots(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("unit_no").cast("bigint").alias("unit_no"), F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "pd_id")


@query(
    "j2_match_passages",
    f"""WITH mentions AS (SELECT 'b' || item_id AS pd_id, '(?i)' || array_to_string(list_transform(string_split_regex({sql_trim("text")}, '{WS}+'),
        lambda w: regexp_replace(w, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')), '{WS}+') AS pattern, {sql_trim("text")} AS v FROM benchmark),
    h AS (SELECT doc_id, pd_id, text, regexp_extract_all(text, pattern) AS hits FROM documents JOIN mentions ON contains(lower(text), lower(string_split_regex(v, '{WS}+')[3])))
    SELECT doc_id, pd_id, len(hits) AS n_hits, strpos(text, hits[1]) - 1 AS first_start, length(hits[1]) AS first_length FROM h WHERE len(hits) > 0""",
)
def _(spark, sf):
    # whole passages against whole documents: values that span line breaks
    none = F.lit(None).cast("string")
    entries = table(spark, sf, "benchmark").select(
        F.lit("all").alias("project_id"), F.concat(F.lit("b"), "item_id").alias("pd_id"), F.col("item_id").alias("seq"), F.lit("other").alias("kind"),
        none.alias("pd_type"), F.col("text").alias("value"), F.lit(None).cast("array<string>").alias("mentions"),
    )
    units = flows.whole_units(text_docs(spark, sf).withColumn("project_id", F.lit("all")))
    hits = M.match_dictionary(units, R.explode_registry(entries))
    return hits.groupBy("doc_id", "pd_id").agg(
        F.count("*").alias("n_hits"), F.min("start").cast("bigint").alias("first_start"), F.min_by(F.col("end") - F.col("start"), "start").cast("bigint").alias("first_length")
    )


@query("j2_match_dictionary", f"WITH {PHRASE_MATCHES} SELECT doc_id, unit_no, s AS start, s + length(hit) AS \"end\", pd_id FROM matches")
def _(spark, sf):
    return spots(phrase_matches(spark, sf))


@query("j2_match_dictionary_shuffled", f"WITH {PHRASE_MATCHES} SELECT doc_id, unit_no, s AS start, s + length(hit) AS \"end\", pd_id FROM matches")
def _(spark, sf):
    return spots(phrase_matches(spark, sf, "shuffle"))


@query(
    "j2_match_detected",
    f"""WITH {FOUND_CTE}, {LINE_UNITS}, {matches_cte("units", DETECT_PROBE)} SELECT doc_id, unit_no, s AS start, s + length(hit) AS "end", pd_id FROM matches""",
)
def _(spark, sf):
    units = flows.line_units(text_docs(spark, sf))
    return spots(M.match_dictionary(units, R.explode_registry(settle(D.detect_pd(units)))))


@query("m2_overlaps_registry", f"WITH RECURSIVE {PHRASE_MATCHES}, {kept_cte('r1, r2')} SELECT doc_id, unit_no, s AS start, e AS \"end\", pd_id FROM kept")
def _(spark, sf):
    return spots(phrase_kept(spark, sf))


@query("m2_overlaps_longest", f"WITH RECURSIVE {PHRASE_MATCHES}, {kept_cte('length(hit) DESC, r1, r2')} SELECT doc_id, unit_no, s AS start, e AS \"end\", pd_id FROM kept")
def _(spark, sf):
    return spots(phrase_kept(spark, sf, "longest"))


@query("m2_overlaps_merge", f"WITH RECURSIVE {PHRASE_MATCHES}, {kept_cte('r2')} SELECT doc_id, unit_no, s AS start, e AS \"end\", pd_id FROM kept")
def _(spark, sf):
    return spots(phrase_kept(spark, sf, "merge"))


@query(
    "j3_match_alternation",
    f"""WITH RECURSIVE {PHRASES_CTE}, t AS (SELECT doc_id, unnest(range(len(l))) AS unit_no, unnest(l) AS line FROM (SELECT doc_id, string_split({MARKED_TEXT}, chr(10)) AS l FROM documents)),
    cut AS (SELECT *, regexp_extract_all(line, '[^{WS[1:]}+') AS words, string_split_regex(line, '[^{WS[1:]}+') AS gaps FROM t),
    word AS (SELECT doc_id, unit_no, line, i, words[i] AS w, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g)))
      + coalesce(list_sum(list_transform(list_slice(words, 1, i - 1), lambda g: length(g))), 0) AS BIGINT) AS pos FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM cut)),
    run AS (SELECT doc_id, unit_no, line, lower(w) AS a, pos + length(w) AS a_end, lower(lead(w) OVER o) AS b, lead(pos) OVER o AS b_at, lead(pos + length(w)) OVER o AS b_end,
      lower(lead(w, 2) OVER o) AS c, lead(pos, 2) OVER o AS c_at FROM word WINDOW o AS (PARTITION BY doc_id, unit_no ORDER BY i)),
    two AS (SELECT *, left(w2, 1) AS key FROM mentions WHERE pd_no % 10 < 2), three AS (SELECT *, lower(string_split(mention, ' ')[3]) AS w3 FROM mentions WHERE pd_no % 10 = 2),
    matches AS (SELECT doc_id, unit_no, a_end - length(w1) AS s, substr(line, a_end - length(w1) + 1, b_at + length(w2) - a_end + length(w1)) AS hit, r1, r2
        FROM run JOIN two ON left(b, 1) = key AND starts_with(b, w2) AND ends_with(a, w1)
      UNION ALL SELECT doc_id, unit_no, a_end - length(w1), substr(line, a_end - length(w1) + 1, c_at + length(w3) - a_end + length(w1)), r1, r2
        FROM run JOIN three ON b = w2 AND ends_with(a, w1) AND starts_with(c, w3)
      UNION ALL SELECT doc_id, unit_no, CAST(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))) + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda g: length(g))), 0) AS BIGINT), hits[i], -1000000, 0
        FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, unit_no, regexp_extract_all(line, '(?i)⚠️\\[(?:НЕТОЧНО: [^\\]]*|НЕЧИТАЕМО)\\]') AS hits, string_split_regex(line, '(?i)⚠️\\[(?:НЕТОЧНО: [^\\]]*|НЕЧИТАЕМО)\\]') AS gaps FROM t))),
    {kept_cte("r1, r2")}
    SELECT doc_id, unit_no, count(*) AS n_hits, string_agg(hit, '|' ORDER BY s) AS hits FROM kept GROUP BY ALL""",
)
def _(spark, sf):
    units = flows.line_units(marked(spark, sf).withColumn("project_id", F.lit("all")))
    hits = M.match_alternation(units, R.explode_registry(phrases(spark, sf)))
    per_unit = hits.groupBy("doc_id", "unit_no").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.struct("start", "hit"))).alias("h"))
    return per_unit.select("doc_id", F.col("unit_no").cast("bigint").alias("unit_no"), "n_hits", F.array_join(F.transform("h", lambda x: x["hit"]), "|").alias("hits"))


@query(
    "j4_unmarked_entries",
    f"""WITH {PHRASE_MATCHES}, marked AS (SELECT DISTINCT doc_id, pd_id FROM matches WHERE (pd_no + doc_id) % 2 = 0)
    SELECT doc_id, pd_id, count(*) AS n FROM matches ANTI JOIN marked USING (doc_id, pd_id) GROUP BY ALL""",
)
def _(spark, sf):
    units, mentions = phrase_units(spark, sf), R.explode_registry(phrases(spark, sf))
    # entries marked already: those of even number in even documents, odd in odd
    done = phrase_matches(spark, sf).filter((F.substring("pd_id", F.lit(2), F.lit(20)).cast("bigint") + F.col("doc_id")) % 2 == 0)
    return M.match_unmarked(units, mentions, done).groupBy("doc_id", "pd_id").agg(F.count("*").alias("n"))


@query(
    "j5_pd_presence",
    f"""WITH {PHRASE_MATCHES} SELECT m.pd_id, count(DISTINCT x.doc_id) AS n_docs, count(x.doc_id) AS n_marks, count(x.doc_id) > 0 AS present
    FROM mentions m LEFT JOIN matches x USING (pd_id) GROUP BY ALL""",
)
def _(spark, sf):
    return M.pd_presence(phrases(spark, sf), phrase_matches(spark, sf)).select("pd_id", "n_docs", "n_marks", "present")


@query(
    "a4_mark_counts",
    f"WITH RECURSIVE {PHRASE_MATCHES}, {kept_cte('r1, r2')} SELECT doc_id, pd_id, count(*) AS n_marks FROM kept GROUP BY ALL",
)
def _(spark, sf):
    return reports.mark_counts(phrase_kept(spark, sf))


@query(
    "w6_occurrence_index",
    f"""WITH RECURSIVE {PHRASE_MATCHES}, {kept_cte('r1, r2')}, o AS (SELECT doc_id, pd_id, unit_no, s, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id, pd_id) AS n,
        coalesce(lead(unit_no * 1000000 + s) OVER w, first_value(unit_no * 1000000 + s) OVER w) AS nx FROM kept WINDOW w AS (PARTITION BY doc_id, pd_id ORDER BY unit_no, s)),
    z AS (SELECT *, last_value(unit_no * 1000000 + s) OVER (PARTITION BY doc_id, pd_id ORDER BY unit_no, s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lst,
        lag(unit_no * 1000000 + s) OVER (PARTITION BY doc_id, pd_id ORDER BY unit_no, s) AS pv FROM o)
    SELECT doc_id, pd_id, unit_no, s AS start, k, n, nx AS next_at, coalesce(pv, lst) AS previous_at FROM z""",
)
def _(spark, sf):
    at = lambda c: F.col(f"{c}.unit_no").cast("bigint") * 1000000 + F.col(f"{c}.start")
    o = reports.occurrence_index(phrase_kept(spark, sf))
    return o.select(
        "doc_id", "pd_id", F.col("unit_no").cast("bigint").alias("unit_no"), F.col("start").cast("bigint").alias("start"), "k", "n",
        at("next").alias("next_at"), at("previous").alias("previous_at"),
    )


@query(
    "m6_reveal",
    f"""WITH RECURSIVE {PHRASE_MATCHES}, {kept_cte('r1, r2')}, {rebuilt_cte("CASE WHEN pd_no % 2 = 0 THEN replacement ELSE hit END")}
    SELECT doc_id, text FROM docs_new""",
)
def _(spark, sf):
    entries = settle(phrases(spark, sf))
    hidden = Z.redact(phrase_units(spark, sf), phrase_kept(spark, sf, hit=True), entries, entries.select("project_id", "pd_id"))
    shown = Z.reveal(hidden, entries.filter("seq % 2 = 0").select("project_id", "pd_id"))
    return Z.units_to_documents(shown).select("doc_id", "text")


@query(
    "m7_pad_mark_spacing",
    r"""WITH t AS (SELECT doc_id, replace(replace(replace(text, ' the ', '<mark class="pd">the</mark>'), ' and ', ' (<mark class="pd">and</mark>, '), '. ', '«<mark x>.</mark>') AS x FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(x, '([^\s(«"''\[])(<mark\s)', '\1 \2', 'g'), '(</mark>)([^\s)\].,!?:;»"''…–—<])', '\1 \2', 'g') AS html FROM t""",
)
def _(spark, sf):
    x = F.replace(
        F.replace(F.replace("text", F.lit(" the "), F.lit('<mark class="pd">the</mark>')), F.lit(" and "), F.lit(' (<mark class="pd">and</mark>, ')),
        F.lit(". "),
        F.lit("«<mark x>.</mark>"),
    )
    return text_docs(spark, sf).select("doc_id", Z.pad_mark_spacing(x).alias("html"))


@query("m4_annotate_html")
def _(spark, sf):
    entries = settle(phrases(spark, sf))
    return Z.annotate_html(
        marked(spark, sf).withColumn("project_id", F.lit("all")), entries, R.explode_registry(entries), entries.filter("seq % 2 = 0").select("project_id", "pd_id")
    )


@query("m5_annotate_ambiguous")
def _(spark, sf):
    units, kept = phrase_units(spark, sf), phrase_kept(spark, sf)
    words = spread(table(spark, sf, "benchmark"), "item_id").select("item_id", F.posexplode(F.split(X.js_trim("text"), WS + "+", -1)).alias("i", "value"))
    once = words.groupBy("value").agg(F.min(F.col("item_id") * 1000000 + F.col("i")).alias("seq"))
    every_word = once.select(F.lit("all").alias("project_id"), "seq", "value", F.lit(None).cast("string").alias("context"), F.lit("a word of a passage").alias("reason"))
    found = Z.annotate_ambiguous(units, kept, every_word)
    return found.groupBy("doc_id", "unit_no").agg(F.count("*").alias("n_spans"), F.min("start").alias("first"))


@query(
    "m11_redaction_report",
    f"""WITH RECURSIVE {PHRASE_MATCHES}, {kept_cte('r1, r2')}, e AS (SELECT 't' || (pd_no % 10) AS group_key, pd_id, pd_no FROM mentions),
    c AS (SELECT group_key, count(*) AS n_entries FROM e GROUP BY ALL),
    k AS (SELECT group_key, count(*) AS n_marks, count(*) FILTER (e.pd_no % 2 = 0) AS n_hidden, count(DISTINCT doc_id) AS n_docs FROM kept JOIN e USING (pd_id) GROUP BY ALL),
    s AS (SELECT CAST(sum(len(regexp_extract_all({MARKED_TEXT}, '(?i)⚠️\\[(?:НЕТОЧНО: [^\\]]*|НЕЧИТАЕМО)\\]'))) AS BIGINT) AS n_uncertain, count(*) FILTER (length({MARKED_TEXT}) > 25000) AS n_long_docs FROM documents)
    SELECT group_key, n_entries, coalesce(n_marks, 0) AS n_marks, coalesce(n_hidden, 0) AS n_hidden, coalesce(n_docs, 0) AS n_docs, n_uncertain, n_long_docs
    FROM c LEFT JOIN k USING (group_key), s""",
)
def _(spark, sf):
    entries = phrases(spark, sf)
    d = marked(spark, sf).withColumn("project_id", F.lit("all")).withColumn("source", F.lit("ocr")).withColumn("is_summary", F.lit(False))
    gate = C.long_document_flag(d).withColumn("n_uncertain", F.size(X.extract_uncertain("text")).cast("bigint"))
    flags = entries.filter("seq % 2 = 0").select("project_id", "pd_id")
    return reports.redaction_report(entries, phrase_kept(spark, sf), flags, gate).drop("project_id")


@query(
    "s7_export_redacted",
    r"""WITH t AS (SELECT doc_id, source, replace(replace(replace(text, ' the ', '<mark class="pd priv" x="1">the</mark>'), ' and ', '<mark class="uncertain">and</mark>'), '. ',
      '<div class="page-separator" data-page="1"><span class="l"></span><span class="m">P 1</span></div>') AS x FROM documents)
    SELECT source AS project_id, doc_id, replace(replace(replace(replace(x, '<div class="page-separator" data-page="1"><span class="l"></span><span class="m">P 1</span></div>', ''),
      '<mark class="pd priv" x="1">', '<span class="pd-export">'), '<mark class="uncertain">', '<span class="uncertain-export">'), '</mark>', '</span>') AS content FROM t""",
)
def _(spark, sf):
    x = F.replace(
        F.replace(F.replace("text", F.lit(" the "), F.lit('<mark class="pd priv" x="1">the</mark>')), F.lit(" and "), F.lit('<mark class="uncertain">and</mark>')),
        F.lit(". "),
        F.lit('<div class="page-separator" data-page="1"><span class="l"></span><span class="m">P 1</span></div>'),
    )
    path = scratch_dir(spark, "export")
    writers.export_redacted(text_docs(spark, sf).withColumn("html", x), path)
    return spark.read.schema("doc_id bigint, content string, project_id string").json(path)
