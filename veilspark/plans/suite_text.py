"""Text rules, predicates and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import arrays as A, patterns as P, text as X
from ..operators import corpus, lines as L, pages as G, registry as R
from ..sources import readers
from .session import spread
from .suite import query

# White space of the rules, for the SQL side.
WS = r"[\t\n\x0b\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WS_CHARS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(160)||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)"
    "||chr(8196)||chr(8197)||chr(8198)||chr(8199)||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)"
    "||chr(8287)||chr(12288)||chr(65279)"
)


def sql_trim(s: str) -> str:
    return f"trim({s}, {WS_CHARS})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their source as project, over all cores."""
    return spread(table(spark, sf, "documents"), "doc_id").withColumnRenamed("source", "project_id")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "customer"), "c_custkey")


# --- predicates -------------------------------------------------------------


@query("f1_tenant_filter", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 7")
def _(spark, sf):
    return corpus.tenant_filter(table(spark, sf, "events").select("event_id", "user_id", "event_type"), 7)


PERSON_SQL = """
 'n' || c_nationkey AS project_id, 'c' || c_custkey AS pd_id, c_custkey AS seq, 'person' AS kind,
 CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 'private'
      WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'professional' ELSE 'unknown' END AS category,
 CAST(NULL AS string) AS pd_type,
 (CASE WHEN c_custkey % 3 = 0 THEN 'CUSTOMER ' ELSE 'Customer ' END) || (c_custkey % 97) AS value,
 CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN CAST(NULL AS string) ELSE c_mktsegment END AS role,
 CAST(NULL AS string) AS letter, CAST(NULL AS string) AS replacement
"""
PERSON_MENTIONS = "'Customer  ' || (c_custkey % 97), 'Buyer ' || (c_custkey % 5), c_mktsegment, ' ', 'buyer ' || (c_custkey % 3)"


def persons(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").selectExpr(
        *[c.strip() for c in _split_select(PERSON_SQL)], f"array({PERSON_MENTIONS}) AS mentions"
    )


PERSONS = f"persons AS (SELECT {PERSON_SQL}, [{PERSON_MENTIONS}] AS mentions FROM customer)"


def _split_select(sql: str) -> list[str]:
    """Select items of a flat list (no commas outside brackets inside items)."""
    out, depth, item = [], 0, ""
    for ch in sql:
        depth += ch == "("
        depth -= ch == ")"
        if ch == "," and depth == 0:
            out.append(item)
            item = ""
        else:
            item += ch
    return [*out, item]


@query("f2_persons_by_category", f"WITH {PERSONS} SELECT project_id, pd_id, value FROM persons WHERE category = 'private'")
def _(spark, sf):
    return R.persons_by_category(persons(spark, sf), "private").select("project_id", "pd_id", "value")


ADDRESS_VALUE = """CASE c_custkey % 9 WHEN 0 THEN 'г. Самара' WHEN 1 THEN 'г. Самара, ул. Ленина, ' || c_custkey
 WHEN 2 THEN 'Самарская область' WHEN 3 THEN 'СНТ Бор' WHEN 4 THEN 'снт Бор, участок ' || c_nationkey
 WHEN 5 THEN 'корпус ' || c_custkey || '/' || c_nationkey WHEN 6 THEN 'дом' || c_custkey
 WHEN 7 THEN 'наш сад у реки' ELSE c_name END"""
ADDRESS_RE = (
    r"ул\.?|пр\.?|пер\.?|пр-т|б-р|бульв|шоссе|наб\.?|пл\.?|д\.\s*\d|дом\s*\d|кв\.\s*\d|квартира\s*\d"
    r"|проспект|переулок|улица|бульвар|набережная|площадь|тупик|проезд|тер\.?|территори(?:я|и)|снт|днт|тсн"
    r"|сад\b|коллективный\s+сад|участ(?:ок|ка)\b|владен(?:ие|ия)\b|домовладен(?:ие|ия)\b|\d+[-/]\d+"
)


@query(
    "f3_filter_address_detail",
    f"""WITH e AS (SELECT c_custkey AS seq, {ADDRESS_VALUE} AS value,
        CASE WHEN c_custkey % 7 < 6 THEN 'address' ELSE 'phone' END AS pd_type FROM customer)
    SELECT seq, value, pd_type FROM e WHERE pd_type <> 'address' OR regexp_matches(value, '{ADDRESS_RE}')""",
)
def _(spark, sf):
    e = table(spark, sf, "customer").selectExpr(
        "c_custkey AS seq", f"{ADDRESS_VALUE} AS value", "CASE WHEN c_custkey % 7 < 6 THEN 'address' ELSE 'phone' END AS pd_type"
    )
    return R.filter_address_detail(e)


BIRTH_VALUE = """CASE c_custkey % 8 WHEN 0 THEN 'г. Самара' WHEN 1 THEN 'Самара' WHEN 2 THEN ' самара обл. '
 WHEN 3 THEN 'г. Самара, ул. Ленина' WHEN 4 THEN 'Улан-Удэ респ' WHEN 5 THEN 'с. Белозерки' WHEN 6 THEN c_name
 ELSE 'Г.Пермь края.' END"""


@query(
    "f4_filter_generic_birthplace",
    f"""WITH e AS (SELECT c_custkey AS seq, {BIRTH_VALUE} AS value,
        CASE WHEN c_custkey % 5 < 4 THEN 'birthplace' ELSE 'dob' END AS pd_type FROM customer)
    SELECT seq, value, pd_type FROM e WHERE NOT (pd_type = 'birthplace' AND regexp_matches({sql_trim('value')},
      '(?i)^(г\\.?\\s*)?[А-ЯЁ][а-яё]+(-[А-ЯЁ][а-яё]+)?(\\s+(обл|область|края|край|респ|республика)\\.?)?$'))""",
)
def _(spark, sf):
    e = table(spark, sf, "customer").selectExpr(
        "c_custkey AS seq", f"{BIRTH_VALUE} AS value", "CASE WHEN c_custkey % 5 < 4 THEN 'birthplace' ELSE 'dob' END AS pd_type"
    )
    return R.filter_generic_birthplace(e)


@query(
    "f5_long_document_flag",
    r"""SELECT doc_id, (doc_id % 9 <> 0) AND length(regexp_replace(text || '[PAGE:12]' || text, '\[PAGE:\d+\]', '', 'g')) > 25000 AS is_long
    FROM documents""",
)
def _(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        (F.col("doc_id") % 9 == 0).alias("is_summary"),
        F.concat("text", F.lit("[PAGE:12]"), "text").alias("text"),
    )
    return corpus.long_document_flag(d).select("doc_id", "is_long")


@query(
    "f6_analysis_window",
    r"""WITH t AS (SELECT doc_id, regexp_replace('[PAGE:1]' || text, '\[PAGE:\d+\]', '', 'g') AS x FROM documents)
    SELECT doc_id, CASE WHEN length(x) > 25000 THEN left(x, 25000) || chr(10) || '...' ELSE x END AS shown FROM t""",
)
def _(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", X.analysis_window(F.concat(F.lit("[PAGE:1]"), "text")).alias("shown"))


@query(
    "f7_drop_page_number_lines",
    f"""WITH t AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || ' ' || (doc_id % 1500) || ' ' || chr(10)) AS x FROM documents)
    SELECT doc_id, {sql_trim("array_to_string(list_filter(string_split(x, chr(10)), lambda l: NOT regexp_matches("
        + sql_trim("l") + ", '^[0-9]{1,3}$')), chr(10))")} AS text FROM t""",
)
def _(spark, sf):
    x = F.replace("text", F.lit(". "), F.concat(F.lit(".\n "), (F.col("doc_id") % 1500).cast("string"), F.lit(" \n")))
    return docs(spark, sf).select("doc_id", X.drop_page_number_lines(x).alias("text"))


@query(
    "f8_mention_length_filter",
    """WITH m AS (SELECT c_custkey AS seq, CASE WHEN c_nationkey % 2 = 0 THEN 'person' ELSE 'other' END AS kind,
        left(c_mktsegment, CAST(c_custkey % 4 AS INT)) AS mention FROM customer)
    SELECT * FROM m WHERE kind <> 'person' OR length(mention) > 1""",
)
def _(spark, sf):
    m = table(spark, sf, "customer").selectExpr(
        "c_custkey AS seq",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'person' ELSE 'other' END AS kind",
        "left(c_mktsegment, CAST(c_custkey % 4 AS INT)) AS mention",
    )
    return R.mention_length_filter(m)


@query("f9_exclude_summaries", "SELECT doc_id, source FROM documents WHERE doc_id % 10 <> 0")
def _(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", (F.col("doc_id") % 10 == 0).alias("is_summary"))
    return corpus.exclude_summaries(d).drop("is_summary")


RAW_PAGE = """CASE event_id % 8 WHEN 0 THEN '0' WHEN 1 THEN '-3' WHEN 2 THEN 'abc' WHEN 3 THEN '' WHEN 4 THEN 'Infinity'
 WHEN 5 THEN CAST(NULL AS string) ELSE CAST(event_id % 50 AS string) END"""


@query(
    "f10_valid_pages",
    f"""WITH p AS (SELECT event_id, TRY_CAST({RAW_PAGE} AS DOUBLE) AS n FROM events)
    SELECT event_id, CAST(n AS BIGINT) AS page_no FROM p WHERE isfinite(n) AND n > 0""",
)
def _(spark, sf):
    return G.valid_pages(table(spark, sf, "events").selectExpr("event_id", f"{RAW_PAGE} AS page_no"))


# --- scalar rules -----------------------------------------------------------


@query(
    "x1_normalize_pd_text",
    f"""SELECT doc_id, {sql_trim(f"regexp_replace(replace(text, ' a', ' ' || chr(160) || chr(9) || 'a'), '{WS}+', ' ', 'g')")} AS text
    FROM documents""",
)
def _(spark, sf):
    x = F.replace("text", F.lit(" a"), F.lit("  \ta"))
    return docs(spark, sf).select("doc_id", X.normalize_pd_text(x).alias("text"))


@query(
    "x2_dehyphenate",
    """WITH t AS (SELECT doc_id, replace(replace(text, '. ', '-' || chr(10)), ', ', '- ') AS x FROM documents)
    SELECT doc_id, regexp_replace(regexp_replace(x, '([А-яЁёa-zA-Z])-\\r?\\n([а-яёa-z])', '\\1\\2', 'g'),
      '([А-яЁёa-zA-Z])- ([а-яёa-z])', '\\1\\2', 'g') AS text FROM t""".replace("\\\\", "\\"),
)
def _(spark, sf):
    x = F.replace(F.replace("text", F.lit(". "), F.lit("-\n")), F.lit(", "), F.lit("- "))
    return docs(spark, sf).select("doc_id", X.dehyphenate(x).alias("text"))


@query(
    "x3_strip_page_markers",
    r"""SELECT doc_id, regexp_replace(replace(text, '. ', '[PAGE:' || doc_id || ']'), '\[PAGE:\d+\]', '', 'g') AS text FROM documents""",
)
def _(spark, sf):
    x = F.replace("text", F.lit(". "), F.concat(F.lit("[PAGE:"), F.col("doc_id").cast("string"), F.lit("]")))
    return docs(spark, sf).select("doc_id", X.strip_page_markers(x).alias("text"))


@query(
    "x4_split_pages",
    r"""WITH t AS (SELECT doc_id, replace(CASE WHEN doc_id % 3 = 0 THEN text ELSE '[PAGE:1]' || text END, '. ', '.[PAGE:' || (doc_id % 7) || ']') AS x
        FROM documents),
    s AS (SELECT doc_id, list_concat([CAST(NULL AS VARCHAR)], regexp_extract_all(x, '\[PAGE:(\d+)\]', 1)) AS ns,
        string_split_regex(x, '\[PAGE:\d+\]') AS ts FROM t),
    r AS (SELECT doc_id, unnest(ns) AS n, unnest(ts) AS body, unnest(range(len(ts))) AS i FROM s),
    k AS (SELECT * FROM r WHERE n IS NOT NULL OR """ + sql_trim("body") + r""" <> '')
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, CAST(n AS BIGINT) AS page_no, body AS text FROM k""",
)
def _(spark, sf):
    marked = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("[PAGE:1]"), "text"))
    x = F.replace(marked, F.lit(". "), F.concat(F.lit(".[PAGE:"), (F.col("doc_id") % 7).cast("string"), F.lit("]")))
    rows = docs(spark, sf).select("doc_id", F.posexplode(X.split_pages(x)).alias("pos", "p"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "p.page_no", "p.text")


@query("x5_collapse_repeated_words")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", X.collapse_repeated_words("text").alias("text"))


MARKED_TEXT = """replace(replace(replace(text, '. ', ' ⚠️[НЕТОЧНО: ' || lang || ' | word ' || lang || '] '), ', ', ' ⚠️[НЕЧИТАЕМО] '),
  ' and ', ' thes ⚠️[НЕТОЧНО: thes] ')"""
MARK_RE = r"(?i)⚠️\[(?:НЕТОЧНО: [^\]]*|НЕЧИТАЕМО)\]"


def marked(spark, sf) -> DataFrame:
    return docs(spark, sf).select("doc_id", "project_id", F.expr(MARKED_TEXT).alias("text"))


# the echo rule in SQL: the echo is always the same word in front of its mark
@query(
    "x6_fold_uncertain_echo",
    f"""WITH t AS (SELECT doc_id, {MARKED_TEXT} AS x FROM documents),
    s AS (SELECT doc_id, regexp_extract_all(x, '(?i)([А-яЁёa-zA-Z]{{2,}}){WS}+⚠️\\[НЕТОЧНО:{WS}*([А-яЁёa-zA-Z| ]+)\\]') AS hits,
        regexp_extract_all(x, '(?i)([А-яЁёa-zA-Z]{{2,}}){WS}+⚠️\\[НЕТОЧНО:{WS}*([А-яЁёa-zA-Z| ]+)\\]', 1) AS w,
        regexp_extract_all(x, '(?i)([А-яЁёa-zA-Z]{{2,}}){WS}+⚠️\\[НЕТОЧНО:{WS}*([А-яЁёa-zA-Z| ]+)\\]', 2) AS m,
        string_split_regex(x, '(?i)([А-яЁёa-zA-Z]{{2,}}){WS}+⚠️\\[НЕТОЧНО:{WS}*([А-яЁёa-zA-Z| ]+)\\]') AS gaps FROM t),
    r AS (SELECT doc_id, gaps, list_transform(range(1, len(hits) + 1), lambda i:
        CASE WHEN lower(left(w[i], least(5, length(w[i]), length({sql_trim("string_split(m[i], '|')[1]")}))))
               = lower(left({sql_trim("string_split(m[i], '|')[1]")}, least(5, length(w[i]), length({sql_trim("string_split(m[i], '|')[1]")}))))
        THEN '⚠️[НЕТОЧНО: ' || m[i] || ']' ELSE hits[i] END) AS h FROM s)
    SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(h[i], '')), '') AS text FROM r""",
)
def _(spark, sf):
    return marked(spark, sf).select("doc_id", X.fold_uncertain_echo("text").alias("text"))


@query(
    "x7_extract_uncertain",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all({MARKED_TEXT}, '{MARK_RE}') AS hits FROM documents),
    r AS (SELECT doc_id, unnest(range(len(hits))) AS pos, unnest(hits) AS h FROM t)
    SELECT doc_id, pos, CASE WHEN h LIKE '%НЕЧИТАЕМО]' THEN 'unreadable' ELSE 'uncertain' END AS kind,
      CASE WHEN h LIKE '%НЕЧИТАЕМО]' THEN '[НЕЧИТАЕМО]'
        ELSE {sql_trim("string_split(substr(h, 13, length(h) - 13), '|')[1]")} END AS word,
      CASE WHEN h LIKE '%НЕЧИТАЕМО]' THEN ''
        ELSE coalesce({sql_trim("string_split(substr(h, 13, length(h) - 13), '|')[2]")}, '') END AS suggestion FROM r""",
)
def _(spark, sf):
    rows = marked(spark, sf).select("doc_id", F.posexplode(X.extract_uncertain("text")).alias("pos", "u"))
    return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "u.kind", "u.word", "u.suggestion")


@query(
    "x8_resolve_uncertain",
    """SELECT doc_id, replace(replace(replace(text, '. ', ' word ' || lang || ' '), ', ', ' [НЕЧИТАЕМО] '), ' and ', ' thes thes ') AS text
    FROM documents""",
)
def _(spark, sf):
    return marked(spark, sf).select("doc_id", X.resolve_uncertain("text").alias("text"))


NAME = "p_name || ' ' || p_type || (CASE WHEN p_partkey % 3 = 0 THEN ' A.b' WHEN p_partkey % 3 = 1 THEN '  Иван' ELSE '' END)"


@query(
    "x9_canonical_mentions",
    f"""WITH t AS (SELECT p_partkey, string_split({sql_trim(f"regexp_replace({NAME}, '{WS}+', ' ', 'g')")}, ' ') AS w FROM part),
    i AS (SELECT p_partkey, w, list_transform(list_slice(flatten(list_transform(list_slice(w, 2, len(w)), lambda x:
        list_slice(regexp_extract_all(x, '[A-Za-zА-Яа-яЁё]'), 1, CASE WHEN regexp_matches(x, '[.,]') THEN 2 ELSE 1 END))), 1, 2), lambda c: upper(c) || '.') AS ini FROM t),
    c AS (SELECT p_partkey, [array_to_string(w, ' '), w[1], CASE WHEN len(ini) > 0 THEN w[1] || ' ' || array_to_string(ini, '') END,
        CASE WHEN len(ini) > 0 THEN array_to_string(ini, '') || ' ' || w[1] END] AS l FROM i),
    e AS (SELECT p_partkey, unnest(l) AS m, unnest([0, 1, 2, 3]) AS p FROM c),
    f AS (SELECT p_partkey, m, p, row_number() OVER (PARTITION BY p_partkey, lower(m) ORDER BY p) AS rn FROM e WHERE m IS NOT NULL)
    SELECT p_partkey, string_agg(m, '|' ORDER BY p) AS mentions FROM f WHERE rn = 1 GROUP BY p_partkey""",
)
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.array_join(A.canonical_mentions(F.expr(NAME)), "|").alias("mentions"))


@query(
    "x10_regex_escape",
    r"""SELECT page_id, regexp_replace(html, '([.*+?^${}()|\[\]\\])', '\\\1', 'g') AS escaped FROM pages""",
)
def _(spark, sf):
    return spread(table(spark, sf, "pages"), "page_id").select("page_id", P.regex_escape("html").alias("escaped"))


@query(
    "x11_ws_flexible_pattern",
    r"""SELECT item_id, array_to_string(list_transform(string_split_regex("""
    + sql_trim("text")
    + rf""", '{WS}+'), lambda w: regexp_replace(w, '([.*+?^${{}}()|\[\]\\])', '\\\1', 'g')), '{WS}+') AS pattern FROM benchmark""",
)
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", P.ws_flexible_pattern("text").alias("pattern"))


# the patterns as strings, put together from the fixed parts
def sql_escape(value: str) -> str:
    return f"regexp_replace({value}, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"


@query(
    "x12_person_pattern",
    f"""WITH w AS (SELECT c_custkey, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM (SELECT c_custkey, string_split(c_mktsegment || ' ' || c_name, ' ') AS l FROM customer)),
    p AS (SELECT c_custkey, i, CASE WHEN upper(w[1]) <> lower(w[1]) THEN '[' || upper(w[1]) || lower(w[1]) || ']' ELSE {sql_escape("w[1]")} END || {sql_escape("w[2:]")} AS p FROM w)
    SELECT c_custkey, '{P.LEFT_EDGE}' || string_agg(p, '{WS}+' ORDER BY i) || '{P.INITIALS_AFTER}' AS pattern FROM p GROUP BY c_custkey""",
)
def _(spark, sf):
    c = customers(spark, sf)
    name = F.concat_ws(" ", "c_mktsegment", "c_name")
    return c.select("c_custkey", P.person_pattern(name).alias("pattern"))


ADDRESS = """'обл., с. Село' || c_nationkey || ', ' || (CASE WHEN c_custkey % 5 = 0 THEN 'пр.' ELSE 'ул.' END) || ' Street' || c_nationkey ||
  (CASE WHEN c_custkey % 3 = 0 THEN ', д. ' ELSE ', ' END) || c_custkey || (CASE WHEN c_custkey % 2 = 0 THEN 'б' ELSE '' END)"""


@query(
    "x13_address_parts",
    f"""WITH t AS (SELECT c_custkey, {ADDRESS} AS v FROM customer),
    p AS (SELECT c_custkey, v,
      regexp_extract(v, '(?i)(?:ул\\.?|улиц[аеиы]){WS}*([А-ЯA-ZЁ][A-Za-zА-Яа-яЁё0-9-]*(?:{WS}+[А-ЯA-ZЁ][A-Za-zА-Яа-яЁё0-9-]*){{0,3}})', 1) AS street,
      regexp_extract(v, '(?i)(?:д\\.?|дом){WS}*№?{WS}*([0-9]+(?:[A-Za-zА-Яа-яЁё/-]*[0-9A-Za-zА-Яа-яЁё]*)?)', 1) AS h1,
      regexp_extract(v, '(?i),{WS}*([0-9]+(?:[A-Za-zА-Яа-яЁё/-]*[0-9A-Za-zА-Яа-яЁё]*)?){WS}*$', 1) AS h2,
      regexp_extract(v, '(?i)(?:^|,{WS}*|{WS}+)(с\\.?|пос\\.?|пгт\\.?|г\\.?|дер\\.?|д\\.){WS}*([А-ЯA-ZЁ][A-Za-zА-Яа-яЁё-]*(?:{WS}+[А-ЯA-ZЁ][A-Za-zА-Яа-яЁё-]*){{0,2}})', 1) AS lt,
      regexp_extract(v, '(?i)(?:^|,{WS}*|{WS}+)(с\\.?|пос\\.?|пгт\\.?|г\\.?|дер\\.?|д\\.){WS}*([А-ЯA-ZЁ][A-Za-zА-Яа-яЁё-]*(?:{WS}+[А-ЯA-ZЁ][A-Za-zА-Яа-яЁё-]*){{0,2}})', 2) AS ln FROM t),
    q AS (SELECT *, CASE WHEN h1 <> '' THEN h1 WHEN street <> '' THEN h2 ELSE '' END AS house FROM p)
    SELECT c_custkey, CASE WHEN street <> '' AND house <> '' THEN street END AS street,
      CASE WHEN street <> '' AND house <> '' THEN house END AS house,
      CASE WHEN street <> '' AND house <> '' THEN lt END AS locality_type,
      CASE WHEN street <> '' AND house <> '' THEN ln END AS locality_name FROM q""",
)
def _(spark, sf):
    return (
        customers(spark, sf)
        .select("c_custkey", P.address_parts(F.expr(ADDRESS)).alias("p"))
        .select("c_custkey", "p.street", "p.house", "p.locality_type", "p.locality_name")
    )


@query("x14_address_pattern")
def _(spark, sf):
    return customers(spark, sf).select("c_custkey", P.address_pattern(F.expr(ADDRESS)).alias("pattern"))


@query(
    "x15_ambiguous_pattern",
    f"""SELECT item_id, '{P.LEFT_EDGE}' || array_to_string(list_filter(string_split_regex({sql_escape("text")}, '{WS}+'), lambda w: w <> ''), '{WS}+') || '{P.RIGHT_EDGE}' AS pattern FROM benchmark""",
)
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", P.ambiguous_pattern("text").alias("pattern"))


LINE_KIND = """CASE (doc_id + line_no) % 13 WHEN 0 THEN '## ' || line WHEN 1 THEN '### ' || line WHEN 2 THEN '---' WHEN 3 THEN '  '
 WHEN 4 THEN '[PAGE:' || line_no || ']' WHEN 5 THEN '[INDENT]' || line WHEN 6 THEN '[RIGHT-BLOCK]' || line
 WHEN 7 THEN '[CENTER]' || line || '[/CENTER]' WHEN 8 THEN '[LEFTRIGHT: ' || line || ' | ' || line || ' ]'
 WHEN 9 THEN '**УСТАНОВИЛ:** ' || line WHEN 10 THEN 'решила ' || line ELSE line END"""
LINES_CTE = """lines AS (SELECT doc_id, source AS project_id, unnest(range(len(l))) AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"""


def lines_of(spark, sf) -> DataFrame:
    return L.explode_lines(docs(spark, sf).select("doc_id", "project_id", "text")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


@query(
    "x16_classify_line",
    f"""WITH {LINES_CTE}, s AS (SELECT doc_id, line_no, {LINE_KIND} AS s FROM lines),
    k AS (SELECT doc_id, line_no, s, {sql_trim("replace(s, '**', '')")} AS plain,
      CASE WHEN starts_with(s, '## ') THEN 'h2' WHEN starts_with(s, '### ') THEN 'h3' WHEN s = '---' THEN 'divider'
       WHEN {sql_trim("s")} = '' THEN 'blank' WHEN regexp_matches(s, '^\\[PAGE:[0-9]+\\]$') THEN 'page'
       WHEN regexp_matches(s, '^\\[INDENT\\][^\\n\\r\\x{{2028}}\\x{{2029}}]+$') THEN 'indent'
       WHEN regexp_matches(s, '^\\[RIGHT-BLOCK\\][^\\n\\r\\x{{2028}}\\x{{2029}}]+$') THEN 'right-block'
       WHEN regexp_matches(s, '^\\[CENTER\\][^\\n\\r\\x{{2028}}\\x{{2029}}]+\\[/CENTER\\]$') THEN 'center'
       WHEN regexp_matches(s, '^\\[LEFTRIGHT:{WS}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+?){WS}*\\|{WS}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+?){WS}*\\]$') THEN 'left-right'
       WHEN length({sql_trim("replace(s, '**', '')")}) < 60 AND regexp_matches({sql_trim("replace(s, '**', '')")},
         '(?i)(УСТАНОВИЛ|ПОСТАНОВИЛ|РЕШИЛ|ОПРЕДЕЛИЛ|ПРИГОВОРИЛ|УСТАНОВИЛА|ПОСТАНОВИЛА|РЕШИЛА|ОПРЕДЕЛИЛА|ПРИГОВОРИЛА|УСТАНОВИЛО|ПОСТАНОВИЛО)(?::|{WS})')
         THEN 'legal-heading' ELSE 'paragraph' END AS kind FROM s)
    SELECT doc_id, line_no, kind, CASE kind WHEN 'h2' THEN substr(s, 4) WHEN 'h3' THEN substr(s, 5) WHEN 'divider' THEN ''
      WHEN 'blank' THEN '' WHEN 'page' THEN regexp_extract(s, '([0-9]+)', 1) WHEN 'indent' THEN substr(s, 9) WHEN 'right-block' THEN substr(s, 14)
      WHEN 'center' THEN regexp_extract(s, '^\\[CENTER\\]([^\\n\\r\\x{{2028}}\\x{{2029}}]+?)\\[/CENTER\\]$', 1)
      WHEN 'left-right' THEN regexp_extract(s, '^\\[LEFTRIGHT:{WS}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+?){WS}*\\|{WS}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+?){WS}*\\]$', 1)
      WHEN 'legal-heading' THEN plain ELSE s END AS body,
      CASE kind WHEN 'left-right' THEN regexp_extract(s, '^\\[LEFTRIGHT:{WS}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+?){WS}*\\|{WS}*([^\\n\\r\\x{{2028}}\\x{{2029}}]+?){WS}*\\]$', 2) ELSE '' END AS extra
    FROM k""",
)
def _(spark, sf):
    s = lines_of(spark, sf).select("doc_id", "line_no", X.classify_line(F.expr(LINE_KIND)).alias("c"))
    return s.select("doc_id", "line_no", "c.kind", "c.body", "c.extra")


PARA = """p_name AS text, CASE p_size % 5 WHEN 0 THEN 'Heading1' WHEN 1 THEN '2' WHEN 2 THEN '1' ELSE CAST(NULL AS string) END AS style,
 CASE p_partkey % 3 WHEN 0 THEN 'center' WHEN 1 THEN 'left' ELSE CAST(NULL AS string) END AS align,
 CASE WHEN p_partkey % 4 = 0 THEN 3001.0 ELSE 700.0 END AS lft, CASE WHEN p_partkey % 7 < 3 THEN 301.0 ELSE 0.0 END AS first_line,
 CAST(p_partkey % 5 AS int) AS bold_runs, 4 AS runs"""


@query(
    "x17_classify_paragraph",
    f"""WITH p AS (SELECT p_partkey, {PARA} FROM part)
    SELECT p_partkey, CASE WHEN style IN ('Heading1', '1') THEN '## ' || text
      WHEN bold_runs * 2 > runs AND align = 'center' THEN '[CENTER]**' || text || '**[/CENTER]'
      WHEN align = 'center' THEN '[CENTER]' || text || '[/CENTER]'
      WHEN lft > 3000 THEN '[RIGHT-BLOCK]' || CASE WHEN bold_runs * 2 > runs THEN '**' || text || '**' ELSE text END
      WHEN bold_runs * 2 > runs THEN '**' || text || '**' WHEN first_line > 300 THEN '[INDENT]' || text ELSE text END AS line FROM p""",
)
def _(spark, sf):
    p = table(spark, sf, "part").selectExpr("p_partkey", *_split_select(PARA))
    c = F.col
    line = X.classify_paragraph(c("text"), c("style"), c("align"), c("lft"), c("first_line"), c("bold_runs"), c("runs"))
    return p.select("p_partkey", line.alias("line"))


@query(
    "x18_table_row_text",
    f"""WITH t AS (SELECT p_partkey, list_filter([{sql_trim("p_name")}, '', CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END, {sql_trim("' ' || p_type || ' '")}],
        lambda x: x <> '') AS c, p_name || repeat(chr(10), CAST(p_size % 6 AS INT)) || p_type || chr(10) AS b FROM part)
    SELECT p_partkey, array_to_string(c, ' | ') AS row_text, {sql_trim("regexp_replace(b, '\\n{3,}', chr(10) || chr(10), 'g')")} AS squeezed FROM t""",
)
def _(spark, sf):
    p = table(spark, sf, "part")
    cells = F.array("p_name", F.lit("  "), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""), F.concat(F.lit(" "), "p_type", F.lit(" ")))
    block = F.concat("p_name", F.repeat(F.lit("\n"), F.col("p_size") % 6), "p_type", F.lit("\n"))
    return p.select("p_partkey", X.table_row_text(cells).alias("row_text"), X.collapse_blank_lines(block).alias("squeezed"))


@query(
    "x19_escape_html",
    r"""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
      regexp_replace(replace(url, '/', '**'), '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g') AS strong FROM pages""",
)
def _(spark, sf):
    p = spread(table(spark, sf, "pages"), "page_id")
    return p.select(
        "page_id", X.escape_html("html").alias("escaped"), X.bold_to_strong(F.replace("url", F.lit("/"), F.lit("**"))).alias("strong")
    )


@query(
    "x20_html_to_text",
    r"""WITH a AS (SELECT page_id, regexp_replace(html, '<!--(?s:.*?)-->', '', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(t, '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(t, '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g') AS t FROM b),
    d AS (SELECT page_id, regexp_replace(t, '(?s)<[!/?A-Za-z][^>]*>', '', 'g') AS t FROM c),
    p AS (SELECT page_id, i, part FROM (SELECT page_id, unnest(string_split(t, '&')) AS part, unnest(range(len(string_split(t, '&')))) AS i FROM d)),
    q AS (SELECT *, CASE WHEN i > 0 THEN regexp_extract(part, '^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', 1) ELSE '' END AS r FROM p),
    n AS (SELECT *, CASE WHEN regexp_matches(r, '^#[0-9]') THEN TRY_CAST(r[2:] AS BIGINT) WHEN regexp_matches(r, '^#[xX]') THEN TRY_CAST('0x' || r[3:] AS BIGINT) END AS code FROM q),
    k AS (SELECT page_id, i, CASE
        WHEN r = '' THEN CASE WHEN i > 0 THEN '&' ELSE '' END || part
        WHEN starts_with(r, '#') THEN CASE WHEN code IS NULL OR code = 0 OR code > 1114111 OR code BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(CAST(code AS INT)) END || part[length(r) + 2:]
        WHEN names.c IS NOT NULL THEN names.c || part[length(r) + 2:] ELSE '&' || part END AS t
      FROM n LEFT JOIN (VALUES ('lt', '<'), ('gt', '>'), ('quot', '"'), ('apos', ''''), ('nbsp', chr(160)), ('amp', '&'), ('mdash', '—'), ('ndash', '–'), ('laquo', '«'),
        ('raquo', '»'), ('hellip', '…'), ('copy', '©'), ('eacute', 'é'), ('uuml', 'ü'), ('middot', '·')) AS names(name, c) ON names.name = r)
    SELECT page_id, string_agg(t, '' ORDER BY i) AS text FROM k GROUP BY page_id""",
)
def _(spark, sf):
    return spread(table(spark, sf, "pages"), "page_id").select("page_id", X.html_to_text("html").alias("text"))


@query(
    "x21_extract_pd_ids",
    r"""WITH t AS (SELECT page_id, list_distinct(regexp_extract_all(replace(html, 'href="', 'data-pd-id="'), 'data-pd-id="([^"]+)"', 1)) AS ids FROM pages)
    SELECT page_id, unnest(ids) AS pd_id FROM t""",
)
def _(spark, sf):
    p = spread(table(spark, sf, "pages"), "page_id")
    return p.select("page_id", F.explode(X.extract_pd_ids(F.replace("html", F.lit('href="'), F.lit('data-pd-id="')))).alias("pd_id"))


RAW_ANSWER = """CASE WHEN c_custkey % 11 = 0 THEN 'no json at all' WHEN c_custkey % 11 = 1 THEN '{"persons": [broken'
 ELSE '```json' || chr(10) || '{"persons":[{"id":"p1","fullName":"' || c_name || '","category":"private","mentions":["' || c_name || '","' || c_mktsegment || '"]}],'
  || '"otherPD":[{"id":"o1","type":"address","value":"' || (CASE WHEN c_custkey % 2 = 0 THEN 'г. Самара' ELSE 'ул. Мира, 5' END) || '"},'
  || '{"id":"o2","type":"birthplace","value":"' || (CASE WHEN c_custkey % 3 = 0 THEN 'г. Пермь' ELSE 'с. Село, дом' END) || '"},{"id":"o3","type":"phone","value":"' || c_custkey || '"}],'
  || '"ambiguousPersons":[{"value":" ' || lower(c_mktsegment) || '","context":"x"}]}' || chr(10) || '```' END"""


@query(
    "x22_parse_pd_response",
    """WITH ok AS (SELECT c_custkey AS doc_id, * FROM customer WHERE c_custkey % 11 > 1)
    SELECT doc_id, 'p1' AS pd_id, 'person' AS kind, c_name AS value, c_name AS mentions FROM ok
    UNION ALL SELECT doc_id, 'o1', 'other', 'ул. Мира, 5', NULL FROM ok WHERE c_custkey % 2 = 1
    UNION ALL SELECT doc_id, 'o2', 'other', 'с. Село, дом', NULL FROM ok WHERE c_custkey % 3 <> 0
    UNION ALL SELECT doc_id, 'o3', 'other', CAST(c_custkey AS VARCHAR), NULL FROM ok""",
)
def _(spark, sf):
    answers = customers(spark, sf).selectExpr(
        "'n' || c_nationkey AS project_id", "c_custkey AS doc_id", f"{RAW_ANSWER} AS raw"
    )
    entries, _ambiguous = readers.read_pd_responses(answers)
    return entries.select("doc_id", "pd_id", "kind", "value", F.array_join("mentions", "|").alias("mentions"))


@query(
    "x23_file_keys",
    r"""SELECT page_id, url || '::' || length(html) || '::' || (page_id * 1000) AS file_key,
      regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g') AS safe_name,
      regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url || (CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx.pdf' WHEN 2 THEN '.pdf.docx' ELSE '' END),
        '(?i)\.pdf$', ''), '(?i)\.docx$', ''), '(?i)\.jpg$', ''), '(?i)\.png$', ''), '(?i)\.webp$', '') AS title FROM pages""",
)
def _(spark, sf):
    p = spread(table(spark, sf, "pages"), "page_id")
    name = F.expr("url || (CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx.pdf' WHEN 2 THEN '.pdf.docx' ELSE '' END)")
    return p.select(
        "page_id",
        X.source_file_key(F.col("url"), F.length("html"), F.col("page_id") * 1000).alias("file_key"),
        X.sanitize_file_name("url").alias("safe_name"),
        X.base_title(name).alias("title"),
    )


@query(
    "x26_pages_from_range",
    """WITH r AS (SELECT event_id, user_id % 9 AS a, event_id % 13 AS b FROM events)
    SELECT event_id, unnest(range(a, b + 1)) AS page_no, unnest(range(1, b - a + 2)) AS chunk_page_index FROM r WHERE a > 0 AND b >= a""",
)
def _(spark, sf):
    e = table(spark, sf, "events")
    pages = G.pages_from_range(F.col("user_id") % 9, F.col("event_id") % 13)
    return e.select("event_id", F.explode(pages).alias("p")).select(
        "event_id", F.col("p.pageNumber").alias("page_no"), F.col("p.chunkPageIndex").alias("chunk_page_index")
    )


@query(
    "x26_normalize_metadata",
    """WITH d AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE user_id % 9 END AS f, event_id % 13 AS t, event_id % 4 AS n FROM events),
    g AS (SELECT event_id, unnest(range(n)) AS i, f FROM d WHERE n > 0),
    gp AS (SELECT event_id, i + 1 AS chunk_page_index, CASE WHEN i % 2 = 0 THEN i + 5 WHEN f > 0 THEN f + i END AS page_no FROM g)
    SELECT event_id, page_no, chunk_page_index FROM gp WHERE page_no IS NOT NULL
    UNION ALL SELECT event_id, unnest(range(f, t + 1)), unnest(range(1, t - f + 2)) FROM d WHERE n = 0 AND f > 0 AND t >= f""",
)
def _(spark, sf):
    # metadata with 0..3 given pages, every other one without a number of its own
    n = (F.col("event_id") % 4).cast("int")
    given = F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.struct(F.when(i % 2 == 0, i + 5).cast("bigint").alias("pageNumber")),
        ),
    )
    start = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") % 9).cast("bigint")
    e = table(spark, sf, "events").select(
        "event_id",
        F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(
            start.alias("pageFrom"), (F.col("event_id") % 13).alias("pageTo"), given.alias("pages"))).alias("sources"))).alias("raw"),
    )
    none = F.lit(None)
    entry = {
        "original_file_name": none.cast("string"), "batch_file_name": none.cast("string"), "project_id": none.cast("string"),
        "page_from": none.cast("bigint"), "page_to": none.cast("bigint"), "total_pages": none.cast("bigint"),
    }
    meta = G.normalize_metadata(F.from_json("raw", G.PAGE_METADATA), entry)
    return e.select("event_id", F.explode(F.flatten(F.transform(meta["sources"], lambda s: s["pages"]))).alias("p")).select(
        "event_id", F.col("p.pageNumber").alias("page_no"), F.col("p.chunkPageIndex").alias("chunk_page_index")
    )
