"""Registered queries of this subpackage, with SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, chat_format, chat_repair, embedding_dedup, exact_dedup, hilbert_search, merkle, mixing, near_dedup, quality, secret_scan, substring_dedup, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op4_byte_bpe")
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    decoded = bpe.round_trip(_table(spark, sf_dir, "documents"), words)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@_query(
    "op9_exact_dedup",
    r"""
    WITH norm AS (
        SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
        FROM documents
    )
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
    FROM norm WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@_query("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"))


#: Texts that score less are predicted to be of low quality.
QUALITY_LIMIT = 0.3


@_query("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    machine = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


@_query("op6_mixing")
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query(
    "op8_embedding_near_dedup",
    r"""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
    ), good AS (
        SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND (SELECT bool_and(e IS NOT NULL AND isfinite(e)) FROM (SELECT unnest(x) AS e))
          AND list_dot_product(x, x) > 0
    ), links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.98
    ), reach AS (
        SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
    ), least AS (
        SELECT a, min(b) AS component_id FROM reach GROUP BY a
    ), n AS (
        SELECT a, count(*) AS n FROM links GROUP BY a
    )
    SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
)
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


_PROBE = "</s>[INST] ok [/INST]"


@_query(
    "op2_chat_format",
    r"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), counted AS (
        SELECT *, length(role) + length(text) + 20
                  + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')) + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]')) AS chars
        FROM rows
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(chars)::BIGINT AS formatted_chars
    FROM counted GROUP BY conv_id
    """,
)
def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"),
    )
    chats = chat_format.format_chats(given.unionByName(probe))
    turns, loss = chat_format.parse(F.col("formatted")), F.array_join(chat_format.masked_texts(F.col("formatted"), F.col("mask")), "")
    chats = chats.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


@_query("op10_secret_scan")
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(number(k) for k in secret_scan.KINDS[:3]), F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"), secret_scan.listed(F.col("spans")).alias("spans"))


@_query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    graded = toxicity.severity(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return graded.select("doc_id", quality.held_out().alias("held_out"), "expected_severity", "grade", (F.col("p_toxic") >= 0.5).alias("toxic"))


@_query("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup_spans(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_sentences", "n_removed", "spans", F.sha2("text", 256).alias("text_sha256"))


#: CRC-32 of an ASCII text {0}, bit by bit.
_CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split({0}, ''), lambda ch: ascii(ch)::BIGINT),
    lambda crc, byte: list_reduce([xor(crc, byte)] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(({f})::VARCHAR)::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


@_query(
    "op11_merkle_manifest",
    f"""
    WITH RECURSIVE leaves AS (
        SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf,
               CASE WHEN {_CRC32.format("doc_id::VARCHAR")} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql("n_chars + 1")}
                    ELSE {_leaf_sql("n_chars")} END AS tried
        FROM documents
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
        FROM leaves
    ), low AS (
        SELECT lang, 0 AS level, pos, n, leaf AS h FROM numbered
        UNION ALL
        SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM low WHERE n > 1 GROUP BY lang, level, pos // 2, n
    ), subroots AS (
        SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1
    ), high AS (
        SELECT 0 AS level, pos, n, h FROM subroots
        UNION ALL
        SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM high WHERE n > 1 GROUP BY level, pos // 2, n
    ), folded AS (
        SELECT doc_id, lang, leaf, 0 AS level, pos, n, tried AS h, '' AS proof FROM numbered
        UNION ALL
        SELECT f.doc_id, f.lang, f.leaf, f.level + 1, f.pos // 2, (f.n + 1) // 2,
               sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
        FROM folded f LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM f.lang AND s.level = f.level AND s.pos = xor(f.pos, 1)
        WHERE f.n > 1
    ), tops AS (
        SELECT f.doc_id, f.leaf, s.h AS subroot, 0 AS level, s.pos, s.n, f.h, f.proof
        FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.n = 1
        UNION ALL
        SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.pos // 2, (f.n + 1) // 2,
               sha256(CASE WHEN f.pos % 2 = 1 THEN coalesce(s.h, '') || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
        FROM tops f LEFT JOIN high s ON s.level = f.level AND s.pos = xor(f.pos, 1)
        WHERE f.n > 1
    )
    SELECT t.doc_id, t.leaf, t.subroot, r.h AS root, sha256(t.proof) AS proof_sha256, t.h AS folded_root, t.h = r.h AS verified
    FROM tops t, high r WHERE t.n = 1 AND r.n = 1
    """,
)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited_documents(_table(spark, sf_dir, "documents"))


_TURN_KEY = "(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"


@_query(
    "op12_chat_repair",
    rf"""
    WITH RECURSIVE given AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC32.format(_TURN_KEY)} % 20 AS fate FROM conversations
    ), hurt AS (
        SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
               CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM given, range(2) AS copies(c) WHERE fate <> 0 AND (c = 0 OR fate = 3)
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
               rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS trimmed, left(role, 1) AS initial
        FROM hurt
    ), kinds AS (
        SELECT *, CASE WHEN trimmed = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN right(trimmed, 1) IN ('.', '!', '?') THEN '-' ELSE 't' END AS fault,
               lag(initial) OVER (PARTITION BY conv_id ORDER BY k) AS before
        FROM numbered
    ), facts AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
               count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
               count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
        FROM kinds GROUP BY conv_id
    ), steps(p, role, q) AS (
        VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
    ), inserted(p, q, cost, audit) AS (
        VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
               (2, 3, 3, 'I'), (3, 2, 3, 'I')
    ), faults(fault, extra) AS (
        VALUES ('b', NULL), ('d', NULL), ('t', 3), ('-', 0)
    ), moves AS (
        SELECT fault, '' AS initial, p, p AS q, 4 AS cost, 'D' AS audit FROM faults, range(4) AS r(p)
        UNION ALL SELECT fault, role, p, q, extra, 'K' FROM faults, steps WHERE extra IS NOT NULL
        UNION ALL SELECT fault, '', p, q, extra + 3, 'R' FROM faults, steps WHERE extra IS NOT NULL AND role <> 's'
    ), best AS (
        SELECT conv_id, 0::BIGINT AS k, 0 AS state, repeat('0', 12) AS value FROM facts
        UNION ALL
        SELECT b.conv_id, b.k + 1, m.q, min(lpad((left(b.value, 12)::BIGINT + i.cost + m.cost)::VARCHAR, 12, '0') || substr(b.value, 13) || i.audit || m.audit)
        FROM best b JOIN kinds r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.k = b.k + 1
        JOIN inserted i ON i.p = b.state JOIN moves m ON m.p = i.q AND m.fault = r.fault AND m.initial IN ('', r.initial)
        GROUP BY b.conv_id, b.k, m.q
    ), done AS (
        SELECT f.conv_id, min(lpad((left(b.value, 12)::BIGINT + i.cost)::VARCHAR, 12, '0') || substr(b.value, 13) || i.audit) AS value
        FROM facts f JOIN best b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.k = f.n JOIN inserted i ON i.p = b.state AND i.q IN (0, 3)
        GROUP BY f.conv_id
    ), audits AS (
        SELECT conv_id, left(value, 12)::BIGINT AS cost, substr(value, 13) AS audit FROM done
    ), edits AS (
        SELECT conv_id, i, audit[i] AS edit, length(replace(left(audit, i - 1), 'I', '')) + 1 AS k,
               length(replace(left(audit, i - 1), 'D', '')) - length(replace(audit, 'D', '')) % 2 AS place
        FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1))::INT AS i FROM audits)
    ), repaired AS (
        SELECT e.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN r.role WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END
                                            || ':' || CASE WHEN edit = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY i)) AS repaired_sha256
        FROM edits e LEFT JOIN kinds r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.k = e.k WHERE edit <> 'D' GROUP BY e.conv_id
    )
    SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
           coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
)
def op12_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repaired_conversations(_table(spark, sf_dir, "conversations"))


@_query(
    "op13_hilbert_search",
    """
    WITH good AS (
        SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
        WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))
          AND list_bool_or(list_transform(embedding, lambda e: e <> 0))
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_reduce([0::DOUBLE] || list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]), lambda a, b: a + b) AS score
        FROM good q JOIN good c ON q.vec_id % 20 = 0 AND c.vec_id IS DISTINCT FROM q.vec_id AND len(c.x) = len(q.x)
    )
    SELECT query_id, (row_number() OVER w)::INT AS rank, vec_id, score
    FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
    """,
)
def op13_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_search.nearest(_table(spark, sf_dir, "embeddings"))
