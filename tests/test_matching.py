"""Anchored matching against brute force, overlap policies, redaction laws."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import matching as M
from veilspark.operators.redaction import redact, reveal
from veilspark.operators.registry import explode_registry

ENTRY = (
    "project_id string, pd_id string, seq bigint, kind string, category string, pd_type string, value string, "
    "role string, letter string, replacement string, mentions array<string>"
)
WORDS = (
    "Иванов Ивановым Иванова И.И. З,С. Лебедев лебедева ёлка Ан Ли O'Neill О'Коннорова Smith smith, "
    "a@b.com (a@b.com) x12-34 12-34 №5 д.5 é éИванов ſmith 4111111111111111 411111 — -- [x] ул.Мира сад "
    "Customer#000000001 Customer#0000000012 Weiß WEISS дом дома straße"
).split() + ["знак \ue000 Иванов", "ул. Мира, д. 5", "улице Мира, дом 5", "д. 5 по ул. Мира", "с. Село, ул.  Мира 5"]
VALUES = [
    ("person", None, v)
    for v in ["Иванов", "Иванов И.И.", "З.С. Лебедев", "Лебедев", "Ан", "Ли", "O'Neill", "О'Коннорова", "Smith",
              "Customer#000000001", "ёлка", "é Иванов", "Иванова Лебедева", "№5 Иванов", "--"]
] + [
    ("other", "email", "a@b.com"), ("other", "card", "4111111111111111"), ("other", "other", "11111"),
    ("other", "other", "12-34"), ("other", "other", "ва"), ("other", "other", "—"), ("other", "other", "smith, a@b.com"),
    ("other", "other", "Weiß"), ("other", "other", "дом дома"), ("other", "other", "[x] ул.Мира"),
    ("other", "other", "(a@b.com)"), ("other", "address", "ул. Мира, д. 5"), ("other", "address", "обл. Дальняя, с. Село, ул.Мира, д. 5"),
    ("other", "address", "улица Мира, д. 5"), ("other", "address", "г. Мир"), ("other", "other", "и"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    glue = [" ", " ", "  ", " ", "\n", ". ", ","]
    units = []
    for doc in range(40):
        for line in range(3):
            text = "".join(rng.choice(WORDS) + rng.choice(glue) for _ in range(rng.randint(0, 14)))
            units.append((f"p{doc % 2}", doc, line, text))
    entries = [
        (f"p{p}", f"e{i}", i, kind, "private" if i % 2 else "professional", pd_type, value, None, f"L{i}", f"[{i}]",
         [value] if kind == "person" else None)
        for p in (0, 1)
        for i, (kind, pd_type, value) in enumerate(VALUES)
        if not (p == 1 and i % 5 == 0)
    ]
    u = spark.createDataFrame(units, "project_id string, doc_id bigint, unit_no int, text string").cache()
    e = spark.createDataFrame(entries, ENTRY).cache()
    return u, e


def brute(units, mentions, overlapping=False):
    pairs = units.join(mentions.select("project_id", "pd_id", "kind", "mention", "pattern", "rank"), "project_id")
    return M._explode_spans(pairs, overlapping)


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "unit_no", "start", "end", "hit", "pd_id", "mention").collect())


@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
@pytest.mark.parametrize("literal", [False, True])
def test_anchors_lose_no_match(corpus, strategy, literal):
    units, entries = corpus
    mentions = explode_registry(entries, literal_persons=literal)
    want = rows(brute(units, mentions))
    got = rows(M.match_dictionary(units, mentions, strategy, literal_persons=literal))
    assert len(want) > 150
    assert got == want


def test_offsets_point_at_the_hit(corpus):
    units, entries = corpus
    hits = M.match_dictionary(units, explode_registry(entries), "broadcast").join(units, ["project_id", *M.UNIT])
    cut = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    assert hits.filter(cut != F.col("hit")).count() == 0


def greedy(matches, key):
    by_unit = {}
    for m in matches:
        by_unit.setdefault((m.doc_id, m.unit_no), []).append(m)
    kept = []
    for unit in by_unit.values():
        last = 0
        for m in sorted(unit, key=key):
            if m.start >= last:
                kept.append((m.doc_id, m.unit_no, m.start, m.end, m.pd_id, m.mention))
                last = m.end
    return sorted(kept)


@pytest.mark.parametrize("policy", ["registry", "longest", "merge"])
def test_overlap_policies(corpus, policy):
    units, entries = corpus
    matches = M.match_dictionary(units, explode_registry(entries), "broadcast").cache()
    keys = {
        "registry": lambda m: (m.start, *m.rank),
        "longest": lambda m: (m.start, -m.end, *m.rank),
        "merge": lambda m: (m.start, m.rank.by_kind, m.rank.by_seq, m.rank.by_pos),
    }
    want = greedy(matches.collect(), keys[policy])
    got = sorted(
        tuple(r)
        for r in M.resolve_overlaps(matches, policy).select("doc_id", "unit_no", "start", "end", "pd_id", "mention").collect()
    )
    assert got == want


def test_alternation_equals_one_big_pattern(spark, corpus):
    units, entries = corpus
    mentions = explode_registry(entries)
    got = sorted(
        tuple(r)
        for r in M.match_alternation(units, mentions, "broadcast")
        .select("doc_id", "unit_no", "start", "raw_end").collect()
    )
    # small fixture: the single alternation can be built outright
    alternation = mentions.groupBy("project_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pattern"))).alias("p")
    ).select("project_id", F.array_join(F.transform("p", lambda x: x["pattern"]), "|").alias("pattern"))
    want = sorted(
        tuple(r)
        for r in M._explode_spans(units.join(alternation, "project_id")).select("doc_id", "unit_no", "start", "end").collect()
    )
    assert got == want


def test_redaction_laws(spark, corpus):
    units, entries = corpus
    kept = M.resolve_overlaps(M.match_dictionary(units, explode_registry(entries), "broadcast")).cache()
    text = lambda df: sorted((r.doc_id, r.unit_no, r.text) for r in df.collect())
    none = entries.filter("false").select("project_id", "pd_id")
    assert text(redact(units, kept, entries, none)) == text(units)
    everything = entries.select("project_id", "pd_id")
    hidden = redact(units, kept, entries, everything)
    assert hidden.agg(F.sum("n_hidden")).first()[0] == kept.count()
    assert text(reveal(hidden, none)) == text(units)
    some = everything.filter(F.col("pd_id").isin("e0", "e3", "e15"))
    assert text(reveal(hidden, some)) == text(redact(units, kept, entries, some))


LITERALS = ["re a", "the the", "aa", "Ёлка дом", "ſ1 b", "ÿ x", "x.y (z)", "к", "K k", "straße", "İ i", "a"]


def literal_case(spark):
    rng = random.Random(11)
    parts = ["re", "a", "The", "THE", "aaa", "ёЛКА", "дом", "S1", "b", "Ÿ", "x", "x.y", "(z)", "К", "\u212a", "k", "straSSe", "straẞe", "İ", "ı", "\ue000", "\U0001f600"]
    glue = [" ", " ", " ", " ", "\u00a0", "\t", "  ", "", "\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(glue) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    units = spark.createDataFrame([("p", i, 0, t) for i, t in enumerate(texts)], "project_id string, doc_id bigint, unit_no int, text string")
    entries = [("p", f"e{i}", i, "other", None, "other", v, None, None, "[x]", None) for i, v in enumerate(LITERALS)]
    return units, explode_registry(spark.createDataFrame(entries, ENTRY))


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("strategy", ["broadcast", "shuffle"])
def test_plain_values_are_found_as_by_their_patterns(spark, strategy, overlapping):
    units, mentions = literal_case(spark)
    want = rows(brute(units, mentions, overlapping))
    assert len(want) > 150
    assert rows(M.match_dictionary(units, mentions, strategy, overlapping=overlapping)) == want


def test_no_text_is_sorted_for_plain_values(spark):
    # sorting pairs with their texts by pattern wrote many times the input to disk
    units, mentions = literal_case(spark)
    plan = M.match_dictionary(units, mentions, "broadcast")._jdf.queryExecution().executedPlan().toString()
    assert "Sort [pattern" not in plan and "hashpartitioning(doc_id" not in plan


def test_documents_dealt_by_id_are_not_shuffled_again(spark):
    units, mentions = literal_case(spark)
    kept = M.resolve_overlaps(M.match_dictionary(units.repartition("doc_id"), mentions, "broadcast"))
    plan = kept.groupBy("doc_id", "pd_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1


def test_candidates_of_a_shuffled_dictionary_stay_beside_their_texts(spark):
    units, mentions = literal_case(spark)
    plan = M.match_dictionary(units, mentions, "shuffle")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(project_id" in x and "doc_id" in x and "ENSURE_REQUIREMENTS" in x]
