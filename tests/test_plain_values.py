"""Plain values found by the trie, against their patterns one by one."""

import random

import pytest
from pyspark.sql import functions as F

from test_matching import ENTRY, brute, literal_case, rows
from veilspark.operators import matching as M, plain_values as V, redaction as Z
from veilspark.operators.registry import explode_registry

UNITS = "project_id string, doc_id bigint, unit_no int, text string"


def registry(spark, values, projects=("p",)):
    entries = [(p, f"e{i}", i, "other", None, "other", v, None, None, "[x]", None) for p in projects for i, v in enumerate(values)]
    return explode_registry(spark.createDataFrame(entries, ENTRY))


@pytest.mark.parametrize("overlapping", [False, True])
def test_trie_finds_what_patterns_find(spark, overlapping):
    units, mentions = literal_case(spark)
    plan = M.match_dictionary(units, mentions)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan
    want = rows(brute(units, mentions, overlapping))
    assert rows(M.match_dictionary(units, mentions, overlapping=overlapping)) == want and len(want) > 150


@pytest.mark.parametrize("chunk", [64, V.CHUNK])
def test_projects_long_values_and_blanks(spark, monkeypatch, chunk):
    monkeypatch.setattr(V, "CHUNK", chunk)
    rng = random.Random(3)
    # values beyond the trie's depth that share their start, one inside the other
    long = " ".join(["ab", "cd"] * 60)
    values = ["ab cd", "d ab", "ab", "cd ab cd", long, long + " x", long + " y", "a", "я ab"]
    glue = [" ", " ", "  ", " ", "\t \n", "", ","]
    texts = ["".join(rng.choice(["ab", "CD", "cd", "x", "Я", "\U0001f600"]) + rng.choice(glue) for _ in range(rng.randint(0, 20))) for _ in range(60)]
    texts += [long.replace(" ", "  ").upper() + " Y ab", long + " x", None, "", "ab", " ab  cd "]
    given = [(p, i, 0, t) for i, t in enumerate(texts) for p in ["p", "q", "r", None][i % 4 : i % 4 + 1]]
    units = spark.createDataFrame(given, UNITS)
    mentions = registry(spark, values).unionByName(registry(spark, values[3:], ("q", "none")))
    want = rows(brute(units, mentions))
    assert rows(M.match_dictionary(units, mentions)) == want and len(want) > 100
    marked = spark.createDataFrame([(i, "e0") for i in range(0, 66, 2)], "doc_id bigint, pd_id string")
    left = [w for w in want if not (w[0] % 2 == 0 and w[5] == "e0")]
    assert rows(M.match_dictionary(units, mentions, except_marked=marked)) == left != want


def test_values_between_letter_edges(spark):
    texts = ["the cat, the  CAT. (the) cat", "breathe cat", "the catx the cat", "Kthe cat", "İthe catı", "the catſ", "1the cat2", "ёthe Ё cat ё", None]
    units = spark.createDataFrame([("p", i, 0, t) for i, t in enumerate(texts)], UNITS)
    given = [("p", i, v, None, None) for i, v in enumerate(["the cat", "cat", "the", "ё", "(the)"])]
    mentions = Z.ambiguous_mentions(spark.createDataFrame(given, "project_id string, seq long, value string, context string, reason string"))
    assert M._with_value(mentions).filter(F.col("edge") == V.EDGED).count() == 5
    want = rows(brute(units, mentions))
    assert rows(M.match_dictionary(units, mentions)) == want and len(want) > 10


def test_every_letter_of_the_edge_rule(spark):
    from veilspark.functions.charset import LETTER
    from veilspark.functions.text import fold_case

    signs = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i <= 0xDFFF]
    given = spark.createDataFrame([(s,) for s in signs], "s string")
    shown = given.select("s", fold_case("s").alias("f"), F.col("s").rlike(f"(?iu){LETTER}").alias("by_pattern")).collect()
    assert [r.s for r in shown if (ord(r.f) in V._LETTERS) != r.by_pattern] == []


def test_too_many_letters_go_another_way(spark, monkeypatch):
    units, mentions = literal_case(spark)
    monkeypatch.setattr(M, "PLAIN_LETTERS", 3)
    found = M.match_dictionary(units, mentions)
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found) == rows(brute(units, mentions))


def test_one_owner_per_whole_hit_without_patterns(spark):
    units = spark.createDataFrame([("p", 0, 0, "a  B and a b"), ("p", 1, 0, "ba b"), ("q", 2, 0, "a b")], UNITS)
    got = M.match_alternation(units, registry(spark, ["b", "A b", "a B"])).select("doc_id", "start", "end", "hit", "pd_id", "mention").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 4, "a  B", "e1", "A b"), (0, 9, 12, "a b", "e1", "A b"), (1, 0, 1, "b", "e0", "b"), (1, 1, 4, "a b", "e1", "A b")]


def test_many_matches_in_one_unit(spark, monkeypatch):
    # blocks of runs: neither cut a run nor depend on their size
    rng = random.Random(5)
    spans = []
    for unit in range(3):
        at = 0
        for i in range(400):
            at += rng.choice([0, 0, 1, 2, 9])
            spans.append((1, unit, at, at + rng.randint(1, 6), i % 7, i))
    given = spark.createDataFrame(spans, "doc_id long, unit_no int, start int, end int, n int, seq long")
    matches = given.withColumn("rank", F.struct(F.col("n").alias("by_length"), F.lit(0).alias("by_kind"), F.col("seq").alias("by_seq"), F.lit(0).cast("long").alias("by_pos")))
    want = []
    for unit in range(3):
        last = 0
        for s in sorted((s for s in spans if s[1] == unit), key=lambda s: (s[2], s[4], s[5])):
            if s[2] >= last:
                want.append(s)
                last = s[3]
    for block in (1, 5, 64):
        monkeypatch.setattr(M, "RUN_BLOCK", block)
        got = M.resolve_overlaps(matches).select("doc_id", "unit_no", "start", "end", "n", "seq").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_lines_of_annotated_html_are_tidied_once(spark):
    # each pass over the lines tidied, glued and classified all texts anew
    docs = spark.range(3).selectExpr("'p' AS project_id", "id AS doc_id", "concat('# Head\\n\\na  b c\\nand ', id) AS text")
    entries = [("p", f"e{i}", i, "other", None, "other", v, None, None, "[x]", None) for i, v in enumerate(["a b", "and", "nothing"])]
    registry_ = spark.createDataFrame(entries, ENTRY)
    shown = Z.annotate_html(docs, registry_, explode_registry(registry_), registry_.filter("pd_id = 'e1'").select("project_id", "pd_id"))
    assert "Range (" not in shown._jdf.queryExecution().optimizedPlan().toString()
    got = [r.html for r in shown.orderBy("doc_id").collect()]
    assert len(got) == 3 and all(h.count('data-pd-id="e0"') == 1 and h.count('data-pd-id="e1"') == 1 and "[x]" in h for h in got)
