"""Stored results that change: commits, marks, memberships, sessions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_golden import ENTRY

from veilspark.operators import corpus as C, lines as L, matching as M, registry as R
from veilspark.operators.redaction import second_pass_segments, segment_spans
from veilspark.operators.spans import SpanStore, _pieces
from veilspark.plans import flows
from veilspark.plans.session import scratch_dir
from veilspark.plans.suite_stream import in_order
from veilspark.sources import readers, writers
from veilspark.sources.versions import VersionedTables
from veilspark.streaming import page_stream as S

UNITS = "project_id string, doc_id bigint, unit_no int, text string"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- commits -----------------------------------------------------------------


def test_readers_see_whole_commits_only(spark):
    t = VersionedTables(spark, scratch_dir(spark, "versions"), {"a": "x bigint", "b": "x bigint, y int"}, {"b": ["y"]})
    one, two = spark.range(3).withColumnRenamed("id", "x"), spark.range(2).select(F.col("id").alias("x"), F.lit(7).alias("y"))
    assert rows(t.read("a")) == rows(t.read("b")) == []
    assert t.commit(4, a=one, b=two)
    t.put("a", one, 5)  # interrupted behind its first write
    assert len(rows(t.read("a"))) == 3 and not t.is_done(5)
    assert t.commit(5, a=one.limit(1), b=two)
    assert rows(t.read("a"), "commit") == [(4,)] * 3 + [(5,)]
    assert not t.commit(5, a=one, b=two)
    assert rows(t.read("b"), "x", "y", "commit") == [(0, 7, 4), (0, 7, 5), (1, 7, 4), (1, 7, 5)]


# --- marks -------------------------------------------------------------------


def person(pd_id, value, mentions):
    return ("p", pd_id, 0, "person", "private", None, value, "свидетель", "А.", None, mentions)


def test_renamed_person_keeps_old_marks_and_gains_new_ones(spark):
    units = spark.createDataFrame(
        [
            ("p", 3, 0, "Стрежнева Лидия Андреевна пояснила обстоятельства."),
            ("p", 4, 0, "Стрекова Лилия Андреевна пояснила, что Стрежнева Лидия Андреевна также фигурирует в деле."),
            ("p", 5, 0, "Никого здесь нет."),
            ("other", 6, 0, "Стрежнева Лидия Андреевна"),
        ],
        UNITS,
    )
    name = "Стрекова Лилия Андреевна"
    entries = spark.createDataFrame([person("p1", name, [name])], ENTRY)
    store = SpanStore(spark, scratch_dir(spark, "marks"), parts=4, slots=4)
    store.add(0, units, M.resolve_overlaps(M.match_dictionary(units, R.explode_registry(entries))))
    assert rows(store.marks(), "doc_id", "hit") == [(4, name)]
    edits = spark.createDataFrame([("p", "p1", "Стрежнева Лидия Андреевна", None)], "project_id string, pd_id string, new_value string, new_role string")
    assert store.rematch(1, R.rename_entries(entries, edits))
    want = [(3, "Стрежнева Лидия Андреевна"), (4, name), (4, "Стрежнева Лидия Андреевна")]
    assert rows(store.marks(), "doc_id", "hit") == sorted(want, key=repr)
    # the same edit again, as a new change, adds nothing; as a replay it is not even tried
    assert not store.rematch(1, R.rename_entries(entries, edits))
    store.rematch(2, R.rename_entries(entries, edits))
    assert rows(store.marks(), "doc_id", "hit") == sorted(want, key=repr)


def test_rematch_equals_matching_all_gaps(spark):
    rng = random.Random(1)
    words = ["ab", "abc", "b", "Ivan", "ivanov", "12", "123", "é", "straße", "--", "Ab", "x1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "", ", ", "."]) for _ in range(n))
    units = spark.createDataFrame([(rng.choice("pq"), d, u, text(9)) for d in range(40) for u in range(3)], UNITS)
    units = units.withColumn("project_id", F.when(F.col("doc_id") % 3 == 0, "q").otherwise("p"))
    other = lambda pid, i, v: (pid, f"{pid}{i}", i, "other", None, "other", v, None, None, "[x]", None)
    old = spark.createDataFrame([other(p, i, text(2).strip() or "ab") for p in "pq" for i in range(8)], ENTRY)
    new = spark.createDataFrame([other(p, i, v) for p in "pq" for i, v in enumerate(["ab", "van", "Ivan  ab", "--", "12", "b é", "c, I", "nothing at all"])] + [("p", "z", 9, "person", "private", None, "Ivan", None, "А.", None, ["Ivan", "Ivanov A.B."])], ENTRY)
    kept = M.resolve_overlaps(M.match_dictionary(units, R.explode_registry(old)))
    store = SpanStore(spark, scratch_dir(spark, "marks"), parts=4, slots=4)
    store.add(0, units, kept)
    store.rematch(1, new)
    gaps = second_pass_segments(units, kept)
    more = M.match_dictionary(gaps, R.explode_registry(new).filter(F.length("mention") > 1))
    want = kept.select("doc_id", "unit_no", "start", "end", "pd_id").unionByName(segment_spans(M.resolve_overlaps(more, "longest")).select("doc_id", "unit_no", "start", "end", "pd_id"))
    assert rows(store.marks(), "doc_id", "unit_no", "start", "end", "pd_id") == rows(want)
    assert want.count() > kept.count()


def test_a_rare_word_reads_few_folders(spark):
    filler = [("p", d, 0, f"text number {d} with common words") for d in range(200)]
    units = spark.createDataFrame([*filler, ("p", 500, 0, "the zanzibar affair")], UNITS)
    store = SpanStore(spark, scratch_dir(spark, "marks"), parts=16, slots=16)
    store.add(0, units, M.match_dictionary(units, R.explode_registry(spark.createDataFrame([], ENTRY))))
    entry = spark.createDataFrame([("p", "z", 1, "other", None, "other", "Zanzibar affair", None, None, "[x]", None)], ENTRY)
    where = store.touched(R.explode_registry(entry))
    assert rows(where) == [("p", 500, 0)]
    plan = where._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot" in plan.replace("isnotnull(slot#", "slot#").replace("[isnotnull(commit", "[slot") or "slot IN" in plan
    keyed = where.withColumn("part", store._part())
    found = store._narrow(store.tables.read("units"), keyed, "doc_id", F.col("part"), "part")
    plan = found._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "text" in line][0]
    assert "part#" in scan.split("PartitionFilters:")[1] and "doc_id" in scan.split("PushedFilters:")[1]
    assert found.count() == 1


def test_joining_documents_twice_changes_nothing(spark):
    t = C.project_tables(spark, scratch_dir(spark, "projects"))
    entry = lambda i, v, k="other": ("p", i, int(i[1:]), k, "private" if k == "person" else None, None if k == "person" else "other", v, None, None, None, None)
    docs = spark.createDataFrame([("p", 1, "Foo Bar met foo bar\nand Baz Q"), ("p", 2, "Baz Q")], "project_id string, doc_id bigint, text string")
    marks = spark.createDataFrame([("p", 1, 0, 0, 7, "Foo Bar", "e2")], t.schemas["marks"])
    for number, names in ((0, [("e1", "Baz Q"), ("e2", "foo bar")]), (1, [("e3", "BAZ  q"), ("e4", "met")])):
        entries = spark.createDataFrame([entry(*n) for n in names], ENTRY)
        for _ in range(2):
            C.join_documents(t, number, docs if number == 0 else docs.filter("doc_id = 2"), entries, marks if number == 0 else marks.limit(0))
    assert rows(C.current(t, "members"), "doc_id", "pos") == [(1, 0), (2, 1)]
    assert rows(C.current(t, "registry"), "pd_id", "value") == [("e1", "Baz Q"), ("e2", "foo bar"), ("e4", "met")]
    # entry e2 is marked in document 1 already, so its second place is left alone
    assert rows(C.current(t, "marks"), "doc_id", "unit_no", "start", "end", "pd_id") == [(1, 0, 0, 7, "e2"), (1, 1, 4, 9, "e1"), (2, 0, 0, 5, "e1")]


def test_published_documents(spark):
    docs = spark.createDataFrame([("p", 1, "Иванов И.И. и Петров П.П., тел. 12345"), ("p", 2, "Иванова И.И. ⚠️[НЕЧИТАЕМО]"), ("q", 3, "Петров П.П. сказал")], "project_id string, doc_id bigint, text string")
    members = docs.select("project_id", F.col("doc_id").alias("pos"), "doc_id")
    row = lambda p, i, seq, kind, cat, value: (p, i, seq, kind, cat, None if kind == "person" else "phone", value, None, None, None if kind == "person" else "[телефон]", None)
    shared = spark.createDataFrame([row("p", "a", 0, "person", "private", "Иванов И.И."), row("p", "b", 1, "person", "professional", "Петров П.П."), row("p", "c", 2, "other", None, "12345"), row("p", "d", 3, "person", "private", "иванов и.и.")], ENTRY)
    own = spark.createDataFrame([(*row("q", "e", 0, "person", "private", "Петров П.П."), 3), (*row("p", "f", 9, "person", "private", "сказал"), 1)], f"{ENTRY}, doc_id bigint")
    flags = spark.createDataFrame([("p", x) for x in "abc"] + [("q", "e")], "project_id string, pd_id string")
    got = rows(flows.publish_documents(docs, members, shared, own, flags), "doc_id", "text", "n_hidden")
    # the second document has an open reading; project q falls back on its last document's entries
    assert got == [(1, "А. и [ФИО 1], тел. [телефон]", 3), (3, "А. сказал", 1)]


# --- streams -----------------------------------------------------------------


def test_an_interrupted_batch_is_written_anew(spark):
    t = S.document_tables(spark, scratch_dir(spark, "membership"))
    page = lambda f, n: ("p", f, n, n, f"d{f}{n}", "t", f"text {n}", 3)
    batch = lambda *ps: spark.createDataFrame([page(*p) for p in ps], S.PAGES)
    step = S.document_step(t)
    step(batch(("b", 2), ("a", 1)), 0)
    second = batch(("b", 1), ("c", 1), ("c", 2))
    t.put("pages", second, 1)  # and no further
    facts, _ = S.documents_with_places(t)
    assert rows(facts, "file_key", "pos", "n_pages") == [("a", 1, 1), ("b", 2, 1)]
    for _ in range(2):
        step(second, 1)
    step(batch(("a", 2), ("b", 1)), 2)
    facts, _ = S.documents_with_places(t)
    assert rows(facts, "file_key", "doc_id", "pos", "n_pages") == [("a", "da1", 1, 2), ("b", "db1", 2, 2), ("c", "dc1", 3, 2)]


def test_keys_are_forgotten_and_late_rows_left_out(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    sent = [(i, at(i * 10)) for i in range(100)] + [(i, at(i * 10 + 1)) for i in range(0, 100, 7)]
    stream = in_order(spark, spark.createDataFrame(sent, "k int, ts timestamp"), "ts", "k")
    seen, log = [], scratch_dir(spark, "late")
    query = S.run_available(S.stream_dedupe(stream, ["k"], "ts", "10 minutes"), lambda b, _: seen.extend(r.k for r in b.collect()), f"{log}/checkpoint")
    assert sorted(seen) == list(range(100))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] < 10
    # a row that comes long after its time is not taken up
    folder = scratch_dir(spark, "in-order")
    # the watermark for late rows is that of the batch before
    for part in ([(1, at(0))], [(2, at(500))], [(3, at(600))], [(4, at(3)), (5, at(601))]):
        spark.createDataFrame(part, "k int, ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    seen.clear()
    S.run_available(S.stream_dedupe(S.read_pages(spark, folder, "k int, ts timestamp"), ["k"], "ts", "10 minutes"), lambda b, _: seen.extend(r.k for r in b.collect()), f"{log}/checkpoint2")
    assert sorted(seen) == [1, 2, 3, 5]


def test_state_holds_open_sessions_only(spark):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    sent = []
    for s in range(30):
        last = 5 if s % 3 else 4  # every third one stops before its last page
        sent += [(s, at(s + 40 * n), n, "running", n, 5, "") for n in range(1, last + 1)]
    sent += [(1, at(900), 9, "failed", 2, 5, "broken"), (2, at(901), 9, "paused", 1, 5, "x"), (2, at(902), 10, "running", 5, 5, "")]
    progress = spark.createDataFrame(sent, "session_id bigint, ts timestamp, seq bigint, status string, page_to bigint, total_pages bigint, error string")
    log = scratch_dir(spark, "sessions")
    query = S.run_available(S.session_lifecycle(in_order(spark, progress, "ts", "seq")), S.session_step(log), f"{log}/checkpoint", mode="update")
    still = rows(S.current_sessions(spark, log), "session_id", "page_to", "status", "error")
    assert still == sorted([(1, 2, "failed", "broken")] + [(s, 4, "running", "") for s in range(0, 30, 3)], key=repr)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert held[-1] == len(still)


# --- documents ---------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("##\ntitle\nmore\nand more", "## title\nmore and more"),
        ("##\n##\n##\n##\nx", "## ##\n## ##\nx"),
        ("a\n##\nb", "a ## b"),
        ("**РЕШИЛ\nвсё\nдалее", "**РЕШИЛ всё\nдалее"),
        ("**РЕШИЛИ\nвсё\nдалее", "**РЕШИЛИ всё далее"),
        (" ###  \n x\n\n##\ny\n## z\nw", " ### x\n\n## y\n## z\nw"),
        ("", ""),
        ("##", "##"),
        ("\n".join(["##", "t", "u", "**РЕШИЛ", " "] * 300), None),
    ],
)
def test_lines_glued_to_a_coming_heading(spark, text, want):
    if want is None:
        want = reference_gluing(text)
    got = spark.createDataFrame([(text,)], "t string").select(L.merge_broken_lines("t")).first()[0]
    assert got == want == reference_gluing(text)


def reference_gluing(text):
    """Line by line, as the rule is stated."""
    import re

    structural = lambda t: not t or t == "---" or t.startswith(("## ", "### ", "[CENTER]", "[INDENT]")) or bool(re.match(r"\*\*(УСТАНОВИЛ|ПОСТАНОВИЛ|РЕШИЛ|ОПРЕДЕЛИЛ|ПРИГОВОРИЛ)[:\s*]", t))
    out, blank = [], False
    for line in text.split("\n"):
        t = line.strip()
        opens = blank or re.match(r"[ \t]{2,}", line) or structural(t) or not out or structural(out[-1].strip())
        if t and not opens:
            out[-1] = f"{out[-1].rstrip()} {t}"
        else:
            out.append(line)
        blank = not t
    return "\n".join(out)


def test_the_page_of_a_line_is_carried_into_later_segments(spark):
    lines = [(1, 0, 0, "[PAGE:4]"), (1, 0, 1, "a"), (1, 1, 0, "b"), (1, 3, 0, "c"), (1, 3, 1, "[PAGE:9]"), (2, 0, 0, "d"), (3, 0, 0, "e"), (None, 0, 0, "[PAGE:2]"), (None, 1, 0, "f")]
    df = spark.createDataFrame(lines, "doc_id bigint, segment_no bigint, line_no int, line string")
    totals = spark.createDataFrame([(1, 100, 1), (2, 0, 6)], "doc_id bigint, total_pages bigint, page_to bigint")
    got = rows(L.page_of_line(df, segment="segment_no", totals=totals), "doc_id", "line", "page_no", "last_page")
    want = [(1, "[PAGE:4]", 4, 9), (1, "a", 4, 9), (1, "b", 4, 9), (1, "c", 4, 9), (1, "[PAGE:9]", 9, 9), (2, "d", None, 6), (3, "e", None, None), (None, "[PAGE:2]", 2, 2), (None, "f", 2, 2)]
    assert got == sorted(want, key=repr)


def test_an_updated_document_keeps_its_place(spark):
    target = spark.createDataFrame([(i, 0, i) for i in range(5)], "doc_id bigint, saved_at bigint, created_at bigint")
    delta = spark.createDataFrame([(0, 1), (9, 2), (9, 3)], "doc_id bigint, seq bigint")
    grown = writers.upsert_documents(target, delta, now=F.lit(7).cast("bigint"), seq="seq")
    assert rows(grown) == sorted([(0, 7, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (9, 7, 7)], key=repr)
    assert [r.doc_id for r in C.latest_documents(grown, k=2, stamp="created_at").collect()] == [9, 4]


def test_summaries_window_lengths_not_texts(spark):
    docs = spark.createDataFrame([(i, f"text {i}" * i) for i in range(1, 6)], "doc_id bigint, text string")
    members = spark.createDataFrame([("p", i, i) for i in range(1, 6)], "project_id string, pos bigint, doc_id bigint")
    made = C.build_project_summary(members, docs)
    parts = sorted(made.collect(), key=lambda r: r.part_no)
    whole = "".join(r.part_text for r in parts)
    assert whole.startswith("text 1\n[PART:2]\ntext 2text 2\n[PART:3]") and all(whole[r.char_start :].startswith(r.part_text) for r in parts)
    plan = made._jdf.queryExecution().optimizedPlan()
    below = [node for node in iterate(plan) if node.nodeName() == "Window"]
    assert below and all("text" not in node.output().mkString(" ") for node in below)


def iterate(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from iterate(children.apply(i))


def test_listing_reads_no_content(spark):
    folder = scratch_dir(spark, "files")
    spark.range(3).selectExpr("CAST(id AS string)").coalesce(1).write.text(folder)
    listed = readers.read_source_files(spark, folder)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert rows(listed, "route", "error") == [("rejected", "unsupported file type")]


def test_words_meet_anchors_by_equality(spark):
    # all words of a project were compared with all anchors of its mentions
    words = ["straße", "a", "ab", "xyxyz", "12ab"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", _pieces(F.col("w"), [("part", 2), ("start", 3), ("part", 1)]).alias("p")).collect()
    for r in got:
        want = {("whole", r.w)} | {("part", r.w[i : i + n]) for n in (1, 2) for i in range(len(r.w) - n + 1)} | ({("start", r.w[:3])} if len(r.w) > 2 else set())
        assert len(r.p) == len(want) and {tuple(x) for x in r.p} == want
    store = SpanStore(spark, scratch_dir(spark, "marks"), parts=2, slots=2)
    units = spark.createDataFrame([("p", 1, 0, "Иванова ab-straße"), ("p", 2, 0, "xyxyz"), ("q", 3, 0, "ab")], UNITS)
    entry = spark.createDataFrame([("p", "e", 0, "other", None, "other", "yx", None, None, "[x]", None), person("n", "Иванов", ["Иванов"])], ENTRY)
    store.add(0, units, M.match_dictionary(units, R.explode_registry(entry.filter("false"))))
    assert rows(store.touched(R.explode_registry(entry)), "doc_id") == [(1,), (2,)]
    store.rematch(1, entry)
    assert rows(store.marks(), "doc_id", "hit") == sorted([(1, "Иванова"), (2, "yx")], key=repr)
