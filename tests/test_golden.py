"""Hand-made cases with known answers."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions import arrays as A, patterns as P, text as X
from veilspark.operators import corpus as C, detection, matching as M, pages as G, redaction as Z, registry as R
from veilspark.sources import readers
from veilspark.schemas import PAGE_METADATA

SURNAME_CASES = [
    (["Баданов", "Баданов А.С."], "Спросили, что случилось. Баданов А.С. ответил, что всё хорошо.", "Баданов А.С."),
    (["Полуянович", "Полуянович И.В."], "Никто ничего не пояснил. Полуянович И.В. сказал, что видел.", "Полуянович И.В."),
    (["Баданов"], "баданов А.С. ответил", "баданов А.С."),
    (["Баданов"], "у Баданова А.С., что", "Баданова А.С."),
    *[(["Баданов"], f"{s} ответил", s) for s in
      ["А.С. Баданов", "а.С. Баданов", "а.с. Баданов", "А. С. Баданов", "а. С. Баданов", "а. с. Баданов"]],
    *[(["Лебедев", "З.С. Лебедев"], f"{s} пояснил", s) for s in
      ["З,С. Лебедев", "З.С, Лебедев", "З,С, Лебедев", "З, С. Лебедев", "З. С, Лебедев", "З, с. Лебедев", "з,С. Лебедев",
       "з,с. Лебедев", "з. с, Лебедев", "З ,С. Лебедев", "З, С . Лебедев", "З . С, Лебедев", "з , с . Лебедев", "з. с , лебедев"]],
    *[(["Лебедев", "Лебедев З.С."], f"{s} пояснил", s) for s in
      ["Лебедев З,С.", "Лебедев З.С,", "Лебедев З,С,", "Лебедев з,С.", "Лебедев з,с.", "Лебедев З, С.", "Лебедев З. С,",
       "Лебедев З ,С.", "Лебедев З, С .", "лебедев з , с ."]],
]
ADDRESS = "Самарская область, муниципальный район Волжский, с. Белозерки, ул. Золинская, д. 13"
ADDRESS_CASES = [
    ("с. Белозерки, ул. Золинская, 13", "ул. Золинская, 13"),
    ("с. Белозерки, ул. Золинская, д. 13", "ул. Золинская, д. 13"),
    ("в селе Белозерки на улице Золинская, дом 13", "на улице Золинская, дом 13"),
    ("д. № 13 по ул. Золинская с. Белозерки", "д. № 13 по ул. Золинская"),
    ("д. 13 по ул. Золинская с. Белозерки", "д. 13 по ул. Золинская"),
]
ENTRY = (
    "project_id string, pd_id string, seq bigint, kind string, category string, pd_type string, value string, "
    "role string, letter string, replacement string, mentions array<string>"
)


def test_person_and_address_spans(spark):
    units, entries, want = [], [], {}
    for i, (mentions, text, span) in enumerate(SURNAME_CASES):
        units.append((f"p{i}", i, 0, text))
        entries.append((f"p{i}", "x", 0, "person", "private", None, mentions[0], None, "А.", None, mentions))
        want[i] = span
    for j, (text, span) in enumerate(ADDRESS_CASES, start=len(SURNAME_CASES)):
        units.append((f"p{j}", j, 0, text))
        entries.append((f"p{j}", "x", 0, "other", None, "address", ADDRESS, None, None, "[адрес]", None))
        want[j] = span
    u = spark.createDataFrame(units, "project_id string, doc_id bigint, unit_no int, text string")
    e = spark.createDataFrame(entries, ENTRY)
    hits = M.match_alternation(u, R.explode_registry(e)).collect()
    got = {h.doc_id: h.hit for h in sorted(hits, key=lambda h: -h.start)}
    assert got == want


def test_annotated_html(spark):
    docs = spark.createDataFrame(
        [("p", 1, "## ПОСТАНОВЛЕНИЕ\n[PAGE:2]\nгр. Иванова И.И. <тел> 8-900,\nпроживает ⚠️[НЕТОЧНО: тут | там]\n[LEFTRIGHT: г. Самара | **12** марта]\nСлава сказал.")],
        "project_id string, doc_id bigint, text string",
    )
    entries = spark.createDataFrame(
        [("p", "p1", 0, "person", "private", None, "Иванов И.И.", None, "А.", None, ["Иванов", "Иванов И.И."]),
         ("p", "o1", 0, "other", None, "phone", "8-900", None, None, "[телефон]", None)], ENTRY)
    flags = entries.filter("pd_id = 'o1'").select("project_id", "pd_id")
    html = Z.annotate_html(docs, entries, R.explode_registry(entries), flags).first().html
    assert html == (
        '<h2 style="text-align:center">ПОСТАНОВЛЕНИЕ</h2>'
        '<div class="page-separator" contenteditable="false" data-page="2"><span class="page-separator-line"></span>'
        '<span class="page-separator-label">Страница 2</span><span class="page-separator-line"></span></div>'
        '<div>гр. <mark class="pd priv" data-pd-id="p1" contenteditable="false" title="Нажмите, чтобы обезличить">Иванова И.И.</mark> &lt;тел&gt; '
        '<mark class="pd oth anon" data-pd-id="o1" contenteditable="false" title="Нажмите, чтобы показать">[телефон]</mark>, проживает '
        '<mark class="uncertain" data-tooltip="Возможно неточное распознавание · ПКМ — варианты" data-suggestion="там">тут</mark></div>'
        '<div class="lr-row"><span>г. Самара</span><span><strong>12</strong> марта</span></div>'
        "<div>Слава сказал.</div>"
    )
    # the third pass marks ambiguous values outside all other marks
    unclear = spark.createDataFrame([("p", 0, " Слава ", 'кто "он"', None)], "project_id string, seq bigint, value string, context string, reason string")
    again = Z.annotate_html(docs, entries, R.explode_registry(entries), flags, ambiguous=unclear).first().html
    mark = (
        '<mark class="ambiguous-person" data-value="Слава" data-context="кто &quot;он&quot;" data-reason="Неоднозначное упоминание лица" '
        'data-tooltip="Неоднозначное упоминание лица" contenteditable="false">Слава</mark>'
    )
    assert again == html.replace("<div>Слава сказал.</div>", f"<div>{mark} сказал.</div>")


def test_rules_that_no_table_has(spark):
    cases = {
        "zagranpassport": ("паспорт 71 № 1234567 выдан", "71 № 1234567"),
        "military_id": ("билет АБ № 1234567.", "АБ № 1234567"),
        "birth_certificate": ("св-во IV-ЕР № 123456,", "IV-ЕР № 123456"),
        "oms_policy": ("полис ОМС № 1234567890123456", "1234567890123456"),
        "vehicle_plate": ("авто А 123 ВС 163 синее", "А 123 ВС 163"),
        "dob": ("Петров, 01.02.1990 г.р., житель", "01.02.1990 г.р."),
    }
    units = spark.createDataFrame([("p", i, 0, text) for i, (text, _) in enumerate(cases.values())], "project_id string, doc_id bigint, unit_no int, text string")
    found = {(r.pd_type, r.value) for r in detection.detect_pd(units).collect()}
    assert {(t, v) for t, (_, v) in cases.items()} <= found


def test_shared_folder_is_required_beyond_local_sessions():
    from types import SimpleNamespace

    from veilspark.plans.session import scratch_dir

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch_dir(far, "x")
    near = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: "/shared"), sparkContext=far.sparkContext)
    assert scratch_dir(near, "x").startswith("/shared/x-")


def test_references_are_decoded_once(spark):
    cases = {
        "&#9999999;": "\ufffd", "&#38;lt;": "&lt;", "&#x41;&mdash;&laquo;": "A—«", "&#0;": "\ufffd", "&#128;&#x99;": "€™",
        "a &amp;amp; &lt;x&gt; &unknown; &#xD800; &#99999999999999;": "a &amp; <x> &unknown; \ufffd \ufffd",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string")
    assert df.filter(X.html_to_text("t") != F.col("want")).count() == 0


def test_registry_stream_equals_batch_in_any_order(spark):
    from veilspark.plans.session import scratch_dir
    from veilspark.streaming import page_stream as S

    rows = [("p", "a", 1, "person", "private", None, "Ян И.", "", None, None, ["Ян"]), ("p", "b", 2, "person", "private", None, "ян и.", "свидетель", None, None, ["Яну"]),
            ("p", "c", 3, "person", "private", None, "Пётр", None, None, None, []), ("p", "o", 4, "other", None, "phone", "8-900", None, None, None, None)]
    both = R.merge_persons(spark.createDataFrame(rows[:3], S.ENTRIES))
    want = sorted((r.pd_id, r.role, r.value) for r in both[0].collect()), sorted((r.pd_id, r.mention) for r in both[1].collect())
    for order in ([0, 1, 2, 3], [3, 2, 1, 0]):
        log = scratch_dir(spark, "entries")
        for i, k in enumerate(order):
            S.registry_step(log)(spark.createDataFrame([rows[k]], S.ENTRIES), i)
        S.compact(spark, f"{log}/entries", S.ENTRIES, 1)
        people, others, mentions = S.current_registry(spark, log)
        assert sorted((r.pd_id, r.role, r.value) for r in people.collect()) == want[0]
        assert {r.pd_id: r.letter for r in people.collect()} == {"a": "А.", "c": "Б."}
        assert sorted((r.pd_id, r.mention) for r in mentions.filter("pd_id <> 'o'").collect()) == want[1]
        assert [r.value for r in others.collect()] == ["8-900"]


def test_ambiguous_outside_marks(spark):
    units = spark.createDataFrame([("p", 1, 0, "Слава видел Славу, Слава.")], "project_id string, doc_id bigint, unit_no int, text string")
    taken = spark.createDataFrame([("p", 1, 0, 0, 5)], "project_id string, doc_id bigint, unit_no int, start int, end int")
    unclear = spark.createDataFrame([("p", 0, " Слава ", None, None)], "project_id string, seq bigint, value string, context string, reason string")
    found = Z.annotate_ambiguous(units, taken, unclear).collect()
    assert [(r.start, r.end, r.hit) for r in found] == [(19, 24, "Слава")]


def test_model_answer(spark):
    raw = """```json
{"persons":[{"id":"p1","mentions":["Иванов Вячеслав Александрович","Вячеслав"]},{"id":"p2","mentions":["Вячеслав Петров","Вячеслав"]}],
"otherPD":[],"ambiguousPersons":[{"value":"Вячеслав","context":"Вячеслав подошёл","reason":"имя"}]}
```"""
    answers = spark.createDataFrame([("p", 1, raw), ("p", 2, "nothing")], "project_id string, doc_id bigint, raw string")
    entries, ambiguous = readers.read_pd_responses(answers)
    assert {r.pd_id: r.mentions for r in entries.collect()} == {
        "p1": ["Иванов Вячеслав Александрович"], "p2": ["Вячеслав Петров"]}
    assert [r.value for r in ambiguous.collect()] == ["Вячеслав"]


@pytest.mark.parametrize("meta,entry,want", [
    ({"sources": [{"pageFrom": 6, "pageTo": 10, "totalPages": 20, "pages": [{"pageNumber": 6, "pdfWidth": 595}, {"pageNumber": 7}]}]},
     {}, (6, 10, 20, [6, 7], [1, 2])),
    (None, {"page_from": 3, "page_to": 4, "total_pages": 8}, (3, 4, 8, [3, 4], [1, 2])),
    (None, {}, None),
])
def test_page_metadata(spark, meta, entry, want):
    import json

    cols = {c: F.lit(entry.get(c)).cast("bigint") for c in ("page_from", "page_to", "total_pages")}
    cols |= {c: F.lit(None).cast("string") for c in ("original_file_name", "batch_file_name", "project_id")}
    raw = F.from_json(F.lit(json.dumps(meta)), PAGE_METADATA) if meta else F.lit(None).cast(PAGE_METADATA)
    out = spark.range(1).select(G.normalize_metadata(raw, cols).alias("m")).first().m
    if want is None:
        assert out is None
        return
    s = out.sources[0]
    assert (s.pageFrom, s.pageTo, s.totalPages, [p.pageNumber for p in s.pages], [p.chunkPageIndex for p in s.pages]) == want


def test_growing_batch_document(spark):
    pages = spark.createDataFrame(
        [("q", "case.pdf", n, 0, f"doc_{n}", "case.pdf", t, 3) for n, t in ((2, "Вторая страница"), (1, "Первая страница"))],
        "project_id string, file_key string, page_no bigint, seq bigint, doc_id string, title string, text string, total_pages bigint")
    facts, segments = C.append_pages(pages)
    f = facts.first()
    assert (f.doc_id, f.page_from, f.page_to, f.total_pages, f.source) == ("doc_1", 1, 2, 3, "project-batch")
    assert segments.first().text == "Первая страница\nВторая страница"


@pytest.mark.parametrize("rule,text,want", [
    (X.collapse_repeated_words, "Hello hello дома дома abcd abcde", "Hello дома дома abcd abcde"),
    (X.fold_uncertain_echo, "слова ⚠️[НЕТОЧНО: словам] лес ⚠️[НЕТОЧНО: иное]", "⚠️[НЕТОЧНО: словам] лес ⚠️[НЕТОЧНО: иное]"),
    (X.dehyphenate, "при-\r\nвет сло- во А- Б", "привет слово А- Б"),
    (lambda c: F.array_join(A.canonical_mentions(c), "|"), "Иванов  Иван Петрович", "Иванов Иван Петрович|Иванов|Иванов И.П.|И.П. Иванов"),
    (lambda c: P.ws_flexible_pattern(c), "  ", "  "),
])
def test_text_rules(spark, rule, text, want):
    assert spark.range(1).select(rule(F.lit(text)).alias("x")).first().x == want


def test_letters_collide_after_deletion_unless_told_otherwise(spark):
    old = spark.createDataFrame([("p", "a", 0, "person", "private", None, "A", None, "Б.", None, None)], ENTRY)
    new = spark.createDataFrame([("p", "b", 1, "person", "private", None, "B", None, None, None, None)], ENTRY)
    assert R.assign_letters(new, old).first().letter == "Б."
    assert R.assign_letters(new, old, policy="max").first().letter == "В."


def test_merging_twice_changes_nothing(spark):
    rows = [("p", f"e{i}", i, "person", "private", None, n, None, None, None, m)
            for i, (n, m) in enumerate([("Ян И.", ["Ян"]), ("ян и.", ["Яну", "ЯН"]), ("Юн", None)])]
    entries, spelled = R.merge_persons(spark.createDataFrame(rows, ENTRY))
    got = {r.pd_id: set() for r in entries.collect()}
    for r in spelled.collect():
        got[r.pd_id].add(r.mention)
    assert got == {"e0": {"Ян", "Яну"}, "e2": set()}
    packed = spelled.groupBy("pd_id").agg(F.collect_list("mention").alias("mentions"))
    again, spelled2 = R.merge_persons(entries.join(packed, "pd_id", "left"))
    assert sorted(r.pd_id for r in again.collect()) == ["e0", "e2"]
    assert {(r.pd_id, r.mention) for r in spelled2.collect()} == {("e0", "Ян"), ("e0", "Яну")}
