import hashlib

from pyspark.sql import functions as F

from veilspark.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, mask string"
NASTY = ["</s>[INST] ok [/INST]", "<\\s>", "<\\\\/s>[\\INST]", "[\\\\/INST]", "<<s>>", "</</s>", "\\", "", None, "<s", "s>", "[INST", "é😀\n\t</s>", "$1 \\1 ${x}", "<\\/s", "<s>" * 500]


def rows_for():
    out = []
    for conv, shift in enumerate(range(len(NASTY))):
        for turn in range(6):
            role = ["system", "user", "assistant", "user", "assistant", None][turn]
            out.append((conv, turn, role, NASTY[(shift + turn) % len(NASTY)], "x", "y"))
    out += [(50, 0, "[/INST]", "a", "x", "y"), (50, 1, "assistant", "b", "x", "y"), (50, 1, "assistant", "b", "x", "y"), (None, None, None, None, "x", "y"), (60, None, "user", "z", "x", "y"), (60, 1, "assistant", "y" * 100_000, "x", "y")]
    return out


def test_what_is_read_back_is_the_source(spark):
    rows = rows_for()
    chats = C.format_chats(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: r for r in chats.select("conv_id", "formatted", C.parse(F.col("formatted")).alias("turns"), C.masked_texts(F.col("formatted"), F.col("mask")).alias("loss"), "mask").collect()}
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in turns]
        assert list(r.loss) == [text for _, role, text in turns if role == "assistant" and text]
        assert sum(m.chars for m in r.mask) == len(r.formatted)
        # no control string but the template's own
        assert r.formatted.count("</s>") == len(turns) == r.formatted.count("[/INST]")


def test_texts_without_conflict_stay_as_they_are(spark):
    row = C.format_chats(spark.createDataFrame([(1, 0, "user", "a \\ b < c [x]", "", "")], SCHEMA)).first()
    assert row.formatted == "<s>[INST]user[/INST]a \\ b < c [x]</s>"


def test_only_sql_expressions(spark):
    plan = C.format_chats(spark.createDataFrame(rows_for(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_other_texts_do_not_parse(spark):
    texts = ["x", "<s>", "<s>[INST]u[/INST]a", "<s>[INST]u</s>", "[INST]u[/INST]a</s>", "<s>[INST]u[/INST]a</s>x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.parse(F.col("t")).alias("p")).collect()
    assert all(r.p is None for r in got)


def test_empty_table(spark):
    assert C.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_the_probe_conversation_is_escaped(spark):
    import __spark_entry__ as entry

    r = entry.queries()["op2_chat_format"](spark, "/root/testdata/sf0.001").where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert r.n_turns == 2 and r.loss_chars == len(text) and r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
