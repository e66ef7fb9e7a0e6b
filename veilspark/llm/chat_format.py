"""Chat formatting with a grammar round trip, in SQL expressions only.

    conversation = turn*
    turn         = "<s>" "[INST]" role "[/INST]" body "</s>"

The four control strings never stand inside a role or body. A text that would
hold one, or something that reads like an escaped one, is escaped by a
backslash behind its first character ("<\\s>"), one more than it had, and the
parser takes one away. The parser is deterministic: it cuts the rendered text
before every control string and accepts exactly the sequence of the grammar.

A conversation is rendered as it is, parsed again, and compared with its
source; where they differ the conflicting turns are escaped, then all, until
they are identical. The loss mask is a run per turn: its characters, those to
skip, and those to learn (an assistant's body), in code points.

Defined results: null texts and roles are empty; turns are ordered by turn,
role and text, nulls first; repeated rows are turns of their own; rows with a
null conversation id form one conversation; other input columns are never
read; no rows, no conversations. A conversation is one row, so its turns share
a task whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import pick

BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
LEARN = "assistant"

_MARK = r"(?=</?s>|\[/?INST\])"
_ESCAPE_AT = r"(?<=<)(?=\\*/?s>)|(?<=\[)(?=\\*/?INST\])"
_ESCAPED_AT = r"(?<=<)\\(?=\\*/?s>)|(?<=\[)\\(?=\\*/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE_AT), F.lit("\\\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPED_AT), F.lit(""))


def _turn(role: Column, body: Column) -> Column:
    return F.concat(F.lit(BEGIN + HEAD), role, F.lit(BODY), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>, or null if the text is not of the grammar."""
    tokens = F.filter(F.split(formatted, _MARK), lambda t: t != "")
    order = (BEGIN, HEAD, BODY, END)

    def fits(token: Column, i: Column) -> Column:
        kinds = [(i % 4 == k) & (token.startswith(mark) if mark in (HEAD, BODY) else token == mark) for k, mark in enumerate(order)]
        return kinds[0] | kinds[1] | kinds[2] | kinds[3]

    well = (F.size(tokens) % 4 == 0) & F.forall(F.transform(tokens, fits), lambda ok: ok)
    # keep the tokens that carry text, then pair them
    heads = F.filter(tokens, lambda t, i: i % 4 == 1)
    bodies = F.filter(tokens, lambda t, i: i % 4 == 2)
    pairs = F.zip_with(
        heads, bodies, lambda h, b: F.struct(unescape(F.substr(h, F.lit(len(HEAD) + 1))).alias("role"), unescape(F.substr(b, F.lit(len(BODY) + 1))).alias("text"))
    )
    return F.when(well, pairs)


def _rendered(turns: Column, which) -> Column:
    """The conversation with the turns that ``which`` selects escaped."""
    return F.transform(turns, lambda t: F.struct(
        F.when(which(t), escape(t["role"])).otherwise(t["role"]).alias("role"),
        F.when(which(t), escape(t["text"])).otherwise(t["text"]).alias("body"),
        (t["role"] == LEARN).alias("learn"),
    ))


def _text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: _turn(p["role"], p["body"])), "")


def _conflicts(turn: Column) -> Column:
    return ~parse(_turn(turn["role"], turn["text"])).eqNullSafe(F.array(turn))


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, mask."""
    rows = pick(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = rows.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    turns = F.col("turns")
    plain, some, every = (_rendered(turns, w) for w in (lambda t: F.lit(False), _conflicts, lambda t: F.lit(True)))
    same = lambda parts: parse(_text(parts)).eqNullSafe(turns)
    fault = F.raise_error(F.lit("a conversation does not survive its round trip"))
    parts = F.when(same(plain), plain).when(same(some), some).when(same(every), every).otherwise(fault)
    convs = convs.select("conv_id", parts.alias("parts"))
    mask = F.transform("parts", lambda p: F.struct(
        F.length(_turn(p["role"], p["body"])).cast("long").alias("chars"),
        (F.length(p["role"]) + len(BEGIN + HEAD + BODY)).cast("long").alias("skip"),
        F.when(p["learn"], F.length(p["body"])).otherwise(0).cast("long").alias("take"),
    ))
    return convs.select("conv_id", _text(F.col("parts")).alias("formatted"), mask.alias("mask"))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the mask, unescaped, one for each turn with a loss."""
    # a turn's text ends where its only END stands
    pieces = F.filter(F.split(formatted, f"(?<={END})"), lambda p: p != "")
    taken = F.zip_with(pieces, mask, lambda p, m: F.when(m["take"] > 0, F.substr(p, (m["skip"] + 1).cast("int"), m["take"].cast("int"))))
    return F.transform(F.filter(taken, lambda t: t.isNotNull()), unescape)
