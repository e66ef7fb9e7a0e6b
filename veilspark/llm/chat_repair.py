"""Repair of conversation structure by weighted interval parsing.

A well-formed conversation is ``(s?(ua)+)?`` over the initials of its roles.
The repair grammar is that language in Chomsky normal form: nonterminal
``(p, q)`` derives what leads its automaton from state p to state q, with
``(p, q) -> (p, r) (r, q)``, and terminals for the edits of a row: keep (0),
rerole to user or assistant (3), delete (4), each kept row that is truncated 3
more. Blank rows and duplicates can only be deleted. Empty user and assistant
turns (3 each) may be inserted anywhere: cells are closed under insertion on
both sides.

A cell holds, for a span of rows, the least (cost, audit) of every
nonterminal; the audit is the edits' initials in order. Two audits of one cell
with equal costs are never prefixes of each other (the longer one would pay
for its insertions), so the least of a span is made of leasts of its parts.
Nonterminals name the states on both sides, so all ways to split a span give
the same cell, and spans are combined bottom up by length: 1, 2, 4 and so on
inside a bucket of consecutive rows, then bucket by bucket, ``FAN`` spans at a
time, so that a conversation of any length is parsed by many tasks.

Defined results: null roles and texts are one space; rows are ordered by turn
(nulls first), then by role and text (their first 64 and 256 characters, then
a digest of both); rows that are alike follow one another, and all but the
first are duplicates; a null conversation id is one conversation, null turns
count for no gap; other columns are never read; no rows, no conversations. A
conversation's audit is one string, so it must fit a row.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import distribute, pick, settle
from .runs import edges, ranked, whole_runs

#: Rows of one bucket are 2^BUCKET consecutive ones.
BUCKET = 9
#: Spans of a conversation combined by one task at a time.
FAN = 64

_START, _S, _U, _A = range(4)
_STEP = {(_START, "s"): _S, (_START, "u"): _U, (_S, "u"): _U, (_U, "a"): _A, (_A, "u"): _U}
_ENDS = (_START, _A)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_LEGAL = ("su", "ua", "au")
_WHITE = " \t\n\x0b\f\r"

Cell = dict[tuple[int, int], tuple[int, str]]


def _product(left: Cell, right: Cell) -> Cell:
    out: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2:
                best = out.get((p, q))
                if best is None or (cost + more, audit + rest) < best:
                    out[p, q] = cost + more, audit + rest
    return out


def _closure() -> Cell:
    """Insertions alone."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    one = cell | {(p, q): (INSERT, "I") for (p, role), q in _STEP.items() if role in "ua"}
    for _ in range(3):
        cell = _product(cell, one)
    return cell


_INSERTED = _closure()


@lru_cache(maxsize=None)
def row_cell(initial: str, fault: str) -> Cell:
    """A span of one row: initial s, u, a or x (another); fault b (blank), d
    (duplicate), t (truncated) or -."""
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in "t-":
        extra = TRUNCATED if fault == "t" else 0
        for (p, role), q in _STEP.items():
            if role == initial:
                cell[p, q] = extra, "K"
            elif role in "ua":
                cell[p, q] = extra + REROLE, "R"
    return _product(_product(_INSERTED, cell), _INSERTED)


def combine(cells: list[Cell]) -> Cell:
    """Neighbouring spans, twice as long each time."""
    while len(cells) > 1:
        cells = [_product(cells[i], cells[i + 1]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


@lru_cache(maxsize=20_000)
def _short_span(kinds: str) -> Cell:
    return combine([row_cell(kinds[i], kinds[i + 1]) for i in range(0, len(kinds), 2)])


def span_cell(kinds: str) -> Cell:
    """The cell of rows given as two characters each, initial and fault."""
    return _short_span(kinds) if len(kinds) <= 24 else _short_span.__wrapped__(kinds)


def cheapest(cell: Cell) -> tuple[int, str]:
    return min(cell[_START, q] for q in _ENDS if (_START, q) in cell)


def in_order(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with their place and own faults."""
    trimmed = F.rtrim("text", F.lit(_WHITE))
    initial, last = F.substring("role", 1, 1), F.substring(trimmed, -1, 1)
    rows = rows.withColumns(
        {
            "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
            "fault": F.when(trimmed == "", "b").when(last.isin(".", "!", "?"), "-").otherwise("t"),
            "said": F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))),
            "role_head": F.substring("role", 1, 64),
            "text_head": F.substring("text", 1, 256),
            "twin": F.monotonically_increasing_id(),
        }
    )
    return ranked(rows, "conv_id", "turn", "role_head", "text_head", "said", "twin").drop("role_head", "text_head", "twin")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """conv_id, rank, initial, fault of rows in order; the fault of a row that
    is not blank and was said before is d."""
    firsts = rows.groupBy("conv_id", "said").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("said").alias("what"), "first")
    seen = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what")), "left")
    fault = F.when((F.col("fault") != "b") & (F.col("rank") > F.col("first")), "d").otherwise(F.col("fault"))
    return seen.select("conv_id", "rank", "initial", fault.alias("fault"))


_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_SPAN = "place long, start long, first string, last string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cells array<struct<p:int,q:int,cost:long,audit:string>>"
_CELLS = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_NAMES = ["conv_id", "place", "start", "first", "last", *_COUNTS, "cells"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, _CELLS]


def _batch(spans: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*spans), [conv, *_KINDS])], _NAMES)


def _listed(cell: Cell) -> list[dict]:
    return [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in cell.items()]


def _spans(rows: DataFrame) -> DataFrame:
    """A span per conversation and bucket."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches):
        for table in whole_runs(batches, "bucket"):
            conv, bucket, rank = (table.column(c) for c in ("conv_id", "bucket", "rank"))
            initials, faults = "".join(table.column("initial").to_pylist()), "".join(table.column("fault").to_pylist())
            number = np.cumsum([0] + [a != b for a, b in zip(conv.to_pylist(), conv.to_pylist()[1:])])
            at, out = edges(np.asarray(bucket), number).tolist(), []
            for i, j in zip(at[:-1], at[1:]):
                heads, marks = initials[i:j], faults[i:j]
                bad = sum(heads[k : k + 2] not in _LEGAL for k in range(j - i - 1))
                cell = span_cell("".join(map("".join, zip(heads, marks))))
                out.append((conv[i].as_py(), bucket[i].as_py(), rank[i].as_py(), heads[0], heads[-1], marks.count("b"), marks.count("d"), marks.count("t"), bad, _listed(cell)))
            yield _batch(out, conv.type)

    dealt = distribute(rows.withColumn("bucket", F.shiftright("rank", BUCKET)), "bucket").sortWithinPartitions("bucket", "rank")
    return dealt.mapInArrow(run, f"conv_id {kind}, {_SPAN}")


def _union(spans: list[dict]) -> tuple:
    bad = sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(spans, spans[1:]))
    total = [sum(s[c] for s in spans) for c in _COUNTS]
    cell = combine([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in s["cells"]} for s in spans])
    return (spans[0]["conv_id"], spans[0]["place"], spans[0]["start"], spans[0]["first"], spans[-1]["last"], *total[:3], total[3] + bad, _listed(cell))


def parse(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, rank, initial, fault): start (its
    first rank), blank, duplicate, truncated, illegal, cost and audit."""
    spans = settle(_spans(rows))
    kind = dict(spans.dtypes)["conv_id"]
    first = spans.groupBy(F.col("conv_id").alias("of")).agg(F.min("place").alias("from_place"))
    longest = spans.groupBy("conv_id").agg((F.max("place") - F.min("place")).alias("n")).agg(F.max("n")).first()[0] or 0
    if longest:
        near = spans.join(first, F.col("conv_id").eqNullSafe(F.col("of")))
        spans = near.withColumn("place", F.col("place") - F.col("from_place")).drop("of", "from_place")

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out = []
            for span in batch.to_pylist():
                if held and (held[0]["conv_id"] != span["conv_id"] or held[0]["place"] != span["place"]):
                    out.append(_union(held))
                    held = []
                held.append(span)
            if out:
                yield _batch(out, batch.column("conv_id").type)
        if held:
            yield _batch([_union(held)], batch.column("conv_id").type)

    while longest:
        longest //= FAN
        near = distribute(spans.withColumn("place", F.floor(F.col("place") / FAN)), "conv_id", "place")
        near = near.sortWithinPartitions("conv_id", "place", "start").select(_NAMES)
        spans = settle(near.mapInArrow(run, f"conv_id {kind}, {_SPAN}"))
    # from the start to an accepting state, least first
    done = F.filter("cells", lambda c: (c["p"] == _START) & c["q"].isin(*_ENDS))
    best = F.array_min(F.transform(done, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    return spans.select("conv_id", "start", *_COUNTS, best.alias("best")).select("conv_id", "start", *_COUNTS, "best.*")


def edits(parsed: DataFrame) -> DataFrame:
    """conv_id, seq, rank, edit, role of every row of the repaired
    conversations: rank is null for an inserted row, role for a kept one.
    Whether the first is a system's is told by the parity of their number."""
    kind = dict(parsed.dtypes)["conv_id"]
    names = ["conv_id", "seq", "rank", "edit", "role"]

    def run(batches):
        for batch in batches:
            conv_type, out = batch.column("conv_id").type, []
            for conv, start, audit in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "start", "audit"))):
                rank, seq, lead = start, 0, (len(audit) - audit.count("D")) % 2
                for edit in audit:
                    if edit != "D":
                        turn = "user" if (seq - lead) % 2 == 0 else "assistant"
                        out.append((conv, seq, None if edit == "I" else rank, edit, None if edit == "K" else turn))
                        seq += 1
                    rank += edit != "I"
                    if len(out) >= 8192:
                        yield _edit_batch(out, conv_type, names)
                        out = []
            if out:
                yield _edit_batch(out, conv_type, names)

    return parsed.select("conv_id", "start", "audit").mapInArrow(run, f"conv_id {kind}, seq long, rank long, edit string, role string")


def _edit_batch(rows: list[tuple], conv: pa.DataType, names: list[str]) -> pa.RecordBatch:
    kinds = [conv, pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def repaired_rows(placed: DataFrame, made: DataFrame) -> DataFrame:
    """conv_id, seq, edit, role, text of the repaired conversations."""
    own = placed.select(F.col("rank").alias("own_rank"), F.col("role").alias("own_role"), "text")
    both = made.join(own, F.col("rank") == F.col("own_rank"), "left")
    return both.select("conv_id", "seq", "edit", F.coalesce("role", "own_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256. One digest over a conversation is made row
    after row, so its rows pass through one task, of which it holds a batch."""
    kind = dict(repaired.dtypes)["conv_id"]

    def run(batches):
        now, sha = None, None
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if sha is None or conv != now:
                    if sha is not None:
                        out.append((now, sha.hexdigest()))
                    now, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], batch.column("conv_id").type), pa.array([d for _, d in out], pa.string())], ["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.column("conv_id").type), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    near = distribute(repaired.select("conv_id", "seq", "role", "text"), "conv_id").sortWithinPartitions("conv_id", "seq")
    return near.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def filled(conversations: DataFrame) -> DataFrame:
    """The columns read, with one space for null roles and texts."""
    source = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    return source.withColumns({c: F.coalesce(c, F.lit(" ")) for c in ("role", "text")})


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that the checksum of ``conv_id:turn`` (null: one
    space) deals them: dropped, emptied, without sentence ends, repeated, or
    by the user."""
    rows = filled(conversations)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.crc32(F.encode(key, "utf-8")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fate == 3, F.array(F.lit(1), F.lit(2))).when(fate == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    rows = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (conv_id, turn, role, text) without null roles and texts: what
    ``parse`` says of each conversation, with its gaps, and the repaired rows
    (conv_id, seq, edit, role, text)."""
    placed = in_order(rows)
    parsed = settle(parse(with_duplicates(placed)))
    turns = placed.groupBy(F.col("conv_id").alias("of")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    )
    known = parsed.join(turns, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    return known, repaired_rows(placed, edits(parsed))


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation id: gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256, of the damaged rows."""
    known, repaired = repair(damaged(conversations))
    known = known.withColumnRenamed("conv_id", "of")
    said = digests(repaired).withColumnRenamed("conv_id", "who")
    ids = pick(conversations, conv_id="conv_id").distinct()
    out = ids.join(known, F.col("conv_id").eqNullSafe(F.col("of")), "left").join(said, F.col("conv_id").eqNullSafe(F.col("who")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS, "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
