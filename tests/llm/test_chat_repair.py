"""Repairs against a search over all edits, row after row."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from veilspark.llm import chat_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, rank string, place string, cells int, said int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "r", "p", 1, 2) for r in rows], SCHEMA)


def cheapest(kinds):
    """Least (cost, audit) by shortest paths; kinds are (initial, fault)."""

    def inserted(states):
        for _ in range(3):
            for (state, role), to in list(R._STEP.items()):
                if role in "ua" and state in states:
                    cost, audit = states[state]
                    states[to] = min(states.get(to, (9**9, "")), (cost + 3, audit + "I"))
        return states

    states = inserted({0: (0, "")})
    for initial, fault in kinds:
        then = {}
        for state, (cost, audit) in states.items():
            moves = [(state, 4, "D")]
            if fault in "t-":
                more = 3 * (fault == "t")
                moves += [(to, more, "K") for (s, role), to in R._STEP.items() if s == state and role == initial]
                moves += [(to, more + 3, "R") for (s, role), to in R._STEP.items() if s == state and role in "ua"]
            for to, extra, edit in moves:
                then[to] = min(then.get(to, (9**9, "")), (cost + extra, audit + edit))
        states = inserted(then)
    return min(states[s] for s in (0, 3) if s in states)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def brute(given_rows):
    out, hurt = [], damage(given_rows)
    for conv in {r[0] for r in given_rows}:
        rows = sorted((r for r in hurt if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, kinds = set(), []
        for _, _, role, text in rows:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "-" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        cost, audit = cheapest(kinds)
        turns = [r[1] for r in rows if r[1] is not None]
        lines, at = [], 0
        for edit in audit:
            if edit != "D":
                turn = "assistant" if lines and lines[-1].startswith("user:") else "user"
                lines.append((rows[at][2] if edit == "K" else turn) + ":" + ("" if edit == "I" else rows[at][3]))
            at += edit != "I"
        faults = [f for _, f in kinds]
        out.append(
            (
                conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
                sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])),
                cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def answers(spark, rows):
    return sorted((tuple(r) for r in R.repaired_conversations(table(spark, rows)).collect()), key=repr)


KINDS = st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from("bdt-")), min_size=1, max_size=14)


@settings(max_examples=300, deadline=None)
@given(KINDS, st.integers(1, 13))
def test_cells_hold_the_cheapest_edits_however_spans_are_split(kinds, cut):
    whole = R.span_cell("".join(a + b for a, b in kinds))
    assert R.cheapest(whole) == cheapest(kinds)
    parts = [kinds[:cut], kinds[cut:]] if cut < len(kinds) else [kinds]
    assert R.combine([R.span_cell("".join(a + b for a, b in p)) for p in parts]) == whole


def talk(conv, n):
    roles = ("system", "user", "assistant", "user", "assistant", "tool", "", None)
    texts = ("Yes.", "no", "  ", None, "Why?", "a. b", "ü!" * 200, "x" * 300 + "1.", "x" * 300 + "2.")
    return [(conv, None if (conv + t) % 13 == 0 else t // 2 * 2 + t % 2, roles[(t * 7 + conv) % 8 if t % 3 else t % 2 + 1], texts[(t * 5 + conv * 3) % 9]) for t in range(n)]


@pytest.mark.parametrize("bucket, fan", [(9, 64), (2, 2)])
def test_equals_brute_force(spark, monkeypatch, bucket, fan):
    monkeypatch.setattr(R, "BUCKET", bucket)
    monkeypatch.setattr(R, "FAN", fan)
    rows = [r for c in range(40) for r in talk(c, c % 12 + 1)] + talk(100, 150)
    rows += [(None, t, "user", f"{t}.") for t in range(5)] + [(None, None, "user", "0.")] * 3 + rows[:20]
    assert answers(spark, rows) == brute(rows)


def test_no_rows_and_rows_all_dropped(spark):
    assert answers(spark, []) == []
    gone = next((c, 0) for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert answers(spark, [(*gone, "user", "Hi.")]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows_are_well_formed_and_keep_their_texts(spark):
    rows = [r for c in range(30) for r in talk(c, 9)]
    _, repaired = R.repair(R.filled(table(spark, rows)))
    for conv in range(30):
        own = repaired.where(f"conv_id = {conv}").orderBy("seq").collect() if conv < 3 else []
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[:1] for r in own))
        assert {r.text for r in own if r.edit in "KR"} <= {r[3] for r in rows}
        assert all(r.text == "" for r in own if r.edit == "I")
