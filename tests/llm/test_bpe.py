import base64
import random

import pytest
import public_tokenizers as P
import tiktoken

from veilspark.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ALPHABETS = ["abcdefghij", "äöüßéèçñ", "日本語中文字", "😀👍🏽", "\x1c\x1d\x1e\x1f\x85᠎   \t\n\r", " '", "0123456789", "!?.,;:-_=+", "́‍", "Привет"]


def test_encodes_as_the_library(words, library):
    rng = random.Random(3)
    machine = bpe.Transducer(words)
    for _ in range(1500):
        text = "".join(rng.choice(rng.choice(ALPHABETS)) for _ in range(rng.randrange(60)))
        assert machine.encode(text).tolist() == library.encode_ordinary(text)


def test_long_pieces_are_emitted_along_the_way(words, library):
    rng = random.Random(4)
    machine = bpe.Transducer(words)
    for text in ["a" * 5000, "abab" * 2000, " " * 3000, "\n" * 999, "日本" * 900, "=-" * 3000, "".join(rng.choice("etaoinshr") for _ in range(20_000))]:
        assert machine.encode(text).tolist() == library.encode_ordinary(text)


def test_small_tables_change_nothing(words, library, monkeypatch):
    for bound in ("MAX_STATES", "MAX_PAIRS", "MAX_PIECES", "MAX_HEADS"):
        monkeypatch.setattr(bpe, bound, 3)
    machine = bpe.Transducer(words)
    text = "the quick brown fox jumps over the lazy dog, naïve façade " * 5
    assert machine.encode(text).tolist() == library.encode_ordinary(text)


def test_streaming_decode_equals_whole_decode():
    rng = random.Random(5)
    whole = "".join(rng.choice("".join(ALPHABETS)) for _ in range(400)).encode()
    broken = bytes(rng.randrange(256) for _ in range(2000))
    for data in (whole, broken, b"\xf0\x9f", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b""):
        for size in (1, 2, 3, 5, 1000):
            machine = bpe.Utf8Machine()
            parts = [machine.feed(data[i : i + size]) for i in range(0, len(data), size)]
            assert "".join(parts) + machine.finish() == data.decode("utf-8", "replace")


def test_round_trip_in_spark(docs, words, library):
    rows = [(1, "Hello wörld", "s"), (2, None, "s"), (3, "", "s"), (None, "x" * 100_000, None), (1, "Hello wörld", "s"), (4, " \n\t ", "s")]
    got = bpe.decode(bpe.encode(docs(*rows), words), words).collect()
    assert sorted((r.doc_id or 0, r.text, list(r.ids)) for r in got) == sorted((i or 0, t or "", library.encode_ordinary(t or "")) for i, t, _ in rows)


def test_one_pass_there_and_back(docs, words, library):
    rows = [(1, "Hello wörld", "s"), (2, None, "s"), (None, "日本" * 5000, None), (3, "a\u0000b", "s")]
    got = bpe.round_trip(docs(*rows), words).collect()
    assert sorted((r.doc_id or 0, r.text, list(r.ids)) for r in got) == sorted((i or 0, t or "", library.encode_ordinary(t or "")) for i, t, _ in rows)


def small(*merged):
    tokens = [bytes([i]) for i in range(256)] + list(merged)
    split = [(-1, -1)] * 256 + [(m[0], m[1]) for m in merged]
    return bpe.Vocabulary(tuple(tokens), tuple(a for a, _ in split), tuple(b for _, b in split), P.PATTERN)


def test_a_worker_never_encodes_with_another_vocabulary():
    for n in range(40):
        pair = bytes((97 + n % 2, 98))
        words = small(pair)
        assert bpe._transducer(words).encode("abbb").tolist() == ([256, 98, 98] if n % 2 == 0 else [97, 256, 98])
        del words
    bpe._drop_machine()
    assert not bpe._MACHINE


def test_long_pieces_are_not_remembered(words):
    machine = bpe.Transducer(words)
    machine.encode("日本" * 200)
    assert all(len(p) <= bpe.LONG_PIECE for p in machine.pieces)


def test_empty_table(docs, words):
    assert bpe.decode(bpe.encode(docs(), words), words).count() == 0


def test_other_vocabularies_are_refused(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(bytes([i])) + b" %d\n" % i for i in range(255)))
    with pytest.raises(ValueError):
        bpe.Vocabulary.load(str(path), P.PATTERN)
