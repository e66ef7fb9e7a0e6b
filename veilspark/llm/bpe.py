"""Byte-level BPE encoding and decoding by finite-state machines.

Encoding. Two neighbouring tokens are *compatible* if the merges of their
joined bytes never cross the border between them; a token sequence is the BPE
result exactly if all neighbours are compatible. So the merges compile into a
nondeterministic transducer: at any byte a token may begin, it runs down the
vocabulary's trie, and may end at a node that spells a token compatible with
the one before. It is determinised lazily: a deterministic state is the set of
trie nodes live at a byte, made when first met; for each prefix exactly one
token ends in a compatible way, and that one is noted. Output is emitted once
all live hypotheses agree on it, which is at the latest a few token lengths
behind the input. Transitions, compatible pairs and whole pieces (pattern
matches) are remembered in tables of bounded size.

Decoding. Tokens' bytes are joined chunk by chunk; an incremental UTF-8 state
machine holds back the last bytes of an unfinished character.

Defined results: a null text encodes like the empty text, to no ids; null id
lists decode to the empty string; repeated rows are each encoded; other input
columns are never read. The vocabulary must hold all 256 bytes and ranks must
grow along every merge; ``Vocabulary`` refuses others.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import pick, release, slices

#: Bounds of the tables in a worker's memory; a full one is started anew.
MAX_STATES = 100_000
MAX_PAIRS = 250_000
MAX_PIECES = 120_000
MAX_HEADS = 50_000
#: Longer pieces are encoded anew each time they occur.
LONG_PIECE = 64
#: Bytes of a piece's head, after which the transducer's state is remembered.
HEAD = 7
#: Tokens a piece may hold back before the transducer looks for agreement.
LOOKAHEAD = 256


def _split_of(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens whose merge makes this one last."""
    own, parts = ranks[token], [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        choices = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None and r < own]
        if not choices:
            break
        i = min(choices)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        raise ValueError(f"no merges lead to token {own}")
    left, right = (ranks[p] for p in parts)
    if any(len(p) > 1 and ranks[p] > own for p in parts):
        raise ValueError(f"token {own} is older than its parts")
    return left, right


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, each longer token's last merge (-1, -1 for bytes),
    and the pattern that cuts texts into pieces. Fixed size, so it may travel
    with the tasks. ``name`` is a digest of it all."""

    tokens: tuple[bytes, ...]
    lefts: tuple[int, ...]
    rights: tuple[int, ...]
    pattern: str
    name: str = field(init=False)

    def __post_init__(self) -> None:
        digest = hashlib.sha256(self.pattern.encode())
        for token in self.tokens:
            digest.update(len(token).to_bytes(4, "big") + token)
        object.__setattr__(self, "name", digest.hexdigest())

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))) or sum(len(t) == 1 for t in tokens) != 256:
            raise ValueError("ranks must be 0, 1, 2, ... and hold every byte")
        splits = [(-1, -1) if len(t) == 1 else _split_of(t, ranks) for t in tokens]
        return cls(tuple(tokens), tuple(a for a, _ in splits), tuple(b for _, b in splits), pattern)


class _Pieces(dict):
    """Pieces' ids, in two generations: a full one becomes the old one."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) > LONG_PIECE:
            return ids
        if len(self) >= MAX_PIECES:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class _State(dict):
    """A deterministic state: its transitions by byte, made when first asked
    for, the live trie nodes (oldest start first), and the (token, length)
    pairs that may end here."""

    __slots__ = ("machine", "live", "ending")

    def __init__(self, machine: Transducer, live: tuple[int, ...]):
        super().__init__()
        self.machine, self.live = machine, live
        tokens = [machine.token_at[n] for n in live]
        self.ending = tuple((t, machine.length[t]) for t in tokens if t >= 0)

    def __missing__(self, byte: int) -> _State:
        machine = self.machine
        live = tuple(n for node in (*self.live, 0) if (n := machine.child.get(node << 8 | byte)) is not None)
        target = machine.states.get(live)
        if target is None:
            target = machine.states[live] = _State(machine, live)
        self[byte] = target
        return target


class _Pairs(dict):
    def __init__(self, test):
        super().__init__()
        self.test = test

    def __missing__(self, pair: int) -> bool:
        if len(self) >= MAX_PAIRS:
            self.clear()
        answer = self[pair] = self.test(pair >> 20, pair & 0xFFFFF)
        return answer


class Transducer:
    """The encoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.lefts, self.rights = vocabulary.lefts, vocabulary.rights
        self.length = [len(t) for t in vocabulary.tokens]
        self.merged = {(a, b): t for t, (a, b) in enumerate(zip(self.lefts, self.rights)) if a >= 0}
        self.child: dict[int, int] = {}  # (node * 256 + byte) -> node
        self.token_at = [-1]
        for token, spelled in enumerate(vocabulary.tokens):
            node = 0
            for byte in spelled:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[key]
            self.token_at[node] = token
        self.find = regex.compile(vocabulary.pattern).findall
        self.forget()

    def forget(self) -> None:
        """Start all tables anew."""
        self.pairs = _Pairs(self.compatible)
        self.pieces = _Pieces(self.encode_piece)
        self._forget_states()

    def _forget_states(self) -> None:
        self.start = _State(self, ())
        self.states = {(): self.start}
        self.heads: dict[bytes, tuple[_State, list[int]]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the border between a and b survives all merges. The tokens
        that ever touch the border are a's right and b's left descendants; a
        pair of them merges if its rank comes before either grows inwards."""
        never = len(self.length)
        grows_a = grows_b = never  # the rank at which the present descendant is merged into its parent
        x, y = a, b
        while True:
            crossing = self.merged.get((x, y), never)
            # of equal ranks the leftmost merge comes first
            if crossing < grows_a and crossing <= grows_b and crossing < never:
                return False
            # step back in time: undo the younger of both
            inner_x, inner_y = self.rights[x], self.lefts[y]
            if inner_x < 0 and inner_y < 0:
                return True
            if inner_y < 0 or (inner_x >= 0 and x > y):
                grows_a, x = x, inner_x
            else:
                grows_b, y = y, inner_y

    def _run(self, state: _State, last: list[int], data: bytes) -> _State:
        pairs = self.pairs
        for byte in data:
            state = state[byte]
            for token, size in state.ending:
                before = last[-size]
                if before < 0 or pairs[before << 20 | token]:
                    break
            last.append(token)
        return state

    def _agreed(self, last: list[int]) -> int:
        """The longest prefix on whose tokens all hypotheses agree that a token
        length behind the end may still begin."""
        end = len(last) - 1
        starts = set(range(max(0, end - max(self.length)), end + 1))
        while len(starts) > 1:
            latest = max(starts)
            starts.remove(latest)
            starts.add(latest - self.length[last[latest]])
        return starts.pop()

    def _emit(self, last: list[int], end: int) -> list[int]:
        out = []
        while end:
            token = last[end]
            out.append(token)
            end -= self.length[token]
        return out[::-1]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        if len(self.states) > MAX_STATES:
            self._forget_states()
        data, done = piece.encode(), []
        head = data[:HEAD]
        if head not in self.heads:
            if len(self.heads) >= MAX_HEADS:
                self.heads.clear()
            # last: the token that ends at each held position; before them, the last one emitted
            last = [-1]
            self.heads[head] = self._run(self.start, last, head), last
        state, last = self.heads[head]
        last = last[:]
        for start in range(HEAD, len(data), LOOKAHEAD):
            state = self._run(state, last, data[start : start + LOOKAHEAD])
            if len(last) > LOOKAHEAD and (cut := self._agreed(last)):
                done += self._emit(last, cut)
                del last[:cut]
        return (*done, *self._emit(last, len(last) - 1))

    def encode(self, text: str) -> np.ndarray:
        ids = chain.from_iterable(map(self.pieces.__getitem__, self.find(text)))
        return np.fromiter(ids, np.int32)


class Utf8Machine:
    """Incremental UTF-8: feeds chunks of bytes, gives back the text that is
    complete. Only the last bytes of a chunk are looked at by the machine, to
    see whether they begin an unfinished character; ill-formed bytes become
    U+FFFD."""

    def __init__(self) -> None:
        self.held = b""

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that lacks bytes."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                length = 2 if 0xC2 <= byte < 0xE0 else 3 if 0xE0 <= byte < 0xF0 else 4 if byte <= 0xF4 else 1
                # second bytes that no well-formed character has
                second = data[len(data) - back + 1] if back > 1 else None
                low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(byte, (0x80, 0xBF))
                return back if back < length and (second is None or low <= second <= high) else 0
            if byte < 0x80:
                return 0
        return 0

    def feed(self, chunk: bytes) -> str:
        data = self.held + chunk
        keep = self._unfinished(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


def decode_stream(ids: Iterable[int], tokens: tuple[bytes, ...], chunk: int = 65_536) -> Iterator[str]:
    """Texts whose concatenation is the decoded text, chunk by chunk."""
    machine = Utf8Machine()
    ids = np.asarray(ids).tolist()
    for start in range(0, len(ids), chunk):
        yield machine.feed(b"".join(map(tokens.__getitem__, ids[start : start + chunk])))
    yield machine.finish()


_MACHINE: list[tuple[str, Transducer]] = []


def _transducer(vocabulary: Vocabulary) -> Transducer:
    """One per worker process, made anew for another vocabulary."""
    if not _MACHINE or _MACHINE[0][0] != vocabulary.name:
        _MACHINE[:] = [(vocabulary.name, Transducer(vocabulary))]
    return _MACHINE[0][1]


def _drop_machine() -> None:
    """The worker lives on for other stages."""
    _MACHINE.clear()
    release()


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Loaded once per driver; about a second of fixed work."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = Vocabulary.load(path, pattern)
    return _LOADED[path, pattern]


_SHARED: dict[tuple[str, str], object] = {}


def _share(spark: SparkSession, words: Vocabulary):
    """Sent to the executors once per application."""
    key = spark.sparkContext.applicationId, words.name
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(words)
    return _SHARED[key]


def _listed(lists: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists)))


def encode(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>: the BPE ids of each whole text, each pattern
    match encoded separately, no special tokens."""
    return _encoded(docs, words, id_col, text_col, False)


def round_trip(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, text: the ids as ``encode`` gives them and the text decoded
    from them as ``decode`` does, in one pass over the texts."""
    return _encoded(docs, words, id_col, text_col, True)


def _encoded(docs: DataFrame, words: Vocabulary, id_col: str, text_col: str, decoded: bool) -> DataFrame:
    shared = _share(docs.sparkSession, words)

    def run(batches):
        vocabulary = shared.value
        machine = _transducer(vocabulary)
        try:
            for batch in slices(batches, "text", 1_000_000):
                lists = [machine.encode(t or "") for t in batch.column("text").to_pylist()]
                columns = {"doc_id": batch.column("doc_id"), "ids": _listed(lists)}
                if decoded:
                    columns["text"] = pa.array(["".join(decode_stream(ids, vocabulary.tokens)) for ids in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])
        finally:
            del machine
            _drop_machine()

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, ids, text: the text that each list of ids stands for."""
    shared = _share(encoded.sparkSession, words)

    def run(batches):
        tokens = shared.value.tokens
        for batch in slices(batches, "ids", 500_000):
            ids = batch.column("ids")
            texts = ["".join(decode_stream(x.values if x.is_valid else (), tokens)) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, text string")
