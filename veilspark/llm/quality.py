"""Quality classifier: a factorisation machine over hashed words, structure
statistics and length buckets.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)),
so pairwise interactions of all features cost time linear in the features that
a text has. Words count with a logarithm and unit length; statistics describe
the whole text (word lengths, repeats, symbol classes, lines).

The model is fitted by mini-batches in one task on at most ``TRAIN_ROWS``
labelled rows, those with the smallest hash of their id; scoring covers every
row. Its size is fixed, so it travels to all tasks.

Defined results: a null text counts as empty; empty texts get a score from the
statistics alone; labels other than 0 and 1 and null ids are not learned from;
several labels of one id all count; without labels every score is 0.5; an
empty table gives no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import pick, slices, word_hashes

BUCKETS = 1 << 13
RANK = 6
TRAIN_ROWS = 12_000
EPOCHS = 12
_LENGTHS = 16  # buckets of log2 length
_CLASSES = ("letter", "upper", "digit", "space", "line", "stop", "bar", "symbol", "high")
_STATS = len(_CLASSES) + 7
DIMENSIONS = BUCKETS + _LENGTHS + _STATS

_CLASS_OF = np.full(256, _CLASSES.index("symbol"), np.uint8)
for _name, _bytes in {
    "letter": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": (32, 9, 11, 12, 13), "line": (10,),
    "stop": b".,;:!?'\"()-", "bar": b"|", "high": range(128, 256),
}.items():
    _CLASS_OF[list(_bytes)] = _CLASSES.index(_name)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: starts of the rows, feature numbers, values."""
    n = len(texts)
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(n), counts)
    pairs, times = np.unique(owner * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    doc, bucket = pairs // BUCKETS, pairs % BUCKETS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(doc, value * value, n))
    value = value / norm[doc]

    data = [(t or "").encode() for t in texts]
    lengths = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8)
    byte_owner = np.repeat(np.arange(n), lengths)
    kinds = np.bincount(byte_owner * len(_CLASSES) + _CLASS_OF[flat], minlength=n * len(_CLASSES)).reshape(n, -1)
    some_words, some_bytes = np.maximum(counts, 1), np.maximum(lengths, 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.bincount(doc, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, doc, times)
    stats = np.column_stack(
        [
            kinds / some_bytes[:, None],
            np.bincount(owner, again, n) / some_words,
            distinct / some_words,
            most / some_words,
            (lengths - kinds[:, [3, 4]].sum(axis=1)) / some_words / 16,
            np.log1p(counts) / 12,
            np.log1p(kinds[:, 4]) / 8,
            counts == 0,
        ]
    )
    bins = np.minimum(np.log2(lengths + 1).astype(int), _LENGTHS - 1)

    rows = np.concatenate((doc, np.arange(n), np.repeat(np.arange(n), _STATS)))
    cols = np.concatenate((bucket, BUCKETS + bins, np.tile(BUCKETS + _LENGTHS + np.arange(_STATS), n)))
    vals = np.concatenate((value, np.ones(n), stats.ravel())).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    starts = np.searchsorted(rows[order], np.arange(n))
    return starts, cols[order].astype(np.int32), vals[order]


class FactorisationMachine:
    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    @classmethod
    def blank(cls) -> FactorisationMachine:
        return cls(0.0, np.zeros(DIMENSIONS), np.random.default_rng(7).normal(0, 0.02, (DIMENSIONS, RANK)))

    def _sums(self, starts, cols, vals):
        vx = self.factors[cols] * vals[:, None]
        sums = np.add.reduceat(vx, starts)
        square = np.add.reduceat(vx * vx, starts).sum(axis=1)
        line = np.add.reduceat(self.linear[cols] * vals, starts)
        return self.bias + line + ((sums**2).sum(axis=1) - square) / 2, sums

    def scores(self, starts, cols, vals) -> np.ndarray:
        if not len(starts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self._sums(starts, cols, vals)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, batch: int = 64, rate: float = 0.05, decay: float = 1e-5) -> None:
        """Logistic loss, adaptive steps per weight (AdaGrad)."""
        if not len(rows):
            return
        share = np.clip(labels.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        seen_l, seen_f, seen_b = np.full(DIMENSIONS, 1e-6), np.full((DIMENSIONS, RANK), 1e-6), 1e-6
        rng = np.random.default_rng(11)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                part = [rows[i] for i in order[start : start + batch]]
                size = [len(c) for c, _ in part]
                starts = np.cumsum([0, *size[:-1]])
                cols, vals = np.concatenate([c for c, _ in part]), np.concatenate([v for _, v in part])
                raw, sums = self._sums(starts, cols, vals)
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[order[start : start + batch]]
                each = np.repeat(error, size)
                used, inverse = np.unique(cols, return_inverse=True)
                grad_l = np.bincount(inverse, each * vals, len(used)) / len(part) + decay * self.linear[used]
                by_feature = (each * vals)[:, None] * (np.repeat(sums, size, axis=0) - self.factors[cols] * vals[:, None])
                grad_f = np.column_stack([np.bincount(inverse, by_feature[:, k], len(used)) for k in range(RANK)]) / len(part) + decay * self.factors[used]
                grad_b = error.mean()
                seen_l[used] += grad_l**2
                seen_f[used] += grad_f**2
                seen_b += grad_b**2
                self.linear[used] -= rate * grad_l / np.sqrt(seen_l[used])
                self.factors[used] -= rate * grad_f / np.sqrt(seen_f[used])
                self.bias -= rate * grad_b / np.sqrt(seen_b)

    def dumps(self) -> bytes:
        to = io.BytesIO()
        np.savez_compressed(to, bias=self.bias, linear=self.linear.astype(np.float32), factors=self.factors.astype(np.float32))
        return to.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> FactorisationMachine:
        held = np.load(io.BytesIO(data))
        return cls(float(held["bias"]), held["linear"], held["factors"])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """A model from at most ``rows`` labelled rows that are not held out."""
    known = pick(labels, label_id=id_col, label=label_col).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))
    sample = known.orderBy(F.xxhash64("label_id", "label"), "label_id", "label").limit(rows)
    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "text")

    def shape(batches):
        for batch in slices(batches, "text"):
            starts, cols, vals = features(batch.column("text").to_pylist())
            at = np.append(starts, len(cols)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (cols, vals)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "cols", "vals"])

    kinds = dict(texts.dtypes)
    shaped = texts.mapInArrow(shape, f"doc_id {kinds['doc_id']}, label {kinds['label']}, cols array<int>, vals array<float>")

    def train(batches):
        rows, marks = [], []
        for batch in batches:
            marks += batch.column("label").to_pylist()
            rows += [(c.values.to_numpy(), v.values.to_numpy()) for c, v in zip(batch.column("cols"), batch.column("vals"))]
        machine = FactorisationMachine.blank()
        machine.fit(rows, np.array(marks, float))
        yield pa.RecordBatch.from_arrays([pa.array([machine.dumps()], pa.binary())], ["model"])

    # bounded by ``rows``; the order makes reruns agree
    model = shaped.repartition(1).sortWithinPartitions("doc_id", "label").mapInArrow(train, "model binary").collect()
    return FactorisationMachine.loads(model[0]["model"]) if model else FactorisationMachine.blank()


def score(docs: DataFrame, machine: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine.dumps())

    def run(batches):
        machine = FactorisationMachine.loads(shared.value)
        for batch in slices(batches, "text"):
            marks = machine.scores(*features(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.astype(float), pa.float64())], ["doc_id", "score"])

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, score double")


def rejects(docs: DataFrame, machine: FactorisationMachine, limit: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns whose text scores below the limit go; the rest is
    returned. Scored in the row, so ids may be null or repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(machine.dumps())

    def run(batches):
        machine = FactorisationMachine.loads(shared.value)
        for batch in slices(batches, text_col):
            marks = machine.scores(*features(batch.column(text_col).to_pylist()))
            yield batch.filter(pa.array(marks >= limit))

    return docs.mapInArrow(run, docs.schema)
