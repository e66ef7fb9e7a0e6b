"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - t_k) with one weight vector w for all grades
and rising thresholds t_1 < t_2 < t_3; the answer is the expected grade.
Features are words and word beginnings (4, 5 and 6 bytes; so that unseen
endings of known stems count), each with the logarithm of its count.

Labels only say toxic or not, so grades are induced from the training rows: a
clean text is 0; a toxic one is 1, 2 or 3 by how many of its words carry a
feature that is far more frequent in toxic texts (see ``GRADE_HITS``).

Fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of
their id: feature counts are summed in Spark, the ``FEATURES`` with the
strongest association are kept, and one task fits the weights. The model has a
fixed size and travels to all tasks; every row is scored.

Defined results: null and empty texts have no features, which gives them the
thresholds' own grade; labels other than 0 and 1 and null ids are not learned
from; without labels the severity is 0 throughout; repeated rows are scored
each; an empty table gives no rows.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mix, pick, slices, word_hashes
from .quality import held_out

GRADES = 3
#: Hits from which on a toxic text has grade 2, and grade 3.
GRADE_HITS = (4, 8)
PREFIXES = (4, 5, 6)
TRAIN_ROWS = 12_000
FEATURES = 4_096
#: A feature must be in this many training texts.
LEAST_TEXTS = 4
STEPS = 400
_FILTER_BITS = 22


def _found(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners, numbers of the word, and features: the word and its beginnings."""
    words, counts, heads = word_hashes(texts, letters=True, prefixes=PREFIXES)
    owner, number = np.repeat(np.arange(len(texts)), counts), np.arange(len(words))
    parts = [(owner, number, words)]
    for k, head in zip(PREFIXES, heads):
        long = head != 0
        parts.append((owner[long], number[long], mix(head[long] + np.uint64(k))))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _counts(owner: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, feature) and how often."""
    order = np.lexsort((features, owner))
    owner, features = owner[order], features[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (features[1:] != features[:-1])
    at = np.flatnonzero(new)
    return owner[at], features[at], np.diff(np.append(at, len(owner)))


class OrdinalModel:
    """``features`` sorted; ``strong`` are those that count as hits."""

    def __init__(self, features: np.ndarray, strong: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.features, self.strong, self.weights, self.thresholds = features, strong, weights, thresholds
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(features >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows (owner, place in ``features``, value) and hits per text."""
        owner, number, features = _found(texts)
        maybe = self.filter[(features >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
        owner, number, features = owner[maybe], number[maybe], features[maybe]
        place = np.searchsorted(self.features, features)
        place[place == len(self.features)] = 0
        known = self.features[place] == features if len(self.features) else np.zeros(len(place), bool)
        owner, number, place = owner[known], number[known], place[known]
        hit = np.unique(number[self.strong[place]], return_index=True)[1]
        hits = np.bincount(owner[self.strong[place]][hit], minlength=len(texts))
        who, what, n = _counts(owner, place)
        return who, what, np.log1p(n), hits

    def levels(self, owner, place, value, n: int) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= GRADES) for n rows."""
        eta = np.bincount(owner, self.weights[place] * value, n)
        return 1 / (1 + np.exp(-np.clip(eta[:, None] - self.thresholds, -40, 40)))

    def fit(self, owner, place, value, grades: np.ndarray, rate: float = 0.2, decay: float = 1e-4) -> None:
        """Full-batch likelihood ascent with adaptive steps. The thresholds are
        the first one and the logarithms of the gaps, so they stay in order."""
        n = len(grades)
        first, gaps = 0.0, np.zeros(GRADES - 1)
        seen_w, seen_t = np.full(len(self.weights), 1e-8), np.full(GRADES, 1e-8)
        every = np.arange(n)
        for _ in range(STEPS):
            widths = np.exp(gaps)
            self.thresholds = first + np.concatenate(([0.0], np.cumsum(widths)))
            up = self.levels(owner, place, value, n)
            bounds = np.column_stack((np.ones(n), up, np.zeros(n)))
            above, below = bounds[every, grades], bounds[every, grades + 1]
            p = np.maximum(above - below, 1e-12)
            slope = (1 - above - below) / n
            grad_w = np.bincount(place, slope[owner] * value, len(self.weights)) - decay * self.weights
            grad_t = np.zeros(GRADES + 2)
            np.add.at(grad_t, grades, -above * (1 - above) / p / n)
            np.add.at(grad_t, grades + 1, below * (1 - below) / p / n)
            tail = np.cumsum(grad_t[1 : GRADES + 1][::-1])[::-1]  # a gap moves all thresholds behind it
            step_t = np.concatenate(([tail[0]], tail[1:] * widths))
            seen_w += grad_w**2
            seen_t += step_t**2
            self.weights += rate * grad_w / np.sqrt(seen_w)
            step = rate * step_t / np.sqrt(seen_t)
            first += step[0]
            gaps = np.clip(gaps + step[1:], -5, 3)

    def dumps(self) -> bytes:
        to = io.BytesIO()
        np.savez_compressed(to, features=self.features, strong=self.strong, weights=self.weights, thresholds=self.thresholds)
        return to.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> OrdinalModel:
        held = np.load(io.BytesIO(data))
        return cls(held["features"], held["strong"], held["weights"], held["thresholds"])

    @classmethod
    def blank(cls) -> OrdinalModel:
        return cls(np.empty(0, np.uint64), np.empty(0, bool), np.empty(0), np.full(GRADES, 40.0))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> OrdinalModel:
    known = pick(labels, label_id=id_col, label=label_col).where(F.col("label").isin(0, 1) & F.col("label_id").isNotNull() & ~held_out("label_id"))
    sample = known.orderBy(F.xxhash64("label_id", "label"), "label_id", "label").limit(rows)
    texts = pick(docs, doc_id=id_col, text=text_col).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", F.col("label").cast("int").alias("label"), "text")

    def count(batches):
        for batch in slices(batches, "text"):
            toxic = np.asarray(batch.column("label")) == 1
            owner, _, features = _found(batch.column("text").to_pylist())
            who, what, _ = _counts(owner, features)
            names, place = np.unique(what, return_inverse=True)
            bad = np.bincount(place, toxic[who], len(names)).astype(np.int64)
            all_ = np.bincount(place, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], ["feature", "bad", "good"])

    totals = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_bad, n_good = totals.get(1, 0), totals.get(0, 0)
    if not n_bad or not n_good:
        return OrdinalModel.blank()
    counted = texts.mapInArrow(count, "feature long, bad long, good long").groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    strength = F.abs(odds / spread)
    best = counted.where(F.col("bad") + F.col("good") >= LEAST_TEXTS).select("feature", odds.alias("odds"), strength.alias("strength")).orderBy(F.desc("strength"), "feature").limit(FEATURES).collect()
    features = np.array([r["feature"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(features)
    strong = np.array([r["odds"] > 3 and r["strength"] > 3 for r in best], bool)[order]
    model = OrdinalModel(features[order], strong, np.zeros(len(features)), np.zeros(GRADES))
    data = model.dumps()

    def train(batches):
        model, n, parts, grades = OrdinalModel.loads(data), 0, [], []
        for batch in slices(batches, "text"):
            who, what, value, hits = model.rows(batch.column("text").to_pylist())
            parts.append((who + n, what, value))
            toxic = np.asarray(batch.column("label")) == 1
            grades.append(np.where(toxic, 1 + np.searchsorted(GRADE_HITS, hits, side="right"), 0))
            n += batch.num_rows
        if parts:
            model.fit(*(np.concatenate(x) for x in zip(*parts)), np.concatenate(grades))
        yield pa.RecordBatch.from_arrays([pa.array([model.dumps()], pa.binary())], ["model"])

    # bounded by ``rows``; the order makes reruns agree
    done = texts.repartition(1).sortWithinPartitions("doc_id", "label").mapInArrow(train, "model binary").collect()
    return OrdinalModel.loads(done[0]["model"])


def severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, expected_severity (0 to GRADES), grade (the likeliest), p_toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model.dumps())

    def run(batches):
        model = OrdinalModel.loads(shared.value)
        for batch in slices(batches, "text"):
            who, what, value, _ = model.rows(batch.column("text").to_pylist())
            up = model.levels(who, what, value, batch.num_rows)
            bounds = np.column_stack((np.ones(len(up)), up, np.zeros(len(up))))
            grade = (bounds[:, :-1] - bounds[:, 1:]).argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(up.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(up[:, 0].copy())],
                ["doc_id", "expected_severity", "grade", "p_toxic"],
            )

    rows = pick(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_severity double, grade int, p_toxic double")
