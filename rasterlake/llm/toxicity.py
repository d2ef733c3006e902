"""Toxicity by cumulative-link ordinal regression on sparse text features.

A document's features are its distinct words (lower-cased A-Z, punctuation cut from both ends) and the beginnings of longer words, hashed. One
weight vector is shared by all thresholds: P(grade >= k) = sigmoid(score - threshold_k). The output is the
expected grade, the sum of these probabilities.

Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. The fit uses a bounded sample:
the TRAIN_ROWS labelled documents with the smallest hash of their id, whatever the size of the table; only
their hashed features travel, to the one task that fits. Scoring covers every document.

Weights are learnt by proximal adaptive gradient steps on the whole sample. The L1 penalty of a feature grows
with the square root of its frequency, so that a weight must stand out of what chance gives; the features it
leaves are then learnt again with a smaller penalty.

Defined results: a null or empty text has no features and gets the score of the thresholds alone; repeated
rows get equal results; of labels that repeat an id the highest grade counts, of documents that do one is fitted;
labels without a document, or with a null, are ignored; with no labels, or labels of
one grade only, the thresholds follow the smoothed grade shares and no word has weight. Columns other than
those named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

TRAIN_ROWS = 12_000
BITS, GRADES = 20, 3
PREFIXES = (4, 5, 6)
MIN_DOCS, PENALTY, ROUNDS, STEP, RELAX = 6, 2.5, 120, 0.3, 0.15
#: Documents whose expected grade reaches this are rejected.
REJECT_AT = 0.5
_EDGE = b".,;:!?\"'()[]{}<>*$%&#|/\\-_=+~`"


class Features(dict):
    """word -> its hashed features, remembered; starts anew at a bounded size."""

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) > 500_000:
            self.clear()
        bare = word.strip(_EDGE)
        # the word, and its beginnings, told from words by a mark
        parts = [bare, *(b"^" + bare[:k] for k in PREFIXES if len(bare) > k)] if bare else []
        at = self[word] = [zlib.crc32(x) & ((1 << BITS) - 1) for x in parts]
        return at


def features(text: bytes | None, known: Features) -> list[int]:
    """Distinct hashed features of a text, ascending."""
    return sorted(set(chain.from_iterable(map(known.__getitem__, set((text or b"").lower().split())))))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    thresholds: np.ndarray
    weights: dict[int, float] = field(default_factory=dict)

    def severity(self, score: np.ndarray) -> np.ndarray:
        return _sigmoid(score[:, None] - self.thresholds[None, :]).sum(axis=1)

    def grade(self, score: np.ndarray) -> np.ndarray:
        above = np.column_stack([np.ones(len(score)), _sigmoid(score[:, None] - self.thresholds[None, :]), np.zeros(len(score))])
        return (above[:, :-1] - above[:, 1:]).argmax(axis=1)


def fit(rows: list[tuple[int, np.ndarray]], rounds: int = ROUNDS, penalty: float = PENALTY) -> Model:
    """Fits thresholds and shared weights to (grade, features)."""
    y = np.array([g for g, _ in rows], np.int64)
    n = len(y)
    share = (np.bincount(y, minlength=GRADES) + 1.0) / (n + GRADES)
    above = 1 - np.cumsum(share)[:-1]
    cut = np.log((1 - above) / above)
    if n == 0 or len(np.unique(y)) < 2:
        return Model(cut)
    often = np.zeros(1 << BITS, np.int64)
    for _, x in rows:
        often[x] += 1  # a row's features are distinct
    names = np.flatnonzero((often >= MIN_DOCS) & (often < n))
    place = np.full(1 << BITS, -1)
    place[names] = np.arange(len(names))
    # only what is frequent enough is laid out; numbers of rows and columns are what bincount takes as they are
    kept_cols = [c[c >= 0] for c in (place[x] for _, x in rows)]
    row = np.repeat(np.arange(n), [len(c) for c in kept_cols])
    col = np.concatenate(kept_cols)
    del kept_cols, place
    w, seen_w, seen_c = np.zeros(len(names)), np.full(len(names), 1e-12), np.full(len(cut), 1e-12)
    toxic = 1 - share[0]
    least = penalty * np.sqrt(often[names] * toxic * (1 - toxic)) / n
    for turn in range(2 * rounds):
        if turn == rounds:
            # the penalty has chosen the features; now what is left of them is learnt with less of a penalty
            kept = w != 0
            row, col, least = row[kept[col]], col[kept[col]], np.where(kept, least * RELAX, np.inf)
            seen_w[:], seen_c[:] = 1e-12, 1e-12
        score = np.bincount(row, w[col], n)
        p = np.column_stack([np.ones(n), _sigmoid(score[:, None] - cut[None, :]), np.zeros(n)])
        slope = p * (1 - p)  # of P(grade >= k) in the score; 0 at both ends
        mass = np.maximum(p[np.arange(n), y] - p[np.arange(n), y + 1], 1e-9)
        d_score = -(slope[np.arange(n), y] - slope[np.arange(n), y + 1]) / mass / n
        g = np.bincount(col, d_score[row], len(names))
        d_cut = np.zeros(len(cut))
        for k in range(len(cut)):
            d_cut[k] = (slope[:, k + 1] * ((y == k + 1).astype(float) - (y == k)) / mass).sum() / n
        seen_w += g * g
        seen_c += d_cut * d_cut
        rate = STEP / np.sqrt(seen_w)
        w = w - rate * g
        w = np.sign(w) * np.maximum(np.abs(w) - rate * least, 0)
        cut = np.sort(cut - STEP / np.sqrt(seen_c) * d_cut)
        cut[1:] = np.maximum(cut[1:], cut[:-1] + 1e-3)
    kept = np.flatnonzero(w)
    return Model(cut, dict(zip(names[kept].tolist(), w[kept].tolist(), strict=True)))


def _mapped(docs: DataFrame, names: list[str], schema: str, make) -> DataFrame:
    """make(columns of a batch, known features) gives the output columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(make(batch, known), names=names)

    return docs.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    grade = F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1)
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).select(F.col(id_col).alias("__id"), grade.cast("int").alias("__grade"))
    known = known.groupBy("__id").agg(F.max("__grade").alias("__grade"))
    # bounded by `rows`, so broadcasting it is safe at any size of the tables
    sample = known.orderBy(F.xxhash64("__id"), "__id", "__grade").limit(rows)
    used = docs.join(F.broadcast(sample), docs[id_col] == F.col("__id")).select(F.col("__grade").alias("grade"), F.col(text_col).alias("text"), F.col("__id").alias("id"))

    def make(batch: pa.RecordBatch, seen: Features) -> list[pa.Array]:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        return [batch.column(0), pa.array([np.array(features(t, seen), np.int32).tobytes() for t in texts], pa.binary()), batch.column(2).cast(pa.int64())]

    # of rows that repeat an id one is fitted, so that the sample's bound holds
    found = _mapped(used, ["grade", "f", "id"], "grade int, f binary, id long", make).groupBy("id").agg(F.min("grade").alias("grade"), F.min("f").alias("f")).select("grade", "f", "id")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in (2, 0, 1)), strict=True))
        model = fit([(grade, np.frombuffer(f, np.int32)) for _, grade, f in got])
        columns = [pa.array([model.thresholds.tolist()]), pa.array([list(model.weights)], pa.list_(pa.int64())), pa.array([list(model.weights.values())], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cut", "names", "weights"])

    # the sample is bounded, so one task holds it; the driver gets the model alone
    made = found.repartition(1).mapInArrow(learn, "cut array<double>, names array<long>, weights array<double>").collect()
    if not made:
        return fit([])
    return Model(np.array(made[0]["cut"]), dict(zip(made[0]["names"], made[0]["weights"], strict=True)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """`carry`'s columns, or the id alone, then __score, __severity, __grade."""
    kept = carry or (id_col,)
    names = [*kept, "__score", "__severity", "__grade"]
    chosen = docs.select(*kept, *([] if text_col in kept else [F.col(text_col)]))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", __score double, __severity double, __grade int"
    at, weights, n = chosen.columns.index(text_col), model.weights, len(kept)

    def make(batch: pa.RecordBatch, seen: Features) -> list[pa.Array]:
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        s = np.array([sum(weights.get(f, 0.0) for f in features(t, seen)) for t in texts], float)
        return [*(batch.column(k) for k in range(n)), pa.array(s), pa.array(model.severity(s)), pa.array(model.grade(s).astype(np.int32))]

    return _mapped(chosen, names, schema, make)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    made = score(docs, model)
    return made.select("doc_id", F.col("__severity").alias("severity"), F.col("__grade").alias("grade"), (F.col("__severity") >= REJECT_AT).alias("rejected"))
