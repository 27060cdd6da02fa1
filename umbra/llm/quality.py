"""Quality classifier: supervised subword embeddings.

A word's vector is the mean of the learned vectors of its hashed features (the word itself and its character n-grams
of the given lengths in UTF-8 bytes, with word ends marked); a document's is the mean over its words; a softmax over the two classes
follows.  Vectors and output are trained together by plain numpy stochastic gradient descent on the driver.

With two classes the softmax is a logistic function of one linear form, so a trained model is one number for each
feature bucket, about a megabyte, and a document's score is the mean of its words' numbers.

Labels are learned from a bounded sample: of the rows allowed for training, the `sample` with the smallest hashes of
each class, each with its whole text.  What the driver receives of a document is its distinct feature buckets and
their weights, at most `buckets` entries.  A random fifth of the sample sets the operating point: the score is
0.3 where the training side balances best between the classes, and rises with the logit.

Cases: null, empty or blank text: a document without words; its logit is the bias.  Repeated rows are scored each.
Rows of labels that contradict each other: the majority, 1 if it is even.
With no label of one class, every score is that class's absence (0 or 1), 0.5 without any label.  Null doc_id: scored,
not held out, never a label's partner.  Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, column, remainder_is, slices, words

SCORES = "doc_id long, held_out boolean, score double, predicted int"
POINT = 0.3  # a document is predicted 1 from this score on


def grams(word: bytes, sizes: tuple[int, int]) -> list[int]:
    """Hashes of the word and of the byte n-grams of <word> in UTF-8, n in sizes."""
    b, crc = b"<%b>" % word, zlib.crc32
    return [crc(b), *[crc(b[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(b) - n + 1)]]


def terms(text: str | None) -> list[bytes]:
    """The words, and for each word that repeats the one before it a mark that stands for such a word pair."""
    found = words(text)
    return found + [b"\x02"] * sum(map(bytes.__eq__, found, found[1:]))


def sample_of(labels: DataFrame, label: str, sample: int, folds: int, test_fold: int, id_col: str = "doc_id") -> DataFrame:
    """doc_id, label: the rows with the smallest hashes of either class among those that may be learned from."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~remainder_is(F.col("doc_id"), folds, test_fold))
    rows = rows.groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))  # repeated rows once, by majority
    parts = [rows.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@dataclass(frozen=True)
class Model:
    values: np.ndarray  # a float32 for each bucket
    bias: float
    slope: float
    point: float  # the logit at which the score is POINT
    sizes: tuple[int, int]

    def score(self, logit: float) -> float:
        x = self.slope * (logit - self.point) + math.log(POINT / (1 - POINT))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], buckets: int, sizes: tuple[int, int], dim: int = 12, epochs: int = 6, rate: float = 0.5, seed: int = 1) -> Model:
    """rows: (label, distinct buckets, weights that sum to 1).  The classes count alike."""
    given = {r[0] for r in rows}
    if len(given) < 2:
        only = {0: -50.0, 1: 50.0}.get(next(iter(given), -1), math.log(0.5 / 0.5) - math.log(POINT / (1 - POINT)))
        return Model(np.zeros(buckets, np.float32), only, 1.0, 0.0, sizes)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[: len(rows) // 5].tolist())
    share = {k: sum(r[0] == k for r in rows) / len(rows) for k in (0, 1)}
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    learn = [i for i in range(len(rows)) if i not in held]
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            y, at, w = rows[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = w @ emb[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= 0.5 / share[y]
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p
            emb[at] -= (lr * w * len(w))[:, None].clip(0, lr) * back
    values = emb @ (out[:, 1] - out[:, 0])
    model = Model(values, float(bias[1] - bias[0]), 1.0, 0.0, sizes)
    z = np.array([model.bias + float(w @ values[at]) for y, at, w in rows])
    y = np.array([r[0] for r in rows])
    use = np.array([i in held for i in range(len(rows))])
    use = use if all((y[use] == k).any() for k in (0, 1)) else np.ones(len(rows), bool)
    return Model(values, model.bias, *operating_point(z[use], y[use]), sizes)


def operating_point(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, point): the middle of the best gap for balanced accuracy, and a slope by the spread of the logits."""
    cuts = np.unique(z)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    lo, hi = np.sort(z[y == 0]), np.sort(z[y == 1])
    balanced = np.searchsorted(lo, cuts) / len(lo) + 1 - np.searchsorted(hi, cuts) / len(hi)
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    spread = float(np.std(z)) or 1.0
    return 4 / spread, float(cuts[best[len(best) // 2]])


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 2000, folds: int = 5, test_fold: int = 0, buckets: int = 1 << 18, sizes: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text") -> Model:
    chosen = sample_of(labels, label, sample, folds, test_fold)  # at most 2 * sample rows, so it is broadcast
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def counts(batches):
        cache = Cache(lambda w: [h % buckets for h in grams(w, sizes)])
        for batch in slices(batches):
            rows = []
            for doc, y, text in zip(*(column(batch, n) for n in ("doc_id", "label", "text")), strict=True):
                flat = [cache[w] for w in terms(text)]
                at = np.array([x for f in flat for x in f], np.int64)
                w = np.repeat([1 / (len(f) * len(flat)) for f in flat], [len(f) for f in flat]) if flat else np.zeros(0)
                distinct, inverse = np.unique(at, return_inverse=True)
                rows.append((doc, y, distinct.astype("<i4").tobytes(), np.bincount(inverse, w, len(distinct)).astype("<f4").tobytes()))
            names, types = ["doc_id", "label", "at", "w"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    found = base.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(counts, "doc_id long, label int, at binary, w binary")
    rows = {(r["doc_id"], r["label"], bytes(r["at"])): bytes(r["w"]) for r in found.toLocalIterator()}  # repeated rows once
    ordered = sorted(rows.items())
    return train([(y, np.frombuffer(at, "<i4"), np.frombuffer(w, "<f4")) for (_, y, at), w in ordered], buckets, sizes)


def apply(docs: DataFrame, model: Model, folds: int = 5, test_fold: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES, one row for each row of docs; narrow."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), remainder_is(F.col(id_col), folds, test_fold).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        model = shared.value
        values, n, sizes = model.values.astype(float).tolist(), len(model.values), model.sizes

        def value(word: bytes) -> float:
            at = grams(word, sizes)
            return sum([values[h % n] for h in at]) / len(at)

        cache = Cache(value)
        for batch in slices(batches):
            score = []
            for text in column(batch, "text"):
                found = terms(text)
                score.append(model.score(model.bias + math.fsum(map(cache.__getitem__, found)) / max(1, len(found))))
            predicted = pa.array([int(s >= POINT) for s in score], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, test_fold: int = 0, **options) -> DataFrame:
    """Learn from the rows outside the test fold, then score every row of docs."""
    return apply(docs, learn(docs, labels, label, folds=folds, test_fold=test_fold, **options), folds, test_fold)
