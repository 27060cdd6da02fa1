"""Names of persons and places by a trained sequence tagger: an averaged structured perceptron with Viterbi decoding.

A text is cut into sentences and tokens.  A token's score for a label is the sum of the weights of its features: of its own
form (lower-cased, shape, beginnings and ends), and of the forms of its two neighbours; a transition adds its own weight.
Labels are O, and B- and I- of each type.  As features belong to single words, a batch scores each different word once and
decodes all its sentences side by side, step by step.

fit() trains over Spark by parameter mixing: labelled texts are dealt into shards of bounded size by a hash of the text,
each epoch runs the perceptron over every shard from the same weights, and Spark sums the shards' changes by feature.  A
change is a whole number, and sums of whole numbers do not depend on their order, so the same texts give the same model.
What comes to the driver is at most 2**bits rows.  The model is those weights, 2**bits x labels of four bytes,
broadcast to the workers, where each is unpacked once.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .detect import BatchRecognizer

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\S")
#: Where a sentence ends: after these tokens, or at a line's end.
STOPS = frozenset(".!?;")
#: Tokens of a sentence at most; a longer one goes on as the next.
LONGEST = 200
#: Labelled texts of a shard, about.
SHARD = 2000
#: Parts of one that averages are rounded to, so that their sums are exact.
UNIT = 1 << 20
EXAMPLES = "text string, spans array<struct<start:int,end:int,entity_type:string>>"


def shape(word: str) -> str:
    """X for capitals, x for small letters, 9 for digits, others as they are; repeated ones twice at most."""
    out: list[str] = []
    for c in word[:24]:
        s = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if out[-2:] != [s, s]:
            out.append(s)
    return "".join(out)


def own_features(word: str) -> tuple[str, ...]:
    low = word.lower()
    return (f"w {low}", f"s {shape(word)}", f"1 {low[-1:]}", f"2 {low[-2:]}", f"3 {low[-3:]}", f"4 {low[-4:]}", f"a {low[:2]}", f"b {low[:3]}", f"c {shape(word)} {low[-3:]}", "bias")


def beside_features(side: str, word: str) -> tuple[str, ...]:
    low = word.lower()
    return (f"{side}w {low}", f"{side}s {shape(word)}", f"{side}3 {low[-3:]}")


def sentences(text: str) -> list[list[tuple[int, int, str]]]:
    """Tokens (start, end, word) of each sentence of a text."""
    out: list[list[tuple[int, int, str]]] = []
    current: list[tuple[int, int, str]] = []
    before = 0
    for m in TOKEN.finditer(text):
        if current and (len(current) >= LONGEST or "\n" in text[before : m.start()]):
            out.append(current)
            current = []
        current.append((m.start(), m.end(), m.group()))
        before = m.end()
        if m.group() in STOPS:
            out.append(current)
            current = []
    return [*out, current] if current else out


def labelled(tokens: list[tuple[int, int, str]], spans: list[tuple[int, int, str]]) -> list[str]:
    """BIO labels of tokens: those wholly inside a span; spans in order."""
    out = ["O"] * len(tokens)
    for start, end, kind in spans:
        inside = [i for i, (a, b, _) in enumerate(tokens) if a >= start and b <= end]
        for n, i in enumerate(inside):
            out[i] = ("I-" if n else "B-") + kind
    return out


@dataclass
class Tagger:
    """weights: a row a feature hash and a column a label; transitions: from a label (the last row: a beginning) to another."""

    types: tuple[str, ...]
    weights: np.ndarray
    transitions: np.ndarray
    scores: dict = field(default_factory=dict, repr=False, compare=False)
    #: Words whose scores are kept in a worker.
    most_words: int = 200_000

    def __getstate__(self):
        return {"types": self.types, "weights": self.weights, "transitions": self.transitions, "scores": {}, "most_words": self.most_words}

    @cached_property
    def labels(self) -> list[str]:
        return ["O", *(f"{p}-{t}" for t in self.types for p in "BI")]

    def rows(self, features: tuple[str, ...]) -> list[int]:
        return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & (len(self.weights) - 1) for f in features]

    def of_word(self, word: str) -> np.ndarray:
        """Three rows of scores: as the token itself, as the one before it, as the one after it."""
        found = self.scores.get(word)
        if found is None:
            found = np.stack([self.weights[self.rows(f)].sum(0, dtype=np.float64) for f in (own_features(word), beside_features("p", word), beside_features("n", word))])
            if len(self.scores) >= self.most_words:
                self.scores.clear()
            self.scores[word] = found
        return found

    def emissions(self, words: list[str]) -> np.ndarray:
        s = np.stack([self.of_word(w) for w in ("", *words, "")])
        return s[1:-1, 0] + s[:-2, 1] + s[2:, 2]

    def allowed(self) -> np.ndarray:
        """What may follow what: I- of a type only B- or I- of it; 0 or minus infinity."""
        out = np.zeros((len(self.labels) + 1, len(self.labels)))
        for i, a in enumerate([*self.labels, "^"]):
            for j, b in enumerate(self.labels):
                if b[0] == "I" and a[2:] != b[2:]:
                    out[i, j] = -np.inf
        return out

    def decode(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """The best labels of each sentence (its emissions); ties go to the first label.  All sentences take each step at once."""
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        lengths = np.array([len(many[i]) for i in order])
        if not len(order) or not lengths[0]:
            return [np.zeros(0, np.int64) for _ in many]
        step = self.transitions + self.allowed()
        size = len(self.labels)
        padded = np.zeros((len(order), lengths[0], size))
        for row, i in enumerate(order):
            padded[row, : lengths[row]] = many[i]
        back = np.zeros((lengths[0], len(order), size), np.int16)
        score = step[-1] + padded[:, 0]
        ends = [score.copy()]
        for t in range(1, lengths[0]):
            live = int(np.searchsorted(-lengths, -t, side="left"))
            reached = score[:live, :, None] + step[None, :-1]
            back[t, :live] = reached.argmax(1)
            score[:live] = reached.max(1) + padded[:live, t]
            ends.append(score[:live].copy())
        out: list = [None] * len(many)
        for row, i in enumerate(order):
            n = lengths[row]
            best = np.zeros(n, np.int64)
            if n:
                best[-1] = ends[n - 1][row].argmax()
                for t in range(n - 1, 0, -1):
                    best[t - 1] = back[t, row, best[t]]
            out[i] = best
        return out

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """(start, end, type, confidence) of each text.  The confidence of a span is the mean of its tokens' odds of their label
        against the next best."""
        cut = [sentences(t or "") for t in texts]
        flat = [(n, tokens) for n, many in enumerate(cut) for tokens in many if any(w[:1].isupper() or w.isdigit() for *_, w in tokens)]
        emissions = [self.emissions([w for *_, w in tokens]) for _, tokens in flat]
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
        for (n, tokens), best, e in zip(flat, self.decode(emissions), emissions, strict=True):
            i = 0
            while i < len(best):
                if not best[i]:
                    i += 1
                    continue
                name, j = self.labels[best[i]], i + 1
                while j < len(best) and self.labels[best[j]] == f"I-{name[2:]}":
                    j += 1
                margin = float(np.mean([e[k, best[k]] - np.delete(e[k], best[k]).max() for k in range(i, j)]))
                out[n].append((tokens[i][0], tokens[j - 1][1], name[2:], round(0.5 + 0.5 / (1 + math.exp(-max(-30.0, min(30.0, margin)))), 6)))
                i = j
        return out

    def recognizer(self) -> BatchRecognizer:
        return BatchRecognizer(self.types, self)

    def save(self, spark: SparkSession, path: str) -> None:
        row = (list(self.types), len(self.weights), bytearray(self.weights.astype("<f4").tobytes()), bytearray(self.transitions.astype("<f8").tobytes()))
        spark.createDataFrame([row], "types array<string>, features int, weights binary, transitions binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Tagger:
    r = spark.read.parquet(path).head()
    size = 1 + 2 * len(r["types"])
    return Tagger(tuple(r["types"]), np.frombuffer(r["weights"], "<f4").reshape(r["features"], size).copy(), np.frombuffer(r["transitions"], "<f8").reshape(size + 1, size).copy())


def _epoch(tagger: Tagger, texts: list[str], spans: list[list[tuple[int, int, str]]]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], int, int]:
    """One run of the perceptron from the tagger's weights: (row -> whole change, row -> change by the time it has held,
    sentences, sentences with mistakes).  Rows beyond the features are transitions."""
    size, first = len(tagger.labels), len(tagger.weights)
    number = {name: i for i, name in enumerate(tagger.labels)}
    change: dict[int, np.ndarray] = {}
    timed: dict[int, np.ndarray] = {}
    allowed = tagger.allowed()
    work = [(s, [number[x] for x in labelled(s, own)]) for text, own in zip(texts, spans, strict=True) for s in sentences(text)]
    cache: dict[str, tuple[list[int], ...]] = {}

    def rows(word: str) -> tuple[list[int], ...]:
        if word not in cache:
            cache[word] = tuple(tagger.rows(f) for f in (own_features(word), beside_features("p", word), beside_features("n", word)))
        return cache[word]

    def scores(found: list[int]) -> np.ndarray:
        out = tagger.weights[found].sum(0, dtype=np.float64)
        for r in found:
            if r in change:
                out = out + change[r]
        return out

    def add(row: int, label: int, by: int, step: int) -> None:
        for kept, value in ((change, by), (timed, by * step)):
            if row not in kept:
                kept[row] = np.zeros(size)
            kept[row][label] += value

    wrong = 0
    for step, (tokens, gold) in enumerate(work):
        words = ["", *(w for *_, w in tokens), ""]
        found = [[*rows(words[i])[0], *rows(words[i - 1])[1], *rows(words[i + 1])[2]] for i in range(1, len(words) - 1)]
        emission = np.stack([scores(f) for f in found])
        moves = tagger.transitions + np.stack([change.get(first + i, np.zeros(size)) for i in range(size + 1)]) + allowed
        score, back = moves[-1] + emission[0], []
        for e in emission[1:]:
            reached = score[:, None] + moves[:-1]
            back.append(reached.argmax(0))
            score = reached.max(0) + e
        best = [int(score.argmax())]
        for b in reversed(back):
            best.append(int(b[best[-1]]))
        best.reverse()
        if best == gold:
            continue
        wrong += 1
        for i, (a, b) in enumerate(zip(gold, best, strict=True)):
            if a != b:
                for r in found[i]:
                    add(r, a, 1, step)
                    add(r, b, -1, step)
            before = (gold[i - 1], best[i - 1]) if i else (size, size)
            if (before[0], a) != (before[1], b):
                add(first + before[0], a, 1, step)
                add(first + before[1], b, -1, step)
    return change, timed, len(work), wrong


def _shard(shared):
    """For applyInArrow: a shard's changes by row; row -1 has the number of its sentences and of those it got wrong."""

    def run(key, table):
        order = sorted(zip(table.column("text").to_pylist(), ([(s["start"], s["end"], s["entity_type"]) for s in x] for x in table.column("spans").to_pylist()), strict=True))
        change, timed, n, wrong = _epoch(shared.value, [t for t, _ in order], [s for _, s in order])
        # the average over the steps counts a change from the step it was made
        mean = {r: np.rint((c - timed[r] / max(n, 1)) * UNIT).astype(np.int64) for r, c in change.items()}
        last = [*(c.astype(np.int64).tolist() for c in change.values()), [n, wrong]]
        return pa.table({"row": pa.array([*change, -1], pa.int64()), "change": pa.array(last, pa.list_(pa.int64())), "mean": pa.array([*(mean[r].tolist() for r in change), [0, 0]], pa.list_(pa.int64()))})

    return run


def fit(examples: DataFrame, types: tuple[str, ...] = ("PERSON", "LOCATION"), epochs: int = 5, bits: int = 17) -> tuple[Tagger, list[float]]:
    """(a tagger trained on EXAMPLES, the share of sentences that each epoch got wrong).  Spans of other types are not read."""
    rows = examples.select(F.coalesce("text", F.lit("")).alias("text"), F.filter(F.coalesce("spans", F.array().cast("array<struct<start:int,end:int,entity_type:string>>")), lambda s: s["entity_type"].isin(*types)).alias("spans"))
    shards = max(1, math.ceil(rows.count() / SHARD))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int"))
    size = 1 + 2 * len(types)
    tagger = Tagger(tuple(types), np.zeros((1 << bits, size), np.float32), np.zeros((size + 1, size)))
    mean_w, mean_t, mistakes = np.zeros((1 << bits, size)), np.zeros((size + 1, size)), []
    sc = examples.sparkSession.sparkContext
    for _ in range(epochs):
        shared = sc.broadcast(tagger)

        parts = rows.groupBy("shard").applyInArrow(_shard(shared), "row long, change array<long>, mean array<long>")
        sums = [F.sum(F.get(c, F.lit(i))).alias(f"{c}{i}") for c in ("change", "mean") for i in range(size)]
        weights, moves = tagger.weights.astype(np.float64), tagger.transitions.copy()
        average_w, average_t = weights.copy(), moves.copy()
        for r in parts.groupBy("row").agg(*sums, F.count(F.lit(1)).alias("shards")).toLocalIterator():  # 2**bits + size + 2 rows at most
            if r["row"] < 0:
                mistakes.append(r["change1"] / max(r["change0"], 1))
                continue
            # the mean of the shards that changed the row: over all of them, what few saw would fade as shards grow in number
            change, mean = np.array(r[1 : size + 1], float) / r["shards"], np.array(r[size + 1 : 2 * size + 1], float) / (UNIT * r["shards"])
            to, average, at = (weights, average_w, r["row"]) if r["row"] < len(weights) else (moves, average_t, r["row"] - len(weights))
            to[at] += change
            average[at] += mean
        tagger = Tagger(tuple(types), weights.astype(np.float32), moves)
        mean_w += average_w / epochs
        mean_t += average_t / epochs
        shared.unpersist()
    return Tagger(tuple(types), mean_w.astype(np.float32), mean_t), mistakes


def accuracy(found: DataFrame, gold: DataFrame, *by: str) -> DataFrame:
    """entity_type, gold, found, correct, recall, precision of entity rows (by, start, end, entity_type) against labelled ones."""
    keys = [*by, "start", "end", "entity_type"]
    both = found.select(*keys, F.lit(1).alias("f"), F.lit(0).alias("g")).unionByName(gold.select(*keys, F.lit(0).alias("f"), F.lit(1).alias("g")))
    one = both.groupBy(*keys).agg(F.max("f").alias("f"), F.max("g").alias("g"))
    counts = one.groupBy("entity_type").agg(F.sum("g").alias("gold"), F.sum("f").alias("found"), F.sum(F.col("f") * F.col("g")).alias("correct"))
    share = lambda whole: F.when(F.col(whole) > 0, F.col("correct") / F.col(whole))
    return counts.select("entity_type", "gold", "found", "correct", share("gold").alias("recall"), share("found").alias("precision"))
