"""Toxicity by compression distance.

A window is a run of one, two or three words (`widths`), lower-cased, between blanks.  For each width two zstandard
dictionaries are made, one of windows of toxic and one of windows of ordinary text.  A window is compressed with each.
Its gain is the bytes that the toxic dictionary saves against the ordinary one, less the bytes it needs beyond what a
window of its own takes; a document's distance is its largest gain of a width, thresholds calibrated on the training
sample turn the distances into scores, and the largest score counts.  So the order of ordinary words counts: a passage
made of them tells by its windows of two and three words.  Windows of more than one word are compressed where they
share a word pair with the toxic dictionary; without one, no order of words is explained, and single words have their
own width.

A window is short against zstandard's fixed costs, so every byte is written as WIDTH bytes before compression; lengths
then resolve single letters.  Most windows of a toxic document are ordinary, so the toxic dictionary holds the windows
that tell: those in enough different toxic sample documents that are that much rarer in ordinary ones.  How many are
enough is no fixed share: each of SHARES parts of the sample is measured by dictionaries of the others, and of LEVELS the
one that separates the classes best there is taken, with its threshold, for each width in turn; a wider width is
left out where it adds nothing.  The dictionaries are then made of the whole sample.  The ordinary dictionary holds the
windows most common in ordinary documents, for the wider widths with the commonest words.

Labels are learned from a bounded sample: of the rows allowed for training, the `sample` with the smallest hashes of
each class, each with its whole text; the sample's windows are counted by Spark, and the driver receives at most
`dictionary_windows` of them a class and width, and the gains of each sample document.

The sizes of the dictionaries (`toxic_bytes`, `ordinary_bytes`, before widening) and the number of windows they are chosen
from are the model's size, as the number of buckets is elsewhere.  Every single word of every text is scored, and of the
wider windows those that share a word pair with the toxic dictionary; the others are not compressed.

zstandard's own trainer cuts segments at any byte and spends most of a small dictionary on pieces of telling words: with
it, and with plain bytes, windows of 3 or 4 words found 52 to 55 % of held-out toxic documents at 3 to 5 % of the clean
ones (sf0.1), against 92 % at 1 % of these dictionaries.  So the dictionaries are made here, as raw content.

Cases: null, empty or blank text: no window, gain -99.  Repeated rows are scored each.  Without labels of both classes,
or without telling windows, every score is 0.  Null doc_id: scored, not held out.  Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, column, forget, remainder_is, slices, words, written
from .quality import POINT, SCORES, sample_of

#: Bytes written for one.
WIDTH = 3
#: For each byte, the bytes written behind it.
OTHERS = tuple(bytes((b * times + more) % 256 for b in range(256)) for times, more in ((167, 13), (91, 7)))
#: Toxic sample documents that a telling window is in, at least: the choices.
LEVELS = (3, 4, 5, 6, 8, 12, 24)
#: Shares of the sample that are measured by dictionaries of the others.
SHARES = 4
NONE = -99


def widened(text: bytes) -> bytes:
    """Each byte as WIDTH bytes, the byte and fixed linear functions of it."""
    out = bytearray(WIDTH * len(text))
    out[::WIDTH] = text
    for i, other in enumerate(OTHERS, 1):
        out[i::WIDTH] = text.translate(other)
    return bytes(out)


def plain_words(text: str | None) -> list[bytes]:
    return [w for w in (w.strip(b".,;:!?&$%#*\"'()|") for w in words(text, lower=True)) if w]


def windows(found: list[bytes], width: int) -> list[bytes]:
    """Runs of `width` words at every word."""
    return found if width == 1 else [b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    n = max(10, len(content).bit_length()) + 1
    params = zstandard.ZstdCompressionParameters(window_log=n, hash_log=n, chain_log=n, search_log=6, min_match=4, target_length=32, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


@dataclass(frozen=True)
class Part:
    """The dictionaries of one width."""

    toxic: bytes
    ordinary: bytes
    width: int
    floor: int  # the median length of the toxic dictionary's own windows under it
    pairs: frozenset  # the word pairs of the toxic dictionary
    point: float = 0.0

    def windows(self, found: list[bytes]):
        """The windows of words that the dictionaries are asked about."""
        if self.width == 1:
            return found
        pairs, width, last = self.pairs, self.width, len(found) - self.width
        at = {k for i, pair in enumerate(zip(found, found[1:], strict=False)) if pair in pairs for k in range(max(0, i - width + 2), min(i, last) + 1)}
        return [b" ".join(found[k : k + width]) for k in at]

    def distance(self, cached: int = 250_000):
        """words -> the largest gain of their windows."""
        gains = meter([self])
        gain = Cache(lambda window: gains(window)[0], cached)
        return lambda found: max(map(gain.__getitem__, self.windows(found)), default=NONE)


def meter(parts: list[Part | None]):
    """window -> its gain under each of parts.  A window that a toxic dictionary explains too badly for any gain has gain
    NONE.  The parts share their ordinary dictionary, and the toxic ones hold ever fewer of the same windows: what the first
    explains too badly the others do too.  A window is widened once and compressed once with each different dictionary."""
    none = (NONE,) * len(parts)
    if not parts[0]:
        return lambda window: none
    kinds = list(dict.fromkeys((p.toxic, p.floor) for p in parts if p))
    place = [kinds.index((p.toxic, p.floor)) if p else len(kinds) for p in parts]
    toxic, ordinary = [(compressor(content).compress, floor) for content, floor in kinds], compressor(parts[0].ordinary).compress

    def gains(window: bytes) -> tuple[int, ...]:
        data, found, plain = widened(b" %b " % window), [], None
        for compress, floor in toxic:
            t = len(compress(data))
            if t - floor > 10 and 2 * t >= len(data) + 20 + floor:
                if not found:
                    return none
                found.append(NONE)
                continue
            if plain is None:
                plain = len(ordinary(data))
            found.append(plain - t - max(0, t - floor))
        found.append(NONE)
        return tuple([found[i] for i in place])

    return gains


def distances(parts: list[Part | None], cached: int = 50_000):
    """words -> the largest gain under each of parts, as in meter()."""
    none = (NONE,) * len(parts)
    if not parts[0]:
        return lambda found: none
    gains = Cache(meter(parts), cached)
    return lambda found: tuple(map(max, zip(none, *{gains[w] for w in parts[0].windows(found)}, strict=True)))


@dataclass(frozen=True)
class Model:
    parts: tuple[Part, ...] = ()

    def scorer(self):
        """text -> score."""
        parts = [(p.distance(250_000 if p.width == 1 else 50_000), p.point) for p in self.parts]
        base = math.log(POINT / (1 - POINT))

        def score(text: str | None) -> float:
            found = plain_words(text)
            x = max((distance(found) - point for distance, point in parts), default=-1000.0) + base
            return 1 / (1 + math.exp(-x)) if x > -700 else 0.0

        return score


def part_of(bad: list[tuple[bytes, int]], good: bytes, width: int, size: int) -> Part | None:
    """The part whose toxic dictionary is made of bad; None without windows."""
    if not bad or not good:
        return None
    toxic = dictionary(bad, size)
    own = compressor(toxic)
    floor = sorted(len(own.compress(widened(b" %b " % w))) for w, _ in bad)[len(bad) // 2]
    pairs = frozenset(p for w, _ in bad for p in zip(w.split(), w.split()[1:], strict=False))
    return Part(toxic, good, width, floor, pairs)


def dictionary(samples: list[tuple[bytes, int]], size: int) -> bytes:
    """The windows' text, the commonest last, where matches cost least, as far as `size` bytes go."""
    text = b"".join(b" %b " % w for w, _ in sorted(samples, key=lambda x: (x[1], x[0])))
    return widened(text)[-size * WIDTH :]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = 3000, folds: int = 4, test_fold: int = 2, widths: tuple[int, ...] = (1, 2, 3), least: int = 3, ratio: float = 10.0, toxic_bytes: int = 32_768, ordinary_bytes: int = 8192, dictionary_windows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    chosen = sample_of(labels, label, sample, folds, test_fold)  # at most 2 * sample rows, so it is broadcast
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("label", "text")

    def split(batches):
        for batch in slices(batches, 200):
            rows = []
            for y, share, text in zip(column(batch, "label"), column(batch, "share"), column(batch, "text"), strict=True):
                found = plain_words(text)
                rows += [(SHARES * y + share, width, w) for width in widths for w in set(windows(found, width))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["k", "width", "window"])

    # copies of one document count once, so that the words of a copied text do not tell
    seen = base.withColumn("h", F.xxhash64("text")).dropDuplicates(["label", "h"])
    seen = written(seen.select("label", F.pmod("h", F.lit(SHARES)).cast("int").alias("share"), "text"))
    sizes = {(r["label"], r["share"]): r["count"] for r in seen.groupBy("label", "share").count().collect()}
    if len({y for y, _ in sizes}) < 2:
        forget(seen)
        return Model()
    counts = [F.sum((F.col("k") == k).cast("int")).alias(f"c{k}") for k in range(2 * SHARES)]
    counted = written(seen.mapInArrow(split, "k int, width int, window binary").groupBy("width", "window").agg(*counts).filter(" + ".join(f"c{k}" for k in range(2 * SHARES)) + " > 1"))
    every = tuple(range(SHARES))
    others = [tuple(h for h in every if h != share) for share in every]

    def tells(shares, value):
        """Whether a window with counts value(k) is that much rarer in ordinary documents of the shares."""
        n = [max(1, sum(sizes.get((y, h), 0) for h in shares)) for y in (0, 1)]
        good, bad = (sum((value(f"c{SHARES * y + h}") for h in shares[1:]), value(f"c{SHARES * y + shares[0]}")) for y in (0, 1))
        return (bad * (n[0] / n[1]) >= ratio * (good + 0.5)) & (bad >= min(LEVELS))

    total = [reduce(add, (F.col(f"c{SHARES * y + h}") for h in every)) for y in (0, 1)]
    found = {}
    for width in widths:
        own = counted.filter(F.col("width") == width)
        bad = own.filter(reduce(or_, (tells(x, F.col) for x in (*others, every)))).orderBy(total[1].desc(), "window").limit(dictionary_windows).collect()
        good = own.filter(~tells(every, F.col)).orderBy(total[0].desc(), "window").limit(dictionary_windows).select("window", total[0].alias("n")).collect()
        found[width] = bad, [(bytes(r["window"]), r["n"]) for r in good]
    common = found[min(widths)][1]

    def part(width: int, shares: tuple[int, ...], enough: int) -> Part | None:
        bad = [(bytes(r["window"]), sum(r[f"c{SHARES + h}"] for h in shares)) for r in found[width][0] if tells(shares, r.__getitem__)]
        good = found[width][1]
        ordinary = dictionary(good, ordinary_bytes) if width == 1 else dictionary(common, ordinary_bytes // 2) + dictionary(good, ordinary_bytes // 2)
        return part_of([x for x in bad if x[1] >= enough], ordinary, width, toxic_bytes)

    kinds = [(width, level) for width in widths for level in LEVELS]
    shared = docs.sparkSession.sparkContext.broadcast([[part(width, others[share], level) for width, level in kinds] for share in every])

    def measure(batches):
        at, meters = None, []
        for batch in slices(batches, 200):
            rows = []
            for share, text in zip(column(batch, "share"), column(batch, "text"), strict=True):
                if share != at:
                    at, meters = share, [distances(shared.value[share][i : i + len(LEVELS)]) for i in range(0, len(kinds), len(LEVELS))]
                found = plain_words(text)
                rows.append([g for m in meters for g in m(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["label", "gains"])

    table = seen.sortWithinPartitions("share").mapInArrow(measure, "label int, gains array<long>").collect()  # at most 2 * sample rows
    forget(seen, counted)
    y, gains = np.array([r["label"] for r in table]), np.array([r["gains"] for r in table], np.int64)
    flagged, parts = np.zeros(len(y), bool), []
    for width in widths:
        best = max((calibrate(y, gains[:, k], flagged) + (k,) for k, (w, _) in enumerate(kinds) if w == width), key=lambda x: (x[0], x[2]))
        now = quality(y, flagged)
        made = part(width, every, max(least, kinds[best[2]][1])) if best[0] > now else None
        if made:
            flagged |= gains[:, best[2]] >= best[1]
            parts.append(Part(made.toxic, made.ordinary, width, made.floor, made.pairs, best[1] - 0.5))
    return Model(tuple(parts))


def quality(y: np.ndarray, flagged: np.ndarray, clean: float = 4.0) -> float:
    """The recall plus `clean` times the share of ordinary documents kept."""
    return float(flagged[y == 1].mean() + clean * (1 - flagged[y == 0].mean()))


def calibrate(y: np.ndarray, gains: np.ndarray, flagged: np.ndarray) -> tuple[float, int]:
    """(quality, cut): the gain from which documents are flagged, besides those that are, with the best quality."""
    cuts = sorted({int(g) for g in gains if g > NONE} | {int(gains.max()) + 1})
    return max((quality(y, flagged | (gains >= c)), c) for c in cuts)


def apply(docs: DataFrame, model: Model, folds: int = 4, test_fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES, one row for each row of docs; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), remainder_is(F.col(id_col), folds, test_fold).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches):
        scored = shared.value.scorer()
        for batch in slices(batches):
            score = [scored(t) for t in column(batch, "text")]
            predicted = pa.array([int(s >= POINT) for s in score], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), predicted], ["doc_id", "held_out", "score", "predicted"])

    return base.mapInArrow(run, SCORES)


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model does not predict toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    place = docs.columns.index(text_col)

    def run(batches):
        scored = shared.value.scorer()
        for batch in slices(batches):
            ok = [scored(t) < POINT for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, test_fold: int = 2, **options) -> DataFrame:
    """Learn from the rows outside the test fold, then score every row of docs."""
    return apply(docs, learn(docs, labels, label, folds=folds, test_fold=test_fold, **options), folds, test_fold)
