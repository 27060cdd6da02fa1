"""Language-model scoring by deleted interpolation of n-gram maximum-likelihood estimates.

P(w | context) = sum over k of weight[bucket, k] * f_k, with f_0 = 1 / (V + 1), f_1 = c(w) / N and
f_k = c(last k-1 tokens, w) / c(last k-1 tokens); the bucket is the power of two of how often the longest context was
seen.  The weights of each bucket are learned by expectation-maximisation on a fold of the training documents whose
counts are deleted for that purpose.

How the counts reach the documents.  Counts of all n-grams of a large corpus fit no broadcast, and a row per token is
a shuffle many times the input.  So documents are dealt into blocks of bounded size; a block asks for the counts of
its distinct n-grams only, as compressed sorted hashes, one request for each hash range; the task of a range adds up
what all blocks counted and sends each block its totals in the order asked.  Beyond 2**FAN ranges requests go in two steps:
a block asks collectors, one for each of 2**FAN coarse ranges and its lane; a collector merges what the blocks of its lane
ask and asks the ranges; the answers go back the same way.  So no task sends or gets more than some 2**FAN messages, and
their number grows with the corpus and not with its square.  Two more passes over the blocks learn the weights and score.  Unigrams are held by 64-bit hashes; longer n-grams by 32 bits within a range, and the number of
ranges follows the corpus, so that a few n-grams in ten thousand share a count at any size.

Cases: null or empty text: the end token alone.  Repeated rows are separate documents.  A null doc_id belongs to the
training documents.  Without training documents every weight lies on f_0 = 1.  Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, crc_mod, words, written

END, BOS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
STEPS = 4  # cells an octave in which EM holds the estimates
BUCKETS = 44
FAN = 10  # bits of hash ranges that a task sends to
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _planes(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes())


def _unplanes(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype) if len(raw) else np.zeros(0, dtype)


class Grams:
    """The n-grams of a block of documents: for each order the distinct keys and each token's place among them."""

    def __init__(self, texts: list, order: int, bits: int, cache: Cache):
        hashes = [np.fromiter(map(cache.__getitem__, words(t, lower=True)), np.uint64) for t in texts]
        self.sizes = np.array([len(h) + 1 for h in hashes], np.int64)
        pad = order - 1
        head, tail = np.full(pad, BOS, np.uint64), np.array([END], np.uint64)
        stream = np.concatenate([x for h in hashes for x in (head, h, tail)]) if hashes else np.zeros(0, np.uint64)
        ends = np.cumsum(self.sizes + pad)
        real = np.ones(len(stream), bool)
        for k in range(pad):
            real[ends - self.sizes - pad + k] = False
        self.token = np.flatnonzero(real)  # where the tokens are in the padded stream
        self.doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.keys, self.at = [], []
        gram = stream
        for k in range(1, order + 1):
            if k > 1:
                before = np.concatenate([gram[:1], gram[:-1]]) if len(gram) else gram
                gram = _mix(before * np.uint64(0x9FB21C651E98DF25) + stream)
            keys, at = np.unique(gram if k == 1 else gram >> np.uint64(32 - bits), return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
        self.pad, self.spread = pad, np.repeat(np.arange(len(texts)), self.sizes + pad)

    def counted(self, k: int, docs: np.ndarray) -> np.ndarray:
        """How often each key of order k+1 ends at a token, or (order 1) is the pad, in the documents marked.

        The pad counts once a document, as the context of its first token."""
        mark = docs[self.spread]
        if self.pad:
            use = mark.copy()
            use[:] = False
            use[self.token] = mark[self.token]
            first = self.token[np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)] - 1 if len(self.sizes) else np.zeros(0, np.int64)
            if k + 1 < self.pad + 1:
                use[first] = docs
            mark = use
        return np.bincount(self.at[k][mark], minlength=len(self.keys[k])).astype(np.uint32)


def _ranges(keys: np.ndarray, k: int, bits: int, first: int | None = None) -> list[tuple[int, int, int]]:
    """(range, from, to) of the sorted keys that lie in each of 2**first ranges that has any; keys of longer n-grams have
    32 + bits bits."""
    first = bits if first is None else first
    top = (keys >> np.uint64(64 - first if k == 0 else 32 + bits - first)).astype(np.int64) if first else np.zeros(len(keys), np.int64)
    found, start = np.unique(top, return_index=True)
    return list(zip(found.tolist(), start.tolist(), [*start[1:].tolist(), len(keys)], strict=True))


def _packed_keys(keys: np.ndarray, whole: bool) -> bytes:
    """Sorted keys of a range by their differences; not whole: their last 32 bits alone."""
    return _planes(np.diff(keys, prepend=np.uint64(0)) if whole else np.diff((keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), prepend=np.uint32(0)))


def _whole_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(b, np.uint64), dtype=np.uint64)


REQUEST = "rng long, ord int, block long, keys binary, counts binary"
_REQUEST = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _requests(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([x[i] for x in rows], ty) for i, ty in enumerate(_REQUEST)], ["rng", "ord", "block", "keys", "counts"])


def _word_cache() -> Cache:
    return Cache(xxhash.xxh3_64_intdigest, 150_000)


def learn_weights(cells: np.ndarray, order: int, unigram_floor: float, rounds: int = 60) -> np.ndarray:
    """EM.  cells: rows (bucket, q_1 .. q_order, n) of held-out tokens; q is STEPS * log2 f, or 1 where f is 0."""
    start = np.array([0.1] + [0.9 / order] * order)
    out = np.tile(start, (BUCKETS, 1))
    if not len(cells):
        return _unseen(out)
    f = np.where(cells[:, 1:-1] > 0, 0.0, 2.0 ** (cells[:, 1:-1] / STEPS))
    f = np.concatenate([np.full((len(f), 1), unigram_floor), f], 1)
    n = cells[:, -1].astype(float)

    def em(rows: np.ndarray) -> np.ndarray:
        w = start.copy()
        for _ in range(rounds):
            share = f[rows] * w
            share *= (n[rows] / share.sum(1))[:, None]
            new = share.sum(0) / share.sum()
            new = np.maximum(new, 1e-7) / np.maximum(new, 1e-7).sum()
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        return w

    out[:] = em(np.arange(len(cells)))
    for b in np.unique(cells[:, 0]).astype(int):
        out[b] = em(np.flatnonzero(cells[:, 0] == b))
    return _unseen(out)


def _unseen(w: np.ndarray) -> np.ndarray:
    """Bucket 0 has an unseen context: its longest estimate has no weight."""
    w[0, -1] = 0
    w[0] /= w[0].sum()
    return w


def _buckets(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(int) + 1, 0)


class Model:
    """Totals, the order, and the estimates of a block's tokens from the counts that the block was sent."""

    def __init__(self, order: int, tokens: float, distinct: float):
        self.order, self.tokens, self.distinct = order, tokens, distinct

    def estimates(self, grams: Grams, counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(f_1 .. f_order as columns, bucket, unigram count) of each token."""
        own = [c[a[grams.token]].astype(float) for c, a in zip(counts, grams.at, strict=True)]
        before = [c[a[np.maximum(grams.token - 1, 0)]].astype(float) for c, a in zip(counts, grams.at, strict=True)]
        f = [own[0] / max(self.tokens, 1)] + [own[k] / np.maximum(before[k - 1], 1) * (before[k - 1] > 0) for k in range(1, self.order)]
        context = before[self.order - 2] if self.order > 1 else np.full(len(own[0]), self.tokens)
        return np.minimum(np.stack(f, 1), 1.0), _buckets(context), own[0]


def _replied(replies: pa.Table, grams: Grams, order: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(kept counts, deleted counts) of each order, in the order of the block's keys."""
    by = sorted(zip(column_of(replies, "ord"), column_of(replies, "rng"), column_of(replies, "counts"), strict=True), key=lambda x: x[:2])
    kept, deleted = [], []
    for k in range(order):
        both = [_unplanes(c, np.uint64).reshape(2, -1) for o, _, c in by if o == k]
        both = np.concatenate(both, 1) if both else np.zeros((2, 0), np.uint64)
        if both.shape[1] != len(grams.keys[k]):
            raise RuntimeError("a block was sent other counts than it asked for")
        kept.append(both[0].astype(np.int64))
        deleted.append(both[1].astype(np.int64))
    return kept, deleted


def _sums(at: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """Whole sums by place; no total wraps or is rounded."""
    out = np.zeros(n, np.uint64)
    np.add.at(out, at, counts.astype(np.uint64))
    return out


def column_of(t: pa.Table, name: str) -> list:
    return t.column(name).to_pylist()


def score(docs: DataFrame, order: int = 2, folds: int = 7, test_fold: int = 2, em_fold: int = 5, block_bytes: int = 8_000_000, range_bytes: int = 6_000_000, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCORES, one row for each row of docs."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).head()
    total = size["b"] + 16 * size["n"]
    blocks = max(1, -(-total // block_bytes))
    bits = max(0, (total // range_bytes).bit_length())
    first, lanes = min(bits, fan), 1 << max(0, bits - fan)
    fold = F.coalesce(crc_mod(F.col("doc_id"), folds), F.lit(-1))
    h = F.xxhash64("doc_id", "text")
    em_blocks = max(1, -(-blocks // folds))
    dealt = base.withColumns({"fold": fold.cast("int"), "block": F.when(fold == em_fold, blocks + F.pmod(h, F.lit(em_blocks))).otherwise(F.pmod(h, F.lit(blocks))).cast("long")})

    def request(t):
        fold_of = np.array(column_of(t, "fold"), int)
        grams = Grams(column_of(t, "text"), order, bits, _word_cache())
        rows = []
        for k in range(order):
            kept = grams.counted(k, (fold_of != test_fold) & (fold_of != em_fold))
            deleted = grams.counted(k, fold_of == em_fold)
            block = t.column("block")[0].as_py()
            for r, a, b in _ranges(grams.keys[k], k, bits, first):
                rows.append((r * lanes + block % lanes, k, block, _packed_keys(grams.keys[k][a:b], k == 0 or lanes > 1), _planes(np.concatenate([kept[a:b], deleted[a:b]]))))
        return _requests(rows)

    def collect(key, t):
        """What the blocks of a lane ask of a coarse range, as one request for each range in it."""
        collector, k = key[0].as_py(), key[1].as_py()
        asked = [_whole_keys(b) for b in column_of(t, "keys")]
        both = np.concatenate([_unplanes(b, np.uint32).reshape(2, -1) for b in column_of(t, "counts")], 1)
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        kept, deleted = (_sums(at, both[i], len(keys)) for i in (0, 1))
        return _requests([(r, k, collector, _packed_keys(keys[a:b], k == 0), _planes(np.concatenate([kept[a:b], deleted[a:b]]))) for r, a, b in _ranges(keys, k, bits)])

    def share(key, left, right):
        """The answers to a collector, for each block that asked it."""
        asked = [_whole_keys(b) for b in column_of(left, "keys")]
        if not asked:
            return pa.table({"block": pa.array([], pa.int64()), "ord": pa.array([], pa.int32()), "rng": pa.array([], pa.int64()), "counts": pa.array([], pa.binary())})
        keys = np.unique(np.concatenate(asked))
        got = sorted(zip(column_of(right, "rng"), column_of(right, "counts"), strict=True))
        both = np.concatenate([_unplanes(c, np.uint64).reshape(2, -1) for _, c in got], 1)
        if both.shape[1] != len(keys):
            raise RuntimeError("a collector was sent other counts than it asked for")
        counts = [_planes(both[:, np.searchsorted(keys, mine)].reshape(-1)) for mine in asked]
        n = len(asked)
        return pa.Table.from_arrays([left.column("block").combine_chunks(), pa.array([key[1].as_py()] * n, pa.int32()), pa.array([key[0].as_py() // lanes] * n, pa.int64()), pa.array(counts, pa.binary())], ["block", "ord", "rng", "counts"])

    def answer(key, t):
        rng, k = key[0].as_py(), key[1].as_py()
        dtype = np.uint64 if k == 0 else np.uint32
        asked = [np.cumsum(_unplanes(b, dtype), dtype=dtype) for b in column_of(t, "keys")]
        counts = [_unplanes(b, np.uint32 if lanes == 1 else np.uint64).reshape(2, -1) for b in column_of(t, "counts")]
        keys, at = np.unique(np.concatenate(asked), return_inverse=True)
        both = np.concatenate(counts, 1)
        kept, deleted = (_sums(at, both[i], len(keys)) for i in (0, 1))
        rows, start = [], 0
        for block, mine in zip(column_of(t, "block"), asked, strict=True):
            place = at[start : start + len(mine)]
            start += len(mine)
            rows.append((block, k, rng, _planes(np.concatenate([kept[place], deleted[place]])), 0, 0, 0, 0))
        if k == 0:
            true = keys != np.uint64(BOS)
            sums = [int(kept[true].sum(dtype=np.int64)), int(deleted[true].sum(dtype=np.int64)), int((kept[true] > 0).sum()), int((kept[true] + deleted[true] > 0).sum())]
            rows.append((-1, k, rng, b"", *sums))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
        names = ["block", "ord", "rng", "counts", "kept", "deleted", "kept_v", "all_v"]
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], ty) for i, ty in enumerate(types)], names)

    asked = dealt.groupBy("block").applyInArrow(request, REQUEST)
    if lanes > 1:
        of_blocks = written(asked)
        asked = of_blocks.groupBy("rng", "ord").applyInArrow(collect, REQUEST)
    replies = written(asked.groupBy("rng", "ord").applyInArrow(answer, "block long, ord int, rng long, counts binary, kept long, deleted long, kept_v long, all_v long"))
    sums = replies.filter("block = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept", "deleted", "kept_v", "all_v")]).head()
    answers = replies.filter("block >= 0").select("block", "ord", "rng", "counts")
    if lanes > 1:
        to_collectors = answers.withColumnRenamed("block", "collector").groupBy("collector", "ord")
        answers = written(of_blocks.withColumnRenamed("rng", "collector").groupBy("collector", "ord").cogroup(to_collectors).applyInArrow(share, "block long, ord int, rng long, counts binary"))
    part, whole = Model(order, sums["kept"], sums["kept_v"]), Model(order, sums["kept"] + sums["deleted"], sums["all_v"])

    def cells(left, right):
        grams = Grams(column_of(left, "text"), order, bits, _word_cache())
        kept, _ = _replied(right, grams, order)
        f, bucket, _ = part.estimates(grams, kept)
        q = np.where(f > 0, np.round(STEPS * np.log2(np.maximum(f, 1e-300))), 1).astype(np.int64)
        found, n = np.unique(np.concatenate([bucket[:, None], q], 1), axis=0, return_counts=True)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in [*found.T, n]], [*names, "n"])

    names = ["b", *[f"q{k}" for k in range(1, order + 1)]]
    em = dealt.filter(F.col("fold") == em_fold).groupBy("block").cogroup(answers.filter(F.col("block") >= blocks).groupBy("block")).applyInArrow(cells, ", ".join(f"{c} long" for c in [*names, "n"]))
    held = em.groupBy(*names).agg(F.sum("n").alias("n")).toPandas() if part.tokens else None  # at most one row a cell
    weights = learn_weights(np.zeros((0, order + 2)) if held is None else held.to_numpy(), order, 1 / (part.distinct + 1))
    if not whole.tokens:
        weights[:] = np.array([1.0] + [0.0] * order)

    def scored(left, right):
        texts = column_of(left, "text")
        grams = Grams(texts, order, bits, _word_cache())
        kept, deleted = _replied(right, grams, order)
        f, bucket, c = whole.estimates(grams, [a + b for a, b in zip(kept, deleted, strict=True)])
        f = np.concatenate([np.full((len(f), 1), 1 / (whole.distinct + 1)), f], 1)
        p = (weights[bucket] * f).sum(1)
        add = lambda x: np.bincount(grams.doc, weights=x, minlength=len(texts))
        base_score = add(np.log10((c + 1) / (whole.tokens + whole.distinct + 1)))
        out = [left.column("doc_id").combine_chunks(), pa.array(np.array(column_of(left, "fold"), int) == test_fold), pa.array(grams.sizes), pa.array(add(c > 0).astype(np.int64)), pa.array(np.full(len(texts), whole.tokens, np.int64)), pa.array(base_score), pa.array(add(np.log10(p)))]
        return pa.Table.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, SCORES)
