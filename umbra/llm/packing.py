"""Best-fit packing of token sequences under several capacities at once.

Documents are tokenised in one narrow pass that keeps only piece metadata (a few dozen bytes each); the metadata is
written to the shared folder, dealt evenly into groups of about `group_pieces`, and each group is packed by vector
best-fit: pieces by decreasing length, each into the open bin that satisfies every capacity and scores best.
Capacities of a bin: tokens, documents, and attention cost (the sum of squared piece lengths).  A bin's score for a
piece is the weighted dot product of the piece's demands and the bin's residuals (small residuals win), or the
weighted norm of the residuals that would be left.

Cases: a null or empty text is the separator alone (one id).  Repeated rows are separate documents.  Pieces of equal
length go by doc_id, piece.  Empty input gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cache, column, slices, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


#: Letters whose normal form and piece depend on the letter alone: those of ASCII and Latin-1.
LETTERS = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()] + [c for c in map(chr, range(0x41, 0x7B)) if c.isalpha()]


def letter_model(tokenizer):
    """word -> ids for words of LETTERS, by the model alone; None if probes show that this tokenizer needs more.

    The table from letters to what the model reads comes from the tokenizer's own normalizer and pre-tokenizer."""
    if tokenizer.normalizer is None or tokenizer.pre_tokenizer is None:
        return None
    pieces = {c: tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c)) for c in LETTERS}
    if any(len(p) != 1 for p in pieces.values()):
        return None
    table, model = {ord(c): p[0][0] for c, p in pieces.items()}, tokenizer.model

    def ids(word: str) -> list[int]:
        return [t.id for t in model.tokenize(word.translate(table))]

    probes = [*LETTERS, *(a + b for a, b in zip(LETTERS, reversed(LETTERS), strict=True)), "".join(LETTERS), "Straße", "internationalisation", "ÉLÈVEs"]
    if not all(ids(w) == tokenizer.encode(w, add_special_tokens=False).ids for w in probes):
        return None
    ids.folds = all(ids(w) == ids(w.lower()) for w in probes)  # whether case matters to this tokenizer
    return ids


@functools.lru_cache(1)
def encoder(tokenizer_path: str, cached_words: int = 500_000, keep: bool = True):
    """text -> numpy uint32 ids, equal to Tokenizer.encode(text, add_special_tokens=False).ids.

    The tokenizer drops white space before it looks for words, so a text is encoded word by word with a bounded cache.
    A word's leading letters go to the model directly, where letter_model() can; the marks behind them are words too.
    A Python worker keeps the tokenizer, and with `keep` the cache too, for its next tasks.
    Texts are cut at plain spaces and line feeds only; any other white space stays for the tokenizer.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    of_letters, only_letters = letter_model(tokenizer), re.compile(f"[{''.join(LETTERS)}]+").fullmatch

    def encode(s: str) -> list[int]:
        return tokenizer.encode(s, add_special_tokens=False).ids

    marks = Cache(lambda s: array("I", encode(s)).tobytes(), 10_000, keep)
    stems = Cache(lambda s: array("I", of_letters(s)).tobytes(), cached_words // 2, keep)

    def word(w: str) -> bytes:
        stem = w.rstrip(".,;:!?&$%#*")
        if of_letters and (stem.isalpha() if stem.isascii() else only_letters(stem)):
            ids = stems[stem.lower() if of_letters.folds else stem]
            return ids + marks[w[len(stem) :]] if len(stem) < len(w) else ids
        return array("I", encode(w)).tobytes()

    cache = Cache(word, cached_words, keep)

    def ids(text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        return np.frombuffer(b"".join(map(cache.__getitem__, filter(None, text.replace("\n", " ").split(" ")))), "<u4")

    return ids


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 500_000, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the separator, cut at multiples of capacity."""

    def run(batches):
        ids = encoder(tokenizer_path, cached_words, keep)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                all_ids = np.append(ids(text), np.array([separator], "<u4")).astype("<u4")
                for k, start in enumerate(range(0, len(all_ids), capacity)):
                    part = all_ids[start : start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.tobytes())))
            names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float, weights=(1.0, 0.05, 0.05), rule: str = "dot") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the order given.  A piece that alone breaks a capacity is an error.

    rule "dot": the feasible bin with the smallest weighted dot product of demand and residual; "norm": with the
    smallest weighted norm of what would be left.  Ties go to the oldest bin.  All demands are shares of a capacity.
    Bins that cannot take even the smallest piece are closed, so that the search stays short.
    """
    lengths = np.asarray(lengths, np.int64)
    cap = np.array([capacity, max_docs, max_cost], float)
    w = np.asarray(weights, float)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    if not len(lengths):
        return bins, offsets
    if lengths.max() > capacity or max_docs < 1 or float(lengths.max()) ** 2 > max_cost:
        raise ValueError("a piece is larger than a bin")
    least = int(lengths.min())
    left = np.empty((3, 64))  # residuals of open bins
    number, filled = np.empty(64, np.int64), np.empty(64, np.int64)
    n_open = made = 0
    for i, size in enumerate(lengths.tolist()):
        need = np.array([size, 1.0, float(size) * size])
        chosen = -1
        if n_open:
            room = left[:, :n_open]
            fits = (room >= need[:, None]).all(0)
            if fits.any():
                score = (w * need / cap**2) @ room if rule == "dot" else w @ ((room - need[:, None]) / cap[:, None]) ** 2
                chosen = int(np.argmin(np.where(fits, score, np.inf)))
        if chosen < 0:
            if n_open == left.shape[1]:
                left = np.concatenate([left, np.empty_like(left)], 1)
                number, filled = np.concatenate([number, number]), np.concatenate([filled, filled])
            chosen, n_open = n_open, n_open + 1
            left[:, chosen], number[chosen], filled[chosen] = cap, made, 0
            made += 1
        bins[i], offsets[i] = number[chosen], filled[chosen]
        left[:, chosen] -= need
        filled[chosen] += size
        if left[0, chosen] < least or left[1, chosen] < 1 or left[2, chosen] < float(least) ** 2:
            last = n_open - 1
            left[:, chosen : last] = left[:, chosen + 1 : n_open]
            number[chosen:last], filled[chosen:last] = number[chosen + 1 : n_open], filled[chosen + 1 : n_open]
            n_open = last
    return bins, offsets


def pack_pieces(found: DataFrame, capacity: int = 2048, max_docs: int | None = None, max_cost: float | None = None, weights=(1.0, 0.05, 0.05), rule: str = "dot", group_pieces: int = 16_384) -> DataFrame:
    """PACKED rows of a written table of pieces.  By default no capacity but the tokens can bind."""
    max_docs, max_cost = max_docs or capacity, max_cost or float(capacity) ** 2
    groups = max(1, -(-found.count() // group_pieces))
    salt = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())  # repeated rows are spread too

    def run(key, batch_table):
        # by Arrow: ids beside a null stay 64-bit integers
        t = batch_table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = best_fit(t.column("length").to_numpy(), capacity, max_docs, max_cost, weights, rule)
        ids = (key[0].as_py() << 32) + bins
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        out = [t.column(n) for n in names]
        return pa.Table.from_arrays([*out, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    dealt = found.withColumn("_group", F.pmod(salt, F.lit(groups)).cast("long"))
    return dealt.groupBy("_group").applyInArrow(run, PACKED)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, separator: int = 0, id_col: str = "doc_id", text_col: str = "text", cached_words: int = 500_000, keep: bool = True, **options) -> DataFrame:
    """Tokenise and pack whole documents: one row a piece (PACKED)."""
    return pack_pieces(written(pieces(docs, tokenizer_path, capacity, separator, id_col, text_col, cached_words, keep)), capacity, **options)


def texts_of(packed: DataFrame, docs: DataFrame) -> DataFrame:
    """packed with the documents' texts, for a writer that materialises the ids of each sequence."""
    return packed.join(docs.select("doc_id", "text"), "doc_id")
