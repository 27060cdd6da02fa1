"""Long lists of phrases found in texts: an Aho-Corasick automaton over tokens, and a join for lists of any size.

A text is a row of tokens: words, blanks, and single other characters; a phrase occurs where its tokens stand in a row.  So
an edge of a phrase that is a word is always a whole word, and a text is read once, whatever the list's length.

The automaton is a trie of the phrases' tokens with failure links, held in arrays: sorted (state, token) keys and their
targets, and for each state its failure link, its depth, whether a phrase ends, and the next shorter phrase that ends with
it.  It is built level by level, all states of a level at once.  A batch of texts is cut into pieces that overlap by the
longest phrase, and all pieces take each step together.  The list is collected and the automaton broadcast up to
MOST_BYTES of phrases, measured before; beyond that `joined()` finds the same by a shuffle.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.errors import ValidationError
from umbra.functions.arrays import exploded, kept_in_order

from .detect import BatchRecognizer

TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
#: Bytes of phrases up to which a list becomes an automaton (some 20 bytes of it for each byte of phrases).
MOST_BYTES = 64 << 20
#: Tokens of a piece of a text, and characters of the texts that are read side by side.
PIECE, TOGETHER = 256, 1 << 21
U = np.uint64


def tokens(phrase: str, fold: bool) -> list[str]:
    found = TOKEN.findall(phrase.strip())
    return [t.casefold() for t in found] if fold else found


class Automaton:
    def __init__(self, phrases, fold: bool = False):
        """phrases: texts; blank ones are left out.  fold: capital and small letters are alike."""
        self.fold = fold
        many = [t for t in (tokens(p, fold) for p in phrases if p) if t]
        self.words: dict[str, int] = {}
        for t in many:
            for w in t:
                self.words.setdefault(w, len(self.words) + 1)
        self.base = len(self.words) + 1
        lengths = np.array([len(t) for t in many], np.int64)
        self.longest = int(lengths.max()) if len(many) else 0
        order = np.argsort(-lengths, kind="stable")
        flat = np.array([self.words[w] for i in order for w in many[i]], np.int64)
        begin = np.concatenate([[0], np.cumsum(lengths[order])])[:-1] if len(many) else np.zeros(0, np.int64)
        lengths = lengths[order]
        state = np.zeros(len(many), np.int64)
        keys, parents, added, depth, n = [], [], [], [np.zeros(1, np.int32)], 1
        ends = []
        for level in range(self.longest):
            live = int(np.searchsorted(-lengths, -level, side="left"))  # longer than level
            unique, at = np.unique(state[:live] * self.base + flat[begin[:live] + level], return_inverse=True)
            keys.append(unique)
            parents.append(unique // self.base)
            added.append(unique % self.base)
            state[:live] = n + at
            depth.append(np.full(len(unique), level + 1, np.int32))
            ends.append(state[:live][lengths[:live] == level + 1])
            n += len(unique)
        self.depth = np.concatenate(depth)
        self.ends = np.zeros(n, bool)
        for e in ends:
            self.ends[e] = True
        whole = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        rank = np.argsort(whole, kind="stable")
        self.keys, self.targets = whole[rank], (rank + 1).astype(np.int32)
        self.fail, self.shorter = np.zeros(n, np.int32), np.zeros(n, np.int32)
        first = 1
        for parent, word in zip(parents, added, strict=True):
            own = np.arange(first, first + len(parent))
            if first > 1:  # the first level falls back to the root
                self.fail[own] = self.step(self.fail[parent], word)
            to = self.fail[own]
            self.shorter[own] = np.where(self.ends[to], to, self.shorter[to])
            first += len(parent)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.targets, self.fail, self.shorter, self.depth, self.ends))

    def step(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Where states go with words (0: a word of no phrase): along the trie, else from their failure links."""
        out = np.zeros(len(states), np.int64)
        todo, at = np.flatnonzero(words > 0), np.asarray(states, np.int64).copy()
        while len(todo) and len(self.keys):
            key = at[todo] * self.base + words[todo]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[todo[hit]] = self.targets[place[hit]]
            todo = todo[~hit & (at[todo] > 0)]
            at[todo] = self.fail[at[todo]]
        return out

    def matches(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """(start, end) of every occurrence of every phrase in each text, by start, the longest first."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size > TOGETHER:
                out += self._matches(some)
                some, size = [], 0
        return out + self._matches(some)

    def _matches(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not self.longest:
            return out
        before = self.longest - 1
        places, numbers, pieces = [], [], []
        for n, text in enumerate(texts):
            found = [m.span() for m in TOKEN.finditer(text or "")]
            get = self.words.get
            ids = np.array([get(text[a:b].casefold() if self.fold else text[a:b], 0) for a, b in found], np.int64)
            places.append(found)
            numbers.append(ids)
            pieces += [(n, i) for i in range(0, len(ids), PIECE) if ids[max(i - before, 0) : i + PIECE].any()]
        if not pieces:
            return out
        width = before + PIECE
        grid = np.zeros((len(pieces), width), np.int64)
        for row, (n, i) in enumerate(pieces):
            part = numbers[n][max(i - before, 0) : i + PIECE]
            lead = max(before - i, 0)
            grid[row, lead : lead + len(part)] = part
        state = np.zeros(len(pieces), np.int64)
        for t in range(width):
            if not state.any() and not grid[:, t].any():
                continue
            state = self.step(state, grid[:, t])
            if t < before:
                continue
            ending = np.where(self.ends[state], state, self.shorter[state])
            rows = np.flatnonzero(ending)
            ending = ending[rows]
            while len(rows):
                for row, size in zip(rows.tolist(), self.depth[ending].tolist(), strict=True):
                    n, i = pieces[row]
                    last = i + t - before
                    out[n].append((places[n][last - size + 1][0], places[n][last][1]))
                ending = self.shorter[ending]
                rows, ending = rows[ending > 0], ending[ending > 0]
        for spans in out:
            spans.sort(key=lambda s: (s[0], -s[1]))
        return out


def longest(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of matches by start, the longest first, those that begin at or after the end of the last that was kept."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if not out or a >= out[-1][1]:
            out.append((a, b))
    return out


@dataclass(frozen=True)
class PhraseModel:
    """For BatchRecognizer: the phrases of one type."""

    automaton: Automaton
    entity_type: str
    score: float
    all_matches: bool = False

    def find_all(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        found = self.automaton.matches(texts)
        return [[(a, b, self.entity_type, self.score) for a, b in (spans if self.all_matches else longest(spans))] for spans in found]


def phrases(entity_type: str, names, score: float = 0.7, fold: bool = False, all_matches: bool = False) -> BatchRecognizer:
    """Recognizes the given names, the leftmost and longest; all_matches: every occurrence, also within others."""
    return BatchRecognizer((entity_type,), PhraseModel(Automaton(names, fold), entity_type, score, all_matches))


def of_table(entity_type: str, names: DataFrame, column: str = "text", score: float = 0.7, fold: bool = False, most_bytes: int = MOST_BYTES) -> BatchRecognizer:
    """phrases() of a table whose phrases take at most `most_bytes`; a longer list raises, and joined() takes it."""
    rows = names.select(F.col(column).alias("p")).filter("p is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("p") + 16), F.lit(0)).alias("n")).head()["n"]
    if size > most_bytes:
        raise ValidationError(f"the phrases take {size} bytes, above {most_bytes}; use joined()")
    return phrases(entity_type, sorted(r["p"] for r in rows.toLocalIterator()), score, fold)


class TokenNumbers(dict):
    """token -> a number of 64 bits; the same in all workers."""

    def __missing__(self, token: str) -> int:
        if len(self) >= 200_000:
            self.clear()
        raw = token.encode("utf-8", "surrogatepass")
        out = zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x9E3779B9)
        if len(raw) <= 64:
            self[token] = out
        return out


def token_numbers(of: list[str]) -> np.ndarray:
    numbers = TokenNumbers()
    return np.array([numbers[t] for t in of], np.uint64)


def marks_of(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` tokens in a row."""
    out = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + len(out)]) * U(0x9FB21C651E98DF25)
        out ^= out >> U(29)
    return out


@dataclass(frozen=True)
class Listed:
    """Lets pass the marks (63 bits) of a list, and few others: a bitmap of 16 to 32 bits a phrase.

    A list beyond MOST_BITS (32 MB) has none; every piece passes then, and the join does all the work."""

    bits: int
    bitmap: np.ndarray | None

    MOST_BITS = 28

    @classmethod
    def of(cls, listed: DataFrame) -> Listed:
        bits = max(16, (16 * listed.count()).bit_length())
        if bits > cls.MOST_BITS:
            return cls(bits, None)
        per = 1 << (bits - 10)

        def build(key, table):
            own = np.zeros(per, bool)
            own[np.array(table.column("at").to_pylist(), np.int64) % per] = True
            return pa.table({"slice": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

        at = F.expr(f"mark % {1 << bits}")
        out = np.zeros(1 << (bits - 3), np.uint8)
        for r in listed.select(at.alias("at"), F.floor(at / per).cast("long").alias("slice")).groupBy("slice").applyInArrow(build, "slice long, bits binary").toLocalIterator():  # 1024 rows at most
            out[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
        return cls(bits, out)

    def holds(self, marks: np.ndarray) -> np.ndarray:
        if self.bitmap is None:
            return np.ones(len(marks), bool)
        at = (marks & U((1 << self.bits) - 1)).astype(np.int64)
        return (self.bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def joined(nodes: DataFrame, names: DataFrame, *by: str, text_col: str = "text", column: str = "text", fold: bool = False, all_matches: bool = False) -> DataFrame:
    """by, start, end, text: what phrases() finds, for lists of any size.  `by` names a row of nodes.

    Each row gives the pieces of its text that are as many tokens long as a phrase is and pass a filter of the phrases' hashes
    (Listed), and those meet the list by a join on the text; the lengths (a few numbers) and the filter are collected,
    nothing else."""

    def split(batches):
        for batch in batches:
            many = [t for t in (tokens(p, fold) for p in batch.column(0).to_pylist()) if t]
            marks = [int(marks_of(token_numbers(t), len(t))[0]) >> 1 for t in many]
            yield pa.RecordBatch.from_arrays([pa.array(["".join(t) for t in many], pa.string()), pa.array(list(map(len, many)), pa.int32()), pa.array(marks, pa.int64())], ["phrase", "size", "mark"])

    listed = names.select(F.col(column).alias("p")).filter("p is not null").mapInArrow(split, "phrase string, size int, mark long").distinct()
    sizes = sorted(r["size"] for r in listed.select("size").distinct().collect())
    known = nodes.sparkSession.sparkContext.broadcast(Listed.of(listed))
    keys = [f"_k{i}" for i in range(len(by))]
    schema = ", ".join([*(f"{k} {nodes.schema[b].dataType.simpleString()}" for k, b in zip(keys, by, strict=True)), "start int, end int, piece string, own string"])

    def cut(batches):
        numbers = TokenNumbers()
        for batch in batches:
            rows, starts, ends, pieces, owns = [], [], [], [], []

            def made():
                own = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(pieces, pa.string()), pa.array(owns, pa.string())], [*keys, "start", "end", "piece", "own"])  # noqa: B023

            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                plain = found = TOKEN.findall(text or "")
                if fold:
                    plain = [t.casefold() for t in found]
                h = np.fromiter(map(numbers.__getitem__, plain), np.uint64, len(plain))
                hits = [(i, size) for size in sizes if size <= len(h) for i in np.flatnonzero(known.value.holds(marks_of(h, size) >> U(1))).tolist()]
                if not hits:
                    continue
                place = np.append(0, np.cumsum(np.fromiter(map(len, found), np.int64, len(found))))  # TOKEN leaves nothing out
                for i, size in hits:
                    if not plain[i].isspace() and not plain[i + size - 1].isspace():
                        rows.append(row)
                        starts.append(int(place[i]))
                        ends.append(int(place[i + size]))
                        pieces.append("".join(plain[i : i + size]))
                        owns.append("".join(found[i : i + size]))
                if len(rows) > 10_000:
                    yield made()
                    rows, starts, ends, pieces, owns = [], [], [], [], []
            if rows:
                yield made()

    pieces = nodes.select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=True)], F.col(text_col).alias("_t")).mapInArrow(cut, schema)
    met = pieces.join(listed, pieces["piece"] == listed["phrase"]).select(*keys, "start", "end", "own")
    if all_matches:
        rows = met.select(*keys, F.struct("start", "end", "own").alias("s"))
    else:
        ordered = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "end", "own")))
        rows = exploded(met.groupBy(*keys).agg(ordered.alias("a")), kept_in_order(F.col("a")), *keys)
    return rows.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], "s.start", "s.end", F.col("s.own").alias("text"))
