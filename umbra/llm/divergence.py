"""Divergence of sources: how far the term distributions of a language's sources lie from each other and from the language.

Terms are runs of letters (A-Z lower-cased, and everything beyond ASCII).  A language keeps the terms in at least `least`
of its documents.  A group (language, source) and a language give each kept term a share of `scale`, smoothed by `prior`
occurrences; groups are compared in pairs by the sum of the differences over all kept terms, and each with its language
by term.

Most terms stand in few documents, and they are not shuffled.  A first pass counts documents by term within tasks and puts
the counts in a count-min sketch: `depth` rows of cells, of which a term has one each, so the least of its cells is never
below its document frequency.  Counts stop at `least`, which merging keeps exact for the question whether a cell reaches it;
sketches are cut into blocks, merged by block in two steps (no task gets more than the square root of the partial ones),
and what is left is one bit a cell.  In the second pass each task counts its terms by group and drops those whose
bits say that they cannot reach `least`; survivors are counted exactly, and only then are rare terms that came through left
out.  The sketch has a cell a row for 32 to 64 bytes of text, up to 2**MOST_BITS cells (48 MB broadcast in all): beyond it fewer
terms are dropped early and the result is the same.

Pairs: a term that neither of two groups has adds the same to each pair, so it is enough to meet terms that both have (a join
on the term, of which each group has one row) and, for terms of one alone, the group's histogram of shares with the
other's share of an absent term; the rest is a product.  All sums are whole numbers.

Cases: null text, language and source read as ''.  Groups without terms take part; where a language keeps no term its
pairs have value 0 and there are no terms.  Repeated rows are documents each; ids are not read.  A source alone in its
language has no pair.  No documents: no rows.  Ties go by the item's bytes.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_side, forget, slices, written

#: Bytes that are no part of a term are blanks; A-Z are small.  A character beyond ASCII has bytes from 0x80 on alone.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK_BITS = 14
LEAST_BITS, MOST_BITS = 16, 27
#: Different terms that a task holds before it hands on what it has counted.
HELD = 400_000
COUNTED = "lang string, source string, terms array<struct<term:binary,n:long,docs:long>>"


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(TERM_BYTES).split() if text else []


def _read(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))


class Cells:
    """Which cells of a sketch a term has."""

    def __init__(self, bits: int, depth: int):
        self.bits, self.depth = bits, depth

    def of(self, lang: bytes, names: list[bytes]) -> np.ndarray:
        """A row of `depth` cell numbers for each name; row j of the sketch has the numbers from j * 2**bits on."""
        seed = xxhash.xxh32_intdigest(lang)
        h = np.fromiter((xxhash.xxh64_intdigest(n, seed) for n in names), np.uint64, len(names))
        step = (h >> np.uint64(32)) | np.uint64(1)
        rows = [((h + np.uint64(j) * step) & np.uint64((1 << self.bits) - 1)) + np.uint64(j << self.bits) for j in range(self.depth)]
        return np.stack(rows, 1).astype(np.int64)


def merged(offsets: list[bytes], counts: list[bytes], most: int) -> np.ndarray:
    """A block of cells, each at most `most`; no partial count is more, so sums of them stay small."""
    out = np.zeros(1 << BLOCK_BITS, np.uint32)
    for o, c in zip(offsets, counts, strict=True):
        out[np.frombuffer(o, np.uint16)] += np.frombuffer(c, np.uint32)
    return np.minimum(out, most, out)


def _parts(block: np.ndarray) -> tuple[bytes, bytes]:
    at = np.flatnonzero(block)
    return at.astype(np.uint16).tobytes(), block[at].astype(np.uint32).tobytes()


def sketch(rows: DataFrame, cells: Cells, least: int) -> np.ndarray:
    """One bit a cell: whether it counts `least` documents or more."""
    salts = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def count(batches):
        held: dict[bytes, Counter] = {}
        salt = TaskContext.get().partitionId() % salts  # the same when the task is run again

        def parts():
            numbers, counts = [], []
            for lang, c in held.items():
                numbers.append(cells.of(lang, list(c)).reshape(-1))
                counts.append(np.repeat(np.fromiter(c.values(), np.int64, len(c)), cells.depth))
            held.clear()
            if not numbers:
                return
            at, inverse = np.unique(np.concatenate(numbers), return_inverse=True)
            total = np.minimum(np.bincount(inverse, np.concatenate(counts)).astype(np.int64), least)
            blocks = at >> BLOCK_BITS
            edges = np.flatnonzero(np.diff(blocks, prepend=-1))
            made = [(int(blocks[a]), (at[a:b] & ((1 << BLOCK_BITS) - 1)).astype(np.uint16).tobytes(), total[a:b].astype(np.uint32).tobytes()) for a, b in zip(edges, [*edges[1:], len(at)], strict=True)]
            blocks_, offsets, counts_ = zip(*made, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int32()), pa.array(np.full(len(made), salt), pa.int32()), pa.array(offsets, pa.binary()), pa.array(counts_, pa.binary())], ["block", "salt", "offsets", "counts"])

        for batch in slices(batches, 250):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang.encode(), Counter()).update(set(terms(text)))
            if sum(map(len, held.values())) > HELD:
                yield from parts()
        yield from parts()

    def merge(key, table):
        offsets, counts = _parts(merged(table.column("offsets").to_pylist(), table.column("counts").to_pylist(), least))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "offsets": pa.array([offsets], pa.binary()), "counts": pa.array([counts], pa.binary())})

    def final(key, table):
        block = merged(table.column("offsets").to_pylist(), table.column("counts").to_pylist(), least)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(block >= least).tobytes()], pa.binary())})

    partial = rows.select("lang", "text").mapInArrow(count, "block int, salt int, offsets binary, counts binary")
    once = partial.groupBy("block", "salt").applyInArrow(merge, "block int, offsets binary, counts binary")
    out = np.zeros(cells.depth << (cells.bits - 3), np.uint8)
    width = 1 << (BLOCK_BITS - 3)
    for r in once.groupBy("block").applyInArrow(final, "block int, bits binary").toLocalIterator():  # depth * 2**(bits - BLOCK_BITS) rows at most
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)
    return out


def survivors(rows: DataFrame, cells: Cells, bits: np.ndarray) -> DataFrame:
    """lang, source, term, n, docs of tasks: the terms that the sketch does not rule out."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush():
            known: dict[str, dict[bytes, bool]] = {}
            for (lang, source), (n, docs) in held.items():
                own = known.setdefault(lang, {})
                new = [t for t in n if t not in own]
                if new:
                    at = cells.of(lang.encode(), new)
                    own.update(zip(new, ((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(1).tolist(), strict=True))
                kept = [t for t in n if own[t]]
                if kept:
                    value = pa.StructArray.from_arrays([pa.array(kept, pa.binary()), pa.array([n[t] for t in kept], pa.int64()), pa.array([docs[t] for t in kept], pa.int64())], ["term", "n", "docs"])
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([source]), pa.ListArray.from_arrays(np.array([0, len(kept)], np.int32), value)], ["lang", "source", "terms"])
            held.clear()

        for batch in slices(batches, 250):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = terms(text)
                if found:
                    n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                    n.update(found)
                    docs.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from flush()
        yield from flush()

    counted = rows.select("lang", "source", "text").mapInArrow(count, COUNTED)
    return counted.select("lang", "source", F.explode("terms").alias("t")).select("lang", "source", F.col("t.term").cast("string").alias("term"), "t.n", "t.docs")


def share(count: Column, total: Column, kept: Column, scale: int, prior: int) -> Column:
    """1 + floor(scale * (count + prior) / (total + prior * kept)), exact at any count; null where nothing is kept."""
    raised = (count + prior).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.when(kept > 0, F.call_function("div", raised, (total + prior * kept).cast("decimal(19,0)")) + 1)


def counted(docs: DataFrame, least: int = 30, depth: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n, docs: exact counts of all terms that the sketch does not rule out, a written table."""
    rows = _read(docs, text_col, lang_col, source_col)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).head()["n"]
    cells = Cells(min(MOST_BITS, max(LEAST_BITS, (size // 64).bit_length())), depth)
    found = survivors(rows, cells, sketch(rows, cells, least))
    return written(found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def audit(docs: DataFrame, least: int = 30, top: int = 50, scale: int = 1_000_000_000, prior: int = 5, depth: int = 3, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank."""
    counts = counted(docs, least, depth, text_col, lang_col, source_col)
    totals = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("whole"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least).drop("docs"))
    langs = totals.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("lang_total"))
    own = written(counts.join(totals, ["lang", "term"]).select("lang", "source", "term", "n", "whole"))
    forget(counts)
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("held"))
    groups = _read(docs, text_col, lang_col, source_col).select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = groups.select("lang", "source", *map(zero, ("kept", "lang_total", "total", "held")))
    p = lambda count, total: share(count, F.col(total), F.col("kept"), scale, prior)
    groups = written(groups.withColumns({"id": F.monotonically_increasing_id(), "absent": p(F.lit(0), "total")}))
    side = lambda names: checked_side(groups.select(*names), F.octet_length("lang") + (F.octet_length("source") if "source" in names else 0) + 64)
    known = own.join(side(["lang", "source", "id", "kept", "lang_total", "total", "absent"]), ["lang", "source"])
    shares = written(known.select("lang", "source", "term", "id", "absent", p(F.col("n"), "total").alias("p"), p(F.col("whole"), "lang_total").alias("q")))
    forget(own, totals)
    return _pairs(groups, shares, side).unionByName(_terms(shares, top))


def _ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return rows.withColumn("rank", F.row_number().over(w))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above).filter(F.col("rank") <= top)  # Spark cuts each task's rows of a group to `top` before it shuffles them


def _pairs(groups: DataFrame, shares: DataFrame, side) -> DataFrame:
    """For groups s and t: what s has, against t's absent share, and the other way; terms of both put right; the rest."""
    half = lambda i: shares.select("lang", "term", F.col("id").alias(f"id{i}"), F.col("p").alias(f"p{i}"), F.col("absent").alias(f"absent{i}"))
    apart = lambda a, b: F.abs(F.col(a) - F.col(b))
    both = half(1).join(half(2), ["lang", "term"]).filter("id1 < id2")
    mended = apart("p1", "p2") - apart("p1", "absent2") - apart("p2", "absent1") + apart("absent1", "absent2")
    shared = written(both.groupBy("id1", "id2").agg(F.sum(mended).alias("mended")))
    histogram = shares.groupBy("lang", F.col("id").alias("id1"), F.col("p").alias("p1")).agg(F.count(F.lit(1)).alias("n"))
    met = histogram.join(side(["lang", "id", "absent"]).withColumnsRenamed({"id": "id2", "absent": "absent2"}), "lang").filter("id1 <> id2")
    one_way = written(met.groupBy("id1", "id2").agg(F.sum(F.col("n") * apart("p1", "absent2")).alias("alone")))
    first = groups.select("lang", "source", "id", "absent", "held", "kept").withColumnsRenamed({"id": "id1", "absent": "absent1", "held": "held1"})
    second = side(["lang", "source", "id", "absent", "held"]).withColumnsRenamed({"source": "item", "id": "id2", "absent": "absent2", "held": "held2"})
    pairs = first.join(second, "lang").filter("id1 <> id2")
    turned = lambda rows, value, to: rows.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), F.col(value).alias(to))
    pairs = pairs.join(one_way, ["id1", "id2"], "left").join(turned(one_way, "alone", "alone2"), ["id1", "id2"], "left")
    pairs = pairs.join(shared.unionByName(turned(shared, "mended", "mended")), ["id1", "id2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    rest = (F.col("kept") - F.col("held1") - F.col("held2")) * apart("absent1", "absent2")
    value = zero(zero("alone") + zero("alone2") + zero("mended") + rest)
    return _ranked(pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))
