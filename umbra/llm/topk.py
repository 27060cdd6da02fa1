"""Exact top-k inner-product search by block-at-a-time pruning.

Components are quantised to integers, so scores are exact.  Rows are ordered in space (by the nearest of a few centroids
fitted on a bounded sample) and cut into blocks, each with its forward index (the block's matrix of components by row)
and its terms' maxima and minima.  For a query a block's bound is the sum over its terms of the largest product that the
block allows; blocks are visited by falling bound, first each query's own best, then the others for all queries at once,
and a block whose bound lies below a query's k-th score so far is not visited for it (equal bounds are, as ties go to the
smaller id).  A block is scored through its forward index term by
term in two steps: after the first terms a row's bound is its score so far and the product of the norms of what is left,
and rows, often all of a block, whose bound lies below the k-th score are left.  The k-th score starts from the k best of
a bounded sample of the candidates.  pruning() tells how much of the blocks was left out.

Queries are cut into chunks of bounded size, candidates dealt into lanes; each lane meets each chunk in a cogroup, so both
sides of a task are bounded, and nothing but the sample and the centroids is broadcast.  Candidates are sent once a chunk
of `chunk` queries.

Numbers: quantised components are whole doubles at any size.  A block where a sum of products could pass 2**53 is scored
with Python's integers and not pruned; a score beyond a long counts as the nearest long.

Cases: a null vec_id, a null vector, or null or non-finite components take no part.  Vectors of another length than
the query's count as having zeros beyond their end.  Of rows that repeat a query's vec_id the smallest vector is the
query; candidates are all rows, repeated ones each, but those with the query's own vec_id.  Ties go to the smaller
vec_id.  Fewer than k candidates: all of them.  Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, slices, written

RESULT = "query_id long, rank int, vec_id long, score long"
HITS = "query_id long, vec_id long, score long, place int, blocks long, left long, rows long, rows_left long"
EXACT = float(1 << 53)
LONG_LIMIT = (1 << 63) - 1
#: Bounds are sums of doubles; they are widened by this share.
SLACK = 1e-9
#: Blocks that each query visits in its own order, before it shares the visits of the others.
LEAD = 4


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the rows that take part, with their components as doubles."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter("vec_id is not null and v is not null").filter(~F.exists("v", bad))


def quantised(lists: list, width: int, scale: int = 256) -> np.ndarray:
    """floor(scale * x) of each component, zeros beyond a vector's end; whole numbers as doubles, or, where a product
    leaves the doubles, as Python's integers."""
    out = np.zeros((len(lists), width))
    for i, x in enumerate(lists):
        n = min(len(x), width)
        out[i, :n] = x[:n]
    with np.errstate(over="ignore"):
        scaled = np.floor(scale * out)
    if np.isfinite(scaled).all():
        return scaled
    return np.array([[int(v) * scale if abs(v) > EXACT else int(np.floor(scale * v)) for v in row] for row in out], object).reshape(out.shape)


def safe(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products of rows of a and b are exact as doubles."""
    if a.dtype == object or b.dtype == object:
        return False
    if not a.size or not b.size:
        return True
    return float(np.abs(a).max(1).max()) * float(np.abs(b).sum(1).max()) < EXACT


class Block:
    """Rows of a block with their bounds; `first` terms are scored before the others."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        if rows.dtype != object:
            self.high, self.low = rows.max(0), rows.min(0)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        b = np.maximum(queries, 0) @ self.high + np.minimum(queries, 0) @ self.low
        return b + SLACK * (np.abs(queries) @ np.maximum(np.abs(self.high), np.abs(self.low)))


def cut(ids: np.ndarray, rows: np.ndarray, centroids: np.ndarray, block_rows: int) -> list[Block]:
    """Blocks of rows that are near each other."""
    if rows.dtype == object or not len(centroids) or not len(ids):
        order = np.arange(len(ids))
    else:
        width = centroids.shape[1]
        near = np.zeros((len(rows), width))
        near[:, : rows.shape[1]] = rows[:, :width]
        own = np.argmax(near @ centroids.T - (centroids**2).sum(1) / 2, 1)
        order = np.lexsort((ids, *near.T[:1], own))
    return [Block(ids[order[i : i + block_rows]], rows[order[i : i + block_rows]]) for i in range(0, len(order), block_rows)]


def search(queries: np.ndarray, own: np.ndarray, floors: np.ndarray, blocks: list[Block], k: int) -> tuple[list[list[tuple]], np.ndarray]:
    """For each query its up to k best (-score, vec_id) of the blocks' rows that reach its floor, sorted; and for each
    query the numbers of blocks, blocks left out or left early, rows, rows left out or left early."""
    n, width = len(queries), queries.shape[1] if len(queries) else 0
    kept: list[list[tuple]] = [[] for _ in range(n)]
    told = np.zeros((n, 4), np.int64)
    told[:, 0], told[:, 2] = len(blocks), sum(len(b.ids) for b in blocks)
    plain = [b for b in blocks if safe(queries, b.rows)]
    for b in (b for b in blocks if not safe(queries, b.rows)):  # exact, without bounds
        mine = [[int(x) for x in row] for row in b.rows]
        for q in range(n):
            x = [int(v) for v in queries[q]]
            scores = [(-max(-LONG_LIMIT - 1, min(LONG_LIMIT, sum(map(int.__mul__, x, row)))), int(i)) for row, i in zip(mine, b.ids, strict=True) if i != own[q]]
            kept[q] = heapq.nsmallest(k, kept[q] + scores)
    if not plain or not n:
        return kept, told
    bounds = np.stack([b.bounds(queries) for b in plain], 1)
    order = np.argsort(-bounds, 1, kind="stable")
    # the terms of the most weight first
    weight = (queries**2).sum(0) * sum((b.rows**2).sum(0) for b in plain)
    terms = np.argsort(-weight, kind="stable")
    head, tail = terms[: max(1, 3 * width // 4)], terms[max(1, 3 * width // 4) :]
    q_head, q_tail, q_rest = queries[:, head], queries[:, tail], np.sqrt((queries[:, tail] ** 2).sum(1))
    floor = np.where(np.isnan(floors), -np.inf, floors).astype(float)  # of each query: no score below it is among its best
    for q, best in enumerate(kept):
        if len(best) == k:
            floor[q] = max(floor[q], -best[-1][0])
    sizes = np.array([len(b.ids) for b in plain])
    halves = [(b.rows[:, head], b.rows[:, tail], np.sqrt((b.rows[:, tail] ** 2).sum(1))) for b in plain]
    seen = np.zeros((n, len(plain)), bool)

    def visit(b: int, mine: np.ndarray) -> None:
        """Score a block for the queries `mine`; their floors rise."""
        block, (x_head, x_tail, x_rest) = plain[b], halves[b]
        seen[mine, b] = True
        part = q_head[mine] @ x_head.T
        reach = part + np.outer(q_rest[mine], x_rest) * (1 + SLACK) + 1e-6 >= floor[mine, None]
        reach &= block.ids[None] != own[mine][:, None]
        alive = reach.any(1)
        told[mine, 3] += len(block.ids) - reach.sum(1)
        told[mine, 1] += ~alive
        for i in np.flatnonzero(alive):
            rows, q = np.flatnonzero(reach[i]), mine[i]
            scores = part[i, rows] + x_tail[rows] @ q_tail[q]
            up = scores >= floor[q]
            rows, scores = rows[up], scores[up]
            if len(rows) > k:
                best = np.lexsort((block.ids[rows], -scores))[:k]
                rows, scores = rows[best], scores[best]
            if len(rows):
                kept[q] = sorted(kept[q] + [(-int(s), int(v)) for s, v in zip(scores, block.ids[rows], strict=True)])[:k]
                if len(kept[q]) == k:
                    floor[q] = max(floor[q], -kept[q][-1][0])

    # each query's best blocks first, in its own order; then the blocks that are left, each for all queries that it can serve
    for step in range(min(LEAD, len(plain))):
        active = np.flatnonzero(bounds[np.arange(n), order[:, step]] >= floor)
        for b in np.unique(order[active, step]):
            visit(b, active[order[active, step] == b])
    for b in np.argsort(-bounds.max(0), kind="stable"):
        mine = np.flatnonzero(~seen[:, b] & (bounds[:, b] >= floor))
        if len(mine):
            visit(b, mine)
    told[:, 1] += (~seen).sum(1)
    told[:, 3] += (~seen) @ sizes
    return kept, told


def fitted(sample: np.ndarray, clusters: int, rounds: int = 8) -> np.ndarray:
    """Centroids of the sample's rows by Lloyd's rounds, from evenly spaced rows in the order of the first terms."""
    if sample.dtype == object or len(sample) < 2 * clusters:
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    start = np.lexsort(sample.T[:2])
    out = sample[start[np.linspace(0, len(start) - 1, clusters).astype(int)]]
    for _ in range(rounds):
        own = np.argmax(sample @ out.T - (out**2).sum(1) / 2, 1)
        out = np.stack([sample[own == c].mean(0) if (own == c).any() else out[c] for c in range(clusters)])
    return out


def hits(vectors: DataFrame, k: int, every: int, block_rows: int, chunk: int, lane_rows: int, sample: int, clusters: int, id_col: str, vector_col: str) -> DataFrame:
    """HITS: the k best of each lane for each query, and on the first of them (place 0) what was left out there."""
    spark = vectors.sparkSession
    rows = written(usable(vectors, id_col, vector_col))
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w")).head()["w"]
    n = rows.count()
    taken = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample).toArrow()  # `sample` rows at most
    of_sample = quantised(column(taken, "v"), width)
    seeds = spark.sparkContext.broadcast((np.array(column(taken, "vec_id"), np.int64), of_sample, fitted(of_sample, clusters)))
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    chunks, lanes = max(1, -(-n // (every * chunk))), max(1, -(-n // lane_rows))

    def floor_of(batches):
        """vec_id, v, floor: no k-th score lies below the floor."""
        ids, cands, _ = seeds.value
        for batch in slices(batches):
            own, q = np.array(column(batch, "vec_id"), np.int64), quantised(column(batch, "v"), width)
            floors = np.full(len(own), -np.inf)
            if safe(q, cands) and len(own):
                scores = np.where(own[:, None] == ids[None], -np.inf, q @ cands.T)
                if scores.shape[1] >= k:
                    floors = np.partition(scores, scores.shape[1] - k, 1)[:, scores.shape[1] - k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors, pa.float64())], ["vec_id", "v", "floor"])

    asked = written(queries.mapInArrow(floor_of, "vec_id long, v array<double>, floor double"))
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)))
    deal = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda x: x.cast("long")))
    left = asked.withColumn("lane", F.explode(deal))
    # a lane is dealt by the vector as well, so that rows which repeat an id are spread
    right = rows.withColumn("lane", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(lanes)))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))

    def meet(asked_table, rows_table):
        own, q = np.array(column(asked_table, "vec_id"), np.int64), quantised(column(asked_table, "v"), width)
        floors = np.array(column(asked_table, "floor"), float)
        blocks = cut(np.array(column(rows_table, "vec_id"), np.int64), quantised(column(rows_table, "v"), width), seeds.value[2], block_rows)
        found, told = search(q, own, floors, blocks, k)
        flat = [(int(own[i]), v, -s, place, *(told[i].tolist() if not place else [0] * 4)) for i, best in enumerate(found) for place, (s, v) in enumerate(best)]
        flat += [(int(own[i]), None, None, 0, *told[i].tolist()) for i, best in enumerate(found) if not best]
        names = ["query_id", "vec_id", "score", "place", "blocks", "left", "rows", "rows_left"]
        return pa.Table.from_arrays([pa.array([r[j] for r in flat], pa.int32() if name == "place" else pa.int64()) for j, name in enumerate(names)], names)

    return left.groupBy("chunk", "lane").cogroup(right.groupBy("chunk", "lane")).applyInArrow(meet, HITS)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = 64, chunk: int = 4096, lane_rows: int = 16_384, sample: int = 4096, clusters: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """RESULT: queries are the rows whose id is divisible by `every`, candidates all rows."""
    found = hits(vectors, k, every, block_rows, chunk, lane_rows, sample, clusters, id_col, vector_col).filter("vec_id is not null")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def pruning(vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = 64, chunk: int = 4096, lane_rows: int = 16_384, sample: int = 4096, clusters: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row: blocks_left, rows_left: the shares of (query, block) and (query, row) left out, or left before their last terms."""
    found = hits(vectors, k, every, block_rows, chunk, lane_rows, sample, clusters, id_col, vector_col)
    share = lambda a, b: (F.sum(a) / F.sum(b)).alias(a if a == "rows_left" else "blocks_left")
    return found.agg(share("left", "blocks"), share("rows_left", "rows"))


