"""Exact k-means by Yinyang grouping.

Components are whole numbers (floor(scale * x)), so distances, sums and centroids are exact.  The starting centroids are
cut once into groups (a few rounds of k-means over the centroids).  A vector keeps an upper bound of the distance to
its own centroid and one lower bound for each group, over the group's other centroids.  When centroids have moved, the
upper bound grows by its centroid's move and a group's bound falls by the group's largest move.  A vector whose upper bound
is below all its lower ones keeps its centroid (global filter); else its upper bound is made exact and tested again; then a
group whose bound is still above it is left out (group filter), and the centroids of the groups that remain are scanned
exactly.  Filters hold only where bounds are truly apart, so ties are scanned and go to the smaller number.

Spark: each assignment is one narrow pass over a written table that holds vectors, centroids and bounds, and writes
the next one.  Tasks add up the vectors that changed their centroid, by centroid, component and limb (digits to the base
2**LIMB, so that sums of any size are exact), and put the sums beside their rows; Spark sums those few rows, at most
k x width x limbs of them come to the driver, and new centroids are the old sums with what came and went.  Nothing grows
with the data but the tables; no vector is shuffled.

Numbers: while components are at most 2**20 in size, distances are exact as doubles.  Vectors beyond that, and
all vectors once a centroid is beyond, are measured in Python's integers and without bounds.  A distance or inertia
beyond a long counts as the greatest long; sums are taken before that.

Cases: null vectors, another number of components, and null or non-finite components take no part.  A null vec_id is no
starting centroid, but its vector is assigned.  Rows that repeat a vec_id are vectors each; among them the starting order
is by vec_id's hash, then by components.  Fewer rows than k: as many centroids as rows with an id; none: no rows.  An empty
cluster keeps its centroid.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Components up to which squared distances of 2**10 components are exact as doubles.
PLAIN = 1 << 20
LIMB = 40
LONG_MAX = (1 << 63) - 1
#: Bounds are square roots and sums of doubles; they are widened by this share.
SLACK = 1e-9
STATE = "vec_id long, v array<long>, big array<string>, own int, upper double, lower array<double>, distance long, sums array<struct<cell:long,value:long>>, told array<long>"


def usable(vectors: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """vec_id, x: the rows that take part, with their components as doubles."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.filter((F.size("x") == width) & ~F.exists("x", bad))


def whole(x: float, scale: int) -> int:
    """floor(scale * x), exact also where the product leaves the doubles."""
    return math.floor(x * scale) if abs(x) < 2.0**900 else int(x) * scale


def limbs(n: int) -> list[int]:
    """Digits of n to the base 2**LIMB, the last of them signed."""
    out = []
    while not -(1 << LIMB) <= n < 1 << LIMB:
        n, digit = divmod(n, 1 << LIMB)
        out.append(digit)
    return [*out, n]


class Centroids:
    """k centroids as exact integers, their groups, and how far they moved at the last update."""

    def __init__(self, rows: list[list[int]], groups: np.ndarray, before: Centroids | None = None):
        self.rows, self.groups, self.k = rows, groups, len(rows)
        self.plain = all(abs(x) <= PLAIN for r in rows for x in r)
        self.matrix = np.array(rows, np.float64) if self.plain else None
        both = before is not None and self.plain and before.plain
        self.moved = np.sqrt(((self.matrix - before.matrix) ** 2).sum(1)) * (1 + SLACK) if both else None
        self.group_moved = np.array([self.moved[groups == g].max() for g in range(groups.max() + 1)]) if both else None


def grouped(rows: list[list[int]], n: int) -> np.ndarray:
    """The number of the group of each centroid: k-means of the centroids themselves, without empty groups."""
    points = np.array([[float(max(-1e100, min(1e100, x))) for x in r] for r in rows])
    scale = np.abs(points).max() or 1.0
    points = points / scale
    middles = points[np.linspace(0, len(points) - 1, min(n, len(points))).astype(int)]
    own = np.zeros(len(points), int)
    for _ in range(5):
        own = ((points[:, None] - middles[None]) ** 2).sum(2).argmin(1)
        middles = np.array([points[own == g].mean(0) if (own == g).any() else m for g, m in enumerate(middles)])
    return np.unique(own, return_inverse=True)[1].reshape(-1)


def squared(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of plain rows to plain centroids."""
    return (rows**2).sum(1)[:, None] - 2 * (rows @ centroids.T) + (centroids**2).sum(1)


def assign(rows: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids, measured: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(own, upper, lower, squared distance, counters) after one assignment of plain rows to plain centroids.

    own of -1: not assigned yet.  measured: the distances of all rows are wanted, else only of those that no filter keeps.
    Counters: rows, rows left out by the global filter, groups, groups left out, distances."""
    n, groups = len(rows), c.groups.max() + 1
    told = np.zeros(5, np.int64)
    told[0], told[2] = n, n * groups
    new = own < 0
    own, lower = own.copy(), lower.copy()
    known = np.flatnonzero(~new)
    if c.moved is None:
        upper, lower = np.full(n, np.inf), np.zeros((n, groups))
    else:
        upper = upper + np.where(new, 0, c.moved[own]) * (1 + SLACK)
        lower = np.maximum(lower - c.group_moved[None] * (1 + SLACK), 0)
    least = lower.min(1) * (1 - SLACK)
    sure = ~new & (upper * (1 + SLACK) < least)
    exact = np.full(n, -1.0)
    open_ = known if measured else known[~sure[known]]
    exact[open_] = ((rows[open_] - c.matrix[own[open_]]) ** 2).sum(1)
    told[4] += len(open_)
    upper[open_] = np.sqrt(exact[open_])
    sure[open_] |= upper[open_] * (1 + SLACK) < least[open_]
    told[1] = sure.sum()
    told[3] = sure.sum() * groups
    best, at = np.where(new, np.inf, exact), np.where(new, c.k, own)
    first, start = own.copy(), exact.copy()
    todo = np.flatnonzero(~sure)
    for g in range(groups):
        scan = todo[new[todo] | ~(upper[todo] * (1 + SLACK) < lower[todo, g] * (1 - SLACK))]
        told[3] += len(todo) - len(scan)
        if not len(scan):
            continue
        numbers = np.flatnonzero(c.groups == g)
        d = squared(rows[scan], c.matrix[numbers])
        told[4] += d.size
        # the group's nearest but for the row's first centroid, and of ties the smallest number
        others = np.where(numbers[None] == first[scan][:, None], np.inf, d)
        near = others.argmin(1)
        value, number = others[np.arange(len(scan)), near], numbers[near]
        runner = np.where(np.arange(len(numbers))[None] == near[:, None], np.inf, others).min(1)
        wins = (value < best[scan]) | ((value == best[scan]) & (number < at[scan]))
        # a group's bound: its nearest that is not the winner; a winner that loses later is put back below
        lower[scan, g] = np.sqrt(np.where(wins, runner, value))
        lost = scan[wins]
        prior, prior_d = at[lost], best[lost]
        real = prior < c.k
        back = lost[real]
        lower[back, c.groups[prior[real]]] = np.minimum(lower[back, c.groups[prior[real]]], np.sqrt(prior_d[real]))
        best[lost], at[lost] = value[wins], number[wins]
    # the first centroid of a row that left it counts in its group's bound
    left = np.flatnonzero(~new & (at != first))
    lower[left, c.groups[first[left]]] = np.minimum(lower[left, c.groups[first[left]]], np.sqrt(start[left]))
    done = best >= 0
    upper = np.where(done, np.sqrt(np.maximum(best, 0)), upper)
    return at.astype(np.int32), upper, lower, best, told


def assign_exactly(rows: list[list[int]], c: Centroids) -> tuple[list[int], list[int]]:
    """(own, squared distance) in Python's integers."""
    own, distance = [], []
    for row in rows:
        d, i = min((sum((x - y) * (x - y) for x, y in zip(row, r, strict=True)), i) for i, r in enumerate(c.rows))
        own.append(i)
        distance.append(d)
    return own, distance


class Sums:
    """What came to and went from each centroid: rows and, by component, whole numbers of any size; cell 0 of a centroid is
    the number of rows, cell width + 1 the distances."""

    def __init__(self, k: int, width: int):
        self.k, self.width = k, width
        self.exact: dict[tuple[int, int], int] = {}

    def add(self, cluster: int, place: int, value: int) -> None:
        self.exact[cluster, place] = self.exact.get((cluster, place), 0) + int(value)

    def move(self, rows: np.ndarray, own: np.ndarray, sign: int) -> None:
        for i in np.unique(own[own >= 0]):
            mine = rows[own == i]
            self.add(i, 0, sign * len(mine))
            for place, value in enumerate(mine.astype(np.int64).sum(0)):
                self.add(i, place + 1, sign * int(value))

    def cells(self) -> list[dict]:
        """(cell, value): the cell's number says limb, centroid and place."""
        wide = self.width + 2
        return [{"cell": int((limb * self.k + i) * wide + place), "value": int(v)} for (i, place), n in self.exact.items() if n for limb, v in enumerate(limbs(n))]


def _start(state: DataFrame, k: int, salt: str) -> list[list[int]]:
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = state.filter("vec_id is not null").select(order.alias("h"), "v", "big").orderBy("h", "v", "big").limit(k).collect()  # k rows
    return [[int(x) for x in (r["v"] if r["big"] is None else r["big"])] for r in rows]


def total(d: np.ndarray) -> int:
    """The exact sum of whole numbers below 2**53."""
    x = d.astype(np.int64)
    return (int((x >> 26).sum()) << 26) + int((x & ((1 << 26) - 1)).sum())


def _pass(state: DataFrame, c: Centroids, width: int, last: bool) -> DataFrame:
    """The next table: every row with its new centroid, and with each task's last row what came and went."""
    shared = state.sparkSession.sparkContext.broadcast(c)
    groups = int(c.groups.max()) + 1

    def run(batches):
        c = shared.value
        sums, told = Sums(c.k, width), np.zeros(5, np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            value = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            own = value("own").to_numpy(zero_copy_only=False).astype(np.int64)
            big = np.flatnonzero(value("big").is_valid().to_numpy(zero_copy_only=False))
            after, distance = np.zeros(n, np.int64), [0] * n
            upper, lower = np.full(n, np.inf), np.zeros((n, groups))
            flat = value("v").flatten().to_numpy(zero_copy_only=False)
            ok = np.ones(n, bool)
            ok[big] = False
            plain = np.flatnonzero(ok)
            rows = flat.reshape(len(plain), width).astype(np.float64)
            if c.plain and len(plain):
                a, u, lo, d, t = assign(rows, own[plain], value("upper").to_numpy(zero_copy_only=False)[plain], value("lower").flatten().to_numpy(zero_copy_only=False).reshape(n, groups)[plain], c, last)
                after[plain], upper[plain], lower[plain] = a, u, lo
                told += t
                for i, x in zip(plain, d.astype(np.int64).tolist(), strict=True):
                    distance[i] = x
                moved = a != own[plain]
                sums.move(rows[moved], a[moved], 1)
                sums.move(rows[moved], own[plain][moved], -1)
                for i in np.unique(a):
                    sums.add(int(i), width + 1, total(d[a == i]) if last else 0)
            texts = value("big").to_pylist() if len(big) else None
            slow = big if c.plain else np.arange(n)
            exact = {int(i): [int(x) for x in texts[i]] for i in big} if texts else {}
            if not c.plain:
                exact |= {int(i): [int(x) for x in rows[j]] for j, i in enumerate(plain)}
            if len(slow):
                a, d = assign_exactly([exact[int(i)] for i in slow], c)
                for i, to, x in zip(slow.tolist(), a, d, strict=True):
                    after[i], distance[i] = to, min(x, LONG_MAX)
                    sums.add(to, width + 1, x)
                    if to != own[i]:
                        for where, sign in ((to, 1), (int(own[i]), -1)):
                            if where >= 0:
                                sums.add(where, 0, sign)
                                for place, y in enumerate(exact[i]):
                                    sums.add(where, place + 1, sign * y)
            arrays = [value("vec_id"), value("v"), value("big"), pa.array(after, pa.int32()), pa.array(upper, pa.float64()), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * groups, pa.array(lower.reshape(-1), pa.float64())), pa.array(distance, pa.int64())]
            yield _batch(arrays, n)
        yield _batch([pa.nulls(1, t) for t in TYPES[:7]], 1, sums.cells(), told.tolist())

    return state.filter("own is not null").select("vec_id", "v", "big", "own", "upper", "lower").mapInArrow(run, STATE)


_CELLS = pa.list_(pa.struct([("cell", pa.int64()), ("value", pa.int64())]))
TYPES = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.int64(), _CELLS, pa.list_(pa.int64())]
NAMES = [part.split(" ")[0] for part in ("vec_id", "v", "big", "own", "upper", "lower", "distance", "sums", "told")]


def _batch(arrays: list, n: int, sums: list | None = None, told: list | None = None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*arrays, pa.array([sums] * n, TYPES[7]), pa.array([told] * n, TYPES[8])], NAMES)


def _totals(state: DataFrame, k: int, width: int) -> tuple[dict[tuple[int, int], int], list[int]]:
    """((centroid, place) -> sum of what came and went; counters): a row a cell that any task touched comes to the driver."""
    cells = state.filter("sums is not null").select(F.explode("sums").alias("s")).groupBy("s.cell").agg(F.sum("s.value").alias("value")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in cells:
        head, place = divmod(r["cell"], width + 2)
        limb, i = divmod(head, k)
        out[i, place] = out.get((i, place), 0) + (r["value"] << (LIMB * limb))
    told = state.filter("told is not null").agg(*[F.coalesce(F.sum(F.get("told", F.lit(i))), F.lit(0)).alias(str(i)) for i in range(5)]).head()
    return out, list(told)


def prepared(vectors: DataFrame, groups: int, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """STATE before the first assignment: whole components, as longs where all are plain and else as decimal numbers."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            with np.errstate(over="ignore"):
                v = np.floor(x * scale)
            ok = (np.abs(v) <= PLAIN).all(1)
            longs = pa.array([row if fine else None for row, fine in zip(np.where(ok[:, None], v, 0).astype(np.int64), ok, strict=True)], TYPES[1])
            big = pa.array([None if fine else [str(whole(float(y), scale)) for y in row] for row, fine in zip(x, ok, strict=True)], TYPES[2])
            zeros = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * groups, pa.array(np.zeros(n * groups), pa.float64()))
            yield _batch([batch.column(0), longs, big, pa.array(np.full(n, -1), pa.int32()), pa.array(np.full(n, np.inf)), zeros, pa.nulls(n, pa.int64())], n)

    return usable(vectors, id_col, vector_col, width).mapInArrow(run, STATE)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, groups: int = 4, width: int = 64, scale: int = 64, salt: str = "1", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]], dict[tuple[int, int], int], list[list[int]]]:
    """(rows vec_id, cluster, distance; centroids; (centroid, 0) -> rows and (centroid, width + 1) -> inertia; counters by
    assignment).  The rows are a written table."""
    state = written(prepared(vectors, groups, id_col, vector_col, width, scale))
    start = _start(state, k, salt)
    if not start:
        return state.select("vec_id", F.col("own").alias("cluster"), "distance").limit(0), [], {}, []
    of = grouped(start, groups)
    c, sums, counters = Centroids(start, of), {}, []
    if (of.max() + 1) != groups:  # fewer groups than asked for
        wide = int(of.max()) + 1
        state = state.withColumn("lower", F.slice("lower", 1, wide))
    for number in range(rounds + 1):
        after = written(_pass(state, c, width, number == rounds))
        forget(state)
        state = after
        change, told = _totals(state, c.k, width)
        counters.append(told)
        sums = {key: value for key, value in sums.items() if key[1] <= width}  # inertia is counted anew
        for key, value in change.items():
            sums[key] = sums.get(key, 0) + value
        if number < rounds:
            rows = [[sums.get((i, p + 1), 0) // n for p in range(width)] if (n := sums.get((i, 0), 0)) else c.rows[i] for i in range(c.k)]
            c = Centroids(rows, of, c)
    return state.filter("own is not null").select("vec_id", F.col("own").alias("cluster"), "distance"), c.rows, sums, counters


def digest(rows: DataFrame, centroids: list[list[int]], sums: dict[tuple[int, int], int], width: int = 64) -> DataFrame:
    """The columns of the query: rows with their cluster's inertia, the whole inertia and the digest of their centroid."""
    inertia = [sums.get((i, width + 1), 0) for i in range(len(centroids))]
    of = lambda values, kind: F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole_: Column = F.lit(min(sum(inertia), LONG_MAX)).cast("long")
    return rows.select("vec_id", "cluster", "distance", of([min(x, LONG_MAX) for x in inertia], "long").alias("cluster_inertia"), whole_.alias("inertia"), of(digests, "string").alias("centroid_sha256"))
