"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (space, tab to carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text by WORD, in UTF-8, only A-Z lower-cased on request; null: none.

    bytes.split() splits at exactly WORD's blanks, and bytes.lower() changes A-Z alone."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode where that is unset, as in tests.

    On a cluster a machine's own folder is no place for tables that other executors read, so there it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="umbra-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, read again with its schema.

    A lost executor costs no recomputation of what is written.  forget() removes the table, scope() those of a step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/umbra-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.block.size", str(32 << 20)).parquet(path)  # small row groups: a writer holds one
    out = spark.read.schema(df.schema).parquet(path)
    out._umbra_path = path
    for held in _scopes:
        held.append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scope(keep=lambda: ()):
    """Remove the tables that written() makes inside, but for those in keep(), when the block ends."""
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes.remove(held)
        paths = {getattr(k, "_umbra_path", None) for k in keep()}
        forget(*[x for x in held if x._umbra_path not in paths])


def forget(*tables: DataFrame) -> None:
    """Remove tables of written() that no later result reads."""
    for df in tables:
        path = getattr(df, "_umbra_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            with contextlib.suppress(Exception):
                at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


#: Bytes up to which one side of a join is broadcast.
BROADCAST_BYTES = 16 << 20


def checked_side(side: DataFrame, size: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """A written table as one side of a join: broadcast if its rows, of `size` bytes each and some for the row, take at most
    `most` bytes; a larger one is joined by a shuffle, in which Spark splits hot keys."""
    total = side.agg(F.coalesce(F.sum(size + F.lit(64)), F.lit(0)).alias("b")).head()["b"]
    return F.broadcast(side) if total <= most else side.hint("merge")


class Places:
    """A filter that lets pass the rows whose id is among ids (column name), and few others.

    A bitmap of 16 to 32 bits an id, broadcast up to 2**MOST_BITS bits (32 MB).  More ids than that get no bitmap: every row
    passes then, and the join that follows does all the work.  hashed: the ids are hashes, whose middle bits are their
    place, so that Python functions can ask too."""

    MOST_BITS = 28
    #: Last bits of a hash that do not count: hashes may have been chosen by them.
    SKIP = 20

    def __init__(self, ids: DataFrame, name: str, hashed: bool = False):
        self.hashed = hashed
        bits = max(16, (16 * ids.count()).bit_length())
        self.bits, self.shared = bits, None
        if bits <= self.MOST_BITS:
            self.shared = ids.sparkSession.sparkContext.broadcast(self._bitmap(ids.select(self._place(name).alias("p"))))

    def _place(self, name: str) -> Column:
        return F.pmod(F.shiftright(name, self.SKIP) if self.hashed else F.xxhash64(name), F.lit(1 << self.bits))

    def _bitmap(self, places: DataFrame) -> np.ndarray:
        per = 1 << (self.bits - 10)

        def build(key, table):
            own = np.zeros(max(per, 8), bool)
            own[np.array(table.column("p").to_pylist(), np.int64) % per] = True
            return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["slice", "bits"])

        out = np.zeros(1 << (self.bits - 3), np.uint8)
        sliced = places.distinct().withColumn("slice", F.floor(F.col("p") / per).cast("long"))
        for r in sliced.groupBy("slice").applyInArrow(build, "slice long, bits binary").collect():  # 1024 rows at most
            out[r["slice"] * per // 8 : (r["slice"] + 1) * per // 8] = np.frombuffer(r["bits"], np.uint8)
        return out

    def test(self, name: str) -> Column:
        """Whether the column may be among the ids; null is not."""
        if self.shared is None:
            return F.col(name).isNotNull()
        shared = self.shared

        @F.pandas_udf("boolean")
        def holds(p: pd.Series) -> pd.Series:
            a = p.to_numpy()
            return pd.Series((shared.value[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & 1 == 1)

        return F.col(name).isNotNull() & holds(self._place(name))

    def among(self):
        """A function of an array of hashes, for Python functions on executors: which may be among the ids."""
        shared, skip, last = self.shared, np.uint64(self.SKIP), np.uint64((1 << self.bits) - 1)
        assert self.hashed

        def may_be(hashes: np.ndarray) -> np.ndarray:
            if shared is None:
                return np.ones(len(hashes), bool)
            p = (hashes.view(np.uint64) >> skip & last).astype(np.int64)
            return (shared.value[p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1

        return may_be

    def holds(self, rows: DataFrame, name: str) -> DataFrame:
        return rows.filter(self.test(name))


def slices(batches, rows: int = 1000):
    """Batches in parts of at most `rows` rows, so that few texts are Python strings at once; after the last the caches of
    this task are emptied and freed memory goes back to the system.

    Spark takes its idle Python workers in turn, so what one keeps from a task counts beside those at work."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    Cache.empty(kept=False)


def _release() -> None:
    """Give freed memory back to the system, where the platform can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null ids have no remainder (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def remainder_is(doc_id: Column, n: int, r: int) -> Column:
    return F.coalesce(crc_mod(doc_id, n) == F.lit(r), F.lit(False))


class Cache(dict):
    """word -> value, filled by make(word) on a miss.  When it holds `most` words they become the older generation,
    from which words still in use come back; so at most twice `most` are held.  keep: for the next tasks too."""

    #: Caches that hold words in this Python worker; a new one empties those that earlier tasks left.
    filled: list = []

    def __init__(self, make, most: int = 250_000, keep: bool = False):
        super().__init__()
        self.make, self.most, self.keep, self.older = make, most, keep, {}
        if Cache.filled:
            Cache.empty()

    @staticmethod
    def empty(kept: bool = True) -> None:
        """Empty the caches that hold words, with or without those to keep, and give their memory back."""
        for cache in Cache.filled:
            if kept or not cache.keep:
                cache.clear()
                cache.older.clear()
        Cache.filled[:] = [c for c in Cache.filled if c]
        _release()

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if not self:
                Cache.filled.append(self)
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def column(batch, name: str) -> list:
    """A column of an Arrow record batch as a Python list."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
