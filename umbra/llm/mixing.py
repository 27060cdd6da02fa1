"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every document's size in words; every source's size, weight and target (water-filling under a cap of epochs).
2. Each source's documents are hashed into a power of two of blocks, and a bijection of the block numbers orders the
   blocks anew in each epoch.  Laid end to end in that order, a source's documents form a line of words; the mix takes
   the line once for each full epoch and then its first words up to the target, so exactly round(target) words.
3. The blocks so drawn are dealt to the output shards.  A binary tree over the shards splits the vector of block
   quotas: the left half of a node's shards gets its share of the blocks, each source's part drawn from the
   multivariate hypergeometric distribution by an urn with hashed uniforms; leaves are the shards' exact quotas.
4. Within its shard each drawn document has a hashed place, the local shuffle.

All of it is DataFrame expressions over hashes, so reruns agree whatever the partitioning.  No task needs more than
one block of a source; a source has at most 2**MAX_BITS blocks, and the tables of sources, blocks and quotas are
small.  The list of sources is held in one row of the tree.

Cases: null source: a source of its own, last.  Null or empty text: size 0, taken 0.  Repeated rows are separate
documents; ties in the order are between equal rows.  Empty input gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

MAX_BITS = 20
WEIGHTS = (3.0, 1.0, 2.0)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts) -> Column:
    """A hashed uniform number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _permuted(block: Column, bits: Column, seed: Column) -> Column:
    """A bijection of the numbers below 2**bits, one for each seed: odd multiplications and xors, each invertible."""
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
    half = F.greatest((bits + 1) / 2, F.lit(1)).cast("int")
    x = block.bitwiseXOR(F.xxhash64(seed, F.lit(1)).bitwiseAND(mask))
    for k in (2, 3):
        odd = F.xxhash64(seed, F.lit(k)).bitwiseAND(F.lit((1 << 30) - 1)).bitwiseOR(F.lit(1))
        x = (x * odd).bitwiseAND(mask)
        x = x.bitwiseXOR(F.call_function("shiftright", x, half))
    return x


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: float = 2.0, block_docs: int = 64) -> DataFrame:
    """One row a source: source, place, source_size, weight, target, quota (words), full (epochs), rest, bits, blocks.

    Shares above `epochs` times a source's size are cut there and the excess is dealt out again by weight until none is
    above: the water level, found by one running sum over the sources ordered by cap / weight.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    t = t.withColumn("place", F.row_number().over(by_name) - 1)
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)) + 1))
    t = t.withColumn("cap", F.col("source_size") * F.lit(epochs)).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    below = F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("level", (total - F.coalesce(below, F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    t = t.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * water, F.col("cap"))))
    t = t.withColumn("quota", F.round("target").cast("long"))
    t = t.withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.col("source_size"))).otherwise(0).cast("int"))
    t = t.withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size"))
    bits = F.least(F.greatest(F.floor(F.log2(F.col("docs") / F.lit(float(block_docs)))), F.lit(0)), F.lit(MAX_BITS)).cast("int")
    t = t.withColumn("bits", bits).withColumn("blocks", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")))
    return t.select("source", "place", "source_size", "weight", "target", "quota", "full", "rest", "bits", "blocks")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """place, bounds: each source's running block quotas over the shards.  quotas: place, drawn (number of blocks)."""
    node = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "drawn"))), lambda x: x["drawn"]).alias("q"))
    node = node.select(F.lit(0).alias("first"), F.lit(shards).alias("n"), "q")
    depth = (shards - 1).bit_length()
    for level in range(depth):
        node = node.withColumn("half", F.floor((F.col("n") + 1) / 2).cast("int"))
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(total.alias("pop"), F.when(F.col("n") > 1, F.floor(total * F.col("half") / F.col("n"))).otherwise(total).cast("long").alias("left"), F.array().cast("array<bigint>").alias("out"))

        at_level = F.lit(level)

        def source(a: Column, x: Column) -> Column:
            urn = F.struct(a["pop"].alias("pop"), a["left"].alias("left"), F.lit(0).cast("long").alias("got"))

            def draw(b: Column, i: Column) -> Column:
                hit = (_uniform(F.lit(seed), at_level, F.col("first"), F.size(a["out"]), i) * b["pop"] < b["left"]).cast("long")
                return F.struct((b["pop"] - 1).alias("pop"), (b["left"] - hit).alias("left"), (b["got"] + hit).alias("got"))

            done = F.aggregate(F.when(x > 0, F.sequence(F.lit(1).cast("long"), x)).otherwise(F.array().cast("array<bigint>")), urn, draw)
            return F.transform(F.array(done), lambda d: F.struct(d["pop"].alias("pop"), d["left"].alias("left"), F.concat(a["out"], F.array(d["got"])).alias("out")))[0]

        node = node.withColumn("l", F.aggregate("q", start, source)["out"])
        left = F.struct(F.col("first").alias("first"), F.least("half", "n").alias("n"), F.col("l").alias("q"))
        right = F.struct((F.col("first") + F.col("half")).alias("first"), (F.col("n") - F.col("half")).alias("n"), F.zip_with("q", "l", lambda q, x: q - x).alias("q"))
        node = node.select(F.explode(F.array(left, right)).alias("x")).select("x.*").filter("n > 0")
    flat = node.select(F.col("first").alias("shard"), F.posexplode("q").alias("place", "k"))
    return flat.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "k"))).alias("s")).select("place", _running("s").alias("bounds"))


def _running(name: str) -> Column:
    empty = F.array().cast("array<bigint>")
    return F.aggregate(name, empty, lambda a, x: F.concat(a, F.array(F.when(F.size(a) > 0, F.try_element_at(a, F.lit(-1))).otherwise(F.lit(0).cast("long")) + x["k"])))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, epochs: float = 2.0, shards: int = 16, seed: int = 7, block_docs: int = 64, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, taken, draws (and the columns `keep`).

    draws: array of (epoch, shard, words, place): the document's first `words` words go to the shard, in the order of
    place.  taken is the sum of words.  All words but for one document a source come whole.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("_key"), *([F.struct(*keep).alias("_kept")] if keep else []))
    sized = written(named) if not keep else named
    small = sized if not keep else written(sized.select("source", "size", "_key"))
    t = written(targets(small, weights, share, epochs, block_docs))
    h = F.xxhash64(F.lit(seed), F.col("_key"))
    attached = sized.join(t.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    at_block = lambda df: df.withColumn("block", h.bitwiseAND(F.col("blocks") - 1))
    rank = lambda e: _permuted(F.col("block"), F.col("bits"), F.xxhash64(F.lit(seed), F.col("place"), e))
    sums = at_block(small.join(t.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))).groupBy("place", "block").agg(F.sum("size").alias("words"))
    table = t.select("place", "bits", "blocks", "full", "rest").join(sums, "place").withColumn("rank", rank(F.col("full")))
    line = Window.partitionBy("place").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    table = written(table.withColumn("start", F.coalesce(F.sum("words").over(line), F.lit(0))).select("place", "block", "rank", "start", "blocks", "full", "rest"))
    drawn = table.groupBy("place").agg(F.first("blocks").alias("b"), F.first("full").alias("f"), F.max(F.when(F.col("start") < F.col("rest"), F.col("rank") + 1)).alias("part"))
    drawn = drawn.select("place", (F.col("b") * F.col("f") + F.coalesce("part", F.lit(0))).alias("drawn"))
    bounds = split_quotas(drawn, shards, seed)
    rows = at_block(attached).join(table.select("place", "block", "rank", "start"), ["place", "block"])
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed + 1), F.col("_key")))
    inside = Window.partitionBy("place", "block").orderBy("_h", "doc_id", "size", "_key").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("at"))))
    rows = rows.join(bounds, "place", "left")
    shard = lambda d: F.size(F.filter("bounds", lambda x: x <= d)).cast("int")
    place = lambda e: F.xxhash64(F.lit(seed + 2), e, F.col("doc_id"), F.col("_h"))
    draw = lambda e, words, r: F.struct(e.cast("int").alias("epoch"), shard(e * F.col("blocks") + r).alias("shard"), words.alias("words"), place(e.cast("int")).alias("place"))
    fulls = F.transform(F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)).otherwise(F.array().cast("array<int>")), lambda e: draw(e, F.col("size"), rank(e)))
    last = F.array(draw(F.col("full"), F.col("part"), F.col("rank")))
    rows = rows.withColumn("draws", F.filter(F.concat(fulls, last), lambda x: x["words"] > 0))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("part")).alias("taken"), "draws", *(["_kept.*"] if keep else []))


def materialise(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a draw, with its shard and place; a draw of part of a document keeps its first words, joined by spaces."""
    rows = mixed.withColumn("_d", F.explode("draws")).drop("draws")
    cut = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_d.words").cast("int")), " ")
    rows = rows.withColumn(text_col, F.when(F.col("_d.words") < F.col("size"), cut).otherwise(F.col(text_col)))
    return rows.withColumns({"shard": F.col("_d.shard"), "epoch": F.col("_d.epoch"), "place": F.col("_d.place")}).drop("_d")


def shuffled(rows: DataFrame, parts: int = 8) -> DataFrame:
    """Materialised rows in the order of their places within their shards; a shard is dealt over `parts` tasks by place."""
    dealt = rows.repartition("shard", F.pmod(F.shiftright("place", 48), F.lit(parts)))
    return dealt.sortWithinPartitions("shard", "place")


def shuffled_in_place(rows: DataFrame) -> DataFrame:
    """Materialised rows in the order of their places within each shard of each task: a local shuffle that moves no text
    between tasks, for what reads all shards at once."""
    return rows.sortWithinPartitions("shard", "place")


def write_shards(rows: DataFrame, path: str, parts: int = 8) -> None:
    """One folder a shard, each shuffled locally by place."""
    shuffled(rows, parts).write.partitionBy("shard").parquet(path)
