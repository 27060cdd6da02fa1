"""A vault: originals of masked spans as a bucketed table, read without being shuffled; and maps sealed by keys.

The table has a row a node, in buckets by document.  Unmasking a few documents names them in a filter, so that Spark reads
their buckets alone; unmasking many joins on the document, for which the vault lies in its buckets already and only the
masked side is shuffled.

Sealed maps: each map is encrypted (AES-GCM) by a key of its own, derived from a master key and the document; that key goes
with the map, wrapped by the master key, so a change of masters re-wraps keys and leaves the contents.  The document's id is
bound to both, and a signature (HMAC-SHA-256) over all fields shows a change of any.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.errors import ValidationError

from .mask import splice

#: Documents up to which their ids are put into the filter of the vault's scan.
FEW = 1000
PLACES = "array<struct<start:int,end:int,original:string>>"


def store(anchors: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """anchors (doc_id, node_id, masked_start, masked_end, original_text) as a bucketed table of nodes."""
    one = F.struct(F.col("masked_start").alias("start"), F.col("masked_end").alias("end"), F.col("original_text").alias("original"))
    nodes = anchors.groupBy("doc_id", "node_id").agg(F.array_sort(F.collect_list(one)).alias("places"))
    writer = nodes.write.mode("overwrite").format("parquet").bucketBy(buckets, "doc_id").sortBy("doc_id")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def _by_document(rows: DataFrame) -> DataFrame:
    """doc_id and its nodes' places as a map; the vault's buckets do for the grouping."""
    return rows.groupBy(F.col("doc_id").alias("_doc")).agg(F.map_from_entries(F.collect_list(F.struct("node_id", "places"))).alias("_nodes"))


def unmask(masked: DataFrame, table: str, few: int = FEW) -> DataFrame:
    """masked (doc_id, node_id, masked_text) with restored_text, from a vault.  Nodes that the vault does not hold keep theirs."""
    vault = masked.sparkSession.table(table)
    ids = [r["doc_id"] for r in masked.select("doc_id").filter("doc_id is not null").distinct().limit(few + 1).collect()]
    if len(ids) <= few:
        vault = vault.filter(F.col("doc_id").isin(ids))
    joined = masked.join(_by_document(vault), F.col("doc_id") == F.col("_doc"), "left")
    places = F.coalesce(F.try_element_at("_nodes", F.col("node_id")), F.array().cast(PLACES))
    joined = joined.withColumn("_places", places)
    return joined.withColumn("restored_text", splice(F.col("masked_text"), F.col("_places"), "original")).select(*masked.columns, "restored_text")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The hexadecimal HMAC of a binary column."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def _signed(key: bytes) -> Column:
    fields = [F.coalesce(F.col(c), F.lit("")) for c in ("doc_id", "key_id", "wrapped_key", "encrypted_content")]
    return hmac_sha256(key, F.concat_ws("\n", *fields).cast("binary"))


def _wrap(key: Column, master: bytes) -> Column:
    return F.base64(F.aes_encrypt(key, F.lit(bytearray(master)), F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.col("doc_id").cast("binary")))


def _check(masters: dict[str, bytes]) -> None:
    if any(len(k) != 32 for k in masters.values()):
        raise ValidationError("a master key has 32 bytes")


def seal(maps: DataFrame, master: bytes, key_id: str) -> DataFrame:
    """Maps as JSON (doc_id, value) sealed: doc_id and a JSON value with key_id, wrapped_key, encrypted_content and signature."""
    _check({key_id: master})
    rows = maps.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("value"), F.lit(key_id).alias("key_id"))
    own = F.unhex(hmac_sha256(master, F.concat_ws("\n", F.lit("map"), "doc_id", F.sha2("value", 256)).cast("binary")))
    rows = rows.withColumn("_key", own)
    content = F.base64(F.aes_encrypt("value", "_key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(bytearray()), F.col("doc_id").cast("binary")))
    rows = rows.withColumns({"wrapped_key": _wrap(F.col("_key"), master), "encrypted_content": content})
    return _written(rows, master)


def _written(rows: DataFrame, master: bytes) -> DataFrame:
    rows = rows.withColumn("signature", _signed(master))
    return rows.select("doc_id", F.to_json(F.struct("doc_id", "key_id", "wrapped_key", "encrypted_content", "signature")).alias("value"))


def _read(sealed: DataFrame, masters: dict[str, bytes]) -> DataFrame:
    """The fields with master keys tried by key_id: _error, and _key where all is in order."""
    _check(masters)
    rows = sealed.select(F.from_json("value", "doc_id string, key_id string, wrapped_key string, encrypted_content string, signature string").alias("m")).select("m.*")
    known, right, key = F.lit(False), F.lit(False), F.lit(None).cast("binary")
    for name, master in masters.items():
        own = F.col("key_id") == name
        known = known | own
        right = F.when(own, _signed(master) == F.col("signature")).otherwise(right)
        key = F.when(own, F.try_aes_decrypt(F.try_to_binary("wrapped_key", F.lit("base64")), F.lit(bytearray(master)), F.lit("GCM"), F.lit("DEFAULT"), F.col("doc_id").cast("binary"))).otherwise(key)
    missing = F.col("doc_id").isNull() | F.col("encrypted_content").isNull() | F.col("wrapped_key").isNull()
    error = F.when(missing, "not a sealed map").when(~F.coalesce(known, F.lit(False)), "unknown key").when(~F.coalesce(right, F.lit(False)), "tampered")
    return rows.withColumn("_error", error).withColumn("_key", F.when(error.isNull(), key))


def unseal(sealed: DataFrame, masters: dict[str, bytes]) -> DataFrame:
    """doc_id, value (the map's JSON, or null) and error: "not a sealed map", "unknown key", "tampered", or null."""
    rows = _read(sealed, masters)
    plain = F.try_aes_decrypt(F.try_to_binary("encrypted_content", F.lit("base64")), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.col("doc_id").cast("binary")).cast("string")
    rows = rows.withColumn("_plain", F.when(F.col("_key").isNotNull(), plain))
    error = F.coalesce("_error", F.when(F.col("_plain").isNull(), "tampered"))
    return rows.select("doc_id", F.when(error.isNull(), F.col("_plain")).alias("value"), error.alias("error"))


def rewrapped(sealed: DataFrame, masters: dict[str, bytes], master: bytes, key_id: str) -> DataFrame:
    """Sealed maps under another master key: keys are wrapped anew, contents stay as they are.  Maps that cannot be opened stay."""
    _check({key_id: master})
    rows = _read(sealed, masters)
    old = sealed.select(F.col("doc_id").alias("_d"), F.col("value").alias("_old"))
    good = rows.filter("_key is not null").withColumns({"key_id": F.lit(key_id), "wrapped_key": _wrap(F.col("_key"), master)})
    bad = old.join(rows.filter("_key is not null").select("doc_id"), F.col("_d") == F.col("doc_id"), "left_anti").select(F.col("_d").alias("doc_id"), F.col("_old").alias("value"))
    return _written(good, master).unionByName(bad)

