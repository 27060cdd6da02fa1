"""Media columns: payloads stored as deduplicated content-defined chunks.

A payload is a text's UTF-8 bytes, filled with zeros to a positive multiple of 64.  Its media form is a mono 8-bit PCM
RIFF/WAVE file whose samples are the payload's bytes, so it is lossless.  The media bytes are cut where a rolling gear
hash has `mask_bits` zero bits, between `least` and `most` bytes.  Each media's manifest is its ordered chunk list.

A first pass computes manifests alone; grouping them by chunk digest tells which chunks lie in one document only.
Documents all of whose chunks do are stored as they are, one row each, and need no shuffle to be read back.  The others
(a filter of fixed size picks them, with few false ones, which do no harm) emit each chunk once a task, compressed;
Spark groups these by digest and keeps one copy, filed under its first media, in a table in the shared folder.

Reading back: chunks filed under their own media go to it directly; shared ones come by a join of the manifests' other
entries with the store on the digest.  The ordered chunks are joined, checked against the manifest's digest (a
mismatch is an error), and the samples are read from the WAVE file for the features.

Cases: null or empty text: 64 zero bytes.  Repeated rows each get their values.  Empty input gives no rows.  Extra
columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Places, column, forget, written

RATE, UNIT = 8000, 64
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
READ = RESULT.replace("doc_id long, n_bytes long", "media binary")


@functools.cache
def gear() -> np.ndarray:
    """256 fixed pseudo-random 32-bit numbers."""
    return np.frombuffer(b"".join(hashlib.sha256(b"gear%d" % i).digest()[:4] for i in range(256)), "<u4")


def cuts(data: bytes, least: int = 1024, most: int = 16_384, mask_bits: int = 11) -> list[int]:
    """Ends of the chunks.  The rolling hash of a place is sum of gear[byte k before it] << k, k below 32, so it depends
    on the last 32 bytes alone and is computed for all places by doubling."""
    h = gear()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    places = np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1
    out, start = [], 0
    for p in [*places.tolist(), len(data)]:
        while p - start > most:
            start += most
            out.append(start)
        if p - start >= least or (p == len(data) and p > start):
            out.append(p)
            start = p
    return out


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), len(raw)


def media_of(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples_of(media: bytes) -> bytes:
    kind, size, form, _, _, code, channels, _, _, _, bits, _, length = struct.unpack("<4sI4s4sIHHIIHH4sI", media[:44])
    if (kind, form, code, channels, bits) != (b"RIFF", b"WAVE", 1, 1, 8) or size != 36 + length or len(media) != 44 + length:
        raise ValueError("not the media that was stored")
    return media[44:]


def feature_of(payload: bytes, chunks: int) -> str:
    x = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"wav8;rate={RATE};samples={len(x)};sum={int(x.sum(dtype=np.int64))};square={int((x.astype(np.int64) ** 2).sum())};peak={int(x.max())};crossings={crossings};chunks={chunks}"


@functools.cache
def _codecs():
    preset = zstandard.ZstdCompressionDict(" ".join(f"{a}{b}" for a in "the of and to in is that la de el que en le les des der die und".split() for b in ("", ",", ".", "s", "tion", "ing", "er", "en")).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=preset), zstandard.ZstdDecompressor(dict_data=preset)


def manifests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (its digest); and once a task for each media: parts, its chunks in order.

    A part is (digest, size, data); data is null where the task has emitted the chunk before.  The memory of what a
    task has emitted is emptied when it holds a million digests."""

    def run(batches):
        seen_media, seen = set(), set()
        for batch in batches:
            rows = []
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                payload, n = payload_of(text)
                media = media_of(payload)
                digest = hashlib.sha256(media).digest()
                parts = None
                if digest not in seen_media:
                    seen_media.add(digest)
                    parts = []
                    for chunk in chunks_of(media):
                        d = digest_of(chunk)
                        parts.append({"digest": d, "size": len(chunk), "data": None if d in seen else _codecs()[0].compress(chunk)})
                        seen.add(d)
                rows.append({"doc_id": doc, "n_bytes": n, "media": digest, "parts": parts})
                if len(seen) > 1_000_000:
                    seen, seen_media = set(), set()
            yield pa.RecordBatch.from_pylist(rows, schema)

    part = pa.struct([("digest", pa.binary()), ("size", pa.int32()), ("data", pa.binary())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("parts", pa.list_(part))])
    spec = "doc_id long, n_bytes long, media binary, parts array<struct<digest:binary,size:int,data:binary>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, spec)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents: doc_id, n_bytes, media; lists: media, digests; chunks: digest, media, data, shared), written tables.

    A chunk is filed under the smallest media among those that carried its bytes; shared: other media hold it too."""
    made = written(manifests(docs, id_col, text_col))
    lists = written(made.filter("parts is not null").select("media", F.transform("parts", lambda p: p["digest"]).alias("digests")).groupBy("media").agg(F.first("digests").alias("digests")))
    parts = made.filter("parts is not null").select("media", F.explode("parts").alias("p")).select("p.digest", "media", "p.data")
    kept = F.min(F.when(F.col("data").isNotNull(), F.struct("media", "data")))
    grouped = parts.groupBy("digest").agg(kept.alias("kept"), (F.min("media") != F.max("media")).alias("shared"))
    chunks = written(grouped.select("digest", F.col("kept.media").alias("media"), F.col("kept.data").alias("data"), "shared"))
    documents = written(made.select("doc_id", "n_bytes", "media"))
    forget(made)
    return documents, lists, chunks


def read_back(lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """READ rows: every media put together from its chunks, checked and measured.

    A group of the last shuffle has a media's list, the chunks filed under it, and the shared ones of its list."""
    shared = chunks.filter("shared")
    entries = lists.select("media", F.explode("digests").alias("digest")).distinct()
    wanted = entries.join(shared.select("digest", F.col("media").alias("owner")), "digest").filter("media != owner").select("media", "digest")
    others = wanted.join(shared.select("digest", "data"), "digest")
    none = lambda kind: F.lit(None).cast(kind)
    rows = lists.select("media", "digests", none("binary").alias("digest"), none("binary").alias("data"))
    for found in (chunks, others):
        rows = rows.unionByName(found.select("media", none("array<binary>").alias("digests"), "digest", "data"))

    def assemble(key, t):
        data = dict(zip(t.column("digest").to_pylist(), t.column("data").to_pylist(), strict=True))
        (ordered,) = [x for x in t.column("digests").to_pylist() if x is not None]
        row = {"media": key[0].as_py()} | measured(key[0].as_py(), [data[d] for d in ordered])
        return pa.Table.from_pylist([row], pa.schema([("media", pa.binary()), *MEASURED]))

    return rows.groupBy("media").applyInArrow(assemble, READ)


MEASURED = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def measured(digest: bytes, stored: list[bytes]) -> dict:
    """The values of a media, read from its stored chunks in order."""
    media = b"".join(map(_codecs()[1].decompress, stored))
    if hashlib.sha256(media).digest() != digest:
        raise ValueError(f"media {digest.hex()} is not what was stored")
    payload = samples_of(media)
    return {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-UNIT:]), "media_bytes": len(media), "media_sha256": digest.hex(), "feature": feature_of(payload, len(stored))}


def chunks_of(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def digest_of(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=20).digest()


def entries(docs: DataFrame) -> DataFrame:
    """doc_id, digests: the distinct chunk digests of each document (doc_id, text)."""

    def run(batches):
        for batch in batches:
            found = [sorted({digest_of(c) for c in chunks_of(media_of(payload_of(t)[0]))}) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "digests"])

    return docs.mapInArrow(run, "doc_id long, digests array<binary>")


def stored_alone(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, chunks (compressed, in order) of documents (doc_id, text) that share no chunk."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                payload, n = payload_of(text)
                media = media_of(payload)
                rows.append((doc, n, hashlib.sha256(media).digest(), [_codecs()[0].compress(c) for c in chunks_of(media)]))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "n_bytes", "media", "chunks"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, media binary, chunks array<binary>")


def read_alone(stored: DataFrame) -> DataFrame:
    """RESULT of stored_alone(); narrow."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), *MEASURED])
        for batch in batches:
            rows = [{"doc_id": r["doc_id"], "n_bytes": r["n_bytes"]} | measured(r["media"], r["chunks"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return stored.mapInArrow(run, RESULT)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT, one row for each row of docs: stored, read back and measured."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = written(entries(base.filter("doc_id is not null")))
    each = found.select("doc_id", F.explode("digests").alias("digest"))
    shared = written(each.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"))  # a table, so that the join can split a hot chunk
    together = F.col("doc_id").isNull() | Places(each.join(shared, "digest").select("doc_id").distinct(), "doc_id").test("doc_id")
    forget(found, shared)
    alone = written(stored_alone(base.filter(~together)))
    documents, lists, chunks = store(base.filter(together))
    back = written(read_back(lists, chunks))  # a table, so that the join can split a hot media
    forget(lists, chunks)
    joined = documents.join(back, "media").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return read_alone(alone).unionByName(joined)
