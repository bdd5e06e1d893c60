"""Media columns stored as content-defined chunks, each distinct chunk once.

Payload: a text's UTF-8 bytes and zeros up to a positive multiple of 64, as 8-bit samples. A gear hash rolls over the last 32
bytes; where its top bits are zero a chunk ends, between ``LEAST`` and ``MOST`` bytes after the one before, so a change
moves only the chunks around it. For all positions of a payload at once the hash is summed by doubling: the sum over 2w bytes
is that over w bytes plus the one w bytes before, shifted by w.

Store: digests of all chunks are counted and owned by Spark joins, without their bytes. A chunk that only one content has
stays with it; a chunk that several contents share becomes a row of its own, kept by its first owner. A content row so holds its
manifest (``CDC1``, number of chunks, then size, digest and whether it is shared of each chunk in order), compressed the bytes
that only it has, and as an index the digests of its shared chunks. The bytes cross the network once, compressed, one copy of
a content from each task.

Reading back: contents without shared chunks are rebuilt within the scan; the others join the shared chunks by digest. Every
chunk is checked against its digest. The stored form of a document, whose size and hash are returned, is what is read
for it: the manifest, its own compressed bytes, and the rows of its shared chunks in order. The features are computed from
the payload rebuilt from these.

Edge cases: a null text is an empty one, whose payload is 64 zeros. Null ids and repeated rows get a row each; equal texts
equal values. Contents are told apart by a 128-bit digest. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

UNIT = 64
LEAST, MOST, BITS = 1 << 10, 1 << 14, 12
ROWS = 128
FEATURES = "content binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _gear() -> np.ndarray:
    """256 numbers of a splitmix64 sequence."""
    with np.errstate(over="ignore"):
        z = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT or UNIT * (not data))


def cuts(payload: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of a payload."""
    ends, at = [], 0
    if len(payload) > least:
        rolled = GEAR[np.frombuffer(payload, np.uint8)]
        width = 1
        while width < 32:
            before = rolled[:-width] << np.uint32(width)
            rolled = rolled.copy()
            rolled[width:] += before
            width *= 2
        for i in (np.flatnonzero(rolled >> np.uint32(32 - bits) == 0) + 1).tolist():
            while i - at > most:
                at += most
                ends.append(at)
            if i - at >= least:
                at = i
                ends.append(at)
    while len(payload) - at > most:
        at += most
        ends.append(at)
    return ends if at == len(payload) else [*ends, len(payload)]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("digest", pa.binary()), ("size", pa.int32())]))
    for b in batches:
        sizes, contents, recipes = [], [], []
        for text in b.column(1).to_pylist():
            payload, at, own = payload_of(text), 0, []
            for end in cuts(payload):
                own.append({"digest": digest(payload[at:end]), "size": end - at})
                at = end
            sizes.append(len((text or "").encode()))
            contents.append(digest(payload + struct.pack("<q", sizes[-1])))
            recipes.append(own)
        columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary()), pa.array(recipes, kind)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "content", "recipe"])


def _press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=9)
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            contents, packed = [], []
            for text in b.column(0).slice(at, ROWS).to_pylist():
                payload = payload_of(text)
                contents.append(digest(payload + struct.pack("<q", len((text or "").encode()))))
                packed.append(press.compress(payload))
            yield pa.RecordBatch.from_arrays([pa.array(contents, pa.binary()), pa.array(packed, pa.binary())], names=["content", "packed"])


STORE = "content binary, digest binary, manifest binary, needed array<struct<place:int,digest:binary>>, data binary"
ENTRY = struct.Struct("<I16s?")


def manifest(entries: list[tuple[int, bytes, bool]]) -> bytes:
    """Size, digest and whether it is shared of each chunk, as stored."""
    return b"".join([b"CDC1", struct.pack("<I", len(entries)), *(ENTRY.pack(*e) for e in entries)])


def read_manifest(data: bytes) -> list[tuple[int, bytes, bool]]:
    if data[:4] != b"CDC1" or len(data) != 8 + struct.unpack_from("<I", data, 4)[0] * ENTRY.size:
        raise ValueError("not a manifest of chunks")
    return list(ENTRY.iter_unpack(data[8:]))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content rows with what only they have, and rows of the shared chunks that they own."""
    press, unpress = zstandard.ZstdCompressor(level=9), zstandard.ZstdDecompressor()
    kind = pa.list_(pa.struct([("place", pa.int32()), ("digest", pa.binary())]))
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            rows = []
            for row in b.slice(at, ROWS).to_pylist():
                payload, at_byte, own = unpress.decompress(row["packed"]), 0, []
                for e in row["entries"]:
                    piece = payload[at_byte : at_byte + e["size"]]
                    at_byte += e["size"]
                    if not e["shared"]:
                        own.append(piece)
                    elif e["owned"]:
                        rows.append((None, e["digest"], None, None, press.compress(piece)))
                whole = len(own) == len(row["entries"])
                listed = manifest([(e["size"], e["digest"], e["shared"]) for e in row["entries"]])
                needed = [{"place": n, "digest": e["digest"]} for n, e in enumerate(row["entries"]) if e["shared"]]
                rows.append((row["content"], None, listed, needed, row["packed"] if whole else press.compress(b"".join(own))))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.binary(), pa.binary(), kind, pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["content", "digest", "manifest", "needed", "data"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Store all payloads. Returns (doc_id, n_bytes, content) of all documents and the chunk store, both as read back."""
    text = F.col(text_col).alias("text")
    kind = docs.schema[id_col].dataType.simpleString()
    cut = docs.select(F.col(id_col).alias("doc_id"), text).mapInArrow(
        _cut, f"doc_id {kind}, n_bytes long, content binary, recipe array<struct<digest:binary,size:int>>"
    )
    meta = settle(cut, "media-recipes")
    recipes = meta.groupBy("content").agg(F.first("recipe").alias("recipe"))
    entries = settle(recipes.select("content", F.posexplode("recipe").alias("place", "e")).select("content", "place", "e.*"), "media-entries")
    owners = settle(
        entries.groupBy("digest")
        .agg(F.min(F.struct("content", "place")).alias("owner"), F.max("content").alias("last"))
        .filter(F.col("owner.content") != F.col("last"))
        .drop("last"),
        "media-shared",
    )
    owned = F.coalesce((F.col("owner.content") == F.col("content")) & (F.col("owner.place") == F.col("place")), F.lit(False))
    plan = (
        entries.join(owners, "digest", "left")
        .withColumn("shared", F.col("owner").isNotNull())
        .select("content", F.struct("place", "digest", "size", "shared", owned.alias("owned")).alias("e"))
        .groupBy("content")
        .agg(F.array_sort(F.collect_list("e")).alias("entries"))
    )
    packed = docs.select(text).mapInArrow(_press, "content binary, packed binary").groupBy("content").agg(F.first("packed").alias("packed"))
    store = packed.join(plan.hint("merge"), "content").mapInArrow(_split, STORE)
    return meta.select("doc_id", "n_bytes", "content"), settle(store, "media-store")


def describe(payload: bytes, chunks: int) -> str:
    """Features of 8-bit samples: chunks, mean, root mean square around it, mean step, entropy in bits, loudest block of 64."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    steps = np.abs(np.diff(x)).sum() / (len(x) - 1)
    loudest = int(x.reshape(-1, UNIT).sum(axis=1).argmax())
    return f"{chunks}:{x.mean():.4f}:{x.std():.4f}:{steps:.4f}:{-(share * np.log2(share)).sum():.4f}:{loudest}"


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            out = []
            for row in b.slice(at, ROWS).to_pylist():
                own, at_byte = unpress.decompress(row["data"]), 0
                shared = {x["place"]: x["data"] for x in row["shared"] or ()}
                media, pieces = [row["manifest"], row["data"]], []
                for place, (size, name, elsewhere) in enumerate(read_manifest(row["manifest"])):
                    if elsewhere:
                        media.append(shared[place])
                        piece = unpress.decompress(shared[place])
                    else:
                        piece = own[at_byte : at_byte + size]
                        at_byte += size
                    if len(piece) != size or digest(piece) != name:
                        raise ValueError("a stored chunk does not match its digest")
                    pieces.append(piece)
                payload, stored = b"".join(pieces), b"".join(media)
                out.append((
                    row["content"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), describe(payload, len(pieces)),
                ))
            kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = [x.split()[0] for x in FEATURES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_media(store: DataFrame) -> DataFrame:
    """Features of every content from the chunk store."""
    rows = store.filter("content is not null").select("content", "manifest", "needed", "data")
    some = F.size("needed") > 0
    none = F.lit(None).cast("array<struct<place:int,data:binary>>").alias("shared")
    whole = rows.filter(~some).select("content", "manifest", "data", none)
    needed = rows.filter(some).select("content", F.explode("needed").alias("c")).select("content", "c.place", "c.digest")
    kept = store.filter("content is null").select("digest", F.col("data").alias("chunk"))
    fetched = needed.join(kept, "digest").groupBy("content").agg(F.collect_list(F.struct("place", F.col("chunk").alias("data"))).alias("shared"))
    partly = rows.filter(some).join(fetched, "content").select("content", "manifest", "data", "shared")
    return whole.mapInArrow(_rebuild, FEATURES).union(partly.mapInArrow(_rebuild, FEATURES))


def op9_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta, store = store_media(table(spark, sf_dir, "documents"))
    return meta.join(settle(read_media(store), "media-features"), "content").drop("content")
