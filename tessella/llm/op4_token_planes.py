"""Token ids in a chunked binary format: fixed-size id blocks are transposed into bit or byte planes, each compressed.

Format: a table of chunks in the shared store, one row a block of ``BLOCK`` ids (the last of a part is shorter): part and
chunk number, the ids before it in its part, its number of ids, the ids and positions of the documents that begin in it, whether its last document goes
on in the next chunk, and the payload: ``PLN1``, mode (1 bit planes, 2 byte planes), number of planes, ids, then each plane as a length and a
zstandard frame. Part, position and document columns form the chunk index; columnar storage lets it be read without the
payloads. Parts follow ascending ids, so the position of a part is the sum of the parts before it.

Tokens: a byte-level BPE encodes each pre-token by itself, so texts of common characters are split by the tokenizer's
rule and each distinct piece is encoded once by the tokenizers library, new ones many to a call, a line each; all other
texts (also those that hold a special token's string) are encoded whole. Both ways give the same ids.

Scale: one range shuffle orders the documents; encoding, planes and reading run within tasks that hold one block. Of the
documents that cross blocks only the parts are shuffled to be joined.

Edge cases: null and empty texts are the end id alone. Null ids come first; repeated rows are encoded as often as they occur,
in the order of id and text. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, settle, table

BLOCK = 1 << 16
END = 0
#: Distinct pieces kept encoded in a worker, and how many are encoded in one text.
PIECES, LINES = 600_000, 256
_PUNCTUATION = r"!-/:-@\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7‐-‧‰-⁞₠-₿"
#: Texts of these characters alone split alike under all versions of the Unicode tables.
COMMON = re.compile(rf"[\t\n\r A-Za-z0-9\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ{_PUNCTUATION}]*")
SPLIT = re.compile(rf" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|'(?:[sdmt]|ll|ve|re)| ?[0-9]+| ?[{_PUNCTUATION}]+|\s+(?!\S)|\s+")
CHUNK = "part int, chunk int, first long, n_ids int, doc_ids array<long>, doc_starts array<int>, open boolean, payload binary"


class Encoder:
    """Texts to ids as little-endian 32-bit integers, with pieces encoded once."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces: dict[str, bytes] = {}
        alone = self._encode(["\n"])[0]
        #: The id of a line break, if it is one id.
        self.line_break = int(alone[0]) if len(alone) == 1 else None

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Encode new pieces: those without white space but for a leading space as lines, since a line break is a piece by itself."""
        lines = [p for p in pieces if self.line_break is not None and not p[-1].isspace()]
        groups = [lines[i : i + LINES] for i in range(0, len(lines), LINES)]
        for own, ids in zip(groups, self._encode(["\n".join(g) for g in groups]), strict=True):
            cuts = np.flatnonzero(ids == self.line_break)
            if len(cuts) == len(own) - 1:
                data = ids.tobytes()
                ends = [*(4 * cuts).tolist(), len(data)]
                self.pieces.update((p, data[a:z]) for p, a, z in zip(own, [0, *(4 * cuts + 4).tolist()], ends, strict=True))
        left = [p for p in pieces if p not in self.pieces]
        self.pieces.update(zip(left, (i.tobytes() for i in self._encode(left)), strict=True))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        if len(self.pieces) > PIECES:
            # Pieces met first are the frequent ones more often than later ones.
            self.pieces = dict(islice(self.pieces.items(), PIECES // 2))
        split = [None if COMMON.fullmatch(t) is None or any(s in t for s in self.special) else SPLIT.findall(t) for t in texts]
        self._learn(set().union(*[s for s in split if s]).difference(self.pieces))
        others = iter(self._encode([t for t, own in zip(texts, split, strict=True) if own is None]))
        for own in split:
            yield next(others).tobytes() if own is None else b"".join(map(self.pieces.__getitem__, own))


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pack(ids: np.ndarray, mode: str = "byte", level: int = 3) -> bytes:
    """The payload of a block of 32-bit ids."""
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if mode == "bit":
        planes = np.packbits(np.unpackbits(wide, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(wide.T)
    press = zstandard.ZstdCompressor(level=level)
    frames = [press.compress(p.tobytes()) for p in planes]
    head = struct.pack("<4sBBI", b"PLN1", 1 if mode == "bit" else 2, len(frames), len(ids))
    return head + b"".join(struct.pack("<I", len(f)) + f for f in frames)


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload."""
    magic, mode, count, n = struct.unpack_from("<4sBBI", payload)
    if magic != b"PLN1" or mode not in (1, 2):
        raise ValueError("not a block of token planes")
    press, at, planes = zstandard.ZstdDecompressor(), 10, []
    for _ in range(count):
        (size,) = struct.unpack_from("<I", payload, at)
        planes.append(np.frombuffer(press.decompress(payload[at + 4 : at + 4 + size]), np.uint8))
        at += 4 + size
    wide = np.stack(planes)
    if mode == 1:
        bits = np.unpackbits(wide, axis=1, bitorder="little")[:, :n]
        wide = np.packbits(bits.T, axis=1, bitorder="little")
        return np.ascontiguousarray(wide).view("<u4").ravel()
    return np.ascontiguousarray(wide.T).view("<u4").ravel()


def write_tokens(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "byte", block: int = BLOCK
) -> DataFrame:
    """Encode all documents in id order into a chunk table in the shared store, which is returned as read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, schema = TaskContext.get().partitionId(), encoder(tokenizer), None
        buffer, first, chunk, ids, starts = bytearray(), 0, 0, [], []

        def emit(n: int, closed: bool) -> pa.RecordBatch:
            nonlocal buffer, first, chunk, ids, starts
            here = sum(s < n for s in starts)
            row = [part, chunk, first, n, ids[:here], starts[:here], not closed, pack(np.frombuffer(bytes(buffer[: 4 * n]), "<u4"), mode)]
            buffer, ids, starts = buffer[4 * n :], ids[here:], [s - n for s in starts[here:]]
            first, chunk = first + n, chunk + 1
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_(), pa.binary()]
            names = [c.split()[0] for c in CHUNK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for b in batches:
            keys = b.column(0).to_pylist()
            for at in range(0, len(keys), 256):
                texts = [t or "" for t in b.column(1).slice(at, 256).to_pylist()]
                for key, coded in zip(keys[at : at + 256], encode(texts), strict=True):
                    ids.append(key)
                    starts.append(len(buffer) // 4)
                    buffer += coded + struct.pack("<I", END)
                    while len(buffer) >= 4 * block:
                        yield emit(block, len(buffer) == 4 * block)
        if buffer:
            yield emit(len(buffer) // 4, True)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    return settle(ordered.mapInArrow(run, CHUNK), "token-planes")


def read_tokens(chunks: DataFrame) -> DataFrame:
    """Per document from its chunks: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, starts = unpack(row["payload"]), row["doc_starts"]
                if len(ids) != row["n_ids"]:
                    raise ValueError("a block of token planes has another length than its index says")
                out = []
                # What precedes the first document's start belongs to the document of an earlier chunk.
                for key, a, z in zip([None, *row["doc_ids"]], [0, *starts], [*starts, len(ids)], strict=True):
                    if a < z:
                        whole = ids[a:z]
                        begun = a > 0 or 0 in starts
                        closed = begun and not (z == len(ids) and row["open"])
                        data = whole.astype("<u4").tobytes()
                        out.append((row["part"], row["first"] + a, key, begun, z - a, zlib.crc32(data) if closed else None, None if closed else data))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
                names = ["part", "at", "doc_id", "begun", "n", "crc", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    pieces = settle(chunks.mapInArrow(run, "part int, at long, doc_id long, begun boolean, n long, crc long, ids binary"), "token-pieces")
    # Pieces without a checksum are parts of the documents that cross blocks, at most two a block.
    crossing = pieces.filter("crc is null")
    order = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = crossing.withColumn("head", F.max(F.when(F.col("begun"), F.col("at"))).over(order))
    joined = named.groupBy("part", "head").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("all")
    )

    @F.pandas_udf("long")
    def checksum(parts):
        return parts.map(lambda own: zlib.crc32(b"".join(own)))

    whole = pieces.filter("crc is not null").select("part", "at", "doc_id", "n", "crc")
    whole = whole.union(joined.select("part", "head", "doc_id", "n", checksum(F.transform("all", lambda x: x["ids"])).alias("crc")))
    sizes = chunks.groupBy("part").agg(F.sum("n_ids").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part, not a document
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return whole.join(bounded_broadcast(bases, 100_000), "part").select(
        "doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")
    )


def op4_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
