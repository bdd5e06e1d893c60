import hashlib
import random
import zlib

import math

import zstandard

from tessella.llm.op9_media_chunks import GEAR, cuts, payload_of, read_manifest, read_media, store_media


def plain_cuts(payload, least, most, bits):
    ends, last = [], 0
    for i in range(len(payload)):
        h = sum(int(GEAR[payload[i - k]]) << k for k in range(min(i + 1, 32))) & 0xFFFFFFFF
        if i + 1 - last >= least and h >> 32 - bits == 0 or i + 1 - last == most:
            last = i + 1
            ends.append(last)
    return ends if last == len(payload) else [*ends, len(payload)]


def test_cuts():
    rnd = random.Random(1)
    for n in (64, 640, 6400):
        payload = bytes(rnd.choices(range(97, 123), k=n))
        assert cuts(payload, 64, 512, 7) == plain_cuts(payload, 64, 512, 7)
    assert cuts(bytes(100_000), 64, 512, 7)[-1] == 100_000


def test_payload():
    assert payload_of(None) == payload_of("") == bytes(64)
    assert payload_of("x" * 64) == b"x" * 64
    assert payload_of("é" * 33) == "é".encode() * 33 + bytes(62)


def test_round_trip(spark):
    rnd = random.Random(2)
    long = "".join(rnd.choices("abcdefgh \n", k=60_000))
    texts = [None, "", "short", "é😀", "short\0", "short", long, "X" + long, long[:30_000] + "Y" + long[30_000:], long, "z" * 200_000]
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, content string")
    meta, store = store_media(docs.repartition(3))
    found = meta.join(read_media(store), "content").collect()
    assert len(found) == len(texts)
    for r in found:
        data = (texts[r["doc_id"] or 0] or "").encode()
        payload = data + bytes((-len(data) % 64) or (0 if data else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
    by = {r["doc_id"] or 0: tuple(r)[2:] for r in found}
    assert by[2] == by[5] and by[6] == by[9] and by[0] == by[1]
    shared = store.filter("content is null")
    assert shared.count() == shared.select("digest").distinct().count() > 0
    assert read_media(store_media(docs.limit(0))[1]).collect() == []


def plain_feature(payload, chunks):
    n, counts = len(payload), [payload.count(i) for i in range(256)]
    mean = sum(payload) / n
    loud = [sum(payload[i : i + 64]) for i in range(0, n, 64)]
    spread = math.sqrt(sum((x - mean) ** 2 for x in payload) / n)
    steps = sum(abs(a - b) for a, b in zip(payload, payload[1:])) / (n - 1)
    entropy = -sum(c / n * math.log2(c / n) for c in counts if c)
    return [chunks, mean, spread, steps, entropy, loud.index(max(loud))]


def test_stored_form_and_features(spark):
    """Size and hash are those of the stored bytes, from which plain code rebuilds the payload; features by plain loops."""
    rnd = random.Random(4)
    long = "".join(rnd.choices("abcdefgh \n", k=40_000))
    texts = [None, "short", "é😀" * 40, long, "X" + long, long[:20_000] + "Y" + long[20_000:], "q" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    meta, store = store_media(docs)
    kept = store.collect()
    chunks = {bytes(r["digest"]): bytes(r["data"]) for r in kept if r["content"] is None}
    contents = {bytes(r["content"]): r for r in kept if r["content"] is not None}
    of = {bytes(r["content"]): texts[r["doc_id"]] for r in meta.collect()}
    unpress, some = zstandard.ZstdDecompressor().decompress, 0
    for r in read_media(store).collect():
        row, payload = contents[bytes(r["content"])], payload_of(of[bytes(r["content"])])
        listed = read_manifest(bytes(row["manifest"]))
        own, parts = unpress(bytes(row["data"])), []
        for size, name, shared in listed:
            parts.append(unpress(chunks[name]) if shared else own[:size])
            own = own if shared else own[size:]
        assert b"".join(parts) == payload and own == b"" and [len(p) for p in parts] == [x[0] for x in listed]
        stored = bytes(row["manifest"]) + bytes(row["data"]) + b"".join(chunks[name] for _, name, shared in listed if shared)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        got = [float(x) for x in r["feature"].split(":")]
        assert all(abs(a - b) < 1e-3 for a, b in zip(got, plain_feature(payload, len(listed)), strict=True))
        some += any(x[2] for x in listed)
    assert some >= 3
