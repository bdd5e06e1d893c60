import random
from collections import Counter

import xxhash

from tessella.llm.op5_simhash import components, fingerprint, links, near_duplicates


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest position reachable over pairs within two bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for text in [None, "", " \n", "one", "One two", "a b c d e f g", "É é A a É é", "x " * 40_000, "rep rep rep rep"]:
        assert fingerprint(text) == plain_fingerprint(text)


def test_all_links_in_sparse_and_dense_blocks(spark):
    rnd = random.Random(1)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    fps = {c ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) * rnd.randrange(2) for c in centres[:3] for _ in range(90)}
    fps |= {c ^ (1 << a) ^ (1 << b) for c in centres for a, b in [(1, 2), (3, 9), (60, 63)]} | {0, 1, (1 << 64) - 1}
    fps = sorted(fps)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    for limit in (4, 64, 10_000):
        roots = {r["node"]: r["root"] for r in components(links(frame, limit)).collect()}
        got = [roots.get(signed(f), signed(f)) for f in fps]
        want = plain_components(fps)
        assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_documents(spark):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(words, k=rnd.randrange(1, 120))) for _ in range(60)]
    texts += texts[:20] + [t + " extra" for t in texts[:30]] + [None, "", " ", "A b", "a B"] + [texts[0]] * 150
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, plain_components(fps), strict=True))}


def test_nulls_repeats_and_empty(spark):
    kind = "doc_id long, text string"
    rows = [(None, "same text here"), (5, "same text here"), (5, "same text here"), (None, None)]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, kind)).collect())
    assert got == {(None, 5): 1, (5, 5): 2, (None, None): 1}
    assert near_duplicates(spark.createDataFrame([], kind)).collect() == []
