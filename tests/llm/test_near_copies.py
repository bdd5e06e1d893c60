import random

import pytest

import corpus_pipeline
from tessella.llm import near_copies as N

KIND = "doc_id long, text string"


def plain_sets(texts, width=5):
    words = [(t or "").lower().split() for t in texts]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]


def plain_components(sets):
    """Smallest position reachable over pairs with a Jaccard similarity of 0.8 or more."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def corpus():
    rnd = random.Random(3)
    line = " ".join(f"l{i}" for i in range(12))
    texts = [" ".join(rnd.choices([f"w{i}" for i in range(300)], k=rnd.randrange(1, 90))) for _ in range(80)]
    texts = [f"{t} {line}" if i % 2 else t for i, t in enumerate(texts)]
    for t in texts[:40]:
        for _ in range(3):
            words = t.split()
            words[rnd.randrange(len(words))] = "changed"
            texts.append(" ".join(words) + " tail" * rnd.randrange(3))
    family = [f"f{i}" for i in range(100)]
    for _ in range(60):
        texts.append(" ".join("new" if i == rnd.randrange(100) else w for i, w in enumerate(family)))
    return texts + texts[:5] + [texts[6].upper(), None, "", "a b", "A  b", "a b c", "1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8", "1 2 3 4 5 6 7"]


@pytest.mark.parametrize("common", [4, 1])
def test_all_similar_pairs_are_linked(spark, monkeypatch, common):
    monkeypatch.setattr(N, "SAMPLE", 1 if common == 1 else 16)
    monkeypatch.setattr(N, "COMMON", common)
    texts = corpus()
    want = plain_components(plain_sets(texts))
    assert 20 < len(set(want)) < len(texts) - 60
    frame = spark.createDataFrame(list(enumerate(texts)), KIND)
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(frame).collect()} == dict(enumerate(want))


def test_stage_drops_what_fingerprints_miss(spark):
    texts = corpus()
    frame = spark.createDataFrame(list(enumerate(texts)), KIND)
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(plain_components(plain_sets(texts))))


def test_a_loose_family_is_joined_without_all_its_pairs(spark, monkeypatch):
    # Each text has two words of its own; only texts that have them at nearly the same place are similar enough.
    rnd, tried = random.Random(5), []
    base = [f"w{rnd.getrandbits(40)}" for _ in range(100)]
    texts = []
    for i in range(300):
        at = rnd.randrange(99)
        texts.append(" ".join([*base[:at], f"x{i}", f"y{i}", *base[at + 2 :]]))
    want = plain_components(plain_sets(texts))
    assert len(set(want)) < 10
    settle = N.settle

    def counted(df, name, **more):
        out = settle(df, name, **more)
        if name == "close-pairs":
            tried.append(out.count())
        return out

    monkeypatch.setattr(N, "settle", counted)
    frame = spark.createDataFrame(list(enumerate(texts)), KIND).repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in N.near_copies(frame).collect()} == dict(enumerate(want))
    assert sum(tried) < 6 * len(texts)
