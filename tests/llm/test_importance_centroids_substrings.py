import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.llm import op11_importance as op11
from tessella.llm import op12_centroids as op12
from tessella.llm import op13_substrings as op13
from tessella.llm.common import settle

KIND = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(text):
    words, word = [], ""
    for c in (text or "").translate(LOW) + " ":
        if ord(c) > 127 or c.isalnum():
            word += c
        elif word:
            words.append(word)
            word = ""
    return words


def plain_features(text, runs):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def plain_resampled(docs, items, buckets, runs, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in plain_features(t, runs))
    t = Counter(bucket(f) for _, x in items for f in plain_features(x, runs))
    whole_s, whole_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (whole_s + buckets) / ((s[b] + 1) * (whole_t + buckets))))
    rows = []
    for doc_id, text in docs:
        found = plain_features(text, runs)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(plain_words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    drawn = fit[: int(len(fit) * share) // 100]
    rank = {}
    for n, r in enumerate(drawn):
        rank.setdefault(r, []).append(n + 1)
    return Counter((*r, rank[r].pop() if rank.get(r) else None) for r in rows)


def corpus(n=120, seed=3):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma", "ÉTÉ", "delta9", "語", "x", "omega", "rho", "Tau"]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "-"]) for _ in range(rng.choice([0, 3, 19, 20, 21, 60])))) for i in range(n)]
    rows += [(None, None), (None, rows[5][1]), (None, "word " * 30), (None, "word " * 30), (n, None), (n + 1, ""), (n + 2, "?! "), rows[7], rows[7]]
    return rows + [(n + 3 + i, "same text " * 20) for i in range(60)] + [(n + 90, "lang " * 50_000)]


@pytest.mark.parametrize(("buckets", "runs", "share", "least"), [(10_000, 1, 10, 20), (7, 2, 50, 3), (64, 3, 100, 0)])
def test_resampling_against_plain_loops(spark, buckets, runs, share, least):
    docs, items = corpus(), [(1, "Alpha beta, alpha"), (2, None), (None, "gamma 語 gamma")]
    frame = spark.createDataFrame(docs, KIND).repartition(3).withColumns({c: F.lit(1) for c in ("bucket", "range", "salt", "weight", "block")})
    target = spark.createDataFrame(items, "item_id long, text string")
    got = op11.resampled(frame, target, buckets=buckets, max_run=runs, share=share, least_words=least).collect()
    assert Counter(map(tuple, got)) == plain_resampled(docs, items, buckets, runs, share, least)


def test_csr_blocks_hold_the_counts(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), KIND).coalesce(1)
    monkeypatch.setattr(op11, "BLOCK_ROWS", 50)
    blocks = op11.csr_blocks(docs, "doc_id", "text", 97, 1, "csr-test").collect()
    got = []
    for b in blocks:
        assert len(b.indptr) == len(b.doc_ids) + 1 == len(b.n_words) + 1
        for i, doc_id in enumerate(b.doc_ids):
            cells = slice(b.indptr[i], b.indptr[i + 1])
            assert b.indices[cells] == sorted(set(b.indices[cells]))
            got.append((doc_id, dict(zip(b.indices[cells], b.counts[cells], strict=True))))
    want = [(i, dict(Counter(zlib.crc32(f.encode()) % 97 for f in plain_words(t)))) for i, t in corpus()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_resampling_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a " * 30), (2, None)], KIND), spark.createDataFrame([], "item_id long, text string")
    assert op11.resampled(docs.limit(0), none).collect() == []
    assert Counter(map(tuple, op11.resampled(docs, none, share=100).collect())) == plain_resampled([(1, "a " * 30), (2, None)], [], 10_000, 1, 100, 20)


def test_blocks_are_held_one_at_a_time(spark, monkeypatch, tmp_path):
    """Many blocks in one file: workers get them one by one, Spark's reader takes one a batch, and row groups end by their bytes."""
    docs, items = [(i, f"alpha beta w{i}") for i in range(60)], [(1, "alpha w7")]
    plain, original, readers = tmp_path / "batches", type(spark.range(0)).mapInArrow, {}

    def noted(batches):
        for b in batches:
            with plain.open("a") as f:
                print("indices" in b.schema.names, b.num_rows, file=f)
            yield b

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, f, *a, **k: original(self, lambda batches: f(noted(batches)), *a, **k))
    keep = lambda df, name, *a, f=op11.settle, **k: (readers.setdefault(name, (spark.conf.get("spark.sql.parquet.columnarReaderBatchSize"), k)), f(df, name, *a, **k))[1]
    monkeypatch.setattr(op11, "settle", keep)
    monkeypatch.setattr(op11, "BLOCK_ROWS", 2)
    before = {k: spark.conf.get(k) for k in op11.ONE_ROW}
    got = op11.resampled(spark.createDataFrame(docs, KIND).coalesce(1), spark.createDataFrame(items, "item_id long, text string"), share=50, least_words=0).collect()
    assert Counter(map(tuple, got)) == plain_resampled(docs, items, 10_000, 1, 50, 0)
    of_blocks = [int(n) for kind, n in map(str.split, plain.read_text().splitlines()) if kind == "True"]
    assert len(of_blocks) >= 60 and set(of_blocks) == {1}
    assert readers["scored"][0] == "1" and readers["csr-corpus"][1]["options"] == op11.WIDE_ROWS
    assert {k: spark.conf.get(k) for k in op11.ONE_ROW} == before


def test_row_groups_of_wide_rows_end_by_their_bytes(spark):
    from tessella.storage import WIDE_ROWS

    wide = spark.range(0, 40, 1, 1).withColumn("cells", F.transform(F.sequence(F.lit(1), F.lit(50_000)), lambda i: F.hash(i, F.col("id"))))
    (file,) = settle(wide, "wide", options=WIDE_ROWS | {"parquet.block.size": f"{1 << 20}"}).inputFiles()
    groups = pq.ParquetFile(file.removeprefix("file://")).metadata
    assert groups.num_rows == 40 and max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 10


def plain_lloyd(rows, clusters, dims, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:clusters]]
    apart = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(centres)), key=lambda k: (apart(v, centres[k]), k))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        groups = [[v for (_, v), o in zip(kept, own, strict=True) if o == k] for k in range(len(centres))]
        centres = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else centres[k] for k, g in enumerate(groups)]
    out = [(i, near(v), apart(v, centres[near(v)])) for i, v in kept]
    inertia = Counter()
    for _, k, d in out:
        inertia[k] += d
    return Counter((i, k, d, inertia[k], sum(inertia.values()), tuple(centres[k])) for i, k, d in out)


def test_lloyd_against_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 3) for _ in range(6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(80)] + [(None, [1.0] * 6), (None, [1.0] * 6), rows[0], rows[0], (0, [9.0] * 6)]
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 5 + [None]), (304, [math.nan] * 6), (305, [math.inf] * 6), (306, [-math.inf] * 6), (307, [-0.001] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit(1) for c in ("parts", "cluster", "distance")})
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    for clusters, rounds in ((5, 3), (16, 1), (400, 2)):
        got = op12.clustered(frame, clusters=clusters, dims=6, rounds=rounds).collect()
        assert Counter((*r[:5], tuple(r[5])) for r in got) == plain_lloyd(rows, clusters, 6, rounds)
    assert op12.clustered(frame.limit(0), dims=6).collect() == []
    with pytest.raises(Exception, match="too large for exact distances"):
        op12.clustered(spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<float>"), dims=6).collect()


def test_nearest_takes_the_first_of_equal_centroids():
    own, distance = op12.nearest(np.array([[0, 0], [2, 0], [4, 0]]), np.array([[1, 0], [1, 0], [3, 0]]))
    assert own.tolist() == [0, 0, 2] and distance.tolist() == [1, 1, 1]


def plain_without(rows):
    split = [(t or "").replace("\t", " ").replace("\n", " ").split(" ") for _, t in rows]
    split = [[w for w in s if w] for s in split]
    first = {}
    for (doc_id, _), w in zip(rows, split, strict=True):
        for i in range(len(w) - 49):
            if doc_id is not None:
                key = tuple(w[i : i + 50])
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(rows, split, strict=True):
        gone = set()
        for i in range(len(w) - 49):
            owner = first.get(tuple(w[i : i + 50]))
            if owner is not None and (doc_id is None or doc_id > owner):
                gone |= set(range(i, i + 50))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def repeating(seed):
    rng = random.Random(seed)
    own = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(4000)}" for _ in range(n)]
    passage, long = own(61), own(300)
    rows = []
    for i in range(60):
        cut = rng.randrange(0, 12)
        rows.append((i, " ".join(own(rng.randrange(40)) + passage[cut:] + own(rng.randrange(60)))))
    for i in range(20):
        a = rng.randrange(200)
        rows.append((100 + i, " ".join(own(rng.randrange(30)) + long[a : a + rng.choice([49, 50, 51, 75, 100])] + own(5))))
    near = own(200)
    for i in range(25):
        copy = list(near)
        copy[rng.randrange(200)] = "changed"
        rows.append((200 + i, "\n".join(copy)))
    rows += [(300 + i, " ".join(long)) for i in range(30)] + [(None, " ".join(long)), (None, " ".join(own(3) + passage)), (None, " ".join(near[:80])), (None, " ".join(near[:80]))]
    rows += [(400, None), (401, ""), (402, "a b"), (403, " ".join(["same"] * 500)), (404, " ".join(["same"] * 49)), (405, " ".join(["same"] * 50)), (405, " ".join(passage)), rows[3], rows[3]]
    rows += [(500, " ".join(own(30_000))), (-7, " ".join(passage[5:58])), (600, "a\u00a0b " * 60), (601, "a\u00a0b\t" * 55), (602, " ".join(["ab"] * 10 + ["ba"] * 10) + " " + " ".join(["ab", "ba"] * 30))]
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_substrings_against_plain_loops(spark, seed):
    rows = repeating(seed)
    random.Random(seed).shuffle(rows)
    frame = spark.createDataFrame(rows, KIND).repartition(1 + 4 * seed).withColumns({c: F.lit(1) for c in ("row", "key", "marks", "hits", "starts", "owner")})
    got = op13.without_repeats(frame).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == plain_without(rows)
    assert all(sum(s.stop - s.start for s in r.repeats) == r.n_removed for r in got)


def test_substrings_of_empty_tables(spark):
    assert op13.without_repeats(spark.createDataFrame([], KIND)).collect() == []
    assert [tuple(r)[:4] for r in op13.without_repeats(spark.createDataFrame([(1, None)], KIND)).collect()] == [(1, 0, 0, "")]


def test_index_takes_blocks_and_filter_keeps_runs(spark):
    """Hits are runs that equal a reference block of another text, and every repeated window holds one."""
    rows = [(i, t) for i, (_, t) in enumerate(r for r in repeating(9) if r[1] and len(r[1].split()) >= 50)]
    texts = spark.createDataFrame(rows, KIND).select("doc_id", F.col("text").cast("binary").alias("text"), F.col("doc_id").alias("row"))
    work = settle(texts.join(op13.shared_grams(texts), "row"), "test-work")
    hits = {r.row: set(r.hits) for r in op13.anchor_hits(work).collect()}
    words = {i: re.split("[ \t\n]+", t.strip(" ")) for i, t in rows}
    blocks = {}
    for i, w in words.items():
        for at in range(0, len(w) - 24, 25):
            blocks.setdefault(tuple(w[at : at + 25]), set()).add(i)
    for i, w in words.items():
        for at in range(len(w) - 24):
            if blocks.get(tuple(w[at : at + 25]), set()) - {i}:
                assert at in hits[i]
