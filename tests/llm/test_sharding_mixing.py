import math
import random
import zlib
from collections import Counter, defaultdict

from tessella.llm import op3_mixing
from tessella.llm.op2_sharding import schedule, shard_documents
from pyspark.sql import functions as F

from tessella.llm.op3_mixing import GOLDEN_HIGH, GOLDEN_LOW, mix, point, schedule as deal, source_targets, taken_words, word_count

KIND = "doc_id long, source string, text string, size string"


def test_schedule():
    rnd = random.Random(1)
    items = [(i, rnd.randrange(1, 1000)) for i in range(300)]
    loads = [0] * 7
    want = {}
    for k, s in sorted(items, key=lambda x: (-x[1], x[0])):
        shard = min(range(7), key=lambda j: (loads[j], j))
        want[k] = shard
        loads[shard] += s
    assert schedule(items, 7) == want
    assert max(loads) <= (4 / 3) * max(sum(loads) / 7, max(s for _, s in items)) + 1


def documents(spark, n=500):
    rnd = random.Random(n)
    texts = [" ".join(rnd.choices(["aa", "é", "ccc", "d"], k=rnd.randrange(0, 60))) for _ in range(n)]
    rows = [(i, f"s{int(9 * rnd.random() ** 2)}" if i % 50 else None, t, "x") for i, t in enumerate(texts)]
    rows += [(1000 + i, "s0", texts[3] + " copy", "x") for i in range(n // 3)] + [(None, "s1", None, "x"), (None, "s1", None, "x"), (5000, "s9", "", "x")]
    return rows, spark.createDataFrame(rows, KIND).repartition(4)


def test_sharding(spark):
    rows, frame = documents(spark)
    got = shard_documents(frame, shards=4).collect()
    assert len(got) == len(rows)
    by = {r[0]: r for r in rows}
    where, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        text = by[r["doc_id"]][2]
        assert (r["size"], r["text_crc32"]) == (len((text or "").encode()) + 16, zlib.crc32((text or "").encode()))
        where[text].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(loads) == [0, 1, 2, 3] and max(loads.values()) - min(loads.values()) < sum(loads.values()) / 4 * 0.5
    assert shard_documents(frame.limit(0)).collect() == []


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, total, target = set(order), float(sum(sizes.values())), {}
    while left:
        share = total / sum(weight[s] for s in left)
        full = {s for s in left if share * weight[s] > cap * sizes[s]}
        for s in full or left:
            target[s] = float(cap * sizes[s]) if full else share * weight[s]
        total -= sum(target[s] for s in full)
        left = left - full if full else set()
    return target


def test_mixing(spark):
    rows, frame = documents(spark)
    mixed = mix(frame, block_words=16)
    got = taken_words(mixed).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, s, t, _ in rows:
        sizes[s] += len((t or "").split())
    target = filled(sizes)
    taken = defaultdict(int)
    for r in got:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) < 1 + 1e-6 for s, t in target.items())
    # Every slot is one block of one source, and any early stretch of the schedule is near the weights.
    pieces = [r for r in mixed.collect() if r["slot"] is not None]
    of = defaultdict(set)
    for p in pieces:
        of[p["slot"]].add(p["source"])
    assert all(len(s) == 1 for s in of.values())
    whole = sum(math.floor(t) for t in target.values())
    for n in (50, 100, 200):
        for s, t in target.items():
            share = sum(p["words"] for p in pieces if p["slot"] < n and p["source"] == s) / (16 * n)
            assert abs(share - t / whole) < 0.12
    assert taken_words(mix(frame, block_words=16)).exceptAll(taken_words(mixed)).count() == 0
    assert taken_words(mix(frame.limit(0))).collect() == []
    assert [r["taken"] for r in taken_words(mix(spark.createDataFrame([(1, None, None, "x")], KIND))).collect()] == [0]


def test_groups_and_bundles_by_plain_scheduling(spark):
    """Groups and bundles rebuilt by plain code and dealt by a plain loop; the fullest shard is above the mean by no more than its last item."""
    rows, frame = documents(spark)
    rows.append((9000, "s0", "long " * 30_000, "x"))
    frame = spark.createDataFrame(rows, KIND).repartition(3)
    shards, grain = 4, 16
    keyed = frame.select("doc_id", "text", F.xxhash64(F.col("text").isNull(), F.col("text")).alias("k")).collect()
    groups = defaultdict(int)
    for r in keyed:
        groups[r["k"]] += len((r["text"] or "").encode()) + 16
    large = -(-sum(groups.values()) // (shards * grain))
    item = {k: (True, k) if b >= large else (False, k % (shards * grain)) for k, b in groups.items()}
    sizes = defaultdict(int)
    for k, b in groups.items():
        sizes[item[k]] += b
    loads, last, where = [0] * shards, [0] * shards, {}
    for key, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        shard = min(range(shards), key=lambda j: (loads[j], j))
        where[key], last[shard] = shard, size
        loads[shard] += size
    got = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in shard_documents(frame, shards=shards, grain=grain).collect()}
    assert all(got[r["doc_id"], zlib.crc32((r["text"] or "").encode())] == where[item[r["k"]]] for r in keyed)
    fullest = max(range(shards), key=loads.__getitem__)
    assert loads[fullest] - sum(loads) / shards <= last[fullest]


def test_points():
    """The arithmetic in parts equals plain whole numbers."""
    golden = (GOLDEN_HIGH << 24) + GOLDEN_LOW
    assert abs(golden / 2**48 - (math.sqrt(5) - 1) / 2) < 2**-46 and golden % 2


def test_slots_claim_every_block(spark):
    rnd = random.Random(8)
    for k in [0, 1, 2, 2**24 - 1, 2**24, 2**40 + 12345, 2**48 + 7]:
        got = spark.range(1).select(point(F.lit(k).cast("long"))).first()[0]
        assert got == k % 2**48 * ((GOLDEN_HIGH << 24) + GOLDEN_LOW) % 2**48
    # A tiny source beside large ones gets its block, and slots before its first are as many as points miss it.
    rows = [(i, f"s{i % 3}", "w " * rnd.randrange(200, 900), "x") for i in range(120)] + [(500, "t", "few words", "x"), (501, None, "one", "x")]
    frame = spark.createDataFrame(rows, KIND)
    sized = frame.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    targets = source_targets(sized, (5, 2, 1), 3, 64).cache()
    total = targets.agg(F.max("hi")).first()[0]
    slots = sorted((r["slot"], r["rank"], r["j"]) for r in deal(spark, targets, total).collect())
    blocks = {r["rank"]: (r["lo"], r["hi"]) for r in targets.collect()}
    seen, want, k = defaultdict(int), [], 0
    while len(want) < total:
        at = k * ((GOLDEN_HIGH << 24) + GOLDEN_LOW) % 2**48 / 2**48 * total
        rank = next(r for r, (lo, hi) in blocks.items() if lo <= at < hi)
        if seen[rank] < blocks[rank][1] - blocks[rank][0]:
            want.append((k, rank, seen[rank]))
        seen[rank] += 1
        k += 1
    assert slots == want
    taken = taken_words(mix(frame, block_words=64)).collect()
    assert {r["doc_id"]: r["taken"] for r in taken if r["source"] in ("t", None)}[500] > 0
    assert all(r["taken"] == 0 or r["first_slot"] is not None for r in taken)


def test_many_null_ids(spark):
    rows = [(None, "s0", f"w{i} " * (i % 7), "x") for i in range(300)]
    got = taken_words(mix(spark.createDataFrame(rows, KIND).repartition(5), block_words=8)).collect()
    assert len(got) == 300 and sum(r["taken"] for r in got) == sum(r["size"] for r in got)


def test_reruns_agree_over_other_files(spark, monkeypatch):
    """One id, or none, in many rows: what is taken depends neither on partitions nor on chunks of equal rows."""
    rows = [(None if i % 2 else 7, "word " * (i % 9), f"s{i % 3}") for i in range(400)] + [(i, "a b c", "s1") for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = []
    for parts, copies in ((1, 1 << 16), (3, 1 << 16), (7, 4)):
        monkeypatch.setattr(op3_mixing, "COPIES", copies)
        mixed = op3_mixing.mix(frame.repartition(parts), block_words=16)
        taken = op3_mixing.taken_words(mixed).collect()
        assert Counter((r["doc_id"], r["size"], r["source"]) for r in taken) == Counter((i, len(t.split()), s) for i, t, s in rows)
        assert all(r["taken"] <= 3 * r["size"] for r in taken)
        assert mixed.select("row").distinct().count() == len(rows)
        found.append(Counter(map(tuple, taken)))
    assert found[0] == found[1] == found[2]
