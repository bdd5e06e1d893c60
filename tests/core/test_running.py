import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import signals as S
from tessella.operators.evaluation import holders
from tessella.operators.running import nearby, numbered, running


def series(n=40):
    rnd = random.Random(n)
    return [(k, i, float(rnd.randrange(9)) if rnd.random() < 0.8 else None) for k, size in ((1, n), (2, 7), (None, 5)) for i in range(size)]


def test_sums_and_maxima_in_buckets(spark):
    rows = series()
    frame = spark.createDataFrame(rows, "k int, i long, v double").repartition(5)
    for size in (1, 3, 1000):
        sums = {(r["k"], r["i"]): r["s"] for r in running(frame, "s", F.col("v"), "k", "i", size=size).collect()}
        tops = {(r["k"], r["i"]): r["s"] for r in running(frame, "s", F.col("v"), "k", "i", F.max, size).collect()}
        near = {(r["k"], r["i"]): r["s"] for r in nearby(frame, "s", F.max("v"), "k", "i", 2, 1, size=size).collect()}
        for k, i, _ in rows:
            seen = [v for a, b, v in rows if a == k and b <= i and v is not None]
            around = [v for a, b, v in rows if a == k and i - 2 <= b <= i + 1 and v is not None]
            assert (sums[k, i], tops[k, i], near[k, i]) == (sum(seen), max(seen, default=None), max(around, default=None))
        assert len(sums) == len(tops) == len(near) == len(rows)


def test_numbers(spark):
    rows = [(k, i * 7 % 40, i) for k, i, _ in series()]
    got = numbered(spark.createDataFrame(rows, "k int, at long, i long"), "n", "k", F.expr("at div 4"), "at").collect()
    for k in (1, 2, None):
        own = sorted((r["at"], r["n"]) for r in got if r["k"] == k)
        assert [n for _, n in own] == list(range(len(own)))


@pytest.mark.parametrize("run", [10, 8192])
def test_percentiles_of_long_recordings(spark, monkeypatch, run):
    """Anchors in many runs equal those by plain windows."""
    import numpy as np

    monkeypatch.setattr(S, "RUN", run)
    rnd = np.random.default_rng(1)
    found = {1: rnd.normal(size=300), 2: rnd.normal(size=3)}
    frames = spark.createDataFrame([(r, i, float(v)) for r, x in found.items() for i, v in enumerate(x)], "rec_id int, f long, db double")
    got = {(r["rec_id"], r["f"]): r["level"] for r in S.rolling_percentile(frames, 12, step=5).collect()}
    for r, x in found.items():
        at = range(0, len(x), 5)
        want = np.interp(range(len(x)), at, [np.percentile(x[max(0, a - 12) : a + 13], 75) for a in at])
        assert np.allclose([got[r, i] for i in range(len(x))], want)


@pytest.mark.parametrize("most", [200_000, 0])
def test_anchors_meet_texts(spark, most):
    texts = ["the cat sat", "a the", "cat", None, "sat the cat sat on", ""]
    anchors = ["The cat", "cat sat on", "a", "the", "", None, "the cat sat on the mat"]
    got = holders(spark.createDataFrame(list(enumerate(texts)), "text_id int, text string"), spark.createDataFrame(list(enumerate(anchors)), "anchor_id int, anchor string"), most_broadcast=most)
    pad = lambda t: f" {(t or '').lower()} "
    want = {(i, j) for i, t in enumerate(texts) for j, a in enumerate(anchors) if a and pad(a) in pad(t)}
    assert {tuple(r) for r in got.collect()} == want


def test_columns_of_the_rows_stay(spark):
    rows = [(k, i, 1.0, "own", "own", "own") for k, i, _ in series()]
    frame = spark.createDataFrame(rows, "k int, i long, v double, _at string, _own string, _carry string")
    for got in (running(frame, "s", F.col("v"), "k", "i", size=3), numbered(frame, "s", "k", F.expr("i div 4"), "i"), nearby(frame.withColumn("_bucket", F.lit("own")), "s", F.sum("v"), "k", "i", 1, 1, size=3)):
        own = [c for c in got.columns if c.startswith("_")]
        assert {tuple(set(r)) for r in got.select(*own).collect()} == {("own",)}


def test_quoting_marks_in_anchors(spark):
    """Anchors are no patterns, whatever they hold."""
    from tessella.operators.evaluation import spans_of

    texts = spark.createDataFrame([("c", r"a foo \e Bar (x) [y] \Q z")], "case string, text string")
    anchors = spark.createDataFrame([("c", r"FOO  \E bar"), ("c", "(X) [y]"), ("c", r"\q Z"), ("c", "absent"), ("c", " "), ("c", None)], "case string, anchor string")
    got = {r["anchor"]: (r["start"], r["stop"]) for r in spans_of(texts, anchors).collect()}
    assert got == {r"FOO  \E bar": (2, 12), "(X) [y]": (13, 20), r"\q Z": (21, 25)}


def test_windows_slide_as_plain_loops_do(spark):
    from tessella.operators.evaluation import LEAST_WINDOW, STOP_WORDS, best_windows

    rnd = random.Random(8)
    vocabulary = ["the", "cat", "dog", "ran", "far", "um", "blue", "sea"]
    say = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    alts = [(c, i, say(rnd.randrange(0, 12))) for c in range(4) for i in range(6)]
    sources = [(c, i, say(rnd.randrange(0, 25))) for c in range(4) for i in range(3)]
    got = {(r["case"], r["alt_id"]): (r["share"], r["src_idx"], r["start"]) for r in best_windows(spark.createDataFrame(alts, "case int, alt_id int, text string"), spark.createDataFrame(sources, "case int, src_idx int, text string")).collect()}
    want = {}
    for c, i, text in alts:
        told = [w for w in text.split() if w not in STOP_WORDS]
        n, best = max(len(told), LEAST_WINDOW), (0, 0, 0)
        for c2, s, other in sources:
            w = other.split()
            for start in range(max(len(w) - n, 0) + 1 if c2 == c and told else 0):
                share = len(set(told) & set(w[start : start + n])) / len(set(told))
                best = max(best, (share, -s, -start), key=lambda b: (b[0] > 0, b)) if share else best
        if best[0]:
            want[c, i] = (best[0], -best[1], -best[2])
    assert got == want and len(want) > 10
