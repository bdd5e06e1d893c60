import importlib
import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_near_copies import plain_components as plain_links
from tests.llm.test_near_copies import plain_sets

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(5)
    vocabulary = {"en": ["the", "and", "thing", "with", "hand"], "de": ["und", "der", "schein", "zug", "nicht"]}
    texts = []
    for i in range(80):
        lang = "en" if i % 3 else "de"
        texts.append((" ".join("".join(rnd.choices(vocabulary[lang], k=rnd.randrange(1, 4))) for _ in range(rnd.randrange(5, 60))), lang))
    rows = [(i, t, g, f"s{i % 4}" if i % 11 else None, len(t)) for i, (t, g) in enumerate(texts)]
    rows += [(100 + i, rows[i][1], "en", "s1", 1) for i in range(10)] + [rows[7]]
    return rows + [(200, None, "en", "s1", None), (201, "", None, "s0", 0), (202, "123 !", "de", "s0", 5), (None, rows[20][1] + " nameless tail words", None, None, 3)]


def test_stages(spark, tmp_path):
    rows = corpus()
    bench = " ".join(rows[12][1].split()[:15])
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/step{n}")
        docs = spark.read.parquet(f"{tmp_path}/step{n}")
        steps.append([tuple(r) for r in docs.collect()])
        if n < 4:
            assert docs.columns == [c.split()[0] for c in KIND.split(", ")]
    assert Counter(steps[0]) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    order = sorted(set(steps[0]), key=lambda r: (r[0] is None, r[0] or 0))
    roots = plain_links(plain_sets([r[1] for r in order]))
    assert Counter(steps[1]) == Counter(order[i] for i in set(roots))
    assert Counter(steps[2]) == Counter(r for r in steps[1] if bench not in r[1])
    assert len(steps[2]) < len(steps[1])
    sizes = Counter()
    for r in steps[2]:
        sizes[r[3]] += len(r[1].split())
    from tests.llm.test_sharding_mixing import filled

    target, took, many = filled(sizes), Counter(), Counter(steps[3])
    assert set(many) <= set(steps[2]) and max(many.values()) <= 3
    for r in steps[3]:
        took[r[3]] += len(r[1].split())
    longest = max(len(r[1].split()) for r in steps[2])
    assert all(t - 1 <= took[s] <= t + longest for s, t in target.items())
    assert Counter(r[0] for r in steps[4]) == Counter(r[0] for r in steps[3])
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in whole.collect()) == Counter((r[0], r[1], r[4], r[5]) for r in steps[4])


def test_stages_with_near_copies_by_shingles(spark, tmp_path):
    """All stages on rows with extra columns that clash with names of the work, near copies by Jaccard as the task sets it."""
    clash = ["count", "kept", "copies", "_key", "row", "row_id", "row_key", "slot", "gone_id", "lang_pred", "score", "text_key", "begins"]
    rows = [(*r, *range(len(clash))) for r in corpus()] + [(300, "lone words " + "long " * 20_000 + "end", "en", "s2", 1, *range(len(clash)))]
    kind = KIND + "".join(f", `{c}` int" for c in clash)
    bench = " ".join(rows[12][1].split()[:15])
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, steps = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/step{n}")
        docs = spark.read.parquet(f"{tmp_path}/step{n}")
        steps.append([tuple(r) for r in docs.collect()])
        assert docs.columns == [c.split()[0] for c in KIND.split(", ")] + clash
    assert Counter(steps[0]) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    order = sorted(set(steps[0]), key=lambda r: (r[0] is None, r[0] or 0))
    assert Counter(steps[1]) == Counter(order[i] for i in set(plain_links(plain_sets([r[1] for r in order]))))
    assert None not in {r[0] for r in steps[1]} and len(steps[1]) < len(order)
    assert Counter(steps[2]) == Counter(r for r in steps[1] if bench not in r[1])
    sizes = Counter()
    for r in steps[2]:
        sizes[r[3]] += len(r[1].split())
    from tests.llm.test_sharding_mixing import filled

    target, took, many = filled(sizes), Counter(), Counter(steps[3])
    assert set(many) <= set(steps[2]) and max(many.values()) <= 3
    for r in steps[3]:
        took[r[3]] += len(r[1].split())
    longest = Counter()
    for r in steps[2]:
        longest[r[3]] = max(longest[r[3]], len(r[1].split()))
    assert all(t - 1 <= took[s] <= t + longest[s] for s, t in target.items())
    assert corpus_pipeline.shard(spark, docs, str(tmp_path)).count() == len(steps[3])


def test_nothing_labelled_and_rows_of_the_mix(spark):
    rows = [(i, f"text {i} " * 30, None, f"s{i % 2}", 1) for i in range(40)] + [(7, "text 7 " * 30, None, "s1", 1)] * 3
    docs = spark.createDataFrame(rows, KIND)
    assert Counter(map(tuple, corpus_pipeline.identify_language(spark, docs, "").collect())) == Counter(rows)
    # Sources stand in turn along the files, as the schedule deals them.
    mixed = [r["source"] for r in corpus_pipeline.mix_to_targets(spark, docs, "").collect()]
    assert min(mixed[i : i + 12].count("s0") for i in range(0, len(mixed) - 11)) > 2


def test_empty(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and importlib.import_module("__spark_entry__").queries()["pipeline"] is corpus_pipeline.run
