"""What the stages of the pipeline hold in executors' memory beside the heap."""

import subprocess
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import near_copies, op2_sharding, op6_langid, op8_decontamination
from tessella.llm.common import settle, small_batches

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_small_batches_reach_python(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["id"])

    before = spark.conf.get(ROWS)
    wide = spark.range(0, 4000, 1, 1).withColumn("text", F.repeat(F.lit("x"), 40_000))
    with small_batches(spark):
        got = [r[0] for r in settle(spark.range(0, 4000, 1, 1).mapInArrow(sizes, "id long"), "batch-sizes").collect()]
        by_bytes = [r[0] for r in settle(wide.mapInArrow(sizes, "id long"), "batch-sizes").collect()]
    assert sum(got) == sum(by_bytes) == 4000 and max(got) <= 512 and max(by_bytes) <= 512
    with pytest.raises(ValueError), small_batches(spark):
        raise ValueError
    assert spark.conf.get(ROWS) == before


def test_stages_settle_in_small_batches(spark, monkeypatch):
    seen = {}
    for module in (corpus_pipeline, near_copies):
        keep = lambda df, name, *a, f=module.settle, **k: (seen.setdefault(name, spark.conf.get(ROWS)), f(df, name, *a, **k))[1]
        monkeypatch.setattr(module, "settle", keep)
    rows = [(i, f"some words of text {i} and more", "en", "s0", 1) for i in range(8)] + [(8, "123", "en", "s0", 1), (None, None, "en", "s0", 1), (8, "letters", None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(repr, map(tuple, corpus_pipeline.identify_language(spark, docs, "").collect()))) == sorted(repr(r) for r in rows if r[1] not in ("123", None))
    near_copies.near_copies(docs)
    assert {"gone", "shingle-prefixes"} <= set(seen) and set(seen.values()) == {"512"}


def test_short_texts_are_parsed_in_bounded_blocks(monkeypatch):
    model = op6_langid.Model({"aa": ["the cat"], "bb": ["der hund"]})
    parse, most = op6_langid._parse, []
    monkeypatch.setattr(op6_langid, "_parse", lambda m, coded, whole: (most.append(len(coded)), parse(m, coded, whole))[1])
    langs, scores = op6_langid.predicted(model, ["cat", "hund"] * 10_000, whole=True)
    assert langs == ["aa", "bb"] * 10_000 and len(set(scores)) <= 2
    assert max(most) * op6_langid.BLOCK * 2 <= op6_langid.SLICE


def test_no_rows_from_plain_python_workers(spark, monkeypatch):
    plans = {}
    keep = lambda df, name, *a, f=settle, **k: (plans.setdefault(name, df._jdf.queryExecution().toString()), f(df, name, *a, **k))[1]
    monkeypatch.setattr(op8_decontamination, "settle", keep)
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("words of text "), "id").alias("text"))
    docs = settle(docs, "documents")
    windows = docs.limit(2).select(F.lit("words of text").alias("window"), F.lit(3).alias("length")).distinct()
    base, found = op8_decontamination.occurrences(docs, windows)
    assert base.count() == found.count() == 30
    dealt = op2_sharding.shard_documents(docs)
    plans["shards"] = dealt._jdf.queryExecution().toString()
    assert dealt.count() == 30
    assert "meetings" in plans and not [name for name, plan in plans.items() if "ExistingRDD" in plan]


def test_workers_need_no_pandas():
    code = "import sys, tessella.llm.op6_langid; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0]).returncode == 0
