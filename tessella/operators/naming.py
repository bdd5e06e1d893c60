"""Names of outputs within a batch of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import base_stem, bounded_stem, model_tag, slug, source_tag

WHISPER = ("whisper-cpp", "faster-whisper")


def unique_names(rows: DataFrame, stem: str, *order: str) -> DataFrame:
    """``rows`` with ``name``: the stem, from its second use on with -2, -3, ..., over numbers that make another row's stem.

    A name made from a stem and a number is made from no other stem, so no two names are equal. NULL stems stay NULL.
    """
    parts = F.regexp_extract(stem, r"(?s)^(.*)-([1-9][0-9]{0,8})$", 1), F.regexp_extract(stem, r"(?s)^(.*)-([1-9][0-9]{0,8})$", 2)
    numbered = rows.select(parts[0].alias("_base"), parts[1].try_cast("int").alias("_number")).filter("_number >= 2").groupBy("_base").agg(F.array_sort(F.collect_set("_number")).alias("_taken"))
    n = F.row_number().over(Window.partitionBy(stem).orderBy(*order))
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_n"), lambda k, b: k + (b <= k).cast("int"))
    name = F.when(F.col("_n") == 1, F.col(stem)).when(F.col(stem).isNotNull(), F.concat_ws("-", stem, free.cast("string")))
    named = rows.withColumn("_n", n).join(numbered, F.col(stem) == F.col("_base"), "left").withColumn("name", name)
    return named.drop("_n", "_base", "_taken")


def run_stems(inputs: DataFrame) -> DataFrame:
    """Per run the stem from its inputs (run_id, idx, stem): the first's base and all tags, distinct, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", base_stem(F.col("stem")).alias("base"), source_tag(F.col("stem")).alias("tag"))))
    rows = inputs.groupBy("run_id").agg(ordered.alias("o"))
    tags = F.array_distinct(F.filter(F.transform("o", lambda s: s["tag"]), lambda t: t != ""))
    return rows.select("run_id", F.concat_ws("-", F.col("o")[0]["base"], F.array_join(tags, "-")).alias("stem"))


def produced_stems(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The stem of each produced text (run_id, base, producer, rejected) from the models that were heard (src_idx, backend, model)."""
    tag = model_tag(F.col("model"))
    tag = F.when(F.col("backend").isin(*WHISPER) & ~tag.contains("whisper"), F.concat(F.lit("whisper-"), tag)).otherwise(tag)
    heard = outcomes.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("src_idx", tag.alias("tag")))).alias("o"))
    tags = F.array_distinct(F.transform(F.coalesce("o", F.array().cast("array<struct<src_idx:int,tag:string>>")), lambda s: s["tag"]))
    suffix = F.when(F.col("rejected"), "too-short-clean").otherwise("clean")
    parts = F.concat_ws("-", "base", tags, model_tag(F.col("producer")), suffix)
    return runs.join(heard.withColumn("o", F.col("o").cast("array<struct<src_idx:int,tag:string>>")), "run_id", "left").select("run_id", bounded_stem(parts).alias("stem"))


def label_backends(transcripts: DataFrame, sources: DataFrame, prefix: str = "asr") -> DataFrame:
    """Transcripts (run_id, label, model) with the backend of their source and the tag in file names.

    Labels are positional: the n-th source (run_id, src_idx, backend) of a run made the transcript labelled ``prefix`` and n;
    other labels have no backend.
    """
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("src_idx"))
    of = sources.select("run_id", F.concat(F.lit(prefix), place.cast("string")).alias("label"), "backend")
    tag = model_tag(F.col("model"))
    tagged = F.when(F.col("backend").isin(*WHISPER) & ~tag.contains("whisper"), F.concat(F.lit("whisper-"), tag)).otherwise(tag)
    return transcripts.join(of, ["run_id", "label"], "left").withColumn("tag", tagged)


def export_names(sources: DataFrame) -> DataFrame:
    """File names of exported sources: place and slug."""
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("src_idx"))
    return sources.withColumn("file", F.format_string("%02d-%s.txt", n, slug(F.col("label"))))
