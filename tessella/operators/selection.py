"""Choosing, ordering and de-duplicating the sources of a run.

``sources``: run_id, src_idx, label, model, kind, text, quality_hint. Order within a run is src_idx and carries meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import trim_space

KINDS = ("asr-final", "asr-live", "external", "user")


def by_run(*order: str) -> Window:
    return Window.partitionBy("run_id").orderBy(*order)


def non_blank(sources: DataFrame) -> DataFrame:
    return sources.filter(trim_space(F.col("text")) != "")


def invalid_kinds(sources: DataFrame) -> DataFrame:
    return sources.filter(F.coalesce(~F.col("kind").isin(*KINDS), F.lit(True)))


def of_kind(sources: DataFrame, kind: str) -> DataFrame:
    return sources.filter(F.col("kind") == kind)


def first_labelled(sources: DataFrame, label: str) -> DataFrame:
    """Per run the first source with the label."""
    return sources.filter(F.col("label") == label).groupBy("run_id").agg(F.min_by(F.struct("*"), "src_idx").alias("s")).select("s.*")


def deduplicated(sources: DataFrame) -> DataFrame:
    """Of sources equal after stripping the first of its run stays. Equal texts meet by a map-side combined minimum."""
    keyed = sources.withColumn("text_key", trim_space(F.col("text")))
    first = keyed.groupBy("run_id", "text_key").agg(F.min("src_idx").alias("src_idx")).select("run_id", "src_idx")
    return sources.join(first, ["run_id", "src_idx"], "left_semi")


def cleanup_sources(sources: DataFrame) -> DataFrame:
    """All final recognitions, live ones only in runs without them, then external and user texts; ``pick`` orders them."""
    final = F.max(F.when(F.col("kind") == "asr-final", 1).otherwise(0)).over(Window.partitionBy("run_id"))
    group = F.when(F.col("kind").isin("external", "user"), 1).otherwise(0)
    kept = (F.col("kind") != "asr-live") | (F.col("_final") == 0)
    chosen = sources.withColumn("_final", final).filter(kept).withColumn("_group", group)
    return chosen.withColumn("pick", F.row_number().over(by_run("_group", "src_idx"))).drop("_final", "_group")


def raw_text(sources: DataFrame) -> DataFrame:
    """Per run the text that stands for it without cleanup: final, else live, else external or user, first of each."""
    rank = F.when(F.col("kind") == "asr-final", 0).when(F.col("kind") == "asr-live", 1).otherwise(2)
    return sources.groupBy("run_id").agg(F.coalesce(F.min_by("text", F.struct(rank, "src_idx")), F.lit("")).alias("raw_text"))


def panels(sources: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Review panels: final recognitions, else live, else the others; then the cleaned text (run_id, text, model)."""
    rank = F.when(F.col("kind") == "asr-final", 0).when(F.col("kind") == "asr-live", 1).otherwise(2)
    ranked = sources.withColumn("_rank", rank).withColumn("_best", F.min("_rank").over(Window.partitionBy("run_id")))
    shown = ranked.filter("_rank = _best").select("run_id", F.col("src_idx").cast("long").alias("place"), "label", "text")
    last = cleaned.select("run_id", F.lit(1 << 40).alias("place"), F.concat(F.lit("clean, "), "model").alias("label"), "text")
    return shown.unionByName(last)


def hosted_names(sources: DataFrame, hosted: list[str]) -> DataFrame:
    """Per run the display names of hosted sources, distinct, in order."""
    names = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("src_idx", "display"))), lambda s: s["display"]))
    return sources.filter(F.col("backend").isin(*hosted)).groupBy("run_id").agg(names.alias("names"))


def network_backends(sources: DataFrame, hosted: list[str]) -> DataFrame:
    """Per run the hosted backends, distinct and sorted; an empty list for runs without one."""
    found = F.array_sort(F.collect_set(F.when(F.col("backend").isin(*hosted), F.col("backend"))))
    return sources.groupBy("run_id").agg(found.alias("backends"))


def numbered_labels(sources: DataFrame, prefix: str = "asr") -> DataFrame:
    """Positional labels in collection order."""
    return sources.withColumn("label", F.concat(F.lit(prefix), F.row_number().over(by_run("src_idx")).cast("string")))


def distinct_displays(sources: DataFrame, name: str = "display") -> DataFrame:
    """A repeated display name gets a counter from its second occurrence."""
    n = F.row_number().over(Window.partitionBy("run_id", name).orderBy("src_idx"))
    return sources.withColumn(name, F.when(n == 1, F.col(name)).otherwise(F.format_string("%s (%d)", F.col(name), n)))


def in_order(values: DataFrame, key: str, order: str, value: str) -> Column:
    """Ordered values of a group as an array."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
