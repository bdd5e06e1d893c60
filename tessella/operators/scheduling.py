"""Sources, devices, options and batches as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.text import slug, trim_space
from tessella.storage import bounded_broadcast

HOSTED = ("net",)


def parsed_specs(specs: DataFrame) -> DataFrame:
    """Comma lists ``backend[:model][@device]`` (run_id, spec) to one row a source: split at the first @, then the first colon."""
    parts = F.filter(F.transform(F.split("spec", ","), trim_space), lambda p: p != "")
    rows = specs.select("run_id", F.posexplode(parts).alias("src_idx", "s"))
    left = F.split_part("s", F.lit("@"), F.lit(1))
    device = F.when(F.instr("s", "@") > 0, F.expr("substring(s, instr(s, '@') + 1)"))
    model = F.when(F.instr(left, ":") > 0, F.expr("substring(split_part(s, '@', 1), instr(split_part(s, '@', 1), ':') + 1)"))
    return rows.select(
        "run_id", "src_idx", trim_space(F.split_part(left, F.lit(":"), F.lit(1))).alias("backend"),
        trim_space(F.coalesce(model, F.lit(""))).alias("model"), F.coalesce(F.nullif(trim_space(device), F.lit("")), F.lit("auto")).alias("device"),
    )


def resolved(sources: DataFrame, backends: DataFrame) -> DataFrame:
    """Sources with the defaults of their backend (backend, default_model, device_kind, default_device); unknown ones carry an error."""
    rows = sources.join(F.broadcast(backends) if backends.limit(1001).count() <= 1000 else backends, "backend", "left")
    return rows.select(
        "run_id", "src_idx", "backend",
        F.coalesce(F.nullif("model", F.lit("")), "default_model").alias("model"),
        F.when(F.col("device") == "auto", F.col("default_device")).otherwise(F.col("device")).alias("device"),
        device_kind(F.col("device"), F.col("device_kind")).alias("device_kind"),
        F.when(F.col("device_kind").isNull(), F.concat(F.lit("unknown backend "), "backend")).alias("error"),
    )


def device_kind(device: Column, natural: Column) -> Column:
    """cpu or gpu where the device says so, else what is natural for the backend."""
    d = F.lower(device)
    return F.when(d == "cpu", "cpu").when(d.isin("gpu", "vulkan") | d.startswith("cuda") | d.rlike("^[0-9]+$"), "gpu").otherwise(natural)


def scheduling_groups(sources: DataFrame) -> DataFrame:
    """Sources of one device share a queue; each hosted one is a queue of its own. ``turn`` orders a queue."""
    group = F.when(F.col("device_kind").isin(*HOSTED), F.concat(F.lit("net:"), F.col("src_idx").cast("string"))).otherwise(F.col("device_kind"))
    rows = sources.withColumn("queue", group)
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("run_id", "queue").orderBy("src_idx")))


def effective_options(options: DataFrame) -> DataFrame:
    """Per run and name the first value set, of flag, user file, preset and default in this order."""
    source = F.when(F.col("flag").isNotNull(), "flag").when(F.col("file").isNotNull(), "file").when(F.col("preset").isNotNull(), "preset").otherwise("default")
    return options.select("run_id", "name", F.coalesce("flag", "file", "preset", "default").alias("value"), source.alias("origin"))


def violations(options: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row for each rule (name: SQL condition that must hold) that a row breaks."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    return options.select("run_id", F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("rule"))


def restricted(sources: DataFrame, limits: DataFrame, language: str | None = None) -> DataFrame:
    """``sources`` (backend, model, device) with ``error`` where their backend takes only what ``limits`` (backend,
    only_model, only_device, only_language) names; NULL there allows all, a blank or automatic choice is the backend's own."""
    rows = sources.join(bounded_broadcast(limits, 1000), "backend", "left")
    other = lambda c, only: F.col(only).isNotNull() & ~F.lower(F.coalesce(c, F.lit(""))).isin("", "auto") & (F.lower(c) != F.lower(only))
    error = F.when(other(F.col("model"), "only_model"), F.concat("backend", F.lit(" takes only model "), "only_model")).when(
        other(F.col("device"), "only_device"), F.concat("backend", F.lit(" runs only on "), "only_device")
    ).when(other(F.lit(language).cast("string"), "only_language"), F.concat("backend", F.lit(" understands only "), "only_language"))
    return rows.withColumn("error", error).drop("only_model", "only_device", "only_language")


def batch_items(entries: DataFrame) -> DataFrame:
    """Entries (batch_id, item, path) with their own slug and directories."""
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", "")
    label = F.concat(F.format_string("%04d-", F.col("item").cast("int")), slug(name))
    kind = F.when(F.lower("path").endswith(".zip"), "archive").otherwise("file")
    return entries.select("batch_id", "item", "path", kind.alias("kind"), label.alias("slug"), F.concat(F.lit("artifacts/"), label).alias("artifacts"), F.concat(F.lit("exports/"), label).alias("exports"))


def batch_totals(items: DataFrame, *keys: str) -> DataFrame:
    return items.groupBy(*keys).agg(F.sum(F.col("failed").cast("int")).alias("failures"), (F.count("*") - F.sum(F.col("failed").cast("int"))).alias("ok"))


def bitrate_ladder(encodings: DataFrame, most: int = 25 * 1000 * 1000) -> DataFrame:
    """Per recording the first encoding (rec_id, rung, size) within the size."""
    fits = encodings.filter(F.col("size") <= most)
    return fits.groupBy("rec_id").agg(F.min_by(F.struct("rung", "size"), "rung").alias("e")).select("rec_id", "e.*")


def first_supported(preferences: DataFrame, supported: DataFrame, *on: str) -> DataFrame:
    """Per device the most preferred value (rank, value) that it supports."""
    return supported.join(preferences, "value").groupBy(*on).agg(F.min_by("value", "rank").alias("value"))


def ordered_devices(devices: DataFrame) -> DataFrame:
    """Input devices (name, channels, is_default) in order: default, named microphone, headset, others; then by name."""
    low = F.lower("name")
    rank = F.when(F.col("is_default"), 0).when(low.contains("mic"), 1).when(low.contains("headset"), 2).otherwise(3)
    return devices.filter("channels > 0").withColumn("rank", rank).orderBy("rank", low)


def device_id(c: Column) -> Column:
    """A device setting as struct (number, name): digits a number, blank neither."""
    text = trim_space(c)
    number = F.when(text.rlike("^-?[0-9]{1,9}$"), text).try_cast("int")
    return F.struct(number.alias("number"), F.when(number.isNull(), F.nullif(text, F.lit(""))).alias("name"))


def announcements(runs: DataFrame) -> DataFrame:
    """What leaves the machine in each run: audio for hosted recognisers, text for a hosted cleanup, nothing else."""
    audio, text = F.size("hosted") > 0, F.col("cleanup_hosted")
    message = F.when(audio & text, "audio and text are sent").when(audio, "audio is sent").when(text, "text is sent").otherwise("nothing is sent")
    return runs.withColumn("announcement", message)


def checkpoint_identity(runs: DataFrame) -> DataFrame:
    """The checkpoint behind a local reply and where that is known from."""
    leaf = lambda c: F.substring_index(c, "/", -1)
    named = F.when(F.lower("served_model").endswith(".gguf"), leaf(F.col("served_model")))
    found = F.coalesce(leaf(F.col("owned_path")), leaf(F.col("server_path")), named)
    origin = F.when(F.col("owned_path").isNotNull(), "process").when(F.col("server_path").isNotNull(), "server").when(named.isNotNull(), "reply").otherwise("unknown")
    return runs.withColumn("checkpoint", found).withColumn("checkpoint_origin", origin)


def backends(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "backend string, default_model string, device_kind string, default_device string")
