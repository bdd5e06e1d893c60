"""The request plan of a cleanup, its prompt and the gates before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import estimated_tokens, plain_cleanup, word_total
from tessella.operators.selection import deduplicated, non_blank

HEAD, TASK = "Recording", "Write the whole transcript."


def source_block(text: Column, label: Column, model: Column, hint: Column, number: Column) -> Column:
    """A source as the prompt shows it: number, label, model, hint if any, size, then its text."""
    title = F.concat(F.lit("Source "), number.cast("string"), F.lit(" - "), label, F.lit(" ("), model, F.lit(")"))
    size = F.concat(F.length(text).cast("string"), F.lit(" chars / "), word_total(text).cast("string"), F.lit(" words"))
    return F.concat(F.concat_ws(" - ", title, hint, size), F.lit(":\n"), text)


def prompts(sources: DataFrame, head: str = HEAD, task: str = TASK) -> DataFrame:
    """Per run the prompt: head, sources in order, task, blank lines between."""
    ordered = F.array_sort(F.collect_list(F.struct("src_idx", "label", "model", "quality_hint", "text")))
    blocks = F.transform(
        "ordered", lambda s, i: source_block(s["text"], s["label"], s["model"], s["quality_hint"], i + 1)
    )
    whole = F.array_join(F.concat(F.array(F.lit(head)), blocks, F.array(F.lit(task))), "\n\n")
    return sources.groupBy("run_id").agg(ordered.alias("ordered")).select("run_id", whole.alias("prompt"))


def size_plan(sources: DataFrame, prompt_tokens: Column, context: int, cap: int) -> DataFrame:
    """Reference words, tokens and flags per run; ``prompt_tokens`` is an aggregate over the run's sources."""
    total = F.when(word_total(F.col("text")) > 0, word_total(F.col("text")))
    plan = sources.groupBy("run_id").agg(
        F.count("*").alias("sources"),
        F.coalesce(F.bround(F.avg(total), 0).cast("int"), F.lit(0)).alias("reference_words"),
        F.coalesce(F.max(estimated_tokens(F.col("text"))), F.lit(0)).alias("largest_source_tokens"),
        prompt_tokens.cast("int").alias("prompt_tokens"),
    )
    wanted = F.greatest(F.lit(4096), F.col("largest_source_tokens") * 2)
    plan = (
        plan.withColumn("output_tokens", F.least(F.lit(cap), wanted))
        .withColumn("token_budget", F.greatest(F.lit(256), F.lit(context * 0.92).cast("int")))
        .withColumn("cap_limited", wanted > cap)
        .withColumn("minimum_words", F.greatest(F.lit(1), F.ceil(F.col("reference_words") * F.lit(0.6))).cast("int"))
    )
    over = F.col("prompt_tokens") + F.col("output_tokens") > F.col("token_budget")
    return plan.withColumn("skip_reason", F.when(F.col("cap_limited"), "output cap").when(over, "context"))


def request_plan(sources: DataFrame, context: int = 32768, cap: int = 8192, instructions: str = TASK) -> DataFrame:
    """The plan over non-blank sources of a run, equal ones once."""
    kept = deduplicated(non_blank(sources))
    fixed = max(1, -(-len(instructions) // 4)) + 32
    return size_plan(kept, F.sum(estimated_tokens(F.col("text"))) + fixed, context, cap)


def cleaned_by_mode(runs: DataFrame) -> DataFrame:
    """Rows (run_id, mode, first_text, reply, error, skip_reason) to text, error and whether it was short."""
    mode, first = F.col("mode"), F.coalesce("first_text", F.lit(""))
    text = F.when(mode == "none", F.lit("")).when(mode == "off", first).when(mode == "heuristic", plain_cleanup(first))
    model = F.when(F.col("error").isNull() & F.col("skip_reason").isNull(), F.coalesce("reply", F.lit(""))).otherwise("")
    return runs.select(
        "run_id",
        text.otherwise(model).alias("text"),
        F.when(mode == "llama", F.coalesce("error", "skip_reason")).alias("error"),
        ((mode == "llama") & (F.col("skip_reason").isNotNull() | F.coalesce(F.col("error").contains("suspiciously short ("), F.lit(False)))).alias("short"),
    )


def audit_eligible(runs: DataFrame) -> DataFrame:
    """Runs whose cleaned text is audited: asked for, by a model, text without error, more than one distinct source."""
    return runs.filter(F.col("annotate") & (F.col("mode") == "llama") & (F.coalesce("text", F.lit("")) != "") & F.col("error").isNull() & (F.col("sources") > 1))


def request_messages(plans: DataFrame, system: str) -> DataFrame:
    """The same two messages for sending and for export."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return plans.withColumn("messages", F.array(message("system", F.lit(system)), message("user", F.col("prompt"))))


def request_payloads(plans: DataFrame, routed: bool = False, effort: str | None = None) -> DataFrame:
    """The JSON body of each request (model, messages, max_tokens, and optionally schema, a JSON text): greedy decoding, the shape of the
    reply where a schema bounds it, only providers that honour it where requests are ``routed``, and the effort if set."""
    schema = F.col("schema") if "schema" in plans.columns else F.lit(None).cast("string")
    body = F.struct("model", "messages", F.lit(0.0).alias("temperature"), F.lit(1).alias("top_p"), "max_tokens")
    parts = [
        F.when(schema.isNotNull(), F.concat(F.lit(',"response_format":{"type":"json_schema","json_schema":{"name":"reply","strict":true,"schema":'), schema, F.lit("}}"))),
        F.when(schema.isNotNull() & F.lit(routed), F.lit(',"provider":{"require_parameters":true}')),
        F.when(F.lit(effort).isNotNull(), F.concat(F.lit(',"reasoning":'), F.to_json(F.struct(F.lit(effort).alias("effort"))))),
    ]
    head = F.regexp_replace(F.to_json(body), r"\}$", "")
    return plans.withColumn("payload", F.concat(head, *[F.coalesce(x, F.lit("")) for x in parts], F.lit("}")))
