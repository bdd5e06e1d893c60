"""Queries on runs, attempts, records and scheduling, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.operators import naming, planning, records, replies, scheduling, selection
from tessella.plans.common import RUN_SOURCES, run_sources, table


def request_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: what each run would ask of a model, and why not."""
    return planning.request_plan(run_sources(spark, sf), context=6000, cap=8192)


def source_select(spark: SparkSession, sf: str) -> DataFrame:
    return selection.cleanup_sources(run_sources(spark, sf)).select("run_id", "src_idx", "kind", "pick")


def source_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    runs = d.select(F.concat_ws("/", "lang", "source").alias("run_id"), F.col("doc_id").alias("src_idx"), "text")
    return selection.deduplicated(selection.non_blank(runs)).select("run_id", "src_idx")


def raw_text(spark: SparkSession, sf: str) -> DataFrame:
    return selection.raw_text(run_sources(spark, sf)).select("run_id", F.md5("raw_text").alias("raw_text"))


def review_panels(spark: SparkSession, sf: str) -> DataFrame:
    sources = run_sources(spark, sf)
    cleaned = selection.raw_text(sources).select("run_id", F.col("raw_text").alias("text"), F.lit("model-a").alias("model"))
    return selection.panels(sources, cleaned).select("run_id", "place", "label", F.md5("text").alias("text"))


def prompt_build(spark: SparkSession, sf: str) -> DataFrame:
    return planning.prompts(run_sources(spark, sf)).select("run_id", F.md5("prompt").alias("prompt"), F.length("prompt").alias("chars"))


def source_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = selection.numbered_labels(run_sources(spark, sf).withColumn("display", F.col("model")))
    return selection.distinct_displays(rows).select("run_id", "src_idx", "label", "display")


def attempts_of_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    reason = F.when(F.col("value") >= 20, F.concat(F.col("event_type"), F.lit(" failed")))
    status = F.when(F.col("value") > 200, 401).when(F.col("value") > 120, 413).when(F.col("value") >= 20, 404).otherwise(200)
    return e.select(F.col("user_id").alias("run_id"), (F.row_number().over(order) - 1).alias("attempt_idx"), F.col("event_type").alias("model"), status.alias("http_status"), reason.alias("reason"))


def fallback_winner(spark: SparkSession, sf: str) -> DataFrame:
    return replies.fallback(attempts_of_events(spark, sf))


def model_catalog_filter(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    models = s.select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("pref_idx"), F.col("s_name").alias("model"))
    return replies.available_models(models, s.filter("s_acctbal > 6000").select(F.col("s_name").alias("model")))


def chat_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    finish = F.element_at(F.array(F.lit("stop"), F.lit("length"), F.lit(None).cast("string"), F.lit("error")), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    content = F.when(F.col("role") == "system", F.lit(" ")).otherwise(F.col("text"))
    body = F.to_json(F.struct(F.array(F.struct(finish.alias("finish_reason"), F.struct(content.alias("content")).alias("message"))).alias("choices")))
    body = F.when(F.pmod("conv_id", F.lit(7)) == 0, F.lit('{"choices": []}')).when(F.pmod("conv_id", F.lit(7)) == 1, F.lit("<html>")).otherwise(body)
    return c.select("conv_id", "turn", replies.rejection(body).alias("rejected"))


def decode_replies(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    quote = F.col("text")
    alt = lambda t: F.struct(t.alias("text"), F.lit(1).alias("source"), t.alias("verbatim"))
    entry = F.struct(quote.alias("quote"), F.array(alt(F.lit("one reading")), alt(F.lit("One, reading!")), alt(F.upper(quote)), alt(F.lit("another"))).alias("alternatives"))
    body = F.to_json(F.struct(F.array(entry, entry).alias("uncertain")))
    turn = F.pmod("turn", F.lit(5))
    content = F.when(turn == 0, body).when(turn == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(turn == 2, F.concat(body, F.lit(', {"x": 1}'))).when(turn == 3, F.lit('{"uncertain": []}')).otherwise(F.lit('{"uncertain": [{"quote": "q"}]}'))
    found = replies.decoded(c.select("conv_id", "turn", content.alias("content")))
    readings = F.aggregate("notes", F.lit(0), lambda s, n: s + F.size(n["alternatives"]))
    return found.select("conv_id", "turn", "understood", F.size("notes").alias("notes"), readings.alias("readings"))


def device_groups(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    kind = F.element_at(F.array(F.lit("cpu"), F.lit("gpu"), F.lit("net")), (F.pmod("s_nationkey", F.lit(3)) + 1).cast("int"))
    rows = s.select(F.pmod("s_suppkey", F.lit(17)).alias("run_id"), F.col("s_suppkey").alias("src_idx"), kind.alias("device_kind"))
    return scheduling.scheduling_groups(rows)


def source_specs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    spec = F.concat(F.lower("p_type"), F.lit(":"), "p_name", F.lit("@cpu, "), F.lower("p_brand"), F.lit(" ,,x@cuda:0"))
    return scheduling.parsed_specs(p.select(F.col("p_partkey").alias("run_id"), spec.alias("spec"))).withColumn("kind", scheduling.device_kind(F.col("device"), F.lit("cpu")))


def option_precedence(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    options = c.select(
        F.col("c_custkey").alias("run_id"), F.lit("mode").alias("name"), F.when(F.col("c_acctbal") < 0, "flag").alias("flag"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "file").alias("file"), F.when(F.col("c_nationkey") < 5, "preset").alias("preset"), F.lit("off").alias("default"),
    )
    return scheduling.effective_options(options)


def batch_totals(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return scheduling.batch_totals(o.withColumn("failed", F.col("o_totalprice") > 200000), "o_orderstatus", "o_orderpriority")


def batch_items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return scheduling.batch_items(p.select(F.lit(1).alias("batch_id"), F.col("page_id").alias("item"), F.col("url").alias("path")))


def status_counters(spark: SparkSession, sf: str) -> DataFrame:
    return records.status_counts(table(spark, sf, "events"), "event_type")


def outcome_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    results = c.select(
        F.col("conv_id").alias("run_id"), F.concat(F.lit("asr"), F.col("turn").cast("string")).alias("label"), F.col("role").alias("model"),
        F.when(F.col("turn") % 5 == 4, F.lit(" \n")).otherwise(F.col("text")).alias("text"), F.when(F.col("turn") % 5 == 3, "no model").alias("skip_reason"),
        F.when(F.col("turn") % 5 == 2, "timeout").alias("error"), ((F.col("turn") + 1) / 8).alias("seconds"), F.length("text").cast("double").alias("duration"),
    )
    return records.outcomes(results).withColumn("text", F.md5("text"))


def last_messages(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    log = e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "props")
    found = records.last_few(log.withColumn("message", F.concat(F.col("seq").cast("string"), F.lit(":"), "props")), "error", 8)
    return found.select("run_id", F.array_join("messages", "|").alias("messages"))


def last_values(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"), "value")
    pairs = F.transform(F.map_entries("values"), lambda p: F.concat_ws("=", p["key"], p["value"].cast("decimal(18,2)").cast("string")))
    return records.last_values(e).select("run_id", F.array_join(F.array_sort(pairs), ";").alias("values"))


def unique_names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "//([^/]+)/", 1).alias("host"))
    return naming.unique_names(p, "host", "page_id").select("page_id", "name")


def produced_names(spark: SparkSession, sf: str) -> DataFrame:
    sources = run_sources(spark, sf)
    heard = sources.select("run_id", "src_idx", F.when(F.col("src_idx") % 2 == 0, "whisper-cpp").otherwise("ctc").alias("backend"), F.concat(F.lit("org/ggml-"), "model", F.lit(".bin")).alias("model"))
    runs = sources.select("run_id").distinct().select("run_id", F.format_string("note %d", F.col("run_id")).alias("base"), F.lit("lab/big-1:free").alias("producer"), (F.col("run_id") % 3 == 0).alias("rejected"))
    return naming.produced_stems(runs, heard)


def request_limits(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    n = F.col("n_chars")
    b = N.audit_budget(F.lit(8192), F.ceil(n / 4).cast("int"), N.note_cap(n / 6))
    return d.select(
        "doc_id", N.request_timeout(F.lit(30.0), n / 4, n / 2).alias("request_timeout"), N.speech_timeout(n.cast("double"), 120.0, 900.0).alias("speech_timeout"),
        N.note_cap(n / 6).alias("note_cap"), b["budget"].alias("budget"), b["ask"].alias("ask"), b["skip"].alias("skip"),
        N.ram_shortfall_mib(n / 10, F.lit(32768), F.lit(3000)).alias("short_mib"),
    )


def diagnostics_json(spark: SparkSession, sf: str) -> DataFrame:
    sources = run_sources(spark, sf)
    runs = selection.raw_text(sources).select("run_id", F.lit("2026-01-01 00:00:00").cast("timestamp").alias("started"), F.col("raw_text").alias("clean_text"))
    outcomes = sources.select("run_id", "label", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("skip_reason"), F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("seconds"), F.lit(2.0).alias("realtime_factor"))
    return records.diagnostics(runs, sources, outcomes)


QUERIES = [
    request_plan, source_select, source_dedupe, raw_text, review_panels, prompt_build, source_labels, fallback_winner, model_catalog_filter,
    chat_acceptance, decode_replies, device_groups, source_specs, option_precedence, batch_totals, batch_items, status_counters, outcome_rows,
    last_messages, last_values, unique_names, produced_names, request_limits, diagnostics_json,
]

_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SLUG = "coalesce(nullif(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'recording')"
_WORDS = r"len(regexp_extract_all(text, '\S+'))"

SQL = {
    "diagnostics_json": rf"""
with {RUN_SOURCES},
raw as (select run_id, coalesce(min_by(text, src_idx) filter (kind = 'asr-final'), min_by(text, src_idx) filter (kind = 'asr-live'), min_by(text, src_idx), '') as clean
    from sources group by 1),
heard as (select run_id, string_agg('{{"src_idx":' || src_idx || ',"label":' || to_json(label)::varchar || ',"model":' || to_json(model)::varchar || ',"kind":' || to_json(kind)::varchar
    || ',"chars":' || length(text) || ',"words":' || {_WORDS} || '}}', ',' order by src_idx) as transcripts,
    string_agg('{{"label":' || to_json(label)::varchar || ',"ok":true,"seconds":1.0,"realtime_factor":2.0}}', ',' order by label) as asr from sources group by 1)
select run_id, '{{"schema":7,"started":"2026-01-01T00:00:00.000000Z",' || '"clean_chars":' || length(clean) || ',' || '"transcripts":[' || transcripts || '],"asr":[' || asr || ']}}' as document from raw join heard using (run_id)""",
    "request_plan": rf"""
with {RUN_SOURCES},
kept as (select *, {_WORDS} as w, greatest(1, ceil(length(text) / 4.0))::int as tok from (
    select *, row_number() over (partition by run_id, {_TRIM.format("text")} order by src_idx) as n from sources where {_TRIM.format("text")} <> '') where n = 1),
sized as (select run_id, count(*) as sources, coalesce(round_even(avg(w) filter (w > 0), 0)::int, 0) as reference_words,
    coalesce(max(tok), 0) as largest_source_tokens, (sum(tok) + 7 + 32)::int as prompt_tokens from kept group by run_id),
p as (select *, least(8192, greatest(4096, largest_source_tokens * 2)) as output_tokens, greatest(256, (6000 * 0.92::double)::int) as token_budget,
    greatest(4096, largest_source_tokens * 2) > 8192 as cap_limited, greatest(1, ceil(reference_words * 0.6::double)::int) as minimum_words from sized)
select *, case when cap_limited then 'output cap' when prompt_tokens + output_tokens > token_budget then 'context' end as skip_reason from p""",
    "source_select": f"""
with {RUN_SOURCES},
g as (select *, max((kind = 'asr-final')::int) over (partition by run_id) as final, (kind in ('external', 'user'))::int as grp from sources)
select run_id, src_idx, kind, row_number() over (partition by run_id order by grp, src_idx) as pick from g where kind <> 'asr-live' or final = 0""",
    "source_dedupe": rf"""
select concat_ws('/', lang, source) as run_id, min(doc_id) as src_idx from documents where {_TRIM.format("text")} <> ''
group by concat_ws('/', lang, source), {_TRIM.format("text")}""",
    "raw_text": f"""
with {RUN_SOURCES},
r as (select *, row_number() over (partition by run_id order by case kind when 'asr-final' then 0 when 'asr-live' then 1 else 2 end, src_idx) as n from sources)
select run_id, md5(text) as raw_text from r where n = 1""",
    "review_panels": f"""
with {RUN_SOURCES},
r as (select *, case kind when 'asr-final' then 0 when 'asr-live' then 1 else 2 end as rank from sources),
b as (select *, min(rank) over (partition by run_id) as best, row_number() over (partition by run_id order by rank, src_idx) as n from r)
select run_id, src_idx::bigint as place, label, md5(text) as text from b where rank = best
union all select run_id, 1099511627776, 'clean, model-a', md5(text) from b where n = 1""",
    "prompt_build": rf"""
with {RUN_SOURCES},
n as (select *, row_number() over (partition by run_id order by src_idx) as k from sources),
b as (select run_id, k, concat_ws(' - ', 'Source ' || k || ' - ' || label || ' (' || model || ')', quality_hint,
    length(text) || ' chars / ' || {_WORDS} || ' words') || ':' || chr(10) || text as block from n),
p as (select run_id, 'Recording' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) order by k) || chr(10) || chr(10) || 'Write the whole transcript.' as prompt
    from b group by run_id)
select run_id, md5(prompt) as prompt, length(prompt)::int as chars from p""",
    "source_labels": f"""
with {RUN_SOURCES},
n as (select *, row_number() over (partition by run_id order by src_idx) as k, row_number() over (partition by run_id, model order by src_idx) as m from sources)
select run_id, src_idx, 'asr' || k as label, case when m = 1 then model else model || ' (' || m || ')' end as display from n""",
    "fallback_winner": """
with a as (select user_id as run_id, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, event_type as model,
    case when value > 200 then 401 when value > 120 then 413 when value >= 20 then 404 else 200 end as status,
    case when value >= 20 then event_type || ' failed' end as reason from events),
m as (select * from (select *, coalesce(max((reason is null or status in (401, 403))::int) over (partition by run_id order by idx rows between unbounded preceding and 1 preceding), 0) as ended from a) where ended = 0)
select run_id, max(model) filter (reason is null) as winner, count(*) as attempts_made, bool_or(reason is not null and status in (401, 403)) as aborted,
    coalesce(string_agg(reason, '; ' order by idx), '') as reasons from m group by run_id""",
    "model_catalog_filter": """
with m as (select s_nationkey as run_id, s_suppkey as pref_idx, s_name as model, s_acctbal > 6000 as listed from supplier)
select run_id, pref_idx, model, listed or not bool_or(listed) over (partition by run_id) as kept from m""",
    "chat_acceptance": r"""
select conv_id, turn, case when conv_id % 7 = 0 then 'no choices' when conv_id % 7 = 1 then 'not JSON' when turn % 4 = 1 then 'truncated at the output limit'
    when turn % 4 = 3 then 'incomplete: finish error' when role = 'system' or regexp_full_match(text, '\s*') then 'no content' end as rejected from conversations""",
    "decode_replies": """
select conv_id, turn, turn % 5 in (0, 1, 3) as understood, (case when turn % 5 in (0, 1) then 1 else 0 end)::int as notes,
    (case when turn % 5 in (0, 1) then 2 else 0 end)::int as readings from conversations""",
    "device_groups": """
with s as (select (s_suppkey % 17) as run_id, s_suppkey as src_idx, ['cpu', 'gpu', 'net'][s_nationkey % 3 + 1] as device_kind from supplier),
q as (select *, case when device_kind = 'net' then 'net:' || src_idx else device_kind end as queue from s)
select *, row_number() over (partition by run_id, queue order by src_idx)::int as turn from q""",
    "source_specs": """
select p_partkey as run_id, 0 as src_idx, lower(p_type) as backend, p_name as model, 'cpu' as device, 'cpu' as kind from part
union all select p_partkey, 1, lower(p_brand), '', 'auto', 'cpu' from part
union all select p_partkey, 2, 'x', '', 'cuda:0', 'gpu' from part""",
    "option_precedence": """
select c_custkey as run_id, 'mode' as name, case when c_acctbal < 0 then 'flag' when c_mktsegment = 'MACHINERY' then 'file' when c_nationkey < 5 then 'preset' else 'off' end as value,
    case when c_acctbal < 0 then 'flag' when c_mktsegment = 'MACHINERY' then 'file' when c_nationkey < 5 then 'preset' else 'default' end as origin from customer""",
    "batch_totals": """
select o_orderstatus, o_orderpriority, sum((o_totalprice > 200000)::int)::bigint as failures, count(*) - sum((o_totalprice > 200000)::int)::bigint as ok
from orders group by 1, 2""",
    "batch_items": rf"""
with p as (select page_id, url, printf('%04d-', page_id) || {_SLUG.format(r"regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '')")} as slug from pages)
select 1 as batch_id, page_id as item, url as path, case when lower(url) like '%.zip' then 'archive' else 'file' end as kind, slug,
    'artifacts/' || slug as artifacts, 'exports/' || slug as exports from p""",
    "status_counters": "select event_type, count(*) as n from events group by 1",
    "outcome_rows": rf"""
with c as (select *, case when turn % 5 = 4 then '' else trim(regexp_replace(text, '\s+', ' ', 'g')) end as t from conversations)
select conv_id as run_id, 'asr' || turn as label, case when turn % 5 not in (2, 3) and t <> '' then md5(t) end as text,
    case when turn % 5 = 3 then 'no model' when turn % 5 <> 2 and t = '' then 'empty text' end as skip_reason, case when turn % 5 = 2 then 'timeout' end as error,
    round_even((turn + 1) / 8.0::double, 3) as seconds, case when length(text) > 0 then round_even(length(text)::double / ((turn + 1) / 8.0::double), 2) end as realtime_factor,
    turn % 5 not in (2, 3) and t <> '' as ok from c""",
    "last_messages": """
with e as (select user_id, event_id, props, row_number() over (partition by user_id order by event_id desc) as r from events where event_type = 'error')
select user_id as run_id, string_agg(event_id || ':' || props, '|' order by event_id) as messages from e where r <= 8 group by user_id""",
    "last_values": """
with v as (select user_id, event_type, arg_max(value, event_id)::decimal(18, 2)::varchar as v from events group by 1, 2)
select user_id as run_id, string_agg(event_type || '=' || v, ';' order by event_type) as values from v group by 1""",
    "unique_names": """
with p as (select page_id, regexp_extract(url, '//([^/]+)/', 1) as host from pages),
n as (select *, row_number() over (partition by host order by page_id) as k from p)
select page_id, case when k = 1 then host else host || '-' || k end as name from n""",
    "produced_names": f"""
with {RUN_SOURCES},
t as (select run_id, 'whisper-' || model as tag, min(src_idx) as i from sources group by 1, 2),
s as (select run_id, string_agg(tag, '-' order by i) as tags from t group by 1)
select run_id, {_SLUG.format("'note ' || run_id || '-' || tags || '-big-1-' || case when run_id % 3 = 0 then 'too-short-clean' else 'clean' end")} as stem from s""",
    "request_limits": """
with d as (select doc_id, n_chars as n, least(50, greatest(25, floor(n_chars / 6.0::double / 150)))::int as cap, ceil(n_chars / 4.0::double)::int as est,
    greatest(256, trunc(8192 * 0.92::double)::int) as budget from documents),
b as (select *, least(greatest(8192, cap * 300), greatest(1024, budget - est)) as ask from d)
select doc_id, least(1800.0::double, greatest(30.0::double, 45.0::double, 15 + (n / 4.0::double) / 250 + (n / 2.0::double) / 12)) as request_timeout,
    least(900.0::double, greatest(120.0::double, 90 + n * 0.25::double)) as speech_timeout, cap as note_cap, budget, ask, est + ask > budget as skip,
    case when n / 10.0::double + 32768 * 32 / 1024 + 1500 - 3000 > 0 then n / 10.0::double + 32768 * 32 / 1024 + 1500 - 3000 end as short_mib from b""",
}
