"""Queries on single derivations of runs, sources, models and records, and their SQL. Rows of the tables stand for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.functions import text as T
from tessella.operators import coverage, derived, evaluation, naming, planning, records, replies, scheduling, selection, signals
from tessella.plans.common import RUN_SOURCES, USER_SAMPLES, run_sources, table, user_samples
from tessella.streaming import segments as S

BACKENDS = ("whisper-cpp", "faster-whisper", "hosted", "hosted-stt", "ctc")
HOSTED = ["hosted", "hosted-stt"]


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as sources of the run that their nation is."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("src_idx"), _pick(BACKENDS, F.col("s_suppkey")).alias("backend"), F.col("s_name").alias("model"))


def source_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Per run the non-blank final sources and the first one labelled s1."""
    sources = run_sources(spark, sf)
    kept = selection.of_kind(selection.non_blank(sources), "asr-final").groupBy("run_id").agg(F.count("*").alias("finals"), F.min("src_idx").alias("first_final"))
    named = selection.first_labelled(sources, "s1").select("run_id", F.md5("text").alias("s1"))
    return kept.join(named, "run_id", "full")


def network_backends(spark: SparkSession, sf: str) -> DataFrame:
    found = selection.network_backends(_suppliers(spark, sf), HOSTED)
    names = selection.hosted_names(_suppliers(spark, sf).withColumn("display", F.substring("model", -1, 1)), HOSTED)
    listed = lambda c: F.array_join(c, ",")
    return found.join(names, "run_id", "left").select("run_id", listed("backends").alias("backends"), listed("names").alias("names"))


def label_backends(spark: SparkSession, sf: str) -> DataFrame:
    s = _suppliers(spark, sf)
    transcripts = s.select("run_id", F.concat(F.lit("asr"), (F.pmod("src_idx", F.lit(5)) + 1).cast("string")).alias("label"), "model", "src_idx")
    found = naming.label_backends(transcripts, s)
    return found.select("run_id", F.col("src_idx").alias("transcript"), "label", "backend", "tag")


def audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / 3).alias("run_id"), F.concat("c_mktsegment", F.when(F.col("c_acctbal") > 1000, ":free").otherwise("")).alias("model"))
    return replies.audit_chain(models, ["f1", "f2"], ["p1"]).select("run_id", F.array_join("chain", ",").alias("chain"))


def model_names(spark: SparkSession, sf: str) -> DataFrame:
    """Short names, files and lists of models."""
    p = table(spark, sf, "part")
    path = F.concat(F.lit("org/whisper-"), F.translate("p_name", " ", "-"), F.when(F.col("p_size") % 2 == 0, ":free").otherwise(""))
    label = F.concat("p_name", F.lit(" in "), "p_type", F.lit("/"), "p_brand", F.when(F.col("p_size") % 3 == 0, ", more").otherwise(""))
    known = F.when(F.col("p_size") < 5, "tiny")
    listed = derived.model_list(F.when(F.col("p_size") > 10, F.concat(F.lit(" "), "p_brand", F.lit(", ,"), "p_type")), ["standard"])
    return p.select(
        "p_partkey", T.short_model(path, known).alias("short"), T.short_label(label).alias("label"), derived.model_file(path, known).alias("file"),
        F.array_join(listed, "|").alias("models"), derived.effective_model(_pick(BACKENDS, F.col("p_partkey")), F.col("p_name"), F.when(F.col("p_size") > 25, F.col("p_brand"))).alias("effective"),
        derived.export_directory(F.concat(F.lit("/out/"), F.translate("p_name", " ", "-"), F.when(F.col("p_size") % 2 == 1, "-clean").otherwise(""), F.lit(".txt"))).alias("exports"),
    )


def presented_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with display names of known models, defaults of their backends and what these allow."""
    s = _suppliers(spark, sf).withColumn("device", _pick(("auto", "cpu", "cuda:0", "7"), F.col("src_idx"))).withColumn("effective_model", F.when(F.col("src_idx") % 3 == 0, F.concat("model", F.lit(".bin"))))
    notes = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_name").alias("model"), F.concat(F.lit("No. "), "s_suppkey").alias("display"), F.lit("rich").alias("hint"))
    kinds = table(spark, sf, "nation").limit(0).select(F.lit("").alias("backend"), F.lit("").alias("default_model"), F.lit("").alias("device_kind"), F.lit("").alias("default_device"))
    for name, model, kind, device in (("whisper-cpp", "base", "gpu", "auto"), ("hosted", "large", "net", "net"), ("ctc", "small", "cpu", "cpu")):
        kinds = kinds.union(spark.range(1).select(F.lit(name), F.lit(model), F.lit(kind), F.lit(device)))
    shown = derived.presented(s, notes).select("run_id", "src_idx", "display", "hint")
    found = scheduling.resolved(s.withColumn("model", F.when(F.col("src_idx") % 4 != 0, F.col("model")).otherwise("")), kinds)
    limits = kinds.filter("backend = 'ctc'").select("backend", F.col("default_model").alias("only_model"), F.col("default_device").alias("only_device"), F.lit(None).cast("string").alias("only_language"))
    bounded = scheduling.restricted(s.withColumn("model", F.when(F.col("src_idx") % 2 == 0, F.lit("SMALL")).otherwise(F.col("model"))), limits)
    return shown.join(found, ["run_id", "src_idx"]).join(bounded.select("run_id", "src_idx", F.col("error").alias("refused")), ["run_id", "src_idx"])


def cleanup_acceptance(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned texts judged by failure, length and worked examples; texts by mode; which runs are audited."""
    c = table(spark, sf, "conversations")
    given = c.withColumn("content", F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.col("text"))).withColumn("failure", F.when(F.col("conv_id") % 11 == 0, "stopped"))
    demos = c.filter("turn = 1 and conv_id % 3 = 0").select(F.upper("text").alias("text"))
    judged = replies.cleanup_rejection(given.withColumn("minimum_words", F.lit(12)), demos)
    runs = judged.select(
        F.concat_ws("/", "conv_id", "turn").alias("run_id"), _pick(("none", "off", "heuristic", "llama"), F.col("turn")).alias("mode"), F.col("text").alias("first_text"),
        F.col("content").alias("reply"), F.col("rejected").alias("error"), F.when(F.col("conv_id") % 7 == 0, "no room").alias("skip_reason"), "rejected", "role", "turn",
    )
    by_mode = planning.cleaned_by_mode(runs)
    audited = planning.audit_eligible(by_mode.join(runs.select("run_id", "mode", (F.col("role") != "system").alias("annotate"), F.col("turn").alias("sources")), "run_id")).select("run_id", F.lit(True).alias("audited"))
    return by_mode.join(runs.select("run_id", "rejected"), "run_id").join(audited, "run_id", "left").select("run_id", "rejected", F.md5("text").alias("text"), "error", "short", F.coalesce("audited", F.lit(False)).alias("audited"))


def speech_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of hosted and local recognisers, good and bad ones."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.pmod("doc_id", F.lit(6))
    good = F.to_json(F.struct("text", F.lit(False).alias("truncated"), F.lit(1.5).alias("audio_seconds"), F.array(F.struct(F.lit(0.0).alias("start"), F.lit(1.5).alias("end"), "text")).alias("segments")))
    body = F.when(n == 1, "[1]").when(n == 2, "no json").when(n == 3, F.to_json(F.struct("text", F.struct(F.lit("x").alias("message")).alias("error")))).when(n == 4, F.lit('{"text": 3, "error": false}')).otherwise(good)
    hosted = d.select("doc_id", replies.speech_rejection(body).alias("rejected"))
    worker = coverage.worker_replies(d.select(F.col("doc_id").alias("rec_id"), F.when(n == 5, 3).otherwise(0).alias("exit_code"), body.alias("stdout"), F.when(F.col("doc_id") % 12 == 5, " broken \n").alias("stderr")))
    faults = coverage.coverage(worker.filter("error is null")).select("rec_id", "fault")
    rows = worker.join(faults, "rec_id", "left").select(F.col("rec_id").alias("doc_id"), F.col("error").alias("worker_error"), F.length("text").alias("chars"), "audio_seconds", F.size("segments").alias("windows"), "fault")
    return hosted.join(rows, "doc_id")


def request_payloads(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").filter("text is not null")
    plans = c.select("conv_id", "turn", F.col("role").alias("model"), F.translate("text", "\"\\/\n\r\t", "      ").alias("prompt"), (F.col("turn") * 100).alias("max_tokens"), F.when(F.col("turn") % 2 == 0, '{"type":"object"}').alias("schema"))
    made = planning.request_payloads(planning.request_messages(plans, "Clean up."), routed=True, effort="low")
    return made.select("conv_id", "turn", F.md5("payload").alias("payload"))


def record_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events, transcripts and report lines of conversations as runs."""
    c = run_sources(spark, sf)
    logged = records.events(c.select("run_id", F.timestamp_micros(F.col("src_idx") * 1_234_567).alias("at"), F.col("kind").alias("type"), F.col("label").alias("fields")))
    logged = logged.groupBy("run_id").agg(F.max("seq").alias("events"), F.max("t").alias("last"))
    heard = records.transcript_events(c).groupBy("run_id").agg(F.md5(F.concat_ws(";", F.transform(F.array_sort(F.collect_list(F.struct("src_idx", "fields"))), lambda s: s["fields"]))).alias("transcripts"))
    runs = c.groupBy("run_id").agg(F.count("*").alias("n"))
    lines = records.report_lines(runs.select("run_id", F.lit("m").alias("served"), F.when(F.col("n") % 2 == 0, "m").otherwise("wanted").alias("requested"), F.when(F.col("n") % 3 == 0, "ck").alias("checkpoint"), (F.col("n") % 4).cast("int").alias("marked"), F.when(F.col("n") % 5 == 0, "late").alias("audit_note"), (F.col("run_id") % 2 == 0).alias("full_auto")))
    lines = lines.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), ";").alias("report"))
    clean = records.clean_texts(runs.select("run_id"), c.filter("src_idx = 2 and run_id % 2 = 1").select("run_id", "text")).select("run_id", F.length("clean_text").alias("clean_chars"))
    chunks = derived.joined_chunks(c.select("run_id", F.col("src_idx").alias("seq"), F.when(F.col("kind") == "user", F.lit(" \n")).otherwise(F.col("text")).alias("text"))).select("run_id", F.md5("text").alias("live"))
    return logged.join(heard, "run_id").join(lines, "run_id").join(clean, "run_id").join(chunks, "run_id")


def run_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Rules broken, devices chosen, checkpoints named and what is announced, customers as runs."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("run_id"), "c_acctbal", "c_nationkey", "c_name", F.lower("c_name").alias("c_phone"), "c_mktsegment")
    rules = {"funds": "c_acctbal > 0", "nation": "c_nationkey < 20", "segment": "c_mktsegment <> 'MACHINERY'"}
    broken = scheduling.violations(c, rules).groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("broken"))
    said = scheduling.announcements(c.withColumn("hosted", F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))).withColumn("cleanup_hosted", F.col("c_acctbal") > 500))
    paths = c.select("run_id", F.when(F.col("c_nationkey") % 5 == 0, F.concat(F.lit("/m/"), "c_name")).alias("owned_path"), F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit("/s/"), "c_phone")).alias("server_path"), F.concat(F.lit("org/"), "c_mktsegment", F.when(F.col("c_nationkey") % 2 == 0, ".GGUF").otherwise("")).alias("served_model"))
    named = scheduling.checkpoint_identity(paths).select("run_id", "checkpoint", "checkpoint_origin")
    device = scheduling.device_id(_pick((" 12 ", "mic one", " ", "-3", "0x1"), F.col("run_id")))
    quiet = N.quiet_warning(F.col("c_acctbal") * 3, F.col("c_nationkey") > 3)
    failed = records.run_failed(c.select("run_id", (F.col("c_nationkey") == 1).alias("interrupted"), F.floor(F.col("c_acctbal") / 5000).alias("errors"), F.when(F.col("c_nationkey") != 2, F.col("c_name")).alias("output"))).select("run_id", "failed")
    hint = T.language_hint(F.lit("Prompt"), _pick(("DE ", "auto", "", "und", "fr"), F.col("run_id")))
    rows = c.select("run_id", device["number"].alias("device_number"), device["name"].alias("device_name"), quiet.alias("quiet"), hint.alias("hint"), N.pcm_seconds(F.col("run_id") * 77, 16000).alias("seconds"), N.realtime_factor(F.col("c_acctbal"), F.col("run_id")).alias("factor"))
    return rows.join(broken, "run_id", "left").join(said.select("run_id", "announcement"), "run_id").join(named, "run_id").join(failed, "run_id")


def text_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Error lines, log excerpts and texts freed of rendered notes."""
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    log = F.array_join(F.transform(F.split("text", " "), lambda w: F.concat(w, F.lit(" "))), "\n")
    noted = F.concat(F.lit("a[1] b[2] c[3]\n\nUncertain passages:\n[1] \"a\": "), F.left("text", F.lit(20)), F.lit("\n[2] \"b\": x"))
    return d.select(
        "doc_id", F.md5(derived.error_text(F.col("text"))).alias("error"), F.md5(derived.log_excerpt(log, ["the", "un", "error"])).alias("log"),
        F.md5(T.without_annotations(F.when(F.col("doc_id") % 2 == 0, noted).otherwise(F.col("text")), "Uncertain passages:")).alias("bare"),
    )


def case_results(spark: SparkSession, sf: str) -> DataFrame:
    """Providers, shown readings, uncovered labels and repeats of cases."""
    line, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    served = evaluation.providers(line.select(F.col("l_orderkey").alias("case"), F.concat("l_returnflag", "l_linestatus").alias("provider")), "case")
    alts = F.array(F.struct(F.when(F.col("o_orderpriority") > "3", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("text"), F.col("o_orderstatus").alias("verbatim")), F.struct(F.lit("").alias("text"), F.lit(" ").alias("verbatim")), F.struct(F.lit(None).cast("string").alias("text"), F.lit("v ").alias("verbatim")))
    shown = o.select(F.col("o_orderkey").alias("case"), F.array_join(evaluation.shown_readings(alts), "/").alias("shown"))
    missed = evaluation.uncovered(shown.select("case"), line.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("case")), "case").withColumn("missed", F.lit(True))
    again = evaluation.repeats(o.select(F.col("o_orderkey").alias("case")), 3).groupBy("case").agg(F.sum("repeat").alias("repeats"))
    return shown.join(served, "case", "left").join(missed, "case", "left").join(again, "case")


def frame_records(spark: SparkSession, sf: str) -> DataFrame:
    """Running maxima, statistics of segments and throttled warnings of event streams."""
    x = user_samples(spark, sf)
    top = records.levels(x.select(F.col("rec_id").alias("run_id"), F.col("i").alias("frame_no"), F.abs("x").alias("peak"), (F.abs("x") / 3).alias("rms")))
    found = S.segment_statistics(S.segments(x.select(F.col("rec_id").alias("stream_id"), F.col("i").alias("frame_no"), (F.col("x") > 3000).alias("voiced"), F.lit(960).alias("n_bytes")), S.Rules(pre_roll=1, end_silence=1, min_voiced=1, longest=5)), 30)
    segments = found.groupBy(F.col("stream_id").alias("run_id")).agg(F.count("*").alias("segments"), F.max("segment").alias("last_segment"), F.round(F.sum("seconds"), 3).alias("seconds"))
    warnings = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    shown = records.throttled(warnings, 86400.0).groupBy(F.col("stream_id").alias("run_id")).agg(F.count("*").alias("shown"))
    return top.join(segments, "run_id", "left").join(shown, "run_id")


def sample_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of embeddings peak-normalised, in padded hops, as int16, and a clip of them."""
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.round(v.cast("double"), 3)).alias("v"))
    normal = N.peak_normalised(F.transform("v", lambda v: v / 8))
    hops = signals.padded_hops(F.col("v"), 10)
    ints = F.transform("v", lambda v: N.to_int16(v * 20000))
    clip = signals.sub_clip(F.col("v"), 16, 0.5, 1.25)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double"))
    return e.select(
        "vec_id", F.round(F.array_max(F.transform(normal, F.abs)), 6).alias("peak"), F.size(hops).alias("hops"), F.array_max(F.transform(hops, F.size)).alias("hop"),
        F.round(total(F.element_at(hops, -1)), 6).alias("last_hop"), total(ints).cast("long").alias("ints"), F.size(clip).alias("clip"), F.round(total(clip), 6).alias("clip_sum"),
    )


def device_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Input devices in order, and the first rate of a preference list that each supports."""
    s = table(spark, sf, "supplier")
    kind = _pick(("Line", "USB Mic", "Headset", "Built-in"), F.col("s_suppkey"))
    devices = s.select(F.concat_ws(" ", kind, "s_name").alias("name"), (F.col("s_suppkey") % 3).alias("channels"), (F.col("s_suppkey") % 50 == 1).alias("is_default"), "s_suppkey")
    ordered = scheduling.ordered_devices(devices).select("s_suppkey", "rank")
    rates = table(spark, sf, "nation").select(F.col("n_nationkey").alias("rank"), (F.pmod(F.col("n_nationkey") * 7, F.lit(25))).alias("value"))
    supported = table(spark, sf, "customer").select(F.pmod("c_custkey", F.lit(40)).alias("s_suppkey"), F.col("c_nationkey").alias("value")).distinct()
    return ordered.join(scheduling.first_supported(rates, supported, "s_suppkey"), "s_suppkey", "left")


QUERIES = [
    source_filters, network_backends, label_backends, audit_chain, model_names, presented_sources, cleanup_acceptance, speech_replies, request_payloads,
    record_lines, run_decisions, text_excerpts, case_results, frame_records, sample_windows, device_choices,
]

_BACKENDS = "['whisper-cpp', 'faster-whisper', 'hosted', 'hosted-stt', 'ctc']"
_SUPPLIERS = f"s as (select s_nationkey as run_id, s_suppkey as src_idx, {_BACKENDS}[(s_suppkey % 5 + 1)::int] as backend, s_name as model from supplier)"
_SLUG = "coalesce(nullif(lower(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), ''), 'recording')"

SQL = {
    "source_filters": f"""
with {RUN_SOURCES},
f as (select run_id, count(*) as finals, min(src_idx) as first_final from sources where trim(text, e' \\t\\n\\r') <> '' and kind = 'asr-final' group by 1),
n as (select run_id, md5(min_by(text, src_idx)) as s1 from sources where label = 's1' group by 1)
select coalesce(f.run_id, n.run_id) as run_id, finals, first_final, s1 from f full join n on f.run_id = n.run_id""",
    "network_backends": f"""
with {_SUPPLIERS},
h as (select run_id, src_idx, backend, right(model, 1) as display from s where backend in ('hosted', 'hosted-stt')),
u as (select run_id, display, min(src_idx) as first from h group by 1, 2)
select r.run_id, coalesce((select string_agg(distinct backend, ',' order by backend) from h where h.run_id = r.run_id), '') as backends,
    (select string_agg(display, ',' order by first) from u where u.run_id = r.run_id) as names from (select distinct run_id from s) r""",
    "label_backends": f"""
with {_SUPPLIERS},
p as (select run_id, 'asr' || row_number() over (partition by run_id order by src_idx) as label, backend from s),
t as (select run_id, src_idx, 'asr' || (src_idx % 5 + 1) as label, {_SLUG.format("model")} as tag from s)
select t.run_id, src_idx as transcript, t.label, backend, case when backend in ('whisper-cpp', 'faster-whisper') and not contains(tag, 'whisper') then 'whisper-' || tag else tag end as tag
from t left join p on p.run_id = t.run_id and p.label = t.label""",
    "audit_chain": """
select c_custkey // 3 as run_id, case when bool_and(c_acctbal > 1000) then 'f1,f2' else 'p1' end as chain from customer group by 1""",
    "model_names": f"""
with p as (select *, replace(p_name, ' ', '-') as n, case when p_size % 2 = 0 then ':free' else '' end as free, split_part(p_name || ' in ' || p_type || '/' || p_brand || case when p_size % 3 = 0 then ', more' else '' end, ',', 1) as head,
    case when p_size < 5 then 'tiny' end as known from part)
select p_partkey, coalesce(known, 'whisper-' || n) as short, case when length(head) <= 32 then head else p_brand end as label, 'ggml-' || coalesce(known, n || free) || '.bin' as file,
    case when p_size > 10 then p_brand || '|' || p_type else 'standard' end as models, case when p_partkey % 5 = 0 and p_size > 25 then p_brand else p_name end as effective, '/out/' || n || '-sources' as exports from p""",
    "presented_sources": f"""
with {_SUPPLIERS},
d as (select *, ['auto', 'cpu', 'cuda:0', '7'][(src_idx % 4 + 1)::int] as device from s),
k as (select * from (values ('whisper-cpp', 'base', 'gpu', 'auto'), ('hosted', 'large', 'net', 'net'), ('ctc', 'small', 'cpu', 'cpu')) v(backend, default_model, kind, default_device))
select d.run_id, d.src_idx, case when s_acctbal > 5000 then 'No. ' || s_suppkey when src_idx % 3 = 0 then model || '.bin' else model end as display, case when s_acctbal > 5000 then 'rich' end as hint, d.backend,
    case when src_idx % 4 = 0 then default_model else model end as model, case when device = 'auto' then default_device else device end as device,
    case when device = 'cpu' then 'cpu' when device in ('cuda:0', '7') then 'gpu' else kind end as device_kind, case when kind is null then 'unknown backend ' || d.backend end as error,
    case when d.backend = 'ctc' and src_idx % 2 = 1 then 'ctc takes only model small' when d.backend = 'ctc' and device not in ('auto', 'cpu') then 'ctc runs only on cpu' end as refused
from d left join k using (backend) join supplier on s_suppkey = src_idx""",
    "cleanup_acceptance": r"""
with c as (select *, case when turn % 5 = 4 then '  ' else text end as content, case when conv_id % 11 = 0 then 'stopped' end as failure from conversations),
demo as (select distinct regexp_extract_all(lower(upper(text)), '[\p{L}\p{M}\p{N}_]+') as tokens from conversations where turn = 1 and conv_id % 3 = 0),
j as (select c.*, coalesce(trim(content, e' \t\n\r'), '') as t, len(regexp_extract_all(coalesce(content, ''), '\S+')) as w,
    list_contains((select list(tokens) from demo), regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{M}\p{N}_]+')) as is_demo from c),
r as (select *, case when failure is not null then failure when t = '' then 'empty output'
    when w < 12 and is_demo then 'incomplete cleanup: suspiciously short (' || w || ' words < 12 expected); a worked example'
    when w < 12 then 'incomplete cleanup: suspiciously short (' || w || ' words < 12 expected)' when is_demo then 'incomplete cleanup: a worked example' end as rejected,
    ['none', 'off', 'heuristic', 'llama'][(turn % 4 + 1)::int] as mode, case when conv_id % 7 = 0 then 'no room' end as skip from j),
h as (select *, trim(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\b(?:um+|uh+|umm+|uhh+|erm|mm+|hmm+|ah+|eh+)\b', ' ', 'g'), '\s+([,.;:!?])', '\1', 'g'), '\s+', ' ', 'g')) as plain from r),
m as (select *, case when mode = 'none' then '' when mode = 'off' then coalesce(text, '')
    when mode = 'heuristic' then case when plain = '' then '' else upper(plain[1]) || plain[2:] || case when regexp_matches(plain, '[.!?]["'')\]]?\s*$') then '' else '.' end end
    when rejected is null and skip is null then coalesce(content, '') else '' end as final,
    case when mode = 'llama' then coalesce(rejected, skip) end as error from h)
select conv_id || '/' || turn as run_id, rejected, md5(final) as text, error, mode = 'llama' and (skip is not null or coalesce(contains(rejected, 'suspiciously short ('), false)) as short,
    role <> 'system' and mode = 'llama' and final <> '' and error is null and turn > 1 as audited from m""",
    "speech_replies": r"""
with d as (select doc_id, coalesce(text, '') as text, doc_id % 6 as n from documents)
select doc_id, case n when 1 then 'not an object' when 2 then 'not an object' when 3 then 'provider error' when 4 then 'no text' end as rejected,
    case when n = 5 then case when doc_id % 12 = 5 then 'broken' else 'the worker ended with 3' end when n = 1 then 'the worker''s reply is no object' when n = 2 then 'the worker''s reply is not JSON' end as worker_error,
    case when n in (0, 3) then length(text) end::int as chars, case when n = 0 then 1.5::double end as audio_seconds, case when n = 0 then 1 end as windows,
    case when n in (3, 4) then 'incomplete reply' end as fault from d""",
    "request_payloads": r"""
with c as (select *, translate(text, '"\/' || chr(10) || chr(13) || chr(9), '      ') as prompt from conversations where text is not null)
select conv_id, turn, md5('{"model":"' || role || '","messages":[{"role":"system","content":"Clean up."},{"role":"user","content":"' || prompt || '"}],"temperature":0.0,"top_p":1,"max_tokens":' || turn * 100
    || case when turn % 2 = 0 then ',"response_format":{"type":"json_schema","json_schema":{"name":"reply","strict":true,"schema":{"type":"object"}}},"provider":{"require_parameters":true}' else '' end
    || ',"reasoning":{"effort":"low"}}') as payload from c""",
    "record_lines": rf"""
with {RUN_SOURCES},
g as (select run_id, count(*) as n, count(*)::int as events, round_even((max(src_idx) - min(src_idx)) * 1.234567::double, 3) as last,
    md5(string_agg('{{"label":"' || label || '"' || coalesce(',"chars":' || length(text) || ',"words":' || len(regexp_extract_all(text, '\S+')), '') || '}}', ';' order by src_idx)) as transcripts,
    md5(coalesce(string_agg(trim(text, e' \t\n\r'), ' ' order by src_idx) filter (kind <> 'user' and trim(text, e' \t\n\r') <> ''), '')) as live,
    coalesce(max(length(text)) filter (src_idx = 2 and run_id % 2 = 1), 0)::int as clean_chars from sources group by 1)
select run_id, events, last, transcripts, concat_ws(';', case when n % 2 = 0 then 'model m' else 'model m for wanted' end, case when n % 3 = 0 then 'checkpoint ck' end,
    case when n % 4 > 0 then (n % 4) || ' passages marked' end, case when run_id % 2 = 0 and n % 5 = 0 then 'late' end) as report, clean_chars, live from g""",
    "run_decisions": r"""
with c as (select c_custkey as run_id, *, ['DE ', 'auto', '', 'und', 'fr'][(c_custkey % 5 + 1)::int] as lang from customer)
select run_id, case run_id % 5 when 0 then 12 when 3 then -3 end::int as device_number, case run_id % 5 when 1 then 'mic one' when 4 then '0x1' end as device_name,
    case when c_nationkey > 3 then case when c_acctbal <= 0 then 'no signal' when round_even(log10(c_acctbal * 3 / 32767) * 20, 2) <= -35 then 'quiet recording: peak ' || round_even(log10(c_acctbal * 3 / 32767) * 20, 2) || ' dBFS' end end as quiet,
    'Prompt' || case when run_id % 5 in (0, 4) then chr(10) || 'Language: ' || lower(trim(lang)) else '' end as hint, run_id * 77 / 16000::double / 2 as seconds,
    case when c_acctbal <> 0 and run_id <> 0 then round_even(c_acctbal / run_id, 2) + 0.0::double end as factor,
    nullif(concat_ws(',', case when not c_acctbal > 0 then 'funds' end, case when not c_nationkey < 20 then 'nation' end, case when c_mktsegment = 'MACHINERY' then 'segment' end), '') as broken,
    case when c_nationkey % 2 = 0 and c_acctbal > 500 then 'audio and text are sent' when c_nationkey % 2 = 0 then 'audio is sent' when c_acctbal > 500 then 'text is sent' else 'nothing is sent' end as announcement,
    case when c_nationkey % 5 = 0 then c_name when c_nationkey % 3 = 0 then lower(c_name) when c_nationkey % 2 = 0 then c_mktsegment || '.GGUF' end as checkpoint,
    case when c_nationkey % 5 = 0 then 'process' when c_nationkey % 3 = 0 then 'server' when c_nationkey % 2 = 0 then 'reply' else 'unknown' end as checkpoint_origin,
    c_nationkey = 1 or floor(c_acctbal / 5000) > 0 or c_nationkey = 2 as failed from c""",
    "text_excerpts": r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
l as (select *, list_filter(list_transform(string_split(array_to_string(list_transform(string_split(text, ' '), lambda w: w || ' '), chr(10)), chr(10)), lambda w: trim(w, e' \t\n\r')),
    lambda w: contains(lower(w), 'the') or contains(lower(w), 'un') or contains(lower(w), 'error'))[1:6] as hits from d)
select doc_id, md5(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300)) as error, md5(array_to_string(hits, ' | ')) as log, md5(case when doc_id % 2 = 0 then 'a b c[3]' else text end) as bare from l""",
    "case_results": """
select o_orderkey as "case", concat_ws('/', nullif(case when o_orderpriority > '3' then o_orderstatus else o_orderpriority end, ''), 'v') as shown, p.providers,
    case when not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R') then true end as missed, 3 as repeats
from orders left join (select l_orderkey, string_agg(distinct l_returnflag || l_linestatus, ',' order by l_returnflag || l_linestatus) as providers from lineitem group by 1) p on l_orderkey = o_orderkey""",
    "frame_records": f"""
with recursive {USER_SAMPLES},
m as (select rec_id, max(abs(x)) as peak, round_even(max(abs(x) / 3), 2) as rms from samples group by 1),
f as (select rec_id as s, i as n, (x > 3000)::int as v, count(*) over (partition by rec_id) as total from samples),
r as (select s, -1::bigint as n, 0 as frames, 0 as closed, 0 as out from (select distinct s from f)
    union all
    select s, n, case when done then 0 else frames end, done::int, case when done or (n = total - 1 and frames > 0) then frames else 0 end
    from (select f.s, f.n, f.total, case when r.frames > 0 then r.frames + 1 when f.v = 1 then 1 else 0 end as frames, r.frames > 0 and (r.frames + 1 >= 5 or f.v = 0) as done from r join f on f.s = r.s and f.n = r.n + 1)),
g as (select s, count(*) as segments, (count(*) - 1)::int as last_segment, round(sum(round_even(out * 30 / 1000.0::double, 3)), 3) as seconds from r where out > 0 group by 1),
e as (select user_id, floor(epoch(ts)) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
w as (select user_id, 0::bigint as k, '-infinity'::double as last, 0 as shown from (select distinct user_id from e)
    union all
    select e.user_id, e.k, case when e.t - w.last >= 86400 then e.t else w.last end, w.shown + (e.t - w.last >= 86400)::int from w join e on e.user_id = w.user_id and e.k = w.k + 1)
select m.rec_id as run_id, peak, rms, case when peak > 0 then round_even(log10(peak / 32767) * 20, 2) + 0.0::double end as peak_db, segments, last_segment, seconds, s.shown
from m left join g on g.s = m.rec_id join (select user_id, max(shown) as shown from w group by 1) s on s.user_id = m.rec_id""",
    "sample_windows": """
with e as (select vec_id, list_transform(embedding, lambda v: round(v::double, 3)) as v from embeddings),
p as (select *, list_max(list_transform(v, lambda x: abs(x / 8))) as top from e)
select vec_id, round(case when top > 0 and top < 0.95 then 0.95 else top end, 6) as peak, ceil(len(v) / 10.0)::int as hops, 10 as hop, round(list_sum(v[(ceil(len(v) / 10.0)::int - 1) * 10 + 1:]), 6) + 0.0::double as last_hop,
    list_sum(list_transform(v, lambda x: least(32767, greatest(-32768, round_even(x * 20000, 0)))::int))::bigint as ints, len(v[9:28])::int as clip, round(list_sum(v[9:28]), 6) + 0.0::double as clip_sum from p""",
    "device_choices": """
with s as (select s_suppkey, ['Line', 'USB Mic', 'Headset', 'Built-in'][(s_suppkey % 4 + 1)::int] as kind from supplier where s_suppkey % 3 > 0),
r as (select n_nationkey as rank, n_nationkey * 7 % 25 as value from nation),
b as (select c_custkey % 40 as d, min_by(r.value, r.rank) as value from customer join r on r.value = c_nationkey group by 1)
select s_suppkey, case when s_suppkey % 50 = 1 then 0 when kind = 'USB Mic' then 1 when kind = 'Headset' then 2 else 3 end as rank, b.value from s left join b on d = s_suppkey""",
}
