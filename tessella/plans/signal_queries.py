"""Queries on signals, intervals and frame streams, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.operators import coverage, signals
from tessella.operators.running import numbered
from tessella.plans.common import USER_SAMPLES, table, user_samples
from tessella.streaming import live
from tessella.streaming import segments as S

HOP, BLOCK = 4, 2


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    return signals.frame_levels(user_samples(spark, sf), HOP)


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else c for c in df.columns])


def pcm_stats(spark: SparkSession, sf: str) -> DataFrame:
    found = signals.pcm_stats(user_samples(spark, sf)).withColumn("peak_db", N.decibels(F.col("peak")))
    return _rounded(found, "rms")


def frame_loudness(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_frames(spark, sf), "db")


def level_summary(spark: SparkSession, sf: str) -> DataFrame:
    return signals.level_summary(_frames(spark, sf))


def rolling_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(signals.rolling_percentile(_frames(spark, sf), half=6, step=5), "level")


def moving_average(spark: SparkSession, sf: str) -> DataFrame:
    frames = _frames(spark, sf).select("rec_id", "f", F.col("db").alias("v"))
    return _rounded(signals.moving_average(frames, 10), "v")


def gain_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(signals.gain_ride(_frames(spark, sf), half=6, width=4, step=5), "v")


def look_ahead_max(spark: SparkSession, sf: str) -> DataFrame:
    peaks = signals.block_peaks(user_samples(spark, sf), BLOCK)
    return signals.look_ahead(peaks, "peak").select("rec_id", "b", "ahead")


def release_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(signals.compression(signals.block_peaks(user_samples(spark, sf), BLOCK)), "held")


def limiter(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(signals.limiting(signals.block_peaks(user_samples(spark, sf), BLOCK)), "factor")


def compressor_curve(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    over = F.col("l_discount") * 200 - 10
    return line.groupBy("l_discount").agg(F.count("*").alias("n")).select("l_discount", "n", F.round(N.knee_reduction(over), 9).alias("reduction"))


def leveled_signal(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain on all values of a type of event in time order, 50 samples a second: recordings of minutes."""
    e = table(spark, sf, "events")
    placed = numbered(e.select("event_type", "ts", "event_id", "value"), "i", "event_type", F.to_date("ts"), "ts", "event_id")
    samples = placed.select(F.col("event_type").alias("rec_id"), F.col("i").cast("long").alias("i"), F.bround(F.col("value") * 50, 0).alias("x"))
    return signals.levelled(samples, 50)


def recording_windows(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return signals.stride_windows(o.select(F.col("o_orderkey").alias("rec_id"), (F.floor("o_totalprice") / 256).alias("seconds")))


def coverage_check(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    stop = F.sum("l_quantity").over(order.rowsBetween(Window.unboundedPreceding, 0))
    gap = F.when(F.col("l_discount") > 0.08, 1.0).otherwise(0.0)
    rows = line.select(F.col("l_orderkey").alias("rec_id"), F.row_number().over(order).alias("k"), (stop - F.col("l_quantity") + gap).alias("start"), stop.alias("stop"))
    return coverage.adjacency_faults(rows)


def _voice_frames(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("stream_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_no"), (F.col("value") > 30).alias("voiced"), F.lit(960).alias("n_bytes")
    )


def voice_segments(spark: SparkSession, sf: str) -> DataFrame:
    return S.segments(_voice_frames(spark, sf), S.Rules(pre_roll=3, end_silence=3, min_voiced=2, longest=10))


def queue_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as frames whose service takes a quarter of an hour per unit of value: live queues for even users, replays for
    odd ones, and a failing consumer on 20 January for every fifth."""
    e = table(spark, sf, "events")
    at = lambda c: F.unix_micros(c) / 1_000_000
    frames = e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("frame_no"), at(F.col("ts").cast("timestamp")).alias("at"), (F.col("value") * 900).alias("service"), F.lit(False).alias("failure"))
    none = lambda kind: F.lit(None).cast(kind)
    failing = e.select("user_id").distinct().filter("user_id % 5 = 0")
    failures = failing.select(F.col("user_id").alias("stream_id"), none("long").alias("frame_no"), at(F.to_timestamp(F.lit("2024-01-20 00:00:00"))).alias("at"), none("double").alias("service"), F.lit(True).alias("failure"))
    frames = frames.union(failures)
    parts = [live.queued(frames.filter(F.col("stream_id") % 2 == n), live.QueueRules(4, n == 0)) for n in (0, 1)]
    return live.queue_summary(parts[0].union(parts[1]))


def rechunked_frames(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").filter("text is not null")
    chunks = c.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("chunk_no"), F.encode("text", "UTF-8").alias("data"))
    return S.rechunked(chunks, 160).select("stream_id", "frame_no", F.md5("frame").alias("frame"))


QUERIES = [
    pcm_stats, frame_loudness, level_summary, rolling_percentile, moving_average, gain_curve, look_ahead_max, release_envelope, limiter, compressor_curve,
    leveled_signal, recording_windows, coverage_check, voice_segments, rechunked_frames, queue_outcomes,
]

_FRAMES = f"""{USER_SAMPLES},
frames as (select rec_id, i // {HOP} as f, 20 * log10(greatest(sqrt(avg(x * x)) / 32767, 1e-9::double)) as db from samples group by 1, 2)"""
_PEAKS = f"""{USER_SAMPLES},
peaks as (select rec_id, i // {BLOCK} as b, max(abs(x)) as peak from samples group by 1, 2)"""
_ROLLING = """
ends as (select rec_id, max(f) as last from frames group by 1),
anchors as (select e.rec_id, a, quantile_cont(db, 0.75) as v from ends e, unnest(range(0, last + 1, 5)) u(a) join frames f on f.rec_id = e.rec_id and f.f between a - 6 and a + 6 group by 1, 2),
rolled as (select f.rec_id, f.f, p.v + (coalesce(q.v, p.v) - p.v) * (f.f - p.a)::double / 5 as level
    from frames f join anchors p on p.rec_id = f.rec_id and p.a = f.f // 5 * 5 left join anchors q on q.rec_id = f.rec_id and q.a = f.f // 5 * 5 + 5)"""
# Short recordings are averaged over as many frames as they have.
_AVERAGE = """(select rec_id, f, avg(w) as v from (select x.rec_id, x.f, y.v as w from
    (select *, least({1}, count(*) over (partition by rec_id)) as n from {0}) x join {0} y on y.rec_id = x.rec_id
    and y.f >= x.f - x.n // 2 and y.f < x.f - x.n // 2 + x.n) group by 1, 2)"""

SQL = {
    "pcm_stats": f"""
with {USER_SAMPLES}
select rec_id, max(abs(x)) as peak, round(sqrt(avg(x * x)), 6) as rms, case when max(abs(x)) > 0 then round_even(log10(max(abs(x)) / 32767) * 20, 2) + 0.0::double end as peak_db from samples group by 1""",
    "frame_loudness": f"with {_FRAMES} select rec_id, f, round(db, 6) as db from frames",
    "level_summary": f"""
with {_FRAMES}, m as (select rec_id, quantile_cont(db, 0.5) as median from frames group by 1)
select rec_id, round_even(quantile_cont(db, 0.5), 2) as level, round_even(quantile_cont(db, 0.9) - quantile_cont(db, 0.1), 2) as spread
from frames join m using (rec_id) where db >= median group by 1""",
    "rolling_percentile": f"with {_FRAMES}, {_ROLLING} select rec_id, f, round(level, 6) as level from rolled",
    "moving_average": f"""
with {_FRAMES}, s as (select rec_id, f, db as v from frames)
select rec_id, f, round(v, 6) as v from {_AVERAGE.format("s", 10)}""",
    "gain_curve": f"""
with {_FRAMES}, {_ROLLING}, s as (select rec_id, f, least(34.0::double, greatest(-12.0::double, -20.0 - level)) as v from rolled),
t as (select * from {_AVERAGE.format("s", 4)})
select rec_id, f, round(least(34.0::double, greatest(-12.0::double, v)), 6) as v from {_AVERAGE.format("t", 4)}""",
    "look_ahead_max": f"with {_PEAKS} select rec_id, b, max(peak) over (partition by rec_id order by b rows between current row and 2 following) as ahead from peaks",
    "release_envelope": f"""
with {_PEAKS}, o as (select rec_id, b, 20 * log10(greatest(peak / 32767, 1e-9::double)) + 14 as over_db from peaks),
r as (select rec_id, b, case when over_db <= -3 then 0 when over_db >= 3 then over_db * 0.75 else (over_db + 3) * (over_db + 3) * 0.75 / 12 end as v from o),
a as (select rec_id, b, max(v) over (partition by rec_id order by b rows between current row and 2 following) as v from r),
l as (select *, max(case when v > 0 then ln(v) + b * 0.04::double end) over (partition by rec_id order by b) as top from a)
select rec_id, b, round(coalesce(exp(top - b * 0.04::double), 0), 6) as held from l""",
    "limiter": f"""
with {_PEAKS}, o as (select rec_id, b, least(1.0::double, 32767 * pow(10, -0.1::double) / greatest(peak, 1e-9::double)) as own from peaks)
select rec_id, b, round(min(own) over (partition by rec_id order by b rows between 2 preceding and 2 following), 6) as factor from o""",
    "compressor_curve": """
with d as (select l_discount, count(*) as n, l_discount * 200 - 10 as o from lineitem group by l_discount)
select l_discount, n, round(case when o <= -3 then 0 when o >= 3 then o * 0.75 else (o + 3) * (o + 3) * 0.75 / 12 end, 9) as reduction from d""",
    "recording_windows": """
with r as (select o_orderkey as rec_id, floor(o_totalprice) / 256 as seconds from orders),
w as (select rec_id, seconds, k from r, unnest(range(0, greatest(ceil(seconds / 240), 1)::bigint)) u(k))
select rec_id, k::int as k, greatest(k * 240.0::double - 5, 0) as start, least((k + 1) * 240.0::double + 5, seconds) as stop,
    k * 240.0::double - greatest(k * 240.0::double - 5, 0) as "left", least((k + 1) * 240.0::double + 5, seconds) - least((k + 1) * 240.0::double, seconds) as "right" from w""",
    "coverage_check": """
with s as (select l_orderkey as rec_id, row_number() over w as k, sum(l_quantity) over (w rows between unbounded preceding and current row) as stop, l_quantity as q, l_discount as d
    from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
i as (select rec_id, k, stop - q + case when d > 0.08 then 1.0 else 0.0 end as start, stop, lag(stop, 1, 0.0) over (partition by rec_id order by k) as before from s)
select rec_id, count(*) filter (not (stop > start and abs(start - before) <= 0.002)) as faults, max(stop) as "end", count(*) as intervals from i group by 1""",
    "voice_segments": """
with recursive f as (select user_id as s, row_number() over (partition by user_id order by ts, event_id) - 1 as n, (value > 30)::int as v, count(*) over (partition by user_id) as total from events),
r as (select s, -1::bigint as n, 0 as kept, 0 as frames, 0 as voiced, 0 as silent, 0::bigint as first, null::bigint[] as out from (select distinct s from f)
    union all
    select s, n, case when opened or closed then 0 else kept end, case when closed then 0 else frames end, case when closed then 0 else voiced end, case when closed then 0 else silent end, first,
        case when closed and (frames >= 10 or voiced >= 2) then [first, n, frames, voiced] when n = total - 1 and not closed and frames > 0 and voiced >= 2 then [first, n, frames, voiced] end
    from (select *, frames > 0 and not opened and (frames >= 10 or silent >= 3) as closed from (
        select f.s, f.n, f.total, r.frames = 0 and f.v = 1 as opened, case when r.frames = 0 then least(r.kept + 1, 3) else 0 end as kept,
            case when r.frames > 0 then r.frames + 1 when f.v = 1 then least(r.kept + 1, 3) else 0 end as frames,
            case when r.frames > 0 then r.voiced + f.v else f.v end as voiced, case when f.v = 1 or r.frames = 0 then 0 else r.silent + 1 end as silent,
            case when r.frames > 0 then r.first else f.n - least(r.kept + 1, 3) + 1 end as first
        from r join f on f.s = r.s and f.n = r.n + 1)))
select s as stream_id, out[1] as first_frame, out[2] as last_frame, out[3] as frames, out[4] as voiced from r where out is not null""",
    "queue_outcomes": """
with recursive f as (select user_id as s, row_number() over (partition by user_id order by ts, event_id) as k, epoch_us(ts) / 1000000.0::double as tm, value * 900 as service,
    user_id % 2 = 0 as live, case when user_id % 5 = 0 then epoch_us(timestamp '2024-01-20 00:00:00') / 1000000.0::double end as fails from events),
g as (select * from f where fails is null or tm <= fails),
r as (select s, 0::bigint as k, []::double[] as starts, '-infinity'::double as free, '-infinity'::double as entered, null::double as started, 0 as depth, false as dropped from (select distinct s from f)
    union all
    select s, k, case when dropped then ahead else list_append(list_filter(ahead, lambda x: x > entry), greatest(entry, free)) end, case when dropped then free else greatest(entry, free) + service end,
        case when dropped then entered else entry end, case when not dropped then greatest(entry, free) end,
        case when not dropped then len(list_filter(ahead, lambda x: x > entry)) + (greatest(entry, free) > entry)::int end, dropped
    from (select *, live and len(ahead) >= 4 as dropped, case when not live and len(ahead) >= 4 then ahead[len(ahead) - 3] else wanted end as entry from (
        select *, list_filter(starts, lambda x: x > wanted) as ahead from (
            select r.s, g.k, r.starts, r.free, r.entered, g.service, g.live, case when g.live then g.tm else greatest(g.tm, r.entered) end as wanted
            from r join g on g.s = r.s and g.k = r.k + 1)))),
o as (select f.s, f.fails, case when r.k is null then 'refused' when dropped then 'dropped' when f.fails is null or started <= f.fails then 'read' when r.entered <= f.fails then 'kept' else 'refused' end as outcome, depth
    from f left join r on f.s = r.s and f.k = r.k)
select s as stream_id, count(*) as frames, count(*) filter (outcome = 'read') as read, count(*) filter (outcome = 'dropped') as dropped, count(*) filter (outcome = 'kept') as kept,
    count(*) filter (outcome = 'refused') as refused, max(case when outcome in ('read', 'kept') then depth end) as deepest, bool_or(outcome = 'dropped' or fails is not null) as failed from o group by 1""",
    "rechunked_frames": """
with s as (select conv_id, string_agg(hex(encode(text)), '' order by turn) as h from conversations where text is not null group by 1)
select conv_id as stream_id, k as frame_no, md5(unhex(h[k * 320 + 1:k * 320 + 320])) as frame from s, unnest(range(0, length(h) // 320)) u(k)""",
}
