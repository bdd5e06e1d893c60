"""Queries on audits and evaluations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import audit, evaluation, replies
from tessella.plans.common import run_sources, table


def _notes(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up notes, as the tables hold none: every run of six words of every turn (the last one may be shorter) is a note on its
    first words, with a shortened copy, a reordered copy, an invention and a bare copy as readings. They are checked
    against all whole texts of the conversation."""
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    alt = lambda t, v: F.struct(t.alias("text"), F.lit(1).alias("source"), v.alias("verbatim"))
    pair = lambda i, j: F.concat_ws(" ", F.get("w", F.lit(i)), F.get("w", F.lit(j)))
    alts = F.array(alt(pair(1, 3), part(2, 4)), alt(pair(3, 1), part(2, 4)), alt(F.lit("zzz yyy"), F.lit("xxx zzz")), alt(part(1, 3), F.lit("xxx zzz")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("all")).filter(F.size("all") > 0)
    rows = rows.select("conv_id", "turn", "all", F.explode(F.sequence(F.lit(0), F.expr("(size(all) - 1) div 6"))).alias("i"))
    rows = rows.withColumn("w", F.slice("all", F.col("i") * 6 + 1, 6))
    return rows.select(
        F.col("conv_id").alias("run_id"), (F.col("turn") * 1000 + F.col("i")).cast("int").alias("note_idx"), part(1, 3).alias("quote"), F.lit("").alias("before"), F.lit("").alias("after"), alts.alias("alternatives")
    )


def verify_citations(spark: SparkSession, sf: str) -> DataFrame:
    found = audit.checked_alternatives(_notes(spark, sf), run_sources(spark, sf))
    return found.select("run_id", "note_idx", "alt_idx", "found", F.col("kept.text").alias("text"), F.col("kept.verbatim").alias("verbatim"))


def rejected_citations(spark: SparkSession, sf: str) -> DataFrame:
    return audit.rejected_counts(_notes(spark, sf), run_sources(spark, sf))


def anchor_render(spark: SparkSession, sf: str) -> DataFrame:
    """Notes verified, placed and rendered over the whole text of each conversation."""
    sources = run_sources(spark, sf)
    texts = sources.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src_idx", "text"))), lambda s: s["text"]), "\n").alias("text"))
    notes = audit.verified_notes(audit.distinct_alternatives(_notes(spark, sf)), sources)
    found = audit.annotated(texts, notes)
    return found.select("run_id", "inline", "appended", F.length("text").alias("chars"), F.md5("plain").alias("plain"))


def audit_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies decoded, verified, rendered and folded into the outcome of their run."""
    sources = run_sources(spark, sf)
    texts = sources.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src_idx", "text"))), lambda s: s["text"]), "\n").alias("text"))
    listed = F.array_sort(F.collect_list(F.struct("note_idx", "quote", "before", "after", "alternatives")))
    bodies = _notes(spark, sf).groupBy("run_id").agg(F.to_json(F.struct(listed.alias("uncertain"))).alias("content"))
    broken = bodies.withColumn("content", F.when(F.col("run_id") % 9 == 0, F.concat("content", F.lit(" x"))).otherwise(F.col("content")))
    found = audit.audited(texts, replies.decoded(broken), sources)
    return found.select("run_id", "inline", "appended", "rejected", "error", F.length("text").alias("chars"))


def region_overlap(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    start = (F.col("l_suppkey") % 60).cast("int")
    notes = line.select(
        F.col("l_orderkey").alias("case"), F.col("l_linestatus").alias("model"), F.col("l_linenumber").alias("note_idx"),
        F.when(F.col("l_discount") < 0.09, start).alias("start"), (start + F.col("l_quantity").cast("int")).alias("stop"),
    ).distinct()
    kind = F.when(F.col("l_returnflag") == "A", "expected").when(F.col("l_returnflag") == "R", "optional").otherwise("forbidden")
    low = (F.col("l_partkey") % 70).cast("int")
    labelled = line.select(F.col("l_orderkey").alias("case"), kind.alias("class"), F.col("l_partkey").alias("region"), low.alias("start"), (low + 10).alias("stop"))
    found = evaluation.classified_notes(notes, labelled)
    return evaluation.region_recall(found, labelled)


def best_window(spark: SparkSession, sf: str) -> DataFrame:
    """Each whole user turn as a reading against the whole other turns of the conversation."""
    c = table(spark, sf, "conversations").withColumn("case", F.col("conv_id"))
    alternatives = c.filter("role = 'user'").select("case", F.col("turn").alias("alt_id"), "text")
    sources = c.filter("role <> 'user'").select("case", F.col("turn").cast("int").alias("src_idx"), "text")
    found = evaluation.best_windows(alternatives, sources)
    moved = evaluation.displaced(F.col("position"), F.col("share"), F.col("alt_id"), F.lit(10))
    return found.withColumn("displaced", moved)


def must_keep_score(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    cleaned = d.select(F.col("lang").alias("case"), F.col("source").alias("model"), F.col("doc_id").alias("repeat"), "text", F.floor(F.col("n_chars") / 6).alias("reference_words"))
    labels = d.select(F.col("lang").alias("case")).distinct().select(
        "case", F.array(F.lit("The "), F.lit("de"), F.lit("und")).alias("must_keep"), F.array(F.lit("###"), F.lit("token")).alias("must_not"),
        F.lit(None).cast("double").alias("min_ratio"), F.lit(1.2).alias("max_ratio"),
    )
    return evaluation.cleanup_scores(cleaned, labels)


def panel_summary(spark: SparkSession, sf: str) -> DataFrame:
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = d.join(labels, "doc_id", "left").select("lang", "source", F.col("quality").cast("double").alias("quality"))
    return evaluation.summary(rows, "quality", "lang", "source")


def recognition_scores(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("case"), F.col("role").alias("model"), "text")
    return evaluation.recognition_scores(c, c.select("case").distinct().withColumn("duration", (F.col("case") % 7 * 30).cast("double")))


def anchors_in_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up labels, all words of each turn by one and by three, in the whole texts of the conversation."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("case"), F.col("role").alias("model"), "text")
    w = F.split("text", " ")
    threes = F.transform(F.sequence(F.lit(0), ((F.size(w) - 1) / 3).cast("int")), lambda i: F.array_join(F.slice(w, (i * 3 + 1).cast("int"), 3), " "))
    anchors = c.select("case", F.explode(F.array_distinct(F.concat(w, threes))).alias("anchor"))
    return evaluation.anchors_in_all(c, anchors)


def invented_names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("lang").alias("case"), F.col("source").alias("model"), "text")
    known = d.select("case").distinct().withColumn("name", F.lit("the"))
    return evaluation.invented_names(d, known).groupBy("case", "model").agg(F.count("*").alias("names"), F.min("name").alias("first_name"))


def labelled_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Made-up labels, every two words of each turn, in its whole text."""
    c = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("case"), "text")
    w = F.split("text", " ")
    pairs = F.transform(F.sequence(F.lit(0), ((F.size(w) - 1) / 2).cast("int")), lambda i: F.array_join(F.slice(w, (i * 2 + 1).cast("int"), 2), " "))
    anchors = c.select("case", F.explode(pairs).alias("anchor"))
    return evaluation.spans_of(c, anchors).select("case", F.md5("anchor").alias("anchor"), "start", "stop")


QUERIES = [
    verify_citations, rejected_citations, anchor_render, audit_replies, region_overlap, best_window, must_keep_score, panel_summary, recognition_scores,
    anchors_in_repeats, invented_names, labelled_spans,
]

_FOLD = "replace(replace(lower(text), 'ß', 'ss'), 'ς', 'σ')"
_KEYS = rf"regexp_extract_all({_FOLD}, '[\p{{L}}\p{{M}}\p{{N}}]+(?:''[\p{{L}}\p{{M}}\p{{N}}]+)*')"
_ASCII = f"regexp_extract_all({_FOLD}, '[a-z0-9'']+')"
_CITED = f"""
t as (select conv_id, turn, {_KEYS} as w from conversations),
k as (select conv_id, ' ' || array_to_string(w, ' ') || ' ' as key from t where len(w) > 0),
r as (select conv_id, (turn * 1000 + i)::int as note, w[6 * i + 1:6 * i + 6] as w from t, unnest(range(0, (len(w) + 5) // 6)) u(i)),
a as (select conv_id, note, 0 as alt_idx, concat_ws(' ', w[2], w[4]) as text, array_to_string(w[2:5], ' ') as verbatim from r
    union all select conv_id, note, 1, concat_ws(' ', w[4], w[2]), array_to_string(w[2:5], ' ') from r
    union all select conv_id, note, 2, 'zzz yyy', 'xxx zzz' from r
    union all select conv_id, note, 3, array_to_string(w[1:3], ' '), 'xxx zzz' from r),
f as (select a.conv_id, note, alt_idx, text, verbatim, bool_or(verbatim <> '' and contains(key, ' ' || verbatim || ' ')) as v, bool_or(text <> '' and contains(key, ' ' || text || ' ')) as h
    from a join k using (conv_id) group by all)"""

SQL = {
    "verify_citations": f"""
with {_CITED}
select conv_id as run_id, note as note_idx, alt_idx, case when v then 'verbatim' when h then 'text' else 'none' end as found,
    case when v and text <> '' and not regexp_matches(' ' || verbatim || ' ', ' ' || replace(text, ' ', ' (.* )?') || ' ') then '' else text end as text,
    case when not v and h then '' else verbatim end as verbatim from f""",
    "rejected_citations": f"""
with {_CITED}
select conv_id as run_id, count(*) filter (not v and not h) as rejected from f group by 1""",
    "region_overlap": """
with l as (select *, (l_suppkey % 60)::int as s, (l_partkey % 70)::int as low from lineitem),
n as (select distinct l_orderkey as c, l_linestatus as model, l_linenumber as i, case when l_discount < 0.09 then s end as start, s + l_quantity::int as stop from l),
b as (select l_orderkey as c, l_returnflag as f, l_partkey as region, low as start, low + 10 as stop from l),
m as (select n.c, n.model, n.i, n.start, list_distinct(list(region) filter (f = 'A')) as regions, max((f = 'R')::int) as o, max((f = 'N')::int) as g
    from n left join b on n.c = b.c and n.start < b.stop and b.start < n.stop group by n.c, n.model, n.i, n.start),
v as (select *, case when start is null then 'unlocatable' when len(regions) > 0 then 'expected' when o = 1 then 'optional' when g = 1 then 'forbidden' else 'spurious' end as verdict from m),
t as (select l_orderkey as c, count(distinct l_partkey) as regions from l where l_returnflag = 'A' group by 1)
select v.c as "case", model, coalesce(len(list_distinct(flatten(list(v.regions) filter (v.regions is not null)))), 0)::int as hit, count(*) filter (verdict = 'spurious') as spurious,
    count(*) filter (verdict = 'forbidden') as forbidden, count(*) filter (verdict = 'unlocatable') as unlocatable, coalesce(max(t.regions), 0) as regions
from v left join t on v.c = t.c group by v.c, model""",
    "best_window": f"""
with c as (select conv_id, turn, role, text from conversations),
a as (select conv_id, turn, w, greatest(len(w), {evaluation.LEAST_WINDOW}) as n, list_distinct(w) as d from (
    select conv_id, turn, list_filter({_ASCII}, lambda v: v not in {evaluation.STOP_WORDS}) as w from c where role = 'user')),
s as (select conv_id, turn, {_ASCII} as w from c where role <> 'user'),
x as (select a.conv_id, a.turn as alt, s.turn::int as src_idx, i - 1 as start, len(s.w) as len, len(list_intersect(d, s.w[i:i + n - 1]))::double / len(d) as share
    from a join s using (conv_id), unnest(range(1, greatest(len(s.w) - n, 0) + 2)) u(i) where len(a.w) > 0),
b as (select *, row_number() over (partition by conv_id, alt order by share desc, src_idx, start) as r from x where share > 0)
select conv_id as "case", alt as alt_id, share, src_idx, start::int as start, start::double / greatest(len, 1) as position,
    share >= 0.5 and abs(start::double / greatest(len, 1) - alt / 10.0::double) > 0.25 as displaced from b where r = 1""",
    "must_keep_score": r"""
with d as (select *, len(regexp_extract_all(text, '\S+')) as w, lower(text) as low, len(regexp_extract_all(text, '\S+'))::double / greatest(floor(n_chars / 6.0), 1) as ratio from documents)
select lang as "case", source as model, doc_id as repeat, w::int as words, ratio, (contains(low, 'the ')::int + contains(low, 'de')::int + contains(low, 'und')::int) as kept,
    (contains(low, '###')::int + contains(low, 'token')::int) as bad, len(regexp_extract_all(text, '(?i)\b(?:um+|uh+|you know|i mean)\b'))::int as residue,
    ratio between 0.75 and 1.2 as in_band from d""",
    "panel_summary": """
with r as (select lang, source, quality::double as q from documents left join labels using (doc_id))
select lang, source, avg(q) as mean, case when min(q) <> max(q) then printf('%.2f [%.2f-%.2f]', avg(q), min(q), max(q)) else printf('%.2f', avg(q)) end as shown,
    count(q) as n, count(*) filter (q is null) as failed from r group by 1, 2""",
    "recognition_scores": rf"""
with w as (select conv_id, role, len(regexp_extract_all(text, '\S+')) as w, {_ASCII} as t from conversations),
g as (select *, list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i + 7], ' ')) as grams from w),
u as (select conv_id, role, w, case when len(t) < 8 then 1.0::double else len(list_distinct(grams))::double / len(grams) end as u from g),
s as (select conv_id, role, (sum(w) // count(*))::bigint as words, min(u) as uniq8, count(*) as n from u group by 1, 2)
select conv_id as "case", role as model, words, uniq8, n, words / greatest((conv_id % 7 * 30)::double / 60, 0.01::double) as wpm from s""",
    "anchors_in_repeats": f"""
with t as (select conv_id, role, ' ' || array_to_string({_ASCII}, ' ') || ' ' as key from conversations),
s as (select conv_id, string_split(text, ' ') as s from conversations),
a as (select conv_id, unnest(s) as anchor from s union select conv_id, array_to_string(s[3 * i + 1:3 * i + 3], ' ') from s, unnest(range(0, (len(s) + 2) // 3)) u(i)),
k as (select conv_id, anchor, array_to_string({_ASCII.replace("text", "anchor")}, ' ') as want from a),
e as (select t.conv_id, role, anchor, bool_and(want <> '' and contains(key, ' ' || want || ' ')) as every from t join k using (conv_id) group by 1, 2, 3)
select conv_id as "case", role as model, count(*) filter (every) as anchors_hit, count(*) as anchors from e group by 1, 2""",
    "invented_names": rf"""
with t as (select lang, source, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+') as k from documents),
names as (select distinct lang, source, lower(k[i]) as name from t, unnest(range(2, len(k) + 1)) u(i)
    where regexp_matches(k[i], '^[A-Z][a-z]{{2,}}$') and not regexp_matches(k[i - 1], '[.!?][ \t\n\x0b\f\r]$')),
rare as (select lang, name from names group by 1, 2 having count(distinct source) <= 1),
written as (select lang, name, count(distinct source) as writers, min(source) as only_one from (select lang, source, unnest({_ASCII}) as name from t) group by 1, 2),
kept as (select n.* from names n join rare using (lang, name) left join written w on w.lang = n.lang and w.name = n.name
    where n.name <> 'the' and (coalesce(w.writers, 0) = 0 or (w.writers = 1 and w.only_one = n.source)))
select lang as "case", source as model, count(*) as names, min(name) as first_name from kept group by 1, 2""",
    "labelled_spans": """
with s as (select conv_id || '/' || turn as c, text, string_split(text, ' ') as s from conversations),
a as (select c, text, array_to_string(s[2 * i + 1:2 * i + 2], ' ') as anchor from s, unnest(range(0, (len(s) + 1) // 2)) u(i))
select c as "case", md5(anchor) as anchor, (instr(text, anchor) - 1)::int as start, (instr(text, anchor) - 1 + length(anchor))::int as stop from a where trim(anchor) <> ''""",
}
