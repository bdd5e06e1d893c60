"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame operations alone.

Targets: all sources, ordered by code point with null last, share the words of the corpus by repeating weights; a target
stops at ``cap`` times its source and the excess is reshared by weight, which is the water level computed in
``source_targets``.

Schedule: every source's documents are shuffled by a hash of their id and laid on one line of words, up to ``cap`` times over
and cut at the target; the line is cut into blocks of ``block_words`` words. Slot k gets the golden-ratio point
``frac(k * phi)``, taken in 48-bit integers; the cumulative numbers of blocks map the point to a source; slots are ranked
within their source, and block j of a source goes to the source's slot of rank j. What a document is taken for are the
words of its pieces in blocks that a slot claims. Slots are dealt until every source has as many as it has blocks; a
point in a source that has all its blocks deals nothing. Since the points are spread evenly over each interval, about as
many slots as blocks are needed, for a source of one block at most a few times as many.

Scale: nothing is ranked or summed within a source alone. Lines and ranks are numbered in buckets of the ids' hashes or
chunks of ``SLOT_CHUNK`` slots, whose totals are then summed up, so a source with a third of all rows is no hot task. Rows
of one source, id and size are interchangeable: they are counted before the line is laid and numbered on it, so one id
(or null) in very many rows is a row for each of its sizes. The table of sources is broadcast only if it is counted to be small.

Edge cases: a null or wordless text has size 0 and is never taken; null sources form one source. Null ids, repeated rows
and clashing column names are fine: the id, source and text are taken by name and each row is kept apart by its place
on the line. Nothing depends on files or partitions, so reruns agree. If all sizes are zero, so are all targets. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, settle, table

#: Hexadecimal digits of an id's hash that name its bucket.
BUCKET_DIGITS = 3
#: Interchangeable rows that one task writes out.
COPIES = 1 << 16
SLOT_CHUNK = 16384
#: The fractional part of the golden ratio in 48 bits: an odd number, so that 2**48 slots visit all points once.
GOLDEN_HIGH, GOLDEN_LOW = divmod(173961102589771, 1 << 24)
CELLS = 1024


def word_count(text):
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...], cap: int, block_words: int) -> DataFrame:
    """One row per source: rank, source, source_size, target (double), quota (words), and its blocks, lo to hi - 1 of all.

    The level L solves sum(min(cap * size, L * weight)) = sum(size). With sources ordered by cap * size / weight those
    before some place are capped; L is the greatest level that leaves the source at its place below its cap.
    """
    one = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source, not per document
    by_ratio = Window.orderBy("ratio", "rank")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("rank", F.row_number().over(one) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("rank") % len(weights) + 1).cast("long"))
        .withColumn("limit", F.col("source_size") * cap)
        .withColumn("ratio", F.col("limit").cast("double") / F.col("weight"))
    )
    before = F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(every) - before).cast("double") / left
    return (
        sources.withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every))
        .withColumn("target", F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("quota", F.floor("target").cast("long"))
        .withColumn("blocks", F.ceil(F.col("quota") / block_words))
        .withColumn("hi", F.sum("blocks").over(one.rowsBetween(Window.unboundedPreceding, 0)))
        .select("rank", "source", "source_size", "target", "quota", (F.col("hi") - F.col("blocks")).alias("lo"), "hi")
    )


def point(k: Column) -> Column:
    """The point of slot k as an integer below 2**48; no product leaves 64 bits."""
    k = k.bitwiseAND((1 << 48) - 1)
    high, low = F.shiftright(k, 24), k.bitwiseAND((1 << 24) - 1)
    return ((high * GOLDEN_LOW + low * GOLDEN_HIGH) % (1 << 24) * (1 << 24) + low * GOLDEN_LOW) % (1 << 48)


def slots(spark: SparkSession, targets: DataFrame, total: int, count: int) -> DataFrame:
    """Rows (slot, rank, j): of the slots 0 to ``count`` those that get a block, with their source and its block j."""
    at = (point(F.col("slot")).cast("double") / F.lit(float(1 << 48)) * total).alias("at")
    width = total / CELLS
    cell = F.floor(F.col("at") / width).cast("int")
    parts = targets.filter("lo < hi").select(
        "rank", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") / width).cast("int"), F.floor(F.col("hi") / width).cast("int"))).alias("cell"),
    )
    dealt = (
        spark.range(count)
        .withColumnRenamed("id", "slot")
        .select("slot", at)
        .withColumn("cell", cell)
        .join(bounded_broadcast(parts, 100_000), "cell")
        .filter("at >= lo and at < hi")
        .select("slot", "rank", (F.col("hi") - F.col("lo")).alias("blocks"), F.expr(f"slot div {SLOT_CHUNK}").alias("chunk"))
    )
    before = Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("rank", "chunk").count().select("rank", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("slot")) - 1
    placed = dealt.withColumn("place", place).join(offsets, ["rank", "chunk"]).withColumn("j", F.col("offset") + F.col("place"))
    return placed.filter("j < blocks").select("slot", "rank", "j")


def schedule(spark: SparkSession, targets: DataFrame, total: int) -> DataFrame:
    """The slots of all ``total`` blocks: twice as many slots are dealt until each block has one."""
    count = 2 * total
    while True:
        dealt = settle(slots(spark, targets, total, count), "mix-schedule")
        if dealt.count() == total:
            return dealt
        count *= 2


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 256,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """The mix: a row per piece of a document in a block, with slot (null: the document is not taken) and words.

    Columns: doc_id, source, size, source_size, target, row (rank, bucket, place, copy: the document's row), slot, words, begins
    (whether the document, or a repeat of it, begins with the piece).
    """
    spark = docs.sparkSession
    sized = settle(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")),
        "mix-sizes",
    )
    targets = settle(source_targets(sized, weights, cap, block_words), "mix-targets")
    total = targets.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]
    ranks = bounded_broadcast(targets.select(F.col("source").alias("of"), "rank"), 10_000)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    equal = (
        sized.join(ranks, F.col("source").eqNullSafe(F.col("of")))
        .groupBy("rank", "doc_id", "size")
        .agg(F.count("*").alias("n"))
        .withColumns({"key": key, "bucket": F.conv(F.substring(key, 1, BUCKET_DIGITS), 16, 10).cast("int"), "length": F.col("n") * F.col("size")})
    )
    before = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        equal.groupBy("rank", "bucket")
        .agg(F.sum("length").alias("whole"))
        .select("rank", "bucket", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("offset"))
    )
    within = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size")
    line = (
        equal.withColumn("place", F.row_number().over(within))
        .withColumn("run", F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, ["rank", "bucket"])
        .select("rank", "bucket", "place", "doc_id", "size", "n", (F.col("offset") + F.col("run") - F.col("length")).alias("base"))
    )
    line = settle(line, "mix-line")
    one = F.lit(0).cast("long")
    chunks = line.filter(F.col("n") > COPIES).withColumn("chunk", F.explode(F.sequence(one, F.expr(f"(n - 1) div {COPIES}"))))
    chunks = chunks.repartition("rank", "bucket", "place", "chunk").union(line.filter(F.col("n") <= COPIES).withColumn("chunk", one))
    last = F.least(F.col("n"), (F.col("chunk") + 1) * COPIES) - 1
    known = chunks.withColumn("copy", F.explode(F.sequence(F.col("chunk") * COPIES, last))).join(bounded_broadcast(targets, 10_000), "rank")
    known = known.withColumn("start", F.col("base") + F.col("copy") * F.col("size"))
    size, start = F.col("size"), F.col("start")
    lo = lambda p: start + p * F.col("source_size")
    hi = lambda p: F.least(lo(p) + size, F.col("quota"))
    passes = F.filter(F.sequence(F.lit(0), F.lit(cap - 1)), lambda p: (size > 0) & (lo(p) < F.col("quota")))
    cut = lambda p: F.transform(
        F.sequence(F.floor(lo(p) / block_words), F.floor((hi(p) - 1) / block_words)),
        lambda j: F.struct(
            j.cast("long").alias("j"),
            (F.least(hi(p), (j + 1) * block_words) - F.greatest(lo(p), j * block_words)).cast("long").alias("words"),
            (j == F.floor(lo(p) / block_words)).alias("begins"),
        ),
    )
    pieces = (
        known.withColumn("piece", F.explode_outer(F.flatten(F.transform(passes, cut))))
        .select(
            "doc_id", "source", "size", "source_size", "target", "rank",
            F.struct("rank", "bucket", "place", "copy").alias("row"), F.col("piece.j").alias("j"), F.col("piece.words").alias("words"),
            F.coalesce("piece.begins", F.lit(False)).alias("begins"),
        )
    )
    plan = schedule(spark, targets, total) if total else spark.createDataFrame([], "slot long, rank int, j long")
    return pieces.join(plan, ["rank", "j"], "left").select(
        "doc_id", "source", "size", "source_size", "target", "row", "slot", "words", (F.col("begins") & F.col("slot").isNotNull()).alias("begins")
    )


def taken_words(mixed: DataFrame) -> DataFrame:
    """One row per document row: the words of it in blocks that a slot claims, and the first of these slots."""
    return (
        mixed.groupBy("row", "doc_id", "source", "size", "source_size", "target")
        .agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), F.col("words"))), F.lit(0)).alias("taken"), F.min("slot").alias("first_slot"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "first_slot")
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = taken_words(mix(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


OP3_SQL = rf"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents
), sources as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank
    from sized group by source
), weighted as (
    select *, [5, 2, 1][(rank % 3 + 1)::int]::bigint as weight, source_size * 3 as cap,
        (source_size * 3)::double / [5, 2, 1][(rank % 3 + 1)::int] as ratio
    from sources
), levels as (
    select *, ((sum(source_size) over ())
        - coalesce(sum(cap) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0))::double
        / (sum(weight) over (order by ratio, rank rows between current row and unbounded following))::double as own_level
    from weighted
), leveled as (
    select *, max(case when own_level <= ratio then own_level end) over () as level from levels
), targets as (
    select *, least(cap::double, level * weight) as target, floor(least(cap::double, level * weight))::bigint as quota
    from leveled
), bounds as (
    select *, ceil(quota / 256)::bigint as own, (sum(ceil(quota / 256)) over (order by rank rows between unbounded preceding and current row))::bigint as hi,
        (sum(ceil(quota / 256)) over ())::bigint as total
    from targets
), line as (
    select s.doc_id, s.size, b.*,
        (sum(s.size) over (partition by b.rank order by md5(coalesce(s.doc_id::varchar, '')), s.doc_id, s.size
            rows between unbounded preceding and current row) - s.size)::bigint as start_at
    from sized s join bounds b on s.source is not distinct from b.source
), passes as (
    select l.*, p, start_at + p * source_size as a, least(start_at + p * source_size + size, quota) as z
    from line l left join range(3) r(p) on size > 0 and start_at + p * source_size < quota
), pieces as (
    select q.*, j, least(z, (j + 1) * 256) - greatest(a, j * 256) as words
    from (select *, case when p is null then [null::bigint] else range(a // 256, (z - 1) // 256 + 1) end as js from passes) q,
        unnest(js) u(j)
), points as (
    select k, ((((k >> 24) * {GOLDEN_LOW} + (k & 16777215) * {GOLDEN_HIGH}) % 16777216 * 16777216 + (k & 16777215) * {GOLDEN_LOW}) % 281474976710656)::double
        / 281474976710656.0::double * total::double as point
    from (select max(total) as total from bounds) t, range(t.total * 16) r(k)
), dealt as (
    select * from (select k, rank, own, row_number() over (partition by rank order by k) - 1 as j
        from points join bounds on own > 0 and point >= hi - own and point < hi) where j < own
)
select q.doc_id, q.size, q.source_size, q.target, coalesce(sum(q.words) filter (d.k is not null), 0)::bigint as taken, min(d.k)::bigint as first_slot
from pieces q left join dealt d on d.rank = q.rank and d.j = q.j
group by q.rank, q.start_at, q.doc_id, q.size, q.source_size, q.target
"""
