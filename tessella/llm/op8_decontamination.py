"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

Windows: every ``width`` consecutive words of a benchmark item, or the whole item if it is shorter. The shingles of the
join are single words, ordered by rarity: how often the documents hold them, ties by code point. To contain a window
exactly a document must contain each of its words, so one prefix token, the rarest, is necessary and enough: the
document's words are joined with the windows' prefix tokens. A meeting fixes the alignment; the positional bound (the window
must start and end within the text) and the length bound (no shorter document) come first, then the slice of the
window's size is compared by hash and, of what is left, word by word.

Scale: prefix tokens (a word, its offset, a key) are counted; up to ``MOST_BROADCAST`` they are broadcast and meet the words of
documents within the scan, so only matches are shuffled. (The comparison there has generated code; a lambda in it would make
Spark copy the text for each word. Words are lower-cased one by one, since translating a whole text is slow.) Beyond that the places of words are shuffled, without the
texts, and the bounds are applied before they meet their texts again. Occurrences are merged as intervals, never
expanded into words.

Edge cases: a null or wordless text has 0 words and 0 hits and is clean; null or wordless items have no windows. Equal
windows of several items count for each of them; null item ids are left out of the list. Repeated document
rows each get a row; ids may be null (rows are told apart by id and text). Empty tables give an empty result or
no hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import ascii_lower, settle, table

#: Rows of words or prefix tokens up to which they are broadcast.
MOST_BROADCAST = 200_000
#: What stands between words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words as they are written; an empty array for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """``ascii_lower`` of a word; the costly way only where the word has other than ASCII characters."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(ascii_lower(word))


def windows_of(benchmark: DataFrame, width: int) -> DataFrame:
    """Distinct rows (item_id, length, window): the windows of each item, lower-cased words joined by spaces."""
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    window = lambda i: ascii_lower(F.array_join(F.slice("words", i, width), " "))
    return (
        benchmark.select("item_id", words_of(F.col("text")).alias("words"))
        .filter(n > 0)
        .select("item_id", F.least(n, F.lit(width)).alias("length"), F.explode(F.transform(starts, window)).alias("window"))
        .distinct()
    )


def occurrences(docs: DataFrame, windows: DataFrame, most_broadcast: int = MOST_BROADCAST) -> tuple[DataFrame, DataFrame]:
    """Every document row as (doc_id, text_key, n_words), and verified rows (doc_id, text_key, start, stop, window).

    Words start to stop - 1 of the document are this window. ``windows`` has rows (window, length), each once.
    """
    words = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
    windows = settle(windows.withColumn("window_key", F.xxhash64("window")), "windows")
    vocabulary = settle(windows.select(F.explode(F.split("window", " ")).alias("word")).distinct(), "vocabulary")
    tokens = words.select(F.explode("words").alias("word")).select(lowered(F.col("word")).alias("word"))
    if vocabulary.count() <= most_broadcast:
        seen = F.broadcast(tokens.join(F.broadcast(vocabulary), "word").groupBy("word").count())
    else:
        seen = tokens.groupBy("word").count().join(vocabulary, "word")
    # A window with a word that no document holds cannot occur and drops out here.
    ranked = (
        windows.select("window_key", "length", F.posexplode(F.split("window", " ")).alias("offset", "word"))
        .join(seen, "word")
        .groupBy("window_key", "length")
        .agg(F.count("*").alias("found"), F.min(F.struct("count", "word", "offset")).alias("rarest"))
        .filter(F.col("found") == F.col("length"))
        .select(F.col("rarest.word").alias("word"), F.col("rarest.offset").alias("offset"), "length", "window_key")
    )
    prefixes = settle(ranked, "prefix-tokens")
    start = F.col("pos") - F.col("offset")
    n_words = F.size("words").cast("long").alias("n_words")
    # Spark may evaluate the slice before the bounds, so its start is made valid.
    piece = ascii_lower(F.array_join(F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("length")), " "))
    same = F.xxhash64(piece) == F.col("window_key")
    columns = ["doc_id", "text_key", n_words, start.alias("start"), (start + F.col("length")).alias("stop"), "window_key", piece.alias("piece")]
    if prefixes.count() <= most_broadcast:
        # One more word, the empty one, ends each text; its row brings the number of words from the same scan.
        # A range makes it without Python workers, as a list of rows would start on every executor.
        none = F.lit(None).cast("long")
        end = docs.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(0).alias("offset"), F.lit(0).alias("length"), none.alias("window_key"))
        placed = words.select("*", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "raw"))
        inside = (start >= 0) & (start + F.col("length") <= F.size("words"))
        met = (
            placed.withColumn("word", lowered(F.col("raw")))
            .join(F.broadcast(prefixes.union(end)), "word")
            .filter(F.col("window_key").isNull() | (inside & same))
            .select(*columns)
        )
        met = settle(met, "meetings")
        base = met.filter("window_key is null").select("doc_id", "text_key", "n_words")
        met = met.filter("window_key is not null")
    else:
        base = words.select("doc_id", "text_key", n_words)
        # The words of a text stay where they are; places alone are shuffled and then brought to their texts.
        places = words.select("doc_id", "text_key", F.size("words").alias("size"), F.posexplode("words").alias("pos", "raw"))
        places = places.withColumn("word", lowered(F.col("raw"))).join(prefixes, "word")
        places = places.filter((start >= 0) & (start + F.col("length") <= F.col("size"))).drop("size", "word", "raw")
        places = places.withColumnsRenamed({"doc_id": "place_id", "text_key": "place_key"}).distinct()
        of = F.col("doc_id").eqNullSafe(F.col("place_id")) & (F.col("text_key") == F.col("place_key"))
        met = places.join(words, of).filter(same).select(*columns)
    # The keys have met; now the words themselves.
    found = met.join(windows, "window_key").filter(F.col("piece") == F.col("window"))
    return base, found.select("doc_id", "text_key", "start", "stop", "window")


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted) and contaminated (n_hit of at least 1/share of the words)."""
    windows = settle(windows_of(benchmark, width), "item-windows")
    base, found = occurrences(docs, windows.select("window", "length").distinct(), most_broadcast)
    found = settle(found.distinct(), "occurrences")
    reach = Window.partitionBy("doc_id", "text_key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc_id", "text_key", "start", "stop").distinct()
    hits = (
        spans.withColumn("from", F.greatest("start", F.coalesce(F.max("stop").over(reach), F.lit(0))))
        .groupBy("doc_id", "text_key")
        .agg(F.sum(F.greatest(F.col("stop") - F.col("from"), F.lit(0))).alias("n_hit"))
    )
    # The items of a window are rows, so one that very many items share is never a list.
    owners = windows.filter("item_id is not null").select("window", F.col("item_id").cast("string").alias("item"))
    items = (
        found.select("doc_id", "text_key", "window").distinct().join(owners, "window")
        .select("doc_id", "text_key", "item").distinct()
        .groupBy("doc_id", "text_key")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    hit = hits.join(items.withColumnsRenamed({"doc_id": "i", "text_key": "k"}), F.col("doc_id").eqNullSafe(F.col("i")) & F.col("text_key").eqNullSafe(F.col("k")), "left").select(
        F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "n_hit", "items"
    )
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    of = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left").select(
        "doc_id", "text_key", "n_words", n_hit.alias("n_hit"), of.alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP8_SQL = f"""
with items as (
    select item_id, {_WORDS} as words from benchmark
), windows as (
    select distinct item_id, array_to_string(words[i:i + 12], ' ') as window, least(len(words), 13) as n
    from items, unnest(range(1, greatest(len(words) - 12, 1) + 1)) u(i) where len(words) > 0
), texts as (
    select doc_id, row_number() over () as row_id, {_WORDS} as words from documents
), sizes as (
    select distinct n from windows
), places as (
    select row_id, i, z.n, array_to_string(words[i:i + z.n - 1], ' ') as window
    from texts, sizes z, unnest(range(1, len(words) - z.n + 2)) u(i) where len(words) >= z.n
), found as (
    select p.row_id, p.i, p.n, w.item_id from places p join windows w on p.window = w.window
), hit as (
    select row_id, count(distinct k) as n_hit from found, unnest(range(i, i + n)) u(k) group by row_id
), named as (
    select row_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids
    from found group by row_id
)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(words) as contaminated
from texts left join hit using (row_id) left join named using (row_id)
"""
