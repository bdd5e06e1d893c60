"""Phrases that stand in texts as runs of whole words.

Texts of a key that have at most ``WHOLE`` code points in all come to its phrases as one row, so each side is shuffled
once. Those of larger keys are spread by words and met by the phrases' rarest ones (``holding``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.storage import bounded_broadcast, settle

#: Code points of a key's texts that are kept in one row, and large keys that are broadcast.
WHOLE, LARGE_KEYS = 1 << 16, 200_000


def by_size(key: str, texts: DataFrame, *others: DataFrame) -> tuple[list[DataFrame], list[DataFrame] | None]:
    """``texts`` (key, text, ...) and ``others`` (key, ...), those of keys with few text first, then those of large keys, if any."""
    sizes = texts.groupBy(key).agg(F.sum(F.length("text")).alias("_n")).filter(F.col("_n") > WHOLE).select(key)
    large = settle(sizes, "large-keys")
    if large.isEmpty():
        return [texts, *others], None
    large = bounded_broadcast(large, LARGE_KEYS)
    return [d.join(large, key, "left_anti") for d in (texts, *others)], [d.join(large, key, "left_semi") for d in (texts, *others)]


def holding(phrases: DataFrame, texts: DataFrame, key: str, text_id: str) -> DataFrame:
    """Rows (key, text_id, phrase): the texts that hold a phrase of their key.

    ``phrases`` (key, phrase) are words joined by single spaces, ``texts`` (key, text_id, words) arrays of such words.
    A phrase meets the texts of its key only where they have its rarest word, which fixes the place; a phrase with a word
    that no text of the key has meets nothing. Places are gathered by text, and each text is compared once with all
    that met it. Empty phrases and null keys stand in no text.
    """
    wanted = phrases.select(key, "phrase").filter("phrase <> ''").distinct()
    words = wanted.select(key, "phrase", F.posexplode(F.split("phrase", " ")).alias("_offset", "_word"))
    places = texts.select(key, text_id, F.size("words").alias("_size"), F.posexplode("words").alias("_pos", "_word"))
    known = places.groupBy(key, "_word").count()
    rarest = (
        words.join(known, [key, "_word"])
        .groupBy(key, "phrase")
        .agg(F.min(F.struct("count", "_offset", "_word")).alias("_r"), F.count("*").alias("_found"))
        .select(key, "phrase", F.col("_r._offset").alias("_offset"), F.col("_r._word").alias("_word"), "_found", F.size(F.split("phrase", " ")).alias("_n"))
        .filter("_found = _n")
    )
    start = F.col("_pos") - F.col("_offset")
    met = places.join(rarest, [key, "_word"]).filter((start >= 0) & (start + F.col("_n") <= F.col("_size")))
    by_text = met.groupBy(key, text_id).agg(F.collect_set(F.struct(start.alias("at"), F.col("_n").alias("n"), "phrase")).alias("_met"))
    same = lambda m: F.array_join(F.slice("words", m["at"] + 1, m["n"]), " ") == m["phrase"]
    held = F.array_distinct(F.transform(F.filter("_met", same), lambda m: m["phrase"]))
    return texts.select(key, text_id, "words").join(by_text, [key, text_id]).select(key, text_id, F.explode(held).alias("phrase"))
