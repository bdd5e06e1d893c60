"""A corpus pipeline of five of the training-data operators, each stage on all that the one before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rows are kept apart by their id and a hash of all their columns, and stand in one struct column while a stage works beside
them: columns of any name, null ids, null texts, ties and empty tables are fine. Rows equal in every column are
interchangeable; the near-duplicate stage keeps one of them.

Texts move only where a stage reorders them (the mix); the others take rows away by an anti join with the rows that go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import near_copies, op2_sharding, op3_mixing, op6_langid, op8_decontamination
from tessella.llm.common import bounded_broadcast, scratch, settle, small_batches, table

#: Rows of a list up to which it is broadcast; beyond that rows and list are shuffled by their key.
BROADCAST = 2_000_000


def _row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])


def _held(docs: DataFrame) -> DataFrame:
    """Columns row (all of ``docs`` in a struct), row_id and row_key."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"), _row_key(docs).alias("row_key"))


def _without(held: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``held`` that aren't in ``gone`` (row_id, row_key)."""
    gone = bounded_broadcast(settle(gone.toDF("gone_id", "gone_key"), "gone"), BROADCAST)
    return held.join(gone, F.col("row_id").eqNullSafe(F.col("gone_id")) & (F.col("row_key") == F.col("gone_key")), "left_anti")


def _once(held: DataFrame) -> DataFrame:
    """Rows that are equal in every column once; only these are shuffled, and at most one of each from a task."""
    again = settle(held.groupBy("row_id", "row_key").count().filter("count > 1").select("row_id", "row_key"), "repeated-rows")
    if again.isEmpty():
        return held
    of = bounded_broadcast(again.toDF("again_id", "again_key"), BROADCAST)
    same = F.col("row_id").eqNullSafe(F.col("again_id")) & (F.col("row_key") == F.col("again_key"))
    one = held.join(of, same, "left_semi").groupBy("row_id", "row_key").agg(F.first("row").alias("row"))
    return _without(held, again).union(one.select("row", "row_id", "row_key"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``: null, empty or without letters) go; all stay if nothing is labelled."""
    model = op6_langid.fit(docs.filter(~op6_langid.held_out(F.col("doc_id"))).select("text", "lang"))
    if not model.langs:
        return docs
    # Only keys go along with the texts to Python and back.
    keyed = docs.select(F.col("doc_id").alias("row_id"), _row_key(docs).alias("row_key"), "text")
    found = op6_langid.identify(keyed, model).filter("lang_pred = 'und'").select("row_id", "row_key").distinct()
    with small_batches(spark):
        return _without(_held(docs), found).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays (null ids last, ties by the row's hash); equal rows stay once.

    Linked are texts with a Jaccard similarity of 0.8 or more of their five-word shingles: the stage's own rule, wider than
    the fingerprints within two bits of op5's query.
    """
    key = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("row_id"), _row_key(docs).alias("row_key"))
    found = near_copies.near_copies(docs.select(key.alias("id"), "text"), "id")
    gone = found.filter("doc_id <> component_id").select("doc_id.row_id", "doc_id.row_key").distinct()
    return _once(_without(_held(docs), gone)).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark passages go."""
    keyed = docs.select(F.struct(F.col("doc_id").alias("row_id"), _row_key(docs).alias("row_key")).alias("doc_id"), "text")
    found = op8_decontamination.contamination(keyed, table(spark, sf_dir, "benchmark")).filter("contaminated")
    return _without(_held(docs), found.select("doc_id.row_id", "doc_id.row_key").distinct()).select("row.*")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix begins it (up to three times, not at all beyond its source's target), in the order
    of the slots that begin it: files follow the schedule, and rows stand in its order within a file."""
    keyed = docs.select(F.struct(F.col("doc_id").alias("row_id"), _row_key(docs).alias("row_key")).alias("key"), "source", "text")
    begun = op3_mixing.mix(keyed, id_col="key").filter("begins")
    # Equal rows are interchangeable: one of them is brought to all the slots of its kind.
    begun = settle(begun.select("doc_id.row_id", "doc_id.row_key", "slot"), "mix-slots").toDF("slot_id", "slot_key", "slot")
    same = F.col("row_id").eqNullSafe(F.col("slot_id")) & (F.col("row_key") == F.col("slot_key"))
    # Both sides have a row for each document, so neither is broadcast at any size.
    rows = _once(_held(docs)).join(begun.hint("merge"), same)
    last = begun.agg(F.max("slot")).first()[0]
    if last is None:
        return docs.limit(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.col("slot") * parts / (last + 1)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("slot").select("row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of the mix."""
    return op2_sharding.shard_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_to_targets),
    ("sharding", shard),
]
#: Automata, fingerprints and the heap have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again; what is no longer needed is removed."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES[:-2]:
            with scratch(spark):
                docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
        name, stage = STAGES[-2]
        docs = settle(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
