"""Importance resampling towards a target: documents are drawn by how much their words resemble the benchmark's.

Features are the runs of 1 to ``max_run`` words of a text (A-Z lowered), hashed into ``buckets`` buckets. The counts of
documents by buckets form a sparse matrix that is kept in the shared folder as blocks in CSR form: a row of the stored
table holds up to ``BLOCK_ROWS`` documents and about ``BLOCK_CELLS`` cells, as row pointers, bucket numbers and counts. Column sums
of the blocks give the two distributions, the gain of a bucket follows from them, and the product of the matrix with the
gains gives every document's weight without another look at its text. Gumbel noise from a hash of the id turns the greatest
scores into a draw without replacement.

Scale: blocks are made, summed and multiplied where they lie; a block is bounded by its cells, a document has at most one cell a
bucket. Readers and workers hold one block at a time, however many a file or a task has (``ONE_ROW``, ``WIDE_ROWS``). Column sums are added up within a task before they are shuffled. Only the gains, one integer a bucket, pass
through the driver: their number is the parameter ``buckets``. Ranks come from a range shuffle of the drawn rows (and those
tied with the last), numbered within ranges whose counts are added up; no window spans all rows.

Edge cases: a null or wordless text has no features, weight 0 and is never drawn (fewer than ``least_words`` words). Without a
benchmark, or with an empty one, the target is the smoothed uniform distribution. A null id hashes as an empty one and comes last among
ties. Repeated rows each get a row and a rank; rows equal in everything are interchangeable. Empty tables give an
empty result. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import ONE_ROW, WIDE_ROWS, settle, small_batches, table

#: A block ends with the document that reaches one of these.
BLOCK_ROWS, BLOCK_CELLS = 4096, 1 << 18
#: Distinct features whose buckets a worker remembers.
KNOWN = 500_000
#: Words of a text as UTF-8 bytes after lower-casing: all bytes of other than ASCII characters belong to words.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
CSR = "block string, doc_ids array<{0}>, n_words array<long>, indptr array<int>, indices array<int>, counts array<int>"


class Buckets(dict):
    """Features to buckets; only so many are remembered."""

    def __init__(self, buckets: int) -> None:
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        found = zlib.crc32(feature) % self.buckets
        if len(self) < KNOWN:
            self[feature] = found
        return found


def row_of(text: bytes | None, max_run: int, known: Buckets) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, ascending buckets and their counts of one text."""
    words = WORD.findall((text or b"").lower())
    features = Counter(words)
    for n in range(2, max_run + 1):
        features.update(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    if not features:
        return 0, np.empty(0, np.int32), np.empty(0, np.int32)
    where = np.fromiter(map(known.__getitem__, features), np.int64, len(features))
    indices, at = np.unique(where, return_inverse=True)
    counts = np.zeros(len(indices), np.int64)
    np.add.at(counts, at, np.fromiter(features.values(), np.int64, len(features)))
    return len(words), indices.astype(np.int32), counts.astype(np.int32)


def csr_blocks(docs: DataFrame, id_col: str, text_col: str, buckets: int, max_run: int, name: str) -> DataFrame:
    """The count matrix of ``docs`` as stored CSR blocks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        ids, sizes, pointers, indices, counts = [], [], [0], [], []
        made = 0

        def block() -> pa.RecordBatch:
            listed = lambda values, of: pa.array([values], pa.list_(of))
            cells = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int32)
            columns = [
                pa.array([f"{made}"]), listed(ids, id_type), listed(sizes, pa.int64()), listed(pointers, pa.int32()),
                listed(cells(indices), pa.int32()), listed(cells(counts), pa.int32()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "n_words", "indptr", "indices", "counts"])

        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                n, where, often = row_of(text.as_py(), max_run, known)
                ids.append(doc_id)
                sizes.append(n)
                pointers.append(pointers[-1] + len(where))
                indices.append(where)
                counts.append(often)
                if len(ids) == BLOCK_ROWS or pointers[-1] >= BLOCK_CELLS:
                    yield block()
                    made += 1
                    ids, sizes, pointers, indices, counts = [], [], [0], [], []
        if ids:
            yield block()

    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        return settle(read.mapInArrow(blocks, CSR.format(kind)), name, options=WIDE_ROWS)


def column_sums(blocks: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, n) of the buckets that the matrix uses."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("indices").flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(np.int64))
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return blocks.select("indices", "counts").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(spark: SparkSession, corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket from the column sums of the two matrices, smoothed by one count a bucket."""
    s, t = column_sums(corpus, buckets).withColumnRenamed("n", "s"), column_sums(target, buckets).withColumnRenamed("n", "t")
    both = s.join(t, "bucket", "full").na.fill(0, ["s", "t"])
    sums = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").na.fill(0, ["s", "t"])
    found = np.zeros((buckets, 2))
    for row in sums.collect():  # one row a bucket
        found[row.bucket] = row.s, row.t
    whole = found.sum(axis=0)
    ratio = (found[:, 1] + 1) * (whole[0] + buckets) / ((found[:, 0] + 1) * (whole[1] + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(blocks: DataFrame, gains: np.ndarray, id_type: str) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): the matrix times the gains, over the row's features."""

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = {name: batch.column(name)[i].values for name in batch.schema.names}
                counts = part["counts"].to_numpy().astype(np.int64)
                cells = np.stack([counts * gains[part["indices"].to_numpy()], counts])
                before = np.concatenate([np.zeros((2, 1), np.int64), cells.cumsum(axis=1)], axis=1)
                pointers = part["indptr"].to_numpy()
                gain, n = before[:, pointers[1:]] - before[:, pointers[:-1]]
                weight = np.floor_divide(gain, np.maximum(n, 1))
                yield pa.RecordBatch.from_arrays([part["doc_ids"], part["n_words"], pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.select("doc_ids", "n_words", "indptr", "indices", "counts").mapInArrow(product, f"doc_id {id_type}, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, share: float, least_words: int) -> DataFrame:
    """``scored`` with a rank from 1 for the ``share`` per cent of the eligible rows with the highest scores."""
    spark = scored.sparkSession
    fit = F.col("n_words") >= least_words
    # Scores are whole thousandths of a logarithm: their number is bounded by the logarithm of counts, not by the rows.
    counts = settle(scored.filter(fit).groupBy("score").count(), "scores")
    most = (counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0] * share) // 100
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("above", F.coalesce(F.sum("count").over(above), F.lit(0))).filter(F.col("above") < most).agg(F.min("score")).first()[0]
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    chosen = F.coalesce(fit & (F.col("score") >= last), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("n_features"), F.asc("salt")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows equal up to the salt stand in any order; it lets the ranges split them.
    spread = scored.filter(chosen).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order)
    drawn = settle(spread.withColumn("range", F.spark_partition_id()), "drawn")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = drawn.groupBy("range").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    rank = F.col("offset") + F.col("within")
    numbered = drawn.withColumn("within", within).join(F.broadcast(offsets), "range")  # one row a range
    numbered = numbered.withColumn("rank", F.when(rank <= most, rank)).select(*scored.columns, "rank")
    return numbered.union(scored.filter(~chosen).withColumn("rank", F.lit(None).cast("long")))


def resampled(
    docs: DataFrame, target: DataFrame, buckets: int = 10_000, max_run: int = 1, share: float = 10, least_words: int = 20, seed: int = 2024,
    id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_features, weight, score and rank (NULL: not drawn)."""
    corpus = csr_blocks(docs, id_col, text_col, buckets, max_run, "csr-corpus")
    wanted = csr_blocks(target, target_id, target_text, buckets, max_run, "csr-target")
    with small_batches(docs.sparkSession, ONE_ROW):
        gains = bucket_gains(docs.sparkSession, corpus, wanted, buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = weighted(corpus, gains, docs.schema[id_col].dataType.simpleString()).withColumn("score", F.col("weight") + noise)
    with small_batches(docs.sparkSession, ONE_ROW):
        scored = settle(scored, "scored")
    return ranked(scored, share, least_words)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
_BIT = lambda c: f"(case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end)"
OP11_SQL = rf"""
with recursive bits as (
    select i, 0 as step, i::bigint as c from range(256) r(i)
    union all select i, step + 1, {_BIT("c")} from bits where step < 8
), steps as (
    select list(c order by i) as t from bits where step = 8
), texts as (
    select row_number() over () as row_id, doc_id, {_WORDS} as words from documents
), items as (
    select {_WORDS} as words from benchmark
), words as (
    select row_id, word, count(*) as n from texts, unnest(words) u(word) group by all
), wanted as (
    select word, count(*) as n from items, unnest(words) u(word) group by all
), coded as (
    select word, hex(encode(word)) as code from (select word from words union select word from wanted)
), hashed as (
    select word, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(code), 2), lambda k:
        (instr('0123456789ABCDEF', code[k]) - 1) * 16 + instr('0123456789ABCDEF', code[k + 1]) - 1)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]))) % 10000 as bucket
    from coded, steps
), s as (
    select bucket, sum(n)::double as s from words join hashed using (word) group by 1
), t as (
    select bucket, sum(n)::double as t from wanted join hashed using (word) group by 1
), sums as (
    select coalesce((select sum(s) from s), 0) as ss, coalesce((select sum(t) from t), 0) as tt
), gains as (
    select bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::bigint as gain from s left join t using (bucket), sums
), gained as (
    select row_id, sum(n)::bigint as n, sum(n * gain)::bigint as g from words join hashed using (word) join gains using (bucket) group by 1
), scored as (
    select doc_id, coalesce(n, 0) as n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::bigint as weight,
        list_reduce(list_prepend(0::bigint, list_transform(range(1, 9), lambda k: instr('0123456789abcdef', sha256('2024:' || doc_id)[k]) - 1)), lambda a, b: a * 16 + b) as h
    from texts left join gained using (row_id)
), noisy as (
    select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from scored
), placed as (
    select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from noisy
)
select doc_id, n_features::bigint as n_features, weight, score, case when n_features >= 20 and place <= (10 * n) // 100 then place end as rank from placed
"""
