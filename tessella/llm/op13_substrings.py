"""Removal of passages that an earlier document has as well, found by fixed-block anchors.

A window is ``WIDTH`` consecutive words. A word goes if a window covers it whose word sequence also starts in a document
with a smaller id. Texts are cut into non-overlapping reference blocks of ``BLOCK`` words; whatever window one text has of
another holds a whole block of that other text, so every repeat shows as a rolling run of ``BLOCK`` words that meets a
reference block. Method:

1. Filter. A rolling run is only sent to the index if its least ``GRAM``-word gram stands in another text too: equal runs
   have equal least grams, so nothing is lost, and one gram in about seven words travels instead of every run.
2. Anchors. The reference blocks of the texts that are left form the index, and their rolling runs probe it: a hit is a
   run that equals a block of another text (and the block itself).
3. Extension. Every hit is extended to both sides by as many words as a window can reach: the windows around hits meet by
   a 128-bit hash, the smallest id that has one is its first owner, and the windows of later documents merge into maximal
   exact repeats. Extending pair by pair would compare all copies of a passage with each other; so each window meets
   its first owner alone.

Scale: a group of equal texts is one text, owned by its smallest id. Runs that several texts of a batch share are settled
there, so a passage that a third of all texts hold sends one row from a batch to the index. Owners of windows are found
with map-side combining and joined, so that Spark may split a common window. Texts are shuffled twice, to meet their shared
grams and, at the end, their repeats; only texts with shared grams are kept for steps 2 and 3.

Edge cases: null, empty and short texts have no windows. A null id counts as larger than all others; rows of one id are
never earlier than each other, whatever their texts. Repeats within one document stay. Repeated rows each get a row. An
empty table gives an empty result. Other columns are not read, so their names may clash. Ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import scratch, settle, table

WIDTH, BLOCK, GRAM = 50, 25, 13
#: Distinct words whose hashes a worker remembers, and the multipliers of rolling hashes (odd numbers).
KNOWN = 1_000_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: What a row of grams or runs is: alone in its batch, the first of several texts there, or a later one of them.
ALONE, LEADER, FOLLOWER = 0, 1, 2


class WordHashes(dict):
    """Words to 64-bit hashes; only so many are remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < KNOWN:
            self[word] = found
        return found


@lru_cache(maxsize=64)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of ``base`` and of its inverse, modulo 2**64."""
    found = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(n, b, np.uint64)
        row[0] = 1
        found.append(np.multiply.accumulate(row))
    return found[0], found[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, n: int, base: int = BASES[0]) -> np.ndarray:
    """The hashes of all runs of ``n`` words."""
    size = len(hashes)
    if size < n:
        return np.empty(0, np.uint64)
    up, down = _powers(base, 1 << (size - 1).bit_length() if size > 1 else 1)
    before = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes * up[:size], out=before[1:])
    return _mixed((before[n:] - before[:-n]) * down[: size - n + 1])


def least(grams: np.ndarray, span: int) -> np.ndarray:
    """The least of each ``span`` consecutive grams."""
    found, reach = grams, 1
    while reach < span:
        step = min(reach, span - reach)
        found = np.minimum(found[:-step], found[step:])
        reach += step
    return found


class Text:
    """The words of a text and the hashes of their runs."""

    def __init__(self, text: bytes | None, known: WordHashes) -> None:
        self.words = (text or b"").split()  # ASCII white space
        self.n = len(self.words)
        self.hashes = np.fromiter(map(known.__getitem__, self.words), np.uint64, self.n)

    def least_grams(self) -> np.ndarray:
        """For each rolling run of ``BLOCK`` words its least gram."""
        return least(rolling(self.hashes, GRAM), BLOCK - GRAM + 1)


def _shares(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """ALONE, LEADER or FOLLOWER for each pair (key, row) of a batch: whether other rows have the key too.

    The pairs of the leading row of a key are all leaders.
    """
    order = np.lexsort((rows, keys))
    k, r = keys[order], rows[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.cumsum(new) - 1
    first = r[np.flatnonzero(new)][group]
    several = np.zeros(int(group[-1]) + 1, bool)
    several[group[r != first]] = True
    kind = np.empty(len(keys), np.int8)
    kind[order] = np.where(several[group], np.where(r == first, LEADER, FOLLOWER), ALONE)
    return kind


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct least grams of each text (row, text) that is long enough for a window."""
    known = WordHashes()
    for batch in batches:
        found, rows, seen = [], [], set()
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
            if row in seen or (t := Text(text.as_py(), known)).n < WIDTH:
                continue
            seen.add(row)
            found.append(np.unique(t.least_grams()))
            rows.append(np.full(len(found[-1]), row, np.int64))
        if found:
            gram, row = np.concatenate(found), np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([_signed(gram), pa.array(row), pa.array(_shares(gram, row))], ["gram", "row", "kind"])


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rolling runs (hash, row, at, aligned, kind) of each text (row, text, marks) whose least gram is marked."""
    known = WordHashes()
    for batch in batches:
        found, rows, places = [], [], []
        for i, row in enumerate(batch.column("row").to_pylist()):
            t = Text(batch.column("text")[i].as_py(), known)
            marks = batch.column("marks")[i].values.to_numpy().view(np.uint64)
            at = np.flatnonzero(np.isin(t.least_grams(), marks))
            found.append(rolling(t.hashes, BLOCK)[at])
            rows.append(np.full(len(at), row, np.int64))
            places.append(at)
        if sum(map(len, found)):
            run, row, at = np.concatenate(found), np.concatenate(rows), np.concatenate(places)
            columns = [_signed(run), pa.array(row), pa.array(at.astype(np.int32)), pa.array(at % BLOCK == 0), pa.array(_shares(run, row))]
            yield pa.RecordBatch.from_arrays(columns, ["run", "row", "at", "aligned", "kind"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows (a, b, doc_id, row, start) of each text (doc_id, row, text, hits) that hold a hit."""
    known = WordHashes()
    for batch in batches:
        parts = []
        for i, row in enumerate(batch.column("row").to_pylist()):
            t = Text(batch.column("text")[i].as_py(), known)
            hits = batch.column("hits")[i].values.to_numpy()
            change = np.zeros(t.n + 2, np.int64)
            np.add.at(change, np.maximum(hits - (WIDTH - BLOCK), 0), 1)
            np.add.at(change, hits + 1, -1)
            start = np.flatnonzero(change.cumsum()[: t.n - WIDTH + 1])
            a, b = (rolling(t.hashes, WIDTH, base)[start] for base in BASES)
            parts.append((a, b, np.full(len(start), i), np.full(len(start), row, np.int64), start.astype(np.int32)))
        if sum(len(p[0]) for p in parts):
            a, b, i, row, start = (np.concatenate(c) for c in zip(*parts, strict=True))
            columns = [_signed(a), _signed(b), batch.column("doc_id").take(pa.array(i)), pa.array(row), pa.array(start)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "doc_id", "row", "start"])


def shared_grams(texts: DataFrame) -> DataFrame:
    """Rows (row, marks): the texts that share least grams with others, and these grams."""
    grams = texts.select("row", "text").mapInArrow(_grams, "gram long, row long, kind byte")
    # Followers are shared already and stand alone; a gram has at most one other row from a batch.
    met = Window.partitionBy(F.when(F.col("kind") == FOLLOWER, F.xxhash64("gram", "row")).otherwise(F.col("gram")))
    other = (F.col("kind") > ALONE) | (F.min("row").over(met) < F.max("row").over(met))
    return grams.select("gram", "row", other.alias("other")).filter("other").groupBy("row").agg(F.collect_set("gram").alias("marks"))


def anchor_hits(work: DataFrame) -> DataFrame:
    """Rows (row, hits): the places of the rolling runs that meet a reference block of another text, and of these blocks."""
    probes = settle(work.select("row", "text", "marks").mapInArrow(_probes, "run long, row long, at int, aligned boolean, kind byte"), "probes")
    # A leader stands for its followers, one of which may have the block.
    block = F.max(F.col("aligned") | (F.col("kind") == LEADER))
    index = probes.filter(F.col("kind") < FOLLOWER).groupBy("run").agg(block.alias("block"), F.min("row").alias("low"), F.max("row").alias("high"))
    index = settle(index.filter("block and low < high").select("run"), "anchors")
    # A batch with several texts of a run need not ask: what a block of yet another text adds is what they share anyway.
    met = probes.filter(F.col("kind") == ALONE).join(index, "run", "left_semi").union(probes.filter(F.col("kind") > ALONE))
    return met.groupBy("row").agg(F.collect_set("at").alias("hits"))


def repeats(docs: DataFrame) -> DataFrame:
    """What is known of texts (columns doc_id, text): rows (key, owner, copies, starts).

    ``key`` is the text's hash and ``owner`` its smallest id, ``copies`` whether several rows have it; ``starts`` are the places of
    its windows, as its owner's, that an earlier document has. Texts without copies and repeats have no row.
    """
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.md5("text").alias("key"), F.xxhash64("text").alias("row"))
    keyed = keyed.filter("text is not null")
    copies = keyed.groupBy("key", "row").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    marks = settle(shared_grams(keyed), "marks")
    # Grouped by another column than the join's, so that Spark may split a text with very many copies, of which a task sends one.
    work = keyed.join(marks.hint("merge"), "row").groupBy("key").agg(
        F.first("row").alias("row"), F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("marks").alias("marks")
    )
    work = settle(work, "repeat-texts")
    hits = settle(anchor_hits(work), "hits")
    windows = work.select("doc_id", "row", "text").join(hits.hint("merge"), "row")
    windows = settle(windows.mapInArrow(_windows, "a long, b long, doc_id long, row long, start int"), "windows")
    firsts = windows.groupBy("a", "b").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    later = windows.join(settle(firsts, "first-owners"), ["a", "b"]).filter("doc_id is null or doc_id > first")
    starts = later.groupBy("row", "doc_id").agg(F.collect_set("start").alias("starts"))
    of = work.select("key", F.col("row").alias("of_row"), F.col("doc_id").alias("owner"))
    starts = starts.join(of, (F.col("row") == F.col("of_row")) & F.col("doc_id").eqNullSafe(F.col("owner")))
    known = copies.select("key", "owner", F.lit(True).alias("copies"), F.lit(None).cast("array<int>").alias("starts")).unionByName(
        starts.select("key", "owner", F.lit(False).alias("copies"), "starts")
    )
    return known.groupBy("key").agg(F.min("owner").alias("owner"), F.max("copies").alias("copies"), F.first("starts", ignorenulls=True).alias("starts"))


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, whole, starts in zip(batch.column("text"), batch.column("whole").to_pylist(), batch.column("starts"), strict=True):
            words = (text.as_py() or b"").split()
            if whole and len(words) >= WIDTH:
                spans = [(0, len(words))]
            elif starts.is_valid and not whole:
                places = np.sort(starts.values.to_numpy())
                ends = np.flatnonzero(np.diff(places) > WIDTH)
                spans = list(zip(places[np.concatenate([[0], ends + 1])].tolist(), (places[np.concatenate([ends, [-1]])] + WIDTH).tolist(), strict=True))
            else:
                spans = []
            kept, at = [], 0
            for start, stop in [*spans, (len(words), len(words))]:
                kept += words[at:start]
                at = stop
            out.append((len(words), sum(b - a for a, b in spans), b" ".join(kept), [{"start": a, "stop": b} for a, b in spans]))
        n, gone, kept, spans = zip(*out, strict=True) if out else ((),) * 4
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        columns = [batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip((n, gone, kept, spans), kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "repeats"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a space) and repeats (ranges of words)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch(docs.sparkSession):
        known = settle(repeats(docs), "repeats", keep=True)
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.md5("text").alias("key"))
    met = texts.join(known.hint("merge"), "key", "left")
    whole = F.coalesce(F.col("copies") & F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("owner"))), F.lit(False))
    found = met.select("doc_id", "text", whole.alias("whole"), "starts").mapInArrow(
        _removals, "doc_id long, n_words long, n_removed long, kept binary, repeats array<struct<start:int,stop:int>>"
    )
    return found.withColumn("kept", F.col("kept").cast("string"))


def op13_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
with texts as (
    select row_number() over () as row_id, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents
), windows as (
    select row_id, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as run from texts, unnest(range(1, len(words) - 48)) u(i) where len(words) >= 50
), firsts as (
    select run, min(doc_id) as owner from windows group by 1
), gone as (
    select distinct row_id, p from windows join firsts using (run), unnest(range(i, i + 50)) u(p) where doc_id > owner
), places as (
    select row_id, p, words[p] as word from texts, unnest(range(1, len(words) + 1)) u(p)
), kept as (
    select row_id, string_agg(word, ' ' order by p) as kept, count(*) as n from places anti join gone using (row_id, p) group by 1
)
select doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from texts left join kept using (row_id)
"""
