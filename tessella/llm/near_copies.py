"""Near copies by word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

Method: SimHash first. The texts' fingerprints over the same shingles are linked within two bits by the pivot distance
tables of op5; texts of one component are verified against one of them. Fingerprints of a fixed radius miss many pairs of
that similarity, so the others are found by an exact prefix filter. All shingles have one order (by hash, those that a
sample of texts shows to be common behind all others; any order gives the same result). Two sets that are similar enough
share a shingle among the first n - ceil(0.8 n) + 1 of each, and the first one that they share stands where enough others
can follow. A pair of which the folded sets (each shingle flips one of 512 bits, for long texts also one of 4,096) differ in
more bits than similar sets can differ in shingles is discarded; every other one is verified by its whole sets. For that
the two texts are brought together compressed, which is a fraction of their shingles. Links are closed into components.

So that a large family of near copies costs no square, components meet before texts do. A text is first compared with the
centre of most of its prefix shingles alone. Then each shingle has a centre for every component at it, and the centres are
compared with the first of them; a component counts once at a shingle, whatever its size. Beside that a hash deals the texts of
crowded shingles into cells of about ``CELL``, another one each turn, and each text is compared with the closest of another
component that it meets there: so a loose family, in which few texts resemble any one centre, joins up by one pair a
text and turn, not by all its pairs. Turns end when they find few links. Only what still differs is compared text by text: at a shingle, the texts outside its largest component with all of
another component, in blocks of ``BLOCK`` by ``BLOCK`` that a hash of both sides spreads over tasks. So n texts alike and s
others at a shingle cost n * s comparisons of folded sets, and no rows but close pairs. A common line of otherwise
different texts is seldom in a prefix.

Edge cases: words are split and lower-cased as for fingerprints; shingles are compared by 64-bit hashes. A text of fewer
words is one shingle, all wordless and null texts are alike. Null ids, repeated rows and empty tables are treated as in op5.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import bounded_broadcast, scratch, settle, small_batches
from tessella.llm import op5_simhash
from tessella.llm.op5_simhash import components, fingerprint_of, shingles

WIDTH = 5
#: The least similarity as a fraction.
LEAST = (4, 5)
#: One text of so many is sampled for common shingles; a shingle of so many sampled texts is common; so many are kept.
SAMPLE, COMMON, MOST = 16, 4, 100_000
BROADCAST = 250_000
#: Longs of a folded set, and of that of a set of more than ``LONG`` shingles.
FOLD, WIDE, LONG = 8, 64, 448
#: Texts on either side of a block of comparisons.
BLOCK = 512
#: Texts side by side in a cell of neighbours, on average.
CELL = 8
#: Turns of centres and neighbours end when one finds so many times fewer links than the first.
FEWER = 32
#: Sets that a task keeps while it verifies pairs.
CACHE = 256


def ordered(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The distinct shingle hashes, common ones (a sorted array) last."""
    found = np.unique(hashes).view(np.int64)
    if not len(common) or not len(found):
        return found
    at = np.searchsorted(common, found)
    return found[np.argsort(common[np.minimum(at, len(common) - 1)] == found, kind="stable")]


def folded(found: np.ndarray, longs: int) -> np.ndarray:
    """The parities of how many hashes fall on each of so many bits."""
    return np.packbits(np.bincount(found & (64 * longs - 1), minlength=64 * longs) & 1).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """The first column and ``grams``, the shingle set of the second."""
    key = texts.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([ordered(shingles(t, width), none) for t in b.column(1).to_pylist()])], names=[key, "grams"])

    return texts.mapInArrow(run, f"{key} long, grams array<long>")


def common_shingles(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Shingles of several texts of a sample, sorted; they speed up the search and don't change what it finds."""
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    sample = texts.filter(F.pmod("text_key", F.lit(SAMPLE)) == 0).dropDuplicates(["text_key"])
    counts = _sets(sample, width).select(F.explode("grams").alias("gram")).groupBy("gram").count().filter(F.col("count") >= COMMON)
    # As Arrow columns: rows would take the driver a hundredfold.
    return np.sort(counts.orderBy(F.desc("count"), "gram").limit(MOST).select("gram").toArrow()["gram"].to_numpy())


def prefixes(docs: DataFrame, id_col: str, text_col: str, width: int, least: tuple[int, int]) -> DataFrame:
    """Rows (id, text_key, node, fp, n, fold, wide, prefix): node stands for a set of n shingles, prefix has the first of them."""
    common = common_shingles(docs, text_col, width)
    num, den = least
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                nodes, prints, sizes, folds, wides, firsts = [], [], [], [], [], []
                for text in b.column(2).to_pylist():
                    hashes = shingles(text, width)
                    found = ordered(hashes, common)
                    nodes.append(xxhash.xxh64_intdigest(found.tobytes(), seed=42))
                    prints.append(fingerprint_of(hashes))
                    sizes.append(len(found))
                    folds.append(folded(found, FOLD))
                    wides.append(folded(found, WIDE) if len(found) > LONG else found[:0])
                    firsts.append(found[: len(found) + num * len(found) // -den + 1] if len(found) else found)
                columns = [b.column(0), b.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(sizes, pa.int32()), _lists(folds), _lists(wides), _lists(firsts)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_key", "node", "fp", "n", "fold", "wide", "prefix"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_key long, node long, fp long, n int, fold array<long>, wide array<long>, prefix array<long>")


def _may_be_alike(a: str, b: str, least: tuple[int, int]) -> Column:
    """Whether sets whose first common shingle stands at ``pos`` can have enough shingles in common."""
    num, den = least
    after = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return (num + den) * after >= num * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _packed(texts: DataFrame) -> DataFrame:
    """Rows (node, packed): the texts (node, text) compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                packed = [press.compress((t or "").encode()) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], names=["node", "packed"])

    return texts.mapInArrow(run, "node long, packed binary")


def _verified(pairs: DataFrame, width: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b, packed_a, packed_b) whose sets are similar enough."""
    num, den = least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress, kept = zstandard.ZstdDecompressor(), OrderedDict()

        def grams(node: int, packed: bytes) -> np.ndarray:
            if node not in kept:
                kept[node] = np.unique(shingles(unpress.decompress(packed).decode(), width))
            kept.move_to_end(node)
            if len(kept) > CACHE:
                kept.popitem(last=False)
            return kept[node]

        for b in batches:
            out = []
            for left, right, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                one, other = grams(left, x), grams(right, y)
                shared = len(np.intersect1d(one, other, assume_unique=True))
                if (num + den) * shared >= num * (len(one) + len(other)):
                    out.append((left, right))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return pairs.select("a", "b", "packed_a", "packed_b").mapInArrow(run, "a long, b long")


def _folded_bits(a: str, b: str) -> Column:
    """In how many bits the folded sets of rows with columns f0, f1, ... differ."""
    return sum((F.bit_count(F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))) for i in range(FOLD)), F.lit(0))


def _folded_close(a: str, b: str, least: tuple[int, int]) -> Column:
    """Whether rows with columns n and f0, f1, ... have folded sets that similar sets can have."""
    num, den = least
    return (num + den) * _folded_bits(a, b) <= (den - num) * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _alike(pairs: DataFrame, firsts: DataFrame, docs: DataFrame, text_col: str, width: int, least: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) of nodes, with the lesser size n, whose sets are similar enough; their folded sets are."""
    num, den = least
    of = lambda c: firsts.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}"))
    bits = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = settle(pairs, "close-pairs")
    if pairs.isEmpty():
        return pairs.select("a", "b")
    closer = pairs.filter(F.col("n") > LONG).select("a", "b").join(of("a"), "a").join(of("b"), "b").filter((num + den) * bits <= (den - num) * (F.col("n_a") + F.col("n_b")))
    near = settle(pairs.filter(F.col("n") <= LONG).select("a", "b").union(closer.select("a", "b")), "closer-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(firsts.select("node", "text_key"), "node")
    texts = docs.select(F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    texts = texts.join(bounded_broadcast(settle(wanted, "close-nodes"), BROADCAST), "text_key").select("node", "text")
    packed = settle(_packed(texts).dropDuplicates(["node"]), "close-texts")
    left, right = (packed.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
    return settle(_verified(near.join(left, "a").join(right, "b"), width, least), "alike")


def _distinct(rows: DataFrame) -> DataFrame:
    """One row a node, the one with the least id. Only rows of nodes that several texts share are shuffled."""
    again = rows.groupBy("node").count().filter("count > 1").select("node")
    again = bounded_broadcast(settle(again, "repeated-nodes"), BROADCAST)
    columns = ["node", "id", "text_key", "fp", "n", "fold", "wide", "prefix"]
    least = rows.join(again, "node", "left_semi").groupBy("node").agg(F.min(F.struct(*columns[1:])).alias("first"))
    lone = rows.join(again, "node", "left_anti").select(*columns)
    return lone.union(settle(least.select("node", "first.*"), "repeated-firsts"))


def _linked(firsts: DataFrame, docs: DataFrame, text_col: str, width: int, least: tuple[int, int]) -> DataFrame:
    """Rows (node, root) of all nodes that have similar ones."""
    rows = firsts.select("node", "n", F.posexplode("prefix").alias("pos", "gram"))
    repeated = settle(rows.groupBy("gram").count().filter("count > 1").select("gram"), "shared-shingles")
    met = settle(rows.join(bounded_broadcast(repeated, BROADCAST), "gram"), "shingle-blocks")
    folds = firsts.select("node", *[F.col("fold")[i].alias(f"f{i}") for i in range(FOLD)])
    alike = lambda pairs: _alike(pairs, firsts, docs, text_col, width, least)
    apart, close = F.col("a.root") != F.col("b.root"), _folded_close("a", "b", least)
    lesser = F.least("a.n", "b.n").alias("n")

    def placed_by(near: DataFrame) -> DataFrame:
        """The rows of shingles at which texts of several roots still meet, with their roots and folded sets."""
        placed = settle(met.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node")), "placed-blocks")
        mixed = placed.groupBy("gram").agg(F.min("root").alias("one"), F.max("root").alias("other")).filter("one <> other").select("gram")
        return settle(placed.join(mixed, "gram", "left_semi").join(folds, "node"), "mixed-blocks")

    def centres(placed: DataFrame, *by: str) -> DataFrame:
        columns = [c for c in placed.columns if c not in (*by, "node")]
        return placed.groupBy(*by).agg(F.min(F.struct("node", *columns)).alias("c")).select(*by, "c.*")

    def between_roots(placed: DataFrame) -> DataFrame:
        """Pairs of centres of a shingle's roots: each with the first of them."""
        own = settle(centres(placed, "gram", "root"), "root-centres")
        met_at = (F.col("a.gram") == F.col("b.gram")) & apart & close & _may_be_alike("a", "b", least)
        return centres(own, "gram").alias("a").join(own.alias("b"), met_at).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), lesser).distinct()

    def between_neighbours(placed: DataFrame, turn: int) -> DataFrame:
        """Of the texts of other roots that a hash puts beside a text at its crowded shingles, the closest: a pair a text at most."""
        sized = placed.groupBy("gram").count().filter(F.col("count") > CELL).select("gram", F.ceil(F.col("count") / CELL).alias("cells"))
        cell = F.pmod(F.xxhash64("node", "gram", F.lit(turn)), "cells")
        spread = settle(placed.join(sized, "gram").withColumn("cell", cell).drop("cells"), "neighbour-cells")
        met_at = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.node") < F.col("b.node"))
        met_pairs = spread.alias("a").join(spread.alias("b"), met_at & apart & close & _may_be_alike("a", "b", least))
        met_pairs = met_pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), lesser, _folded_bits("a", "b").alias("bits"))
        either = F.explode(F.array(*[F.struct(F.col(x).alias("own"), F.col(y).alias("other")) for x, y in ("ab", "ba")]))
        closest = met_pairs.select("n", "bits", either.alias("e")).groupBy("e.own").agg(F.min(F.struct("bits", "e.other", "n")).alias("c"))
        return closest.select(F.least("own", "c.other").alias("a"), F.greatest("own", "c.other").alias("b"), "c.n").distinct()

    def next_pairs(placed: DataFrame, turn: int) -> DataFrame:
        return between_roots(placed).union(between_neighbours(placed, turn)).distinct()

    def remaining(placed: DataFrame) -> DataFrame:
        """All close pairs of different roots: texts outside the largest root of a shingle with those of other roots, in blocks."""
        by_root = placed.groupBy("gram", "root").count()
        largest = by_root.groupBy("gram").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.max("count").alias("most"), F.sum("count").alias("whole"))
        blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
        sized = largest.select("gram", "largest", blocks(F.col("whole") - F.col("most")).alias("lefts"), blocks(F.col("whole")).alias("rights"))
        spread = settle(placed.join(sized, "gram").withColumn("h", F.xxhash64("node")), "remaining-blocks")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = spread.filter("root <> largest").withColumn("i", F.pmod("h", "lefts").cast("int")).withColumn("j", every("rights"))
        right = spread.withColumn("j", F.pmod("h", "rights").cast("int")).withColumn("i", every("lefts"))
        # Two texts outside the largest root meet from either side; once is enough.
        once = (F.col("b.root") == F.col("b.largest")) | (F.col("a.node") < F.col("b.node"))
        met_at = (F.col("a.gram") == F.col("b.gram")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
        joined = left.alias("a").join(right.alias("b"), met_at & apart & once & close & _may_be_alike("a", "b", least))
        return joined.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"), lesser).distinct()

    def added(pairs_of) -> DataFrame:
        """The similar pairs among those of a step; what the step wrote besides goes with it."""
        with scratch(docs.sparkSession):
            return settle(alike(pairs_of()), "near-links", keep=True)

    def first_pairs() -> DataFrame:
        """Texts of fingerprints within two bits, and each text with the one that it meets as a centre at most of its shingles."""
        named = components(op5_simhash.links(settle(firsts.select("fp").distinct(), "near-fingerprints"))).toDF("of", "root")
        prints = firsts.select("node", "n", "fp").join(named, F.col("fp") == F.col("of"), "left").select("node", "n", F.coalesce("root", "fp").alias("print"))
        prints = settle(prints, "near-prints")
        one = prints.groupBy("print").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("texts")).filter("texts > 1")
        pairs = prints.join(one, "print").filter("node <> c.node").select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.least("n", "c.n").alias("n"))
        a, b = centres(met, "gram").alias("a"), met.alias("b")
        shared = a.join(b, (F.col("a.gram") == F.col("b.gram")) & (F.col("a.node") < F.col("b.node")) & _may_be_alike("a", "b", least))
        shared = shared.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b"), lesser).count()
        shared = shared.groupBy("b").agg(F.max_by(F.struct("a", "n"), F.struct("count", "a")).alias("c")).select("c.a", "b", "c.n")
        return pairs.union(shared).distinct()

    near, found = added(first_pairs), []
    # Where a turn stops changes the work that remains, not the result.
    while not found or FEWER * found[-1] > found[0]:
        more = added(lambda: next_pairs(placed_by(near), len(found)))
        near, found = near.union(more), [*found, more.count()]
    return components(near.union(added(lambda: remaining(placed_by(near)))))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: tuple[int, int] = LEAST) -> DataFrame:
    """Rows (doc_id, component_id): each document and the smallest id that it can reach over links."""
    with scratch(docs.sparkSession), small_batches(docs.sparkSession):
        rows = settle(prefixes(docs, id_col, text_col, width, least), "shingle-prefixes")
        firsts = _distinct(rows)
        linked = settle(_linked(firsts, docs, text_col, width, least), "near-copies")
        members = linked.union(linked.select(F.col("root").alias("node"), "root").distinct())
        ids = rows.select("node", "id").join(members, "node")
        least_ids = ids.groupBy("root").agg(F.min("id").alias("component_id"))
        named = settle(members.join(least_ids, "root").select("node", "component_id"), "near-copy-components")
        own = rows.groupBy("node").agg(F.min("id").alias("own"))
        of = settle(own.join(named, "node", "left").select("node", F.coalesce("component_id", "own").alias("component_id")), "node-components")
        return settle(rows.join(of, "node").select(F.col("id").alias("doc_id"), "component_id"), "near-copies", keep=True)
