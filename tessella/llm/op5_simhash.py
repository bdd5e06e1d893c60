"""SimHash near-duplicates: linked fingerprints differ in at most two bits; links are closed into components.

Method: every distinct fingerprint gets a row of a pivot distance table: its Hamming distances to ``PIVOTS``, the zero
fingerprint and those with the four bits of one nibble set. By the triangle inequality fingerprints within r bits differ
by at most r in each coordinate. More follows from the distances to zero and to a nibble together: half of their
difference is how many bits of that nibble are set, which r changed bits can alter in at most r nibbles. The nibbles form six
groups; of two linked fingerprints at least four groups agree in all these coordinates. So pairs meet in the cells of the
table that fifteen choices of four groups make, are discarded by their largest coordinate difference, and the
survivors are verified bit by bit.

Cells of more than ``most`` fingerprints, as families of near copies and very large corpora make, are split by further
pivots, those of a single bit: first by the bits of the four groups; what is still crowded by choices of four of six parts
of the bits left, after which at most 256 fingerprints can share a cell. Any ``most`` gives the same links.

Edge cases: a null or wordless text has fingerprint zero and links like any other. Null ids stay in the result but never
name a component unless all ids of it are null. Repeated rows are kept and share a component. An empty table gives an
empty result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

RADIUS = 2
#: Reference fingerprints: zero and, for each nibble, its four bits.
PIVOTS = [0, *[15 << 4 * i for i in range(16)]]
#: The nibbles of each group; fingerprints within the radius agree in all but ``RADIUS`` groups.
GROUPS = [range(0, 3), range(3, 6), range(6, 9), range(9, 12), range(12, 14), range(14, 16)]
LEFT_OUT = list(combinations(range(len(GROUPS)), RADIUS))
#: Shingles whose bits are unpacked at a time.
STRIDE = 1 << 15


def signed(number: int) -> int:
    """A 64-bit number as Spark's long."""
    return number - (1 << 64) if number >> 63 else number


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The 64-bit hashes of a text's word shingles, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, "<u8")
    width = min(width, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    return np.array([digest(line[a:b]) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], "<u8")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    return fingerprint_of(shingles(text, width))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STRIDE):
        bits = np.unpackbits(hashes[i : i + STRIDE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows (doc_id, fp), fp as a signed 64-bit number."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, fp long")


def distance_table(fps: DataFrame, *others: str) -> DataFrame:
    """Rows (fp, other columns, d0 to d16): the distances to the pivots."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("byte")
    return fps.select("fp", *others, *[distance(p).alias(f"d{i}") for i, p in enumerate(PIVOTS)])


def _coordinates(left_out: tuple[int, ...]) -> Column:
    """Set bits of each nibble in the groups that stay, from the distances, three bits each."""
    key = F.lit(0).cast("long")
    for nibble in [n for g, own in enumerate(GROUPS) if g not in left_out for n in own]:
        key = F.shiftleft(key, 3).bitwiseOR(F.shiftright(F.col("d0") + 4 - F.col(f"d{nibble + 1}"), 1).cast("long"))
    return key


def _mask(bits: list[int]) -> int:
    return signed(sum(1 << b for b in bits))


def _split_masks() -> tuple[list[int], list[tuple[int, int]]]:
    """Per choice of groups the bits that stay, and (choice, bits that stay) with four of six parts of the others added."""
    whole, further = [], []
    for n, out in enumerate(LEFT_OUT):
        left = [4 * x + b for g in out for x in GROUPS[g] for b in range(4)]
        stay = [b for b in range(64) if b not in left]
        parts = [left[i :: len(GROUPS)] for i in range(len(GROUPS))]
        whole.append(_mask(stay))
        further += [(n, _mask(stay + [b for i, p in enumerate(parts) if i not in also for b in p])) for also in LEFT_OUT]
    return whole, further


def _met(rows: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows (fp, n, cell) that share their cell: those in cells of at most ``most`` rows, and the others."""
    rows = settle(rows, "simhash-cells")
    sizes = rows.groupBy("n", "cell").count().filter("count > 1")
    met = settle(rows.join(sizes, ["n", "cell"]), "simhash-met")
    return met.filter(F.col("count") <= most) if most else met, met.filter(F.col("count") > most) if most else met.limit(0)


def _pairs(met: DataFrame) -> DataFrame:
    """Pairs of a cell that no coordinate difference discards and that are within the radius.

    The rows of the table are made anew here: that takes less than to shuffle seventeen distances with each row of a cell.
    """
    rows = distance_table(met, "n", "cell")
    named = [c for c in rows.columns if c.startswith("d")]
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.n") == F.col("b.n")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp"))
    near = F.greatest(*[F.abs(F.col(f"a.{d}") - F.col(f"b.{d}")) for d in named]) <= RADIUS
    exact = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= RADIUS
    return a.join(b, same & near & exact).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(fps: DataFrame, most: int = 64) -> DataFrame:
    """Links (a, b): all pairs of the distinct fingerprints ``fp`` within two bits of each other."""
    table = settle(distance_table(fps), "pivot-distances")
    cells = F.array(*[F.struct(F.lit(n).alias("n"), _coordinates(out).alias("cell")) for n, out in enumerate(LEFT_OUT)])
    few, many = _met(table.select("fp", F.explode(cells).alias("c")).select("fp", "c.*"), most)
    found = _pairs(few)
    if not many.isEmpty():
        whole, further = _split_masks()
        bits = F.element_at(F.array(*map(F.lit, whole)), F.col("n") + 1)
        few, many = _met(many.select("fp", "n", F.col("fp").bitwiseAND(bits).alias("cell")), most)
        found = found.union(_pairs(few))
    if not many.isEmpty():
        parts = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("of"), F.lit(m).alias("mask")) for k, (n, m) in enumerate(further)])
        split = many.select("fp", "n", F.explode(F.filter(parts, lambda p: p["of"] == F.col("n"))).alias("p"))
        found = found.union(_pairs(_met(split.select("fp", F.col("p.k").alias("n"), F.col("fp").bitwiseAND(F.col("p.mask")).alias("cell")), None)[0]))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) of all linked nodes, root the least node of its component, by alternating star contraction.

    Each half step replaces links by links to the least neighbour; every state is written to the shared folder.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    edges = settle(edges, "links")
    seen = state(edges)
    while seen[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # Every neighbour above the node goes to the node's least neighbour.
        edges = both.filter("b > a").join(least, "a").select(F.col("low").alias("a"), "b").distinct()
        # Every node and its lower neighbours go to the least of these.
        least = edges.groupBy("b").agg(F.min("a").alias("low"))
        edges = edges.join(least, "b").select(
            F.col("low").alias("a"), F.explode(F.array("a", "b")).alias("b")
        ).filter("a <> b").distinct()
        edges = settle(edges, "links")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Each document's fingerprint and the smallest id that it can reach over links."""
    fps = settle(fingerprints(docs, id_col, text_col, width), "fingerprints")
    first = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-firsts")
    linked = components(links(first.select("fp")))
    members = linked.join(first, linked["node"] == first["fp"]).select("root", "fp", "first")
    roots = linked.select("root").distinct()
    members = members.union(roots.join(first, roots["root"] == first["fp"]).select("root", "fp", "first"))
    least = members.groupBy("root").agg(F.min("first").alias("component_id"))
    named = members.join(least, "root").select("fp", "component_id")
    of = first.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    # Both sides are read from storage, so Spark can split a fingerprint that very many copies share.
    of = settle(of, "fingerprint-components")
    return fps.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op5_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
