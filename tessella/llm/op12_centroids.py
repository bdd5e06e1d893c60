"""Plain Lloyd clustering of vectors in whole numbers, so that every run gives the same centroids.

Each component x of a vector becomes floor(scale * x). Centroids are sent to all tasks; a task computes the squared
differences to one centroid after another in NumPy, takes the first least one and adds up its vectors by cluster. Only these sums,
one row a cluster and component, are shuffled, whose exact quotients, rounded down, are the next centroids. The first
centroids are the vectors with the least hashes of their ids.

Scale: vectors are read and rounded once and stored as whole numbers; rounds read them where they lie. The driver holds
``clusters`` times ``dims`` numbers, both parameters. Sums over a cluster of any size come from one row a task.

Edge cases: vectors of another length, or with a null or non-finite component, and null vectors are left out. Fewer vectors than
clusters give as many clusters as vectors. Equal hashes (repeated ids) are ordered by the vectors themselves; a null id hashes as an empty one.
Centroids without vectors stay; equal centroids leave all vectors to the first of them. An empty table gives an empty
result. Components beyond ``LARGEST`` in size would make squared distances overflow 64 bits; the job ends with an error
instead of wrong figures, as Spark's own sums do. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import settle, table

#: Vectors of which the differences to a centroid are held at a time.
SLICE = 8192
#: With up to 1,024 components of this size, squared distances stay within 64 bits.
LARGEST = 1 << 25


def whole_vectors(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, parts) of the vectors that are complete, in whole numbers."""
    raw = F.col(vector_col)
    unfit = F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    parts = F.transform(raw, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    kept = vectors.filter((F.size(raw) == dims) & ~unfit).select(F.col(id_col).alias("vec_id"), parts.alias("parts"))
    within = F.forall("parts", lambda x: x.between(-LARGEST, LARGEST))
    return kept.withColumn("parts", F.when(within, F.col("parts")).otherwise(F.raise_error("a component is too large for exact distances in 64 bits")))


def nearest(block: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest centroid of each row, and the squared distance to it."""
    apart = np.empty((len(block), len(centroids)), np.int64)
    for start in range(0, len(block), SLICE):
        part = block[start : start + SLICE]
        for c, centroid in enumerate(centroids):
            apart[start : start + SLICE, c] = np.square(part - centroid).sum(axis=1)
    own = apart.argmin(axis=1)
    return own, apart[np.arange(len(block)), own]


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray]]:
    """For each cluster with vectors their number and the sum of each component."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = sent.value
        n, total = np.zeros(len(centre), np.int64), np.zeros(centre.shape, np.int64)
        for frame in frames:
            if len(frame):
                block = np.stack(frame["parts"].to_numpy())
                own, _ = nearest(block, centre)
                n += np.bincount(own, minlength=len(centre))
                np.add.at(total, own, block)
        cluster, dim = np.divmod(np.arange(total.size), total.shape[1])
        rows = pd.DataFrame({"cluster": cluster.astype("int32"), "dim": dim.astype("int32"), "n": n[cluster], "total": total.ravel()})
        yield rows[rows["n"] > 0]

    sums = vectors.select("parts").mapInPandas(partial, "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    found: dict[int, tuple[int, np.ndarray]] = {}
    for row in sums.collect():  # clusters x components
        found.setdefault(row.cluster, (row.n, np.zeros(centroids.shape[1], np.int64)))[1][row.dim] = row.total
    sent.destroy()
    return found


def lloyd(
    vectors: DataFrame, clusters: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, cluster, distance), and the final centroids."""
    spark = vectors.sparkSession
    kept = settle(whole_vectors(vectors, dims, scale, id_col, vector_col), "whole-vectors")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select(hashed.alias("hash"), "parts").orderBy("hash", "parts").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), np.zeros((0, dims), np.int64)
    centroids = np.array([r.parts for r in sorted(first, key=lambda r: (r.hash, r.parts))], np.int64)
    for _ in range(rounds):
        centroids = centroids.copy()
        for cluster, (n, total) in cluster_sums(kept, centroids).items():
            centroids[cluster] = total // n
    sent = spark.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                own, distance = nearest(np.stack(frame["parts"].to_numpy()), sent.value)
                yield pd.DataFrame({"vec_id": frame["vec_id"], "cluster": own.astype("int32"), "distance": distance})

    return kept.mapInPandas(assign, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), centroids


def clustered(vectors: DataFrame, **parameters) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, inertia of its cluster and of all, and its centroid (array of long)."""
    spark = vectors.sparkSession
    found, centroids = lloyd(vectors, **parameters)
    found = settle(found, "clusters")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    by_cluster = by_cluster.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    centres = spark.createDataFrame([(c, row.tolist()) for c, row in enumerate(centroids)], "cluster int, centroid array<long>")
    # One row a cluster.
    of = F.broadcast(centres.join(by_cluster, "cluster"))
    return found.join(of, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def _round(n: int) -> str:
    """Assignment to the centroids of round n, and the centroids of the next round."""
    apart = "list_sum(list_transform(range(1, 65), lambda d: (v[d] - c[d]) * (v[d] - c[d])))::bigint"
    return f"""
a{n} as (
    select row_id, vec_id, v, arg_min(k, (distance, k)) as k, min(distance) as distance from (select row_id, vec_id, v, k, {apart} as distance from kept, c{n}) group by 1, 2, 3
), s{n} as (
    select k, d, sum(v[d])::hugeint as total, count(*) as n from a{n}, range(1, 65) r(d) group by 1, 2
), m{n} as (
    select k, list(((total - ((total % n) + n) % n) // n)::bigint order by d) as c from s{n} group by 1
), c{n + 1} as (
    select c{n}.k, coalesce(m{n}.c, c{n}.c) as c from c{n} left join m{n} using (k)
)"""


OP12_SQL = f"""
with kept as (
    select row_number() over () as row_id, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: isfinite(x))) = 64
), c0 as (
    select row_number() over (order by hash, v) - 1 as k, v as c from (select sha256('1:' || vec_id) as hash, v from kept order by 1, 2 limit 16)
), {_round(0)}, {_round(1)}, {_round(2)}, {_round(3)}
select vec_id, a3.k::int as cluster, distance, (sum(distance) over (partition by a3.k))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
    sha256(array_to_string(c3.c, ',')) as centroid_sha256 from a3 join c3 using (k)
"""
