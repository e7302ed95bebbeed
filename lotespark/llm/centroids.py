"""Centroid clustering by sort-means, in whole numbers.

`quantized` keeps the usable vectors as integers floor(256 x). Each round `assigned`
starts a vector at its centroid of the round before and scans the other centroids by
their distance from that one. The scan ends at the first centroid that is strictly
more than twice as far from the start as the vector is: it and all after it are
farther from the vector than the start. At exactly twice it may be as near, and a
smaller number wins ties, so it is still looked at. Centroids are K rows and travel
to the tasks; vectors stay where they are, and only sums over a task's vectors are
shuffled. So a vector that a third of the rows repeat is no hot key.

Vectors that are null, have another number of components, or have a null or
non-finite component are left out. Rows that repeat a vec_id are vectors of their own;
as first centroids they come one after the other, by their components. Rows without a
vec_id are clustered but don't start a centroid. Fewer than K vectors give as many
centroids; an empty table gives no rows. Equal first centroids stay apart: the later
ones get no vectors and stay as they are. Components must keep 256 x within 2 ** 26, so
that four squared distances fit a long; others fail the query by name. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ready
from .common import forget, stored

K, DIMENSION, SCALE, ROUNDS, SEED = 40, 64, 256, 5, 2
#: Largest integer component: 4 times 64 squared differences of such integers stay below 2 ** 63.
LARGEST = 1 << 26
#: Vectors that are compared at a time.
ROWS = 8192


def quantized(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer components, of the usable vectors."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    usable = (F.size("embedding") == dimension) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall("embedding", lambda x: F.abs(x.cast("double") * scale) <= LARGEST)
    v = F.when(small, whole.cast("array<int>")).otherwise(F.raise_error(F.concat(F.lit("component out of range in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return vectors.where(usable).select("vec_id", v.alias("v"))


def first_centroids(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors whose `seed:vec_id` has the least SHA-256, in that order."""
    hashed = points.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("at"), "v")
    rows = hashed.orderBy("at", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x from one point c."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, distances computed) of rows x, each scanned from its start."""
    apart = np.stack([squared(centroids, c) for c in centroids])
    best, far, looked = start.copy(), np.zeros(len(x), dtype=np.int64), len(x)
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        own = squared(x[rows], centroids[a])
        order = np.argsort(-own, kind="stable")  # the farthest first, so that those still scanning are a prefix
        rows, own = rows[order], own[order]
        mine, at, here = x[rows], np.full(len(rows), a), own.copy()
        others = np.argsort(apart[a], kind="stable")
        for j in others[others != a]:
            # apart and own are squares: twice the distance is four times the square
            live = int(np.searchsorted(-4 * own, -apart[a, j], "right"))
            if not live:
                break
            looked += live
            d = squared(mine[:live], centroids[j])
            nearer = (d < here[:live]) | ((d == here[:live]) & (j < at[:live]))
            here[:live][nearer], at[:live][nearer] = d[nearer], j
        best[rows], far[rows] = at, here
    return best, far, looked


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points with cluster and distance; a column `cluster` that they have is where each scan starts, else centroid 0."""
    key = points.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                v = b.column("v")
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
                start = b.column("cluster").to_numpy().astype(np.int64) if "cluster" in b.schema.names else np.zeros(b.num_rows, dtype=np.int64)
                best, far, _ = nearest(x, start, centroids)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), v, pa.array(best.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "cluster", "distance"])

    return points.transform(ready).mapInArrow(run, f"vec_id {key}, v array<int>, cluster int, distance long")


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids as floors of their vectors' means; those without vectors stay."""
    d = centroids.shape[1]
    sums = points.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[k].cast("long")).alias(f"s{k}") for k in range(d)))
    out = centroids.copy()
    for r in sums.collect():  # K rows at most
        out[r.cluster] = [r[f"s{k}"] // r.n for k in range(d)]
    return out


def sort_means(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, dimension: int = DIMENSION) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance per usable vector; the final centroids)."""
    points = stored(quantized(vectors, dimension), "points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.where("false").select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        now = stored(assigned(points, centroids), "points")
        forget(points)
        points = now
        centroids = moved(points, centroids)
    final = stored(assigned(points, centroids), "points")
    forget(points)
    return final, centroids


def cluster_report(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, the sums of distances over the cluster and over all, and the digest of the final centroid."""
    spark = points.sparkSession
    sums = {r.cluster: r.s for r in points.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # K rows at most
    rows = [(c, sums.get(c, 0), sum(sums.values()), ",".join(map(str, centroids[c]))) for c in range(len(centroids))]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, components string")
    known = known.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return points.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    """The same in DuckDB, without the pruned scan: all distances, the least by (distance, number)."""
    assign = """
near{r} AS MATERIALIZED (
  SELECT id, vec_id, v, unnest(arg_min({{'c': c, 'd': d}}, [d, c])) FROM (
    SELECT p.id, any_value(p.vec_id) AS vec_id, any_value(p.v) AS v, k.c, any_value(list_sum(list_transform(list_zip(p.v, k.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT AS d
    FROM points p, centroids{r} k GROUP BY p.id, k.c) GROUP BY id, vec_id, v)"""
    move = """
sums{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {d} + 1)) AS i FROM near{r}) GROUP BY c, i),
centroids{n} AS MATERIALIZED (
  SELECT k.c, coalesce(m.v, k.v) AS v FROM centroids{r} k
  LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY i) AS v FROM sums{r} GROUP BY c) m USING (c))"""
    parts = [
        f"""
points AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}),
centroids0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM points WHERE vec_id IS NOT NULL) ORDER BY h, v LIMIT {K})"""
    ]
    for r in range(ROUNDS):
        parts += [assign.format(r=r), move.format(r=r, n=r + 1, d=DIMENSION)]
    parts.append(assign.format(r=ROUNDS))
    return "WITH" + ",".join(parts) + f"""
SELECT n.vec_id, n.c AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.c))::BIGINT AS cluster_inertia, (sum(n.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(k.v, ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN centroids{ROUNDS} k USING (c)"""


SQL = _sql()
