"""Centroid clustering in JVM expressions: integer distances to literal centroids, exact sums a cluster."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stages

LARGEST = 1 << 17  # components at or beyond it would leave 64-bit distances; such vectors take no part


def integer_vectors(vectors: DataFrame, dim: int = 64, scale: int = 256) -> DataFrame:
    """(vec_id, v): vectors of exactly `dim` finite components as floor(scale * x) in long."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(
        (F.size("x") == dim) & F.forall("x", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))))
    return whole.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def first_centroids(vecs: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The `k` vectors of smallest sha256 of `seed:vec_id`, equal ids by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vecs.filter("vec_id IS NOT NULL").select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return [list(r.v) for r in rows]


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct(distance, cluster) of the nearest centroid: squared Euclidean distance, the smaller number at ties."""
    table = F.expr("array(" + ", ".join("array(" + ", ".join(f"{x}L" for x in c) + ")" for c in centroids) + ")")
    square = lambda a, b: (a - b) * (a - b)
    apart = lambda c: F.aggregate(F.zip_with(v, c, square), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.array_min(F.transform(table, lambda c, i: F.struct(apart(c).alias("distance"), i.alias("cluster"))))


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dim` finite components.

    Vectors that are null, of another length, or hold null, NaN or infinite components (or any of 2^17 and more in size) take
    no part. Repeated rows count as often as they occur; a null vec_id is assigned but seeds no centroid. With fewer than
    `k` vectors each is a centroid; without any vector with an id there are no rows. Empty clusters keep their centroid.
    Other columns are ignored.

    What the driver holds is k x dim integers, whatever the input. Each round is one scan with sums combined before a shuffle
    of at most k rows a task; exact integers make the result independent of partitions and of tasks run again.
    """
    staged = Stages()
    vecs = staged.add(integer_vectors(vectors, dim, scale))
    centroids = first_centroids(vecs, k, seed)
    if not centroids:
        kinds = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vecs.sparkSession.createDataFrame([], kinds)
    for _ in range(rounds):
        near = vecs.select("v", nearest(F.col("v"), centroids).alias("near"))
        sums = near.groupBy("near.cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(dim)))
        for r in sums.collect():  # one row a cluster
            centroids[r.cluster] = [r[f"s{i}"] // r.n for i in range(dim)]
    near = vecs.select("vec_id", nearest(F.col("v"), centroids).alias("near")).select("vec_id", "near.cluster", "near.distance")
    near = staged.add(near)
    staged.drop(vecs)
    own = {r.cluster: r.s for r in near.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    pick = lambda values, kind: F.array(*(F.lit(x).cast(kind) for x in values))[F.col("cluster")]
    return near.select("vec_id", "cluster", "distance", pick([own.get(c, 0) for c in range(len(centroids))], "long").alias("cluster_inertia"),
                       F.lit(sum(own.values())).cast("long").alias("inertia"), pick(digests, "string").alias("centroid_sha256"))


def op13(spark, sf_dir):
    from .common import table

    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_sql(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same clustering for DuckDB: one block of common tables a round."""
    apart = "CAST(list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
    assign = lambda r: f"""n{r} AS (SELECT row_no, vec_id, v, q.cluster, q.distance FROM (
  SELECT e.row_no, any_value(e.vec_id) AS vec_id, any_value(e.v) AS v, min(struct_pack(distance := {apart}, cluster := c.cluster)) AS q
  FROM e, c{r} c GROUP BY e.row_no) t)"""  # noqa: E731
    update = lambda r: f"""c{r + 1} AS (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
  SELECT cluster, list(CAST(floor_sum AS BIGINT) ORDER BY i) AS v FROM (
    SELECT cluster, i, CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END AS floor_sum FROM (
      SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM n{r}, (SELECT unnest(range(1, {dim + 1})) AS i) k GROUP BY cluster, i) a) b
  GROUP BY cluster) m ON c.cluster = m.cluster)"""  # noqa: E731
    parts = [f"""e AS (SELECT row_number() OVER (ORDER BY vec_id, v) AS row_no, vec_id, v FROM (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}) t)""",
             f"""c0 AS (SELECT CAST(row_number() OVER (ORDER BY key, v) - 1 AS INTEGER) AS cluster, v FROM (
  SELECT sha256(concat('{seed}:', vec_id)) AS key, v FROM e WHERE vec_id IS NOT NULL ORDER BY key, v LIMIT {k}) t)"""]
    for r in range(rounds):
        parts += [assign(r), update(r)]
    parts.append(assign(rounds))
    last = f"n{rounds}"
    return f"""WITH {', '.join(parts)}
SELECT vec_id, n.cluster, distance, CAST(sum(distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM {last} n JOIN c{rounds} c ON n.cluster = c.cluster"""
