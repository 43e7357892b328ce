"""Nearest neighbours by cross-polytope hashing: pseudo-rotations, signed axes, probed tables, exact reranking."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages

TABLES = 4
BUCKET = 200          # rows a bucket holds on average
CHUNK, ASKED = 4096, 1024  # vectors and queries that meet in one task at most
SAMPLE = 64           # queries whose true neighbours set the number of probes
RECALL = 0.97         # share of the sample's neighbours the probes have to reach
MOST_PROBES = 4096

_FOUND = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of every row, orthonormal; the width is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


class Hashing:
    """`bits` bits a table, in parts of one cross-polytope each; the last part may see fewer coordinates."""

    def __init__(self, dim: int, bits: int, tables: int = TABLES, seed: int = 11) -> None:
        self.dim, self.width = dim, 1 << max(0, math.ceil(math.log2(max(dim, 1))))
        most = 1 + self.width.bit_length() - 1
        self.parts = [most] * (bits // most) + ([bits % most] if bits % most else [])
        self.tables = tables
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, max(len(self.parts), 1), 3, self.width))

    def axes(self, x: np.ndarray, t: int) -> list[np.ndarray]:
        """For every part the rotated rows' products with all signed axes."""
        x = np.pad(x, ((0, 0), (0, self.width - x.shape[1])))
        out = []
        for k, bits in enumerate(self.parts):
            y = x
            for s in self.signs[t, k]:
                y = hadamard(y * s)
            y = y[:, :1 << (bits - 1)]
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def bucket(self, x: np.ndarray, t: int) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for y in self.axes(x, t):
            out = out * y.shape[1] + y.argmax(1)
        return out

    def probes(self, x: np.ndarray, t: int, most: int) -> np.ndarray:
        """Buckets of every row by growing sum over the parts of (best axis - axis)^2, at most `most`."""
        where, cost = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for y in self.axes(x, t):
            lag = (y.max(1, keepdims=True) - y) ** 2
            axis = np.argsort(lag, axis=1, kind="stable")[:, :most]
            lag = np.take_along_axis(lag, axis, 1)
            cost = (cost[:, :, None] + lag[:, None, :]).reshape(len(x), -1)
            where = (where[:, :, None] * y.shape[1] + axis[:, None, :]).reshape(len(x), -1)
            best = np.argsort(cost, axis=1, kind="stable")[:, :most]
            cost, where = np.take_along_axis(cost, best, 1), np.take_along_axis(where, best, 1)
        return where


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows with an id and finite components that are not all zero; v in float or double as it comes, else double."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))
    return (vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL")
            .filter(F.forall("v", finite) & F.exists("v", lambda c: c != 0)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows as doubles, filled up with zeros to `dim` components."""
    ends, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(ends) and (ends == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(ends), dim))
    out[np.repeat(np.arange(len(ends)), ends), np.concatenate([np.arange(n) for n in ends]) if len(flat) else []] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by the largest component first, so that squares stay in range."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with rows, every row summed on its own so that equal rows get equal values."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(axis=1, keepdims=True)
    return (x * q).sum(axis=1) / np.sqrt((q * q).sum() * (x * x).sum(axis=1))


def best_in(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, k: int):
    """The `k` nearest rows of `x` for every query as (query number, row, score); ties to smaller ids."""
    near = unit(queries) @ unit(x).T
    near[own[:, None] == ids[None, :]] = -np.inf
    for i, row in enumerate(near):
        there = np.flatnonzero(row > -np.inf)
        if len(there) > k:
            cut = np.partition(row[there], -k)[-k]
            there = there[row[there] >= cut - 1e-9]  # the product of matrices may be off in its last places
        if len(there):
            score = cosines(queries[i], x[there])
            first = np.lexsort((ids[there], -score))[:k]
            yield i, there[first], score[first]


def _collected(found: list) -> dict:
    cat = lambda j, kind: np.concatenate([f[j] for f in found]) if found else np.zeros(0, kind)
    return {"query_id": cat(0, np.int64), "vec_id": cat(1, np.int64), "score": cat(2, float)}


def _table(cols: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols["query_id"], pa.int64()), pa.array(cols["vec_id"], pa.int64()), pa.array(cols["score"], pa.float64())],
                                      names=["query_id", "vec_id", "score"])


def top(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the best `k` distinct partners of every query."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scanned(vecs: DataFrame, queries: list, dim: int, k: int) -> DataFrame:
    """The nearest rows of a few queries held by the driver, by one scan of all rows."""
    own, asked = np.array([q.vec_id for q in queries], np.int64), np.zeros((len(queries), dim))
    for i, q in enumerate(queries):
        asked[i, :len(q.v)] = q.v

    def scan(batches):
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), dim)
                yield _table(_collected([(np.full(len(rows), own[i]), ids[rows], score) for i, rows, score in best_in(asked, ids, x, own, k)]))

    return top(vecs.mapInArrow(scan, _FOUND), k)


def probes_needed(vecs: DataFrame, asked: DataFrame, hashing: Hashing, k: int) -> int:
    """How many buckets of each table a query visits: the least number that reaches RECALL of the true neighbours of a
    sample of at most SAMPLE queries, drawn by the hash of their id."""
    sample = asked.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    truth = scanned(vecs, sample, hashing.dim, k).select("query_id", F.col("vec_id").alias("near_id"))
    near = truth.join(vecs.groupBy("vec_id").agg(F.first("v").alias("v")), truth.near_id == F.col("vec_id")).select("query_id", "v").collect()  # at most SAMPLE * k rows
    if not near:
        return 1
    pad = lambda rows: np.array([list(r.v) + [0.0] * (hashing.dim - len(r.v)) for r in rows])
    x, q = unit(pad(near)), unit(pad(sample))
    at = np.array([{r.vec_id: i for i, r in enumerate(sample)}[r.query_id] for r in near])
    need = np.full(len(near), MOST_PROBES)
    for t in range(hashing.tables):
        hit = hashing.probes(q, t, MOST_PROBES)[at] == hashing.bucket(x, t)[:, None]
        need = np.minimum(need, np.where(hit.any(1), hit.argmax(1) + 1, MOST_PROBES))
    return int(np.quantile(need, RECALL, method="higher"))


def _entries(df: DataFrame, hashing: Hashing, probes: int, whole: bool = True) -> DataFrame:
    """(t, bucket, vec_id, v): every row once a table, or once for each of the first `probes` buckets. v holds the components
    as bytes of their own type; without `whole` it stays null."""
    kind = np.float32 if df.schema["v"].dataType.simpleString() == "array<float>" else np.float64

    def run(batches):
        for b in batches:
            step = max(1, 65536 // probes)
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                ids, x = part.column(0).to_numpy(), _matrix(part.column(1), hashing.dim)
                raw, u = pa.array([r.tobytes() if whole else None for r in x.astype(kind)], pa.binary()), unit(x)
                for t in range(hashing.tables):
                    buckets = hashing.probes(u, t, probes) if probes > 1 else hashing.bucket(u, t)[:, None]
                    rows = np.repeat(np.arange(len(ids)), buckets.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(buckets.ravel()), pa.array(ids[rows]), raw.take(pa.array(rows))],
                                                     names=["t", "bucket", "vec_id", "v"])

    return df.mapInArrow(run, "t int, bucket long, vec_id long, v binary")


def _meet(vecs: DataFrame, queries: DataFrame, hashing: Hashing, probes: int, k: int, staged: Stages) -> DataFrame:
    """The `k` nearest of every query within each bucket it visits, large buckets cut into blocks of some CHUNK vectors and ASKED
    queries.

    A bucket of c vectors and q queries becomes ceil(c / CHUNK) x ceil(q / ASKED) cells, so that no task holds a whole hot
    bucket. Only buckets that need a cut are listed. Cells are addressed by one hash of their place; two cells under one
    hash would only be ranked together.
    """
    place = ["t", "bucket"]
    kind = np.float32 if vecs.schema["v"].dataType.simpleString() == "array<float>" else np.float64
    sizes = (_entries(vecs, hashing, 1, False).select(*place, F.lit(1).alias("c"), F.lit(0).alias("q"))
             .unionByName(_entries(queries, hashing, probes, False).select(*place, F.lit(0).alias("c"), F.lit(1).alias("q"))))
    cut = staged.add(sizes.groupBy(place).agg(F.sum("c").alias("c"), F.sum("q").alias("q")).filter((F.col("c") > CHUNK) | (F.col("q") > ASKED))
                     .select(*place, F.ceil(F.col("c") / CHUNK).cast("int").alias("parts"), F.ceil(F.col("q") / ASKED).cast("int").alias("asks")))

    def dealt(rows: DataFrame, mine: str, other: str, is_query: bool) -> DataFrame:
        n, copies = F.coalesce(F.col(mine), F.lit(1)), F.greatest(F.coalesce(F.col(other), F.lit(1)), F.lit(1))
        rows = (rows.join(cut, place, "left").withColumn("_own", F.pmod(F.xxhash64("vec_id", F.lit(3)), n).cast("int"))
                .withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))))
        at = ("_copy", "_own") if is_query else ("_own", "_copy")
        return rows.select(F.xxhash64(*place, *at).alias("cell"), F.lit(is_query).alias("is_query"), "vec_id", "v")

    def rank(group: pa.Table) -> pa.Table:
        asks, ids = group.column("is_query").to_numpy(), group.column("vec_id").to_numpy()
        flat = group.column("v").to_pylist()
        x = np.frombuffer(b"".join(flat), kind).reshape(len(flat), -1).astype(np.float64)
        rows, found = np.flatnonzero(~asks), []
        for at in np.array_split(np.flatnonzero(asks), max(1, math.ceil(asks.sum() / ASKED))):
            if len(rows) and len(at):
                found += [(np.full(len(r), ids[at[i]]), ids[rows[r]], s) for i, r, s in best_in(x[at], ids[rows], x[rows], ids[at], k)]
        return pa.Table.from_batches([_table(_collected(found))])

    cells = dealt(_entries(vecs, hashing, 1), "parts", "asks", False).unionByName(dealt(_entries(queries, hashing, probes), "asks", "parts", True))
    return cells.groupBy("cell").applyInArrow(rank, _FOUND)


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 5, tables: int = TABLES, bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query the `k` rows of largest cosine found, itself excepted.

    Null and zero vectors, those with null or non-finite components and rows without id take no part. Vectors of different
    lengths are compared as if the shorter ended in zeros. Rows of one vec_id are one vector to its neighbours (the best of
    their scores counts) and never neighbours of each other; ties go to the smaller vec_id. An empty table, or one without a
    query, gives no rows; other columns are ignored.

    Every row is stored once in each of `tables` hash tables; bits grow with the rows so that a bucket holds `bucket` of
    them on average, and larger ones are cut into blocks, never capped. A query visits as many buckets as a bounded sample
    needs (`probes_needed`); candidates are ranked by exact cosines in double where they meet. Queries that meet fewer than `k`
    partners are compared with all rows in blocks. The shuffle moves `tables` copies of the vectors.
    """
    spark = vectors.sparkSession
    staged = Stages()
    vecs = staged.add(usable(vectors))
    size = vecs.agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.max(F.size("v")).alias("dim")).first()
    asked = usable(queries)
    if not size.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = Hashing(size.dim, max(0, round(math.log2(size.n / bucket))), tables)
    found = staged.add(top(_meet(vecs, asked, hashing, probes_needed(vecs, asked, hashing, k), k, staged), k))
    few = min(k, size.ids - 1)
    enough = found.groupBy("query_id").count().filter(F.col("count") >= few).select(F.col("query_id").alias("vec_id"))
    short = staged.add(asked.join(enough, "vec_id", "left_anti"))
    if short.isEmpty():
        staged.drop(vecs, short)
        return found
    whole = staged.add(top(_meet(vecs, short, Hashing(size.dim, 0, 1), 1, k, staged), k))
    return found.join(whole.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)


def op12(spark, sf_dir):
    from .common import table

    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.filter("vec_id % 50 = 0"))
