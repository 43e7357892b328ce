"""Cutting grids into overlapping patches, stitching them back, cropping and batching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import pad
from .graph import prefix_total

# Fixed value: pixels added before the size is rounded up to whole patches.
EXTRA_PAD = 200


def margins(size: Column, patch: int) -> Column:
    """Margin put on BOTH sides of an axis."""
    return (F.ceil((size + EXTRA_PAD) / patch) * patch - size).cast("int")


def margin_of(size: int, patch: int) -> int:
    return -(-(size + EXTRA_PAD) // patch) * patch - size


def reflect_pad(grid: DataFrame, height: int, width: int, my: int, mx: int) -> DataFrame:
    """Mirror without repeating the edge, as often as the margin needs; padded coordinates start at 0."""
    out = pad(grid, height, width, my, mx, "reflect")
    return out.withColumn("y", F.col("y") + my).withColumn("x", F.col("x") + mx)


def tiles_along(size: int, patch: int, stride: int, margin: int = 0) -> int:
    return (size + 2 * margin - patch) // stride + 1


def _covering(c: str, patch: int, stride: int, n: int) -> Column:
    lo = F.greatest(F.lit(0), F.ceil((F.col(c) - patch + 1) / stride).cast("int"))
    hi = F.least(F.lit(n - 1), F.floor(F.col(c) / stride).cast("int"))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def extract_patches(grid: DataFrame, height: int, width: int, patch: tuple[int, int], stride: int, margin: tuple[int, int] | None = None,
                    padding: bool = True) -> DataFrame:
    """Sliding windows: each pixel explodes to the patches that cover it; (patch_id, py, px) replace (y, x).

    Patch ids run row by row. There is no join and no shuffle; project the columns you need before, as overlapping
    windows multiply the rows by about (patch / stride) squared.
    """
    ph, pw = patch
    my, mx = ((margin_of(height, ph), margin_of(width, pw)) if margin is None else margin) if padding else (0, 0)
    g = reflect_pad(grid, height, width, my, mx) if padding else grid
    ny, nx = tiles_along(height, ph, stride, my), tiles_along(width, pw, stride, mx)
    g = g.withColumn("_ty", F.explode(_covering("y", ph, stride, ny))).withColumn("_tx", F.explode(_covering("x", pw, stride, nx)))
    return g.select(*[c for c in grid.columns if c not in ("y", "x")], (F.col("_ty") * nx + F.col("_tx")).alias("patch_id"),
                    (F.col("y") - F.col("_ty") * stride).alias("py"), (F.col("x") - F.col("_tx") * stride).alias("px"))


def _placed(patches: DataFrame, width: int, patch: tuple[int, int], stride: int, margin: tuple[int, int]) -> DataFrame:
    nx = tiles_along(width, patch[1], stride, margin[1])
    ty = F.floor(F.col("patch_id") / nx).cast("int")
    return (patches.withColumn("y", ty * stride + F.col("py") - margin[0])
            .withColumn("x", (F.col("patch_id") - ty * nx) * stride + F.col("px") - margin[1]).drop("patch_id", "py", "px"))


def _cut(df: DataFrame, height: int, width: int) -> DataFrame:
    return df.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def stitch_crop(patches: DataFrame, height: int, width: int, patch: tuple[int, int], stride: int, margin=(0, 0)) -> DataFrame:
    """Keep the top-left stride x stride block of each patch; a filter and arithmetic, no shuffle."""
    own = patches.filter((F.col("py") < stride) & (F.col("px") < stride))
    return _cut(_placed(own, width, patch, stride, margin), height, width)


def stitch_mean(patches: DataFrame, height: int, width: int, patch: tuple[int, int], stride: int, columns, margin=(0, 0), keys=("image_id",)) -> DataFrame:
    """Average all patches that cover a pixel; the margin is cut before the shuffle, the mean has a map-side part."""
    g = _cut(_placed(patches, width, patch, stride, margin), height, width)
    return g.groupBy(*keys, "y", "x").agg(*[F.avg(c).alias(c) for c in columns])


def pyramid_weights(spark: SparkSession, width: int, height: int) -> DataFrame:
    """(px, py, weight): distance to the edge over distance to edge and centre, scaled to sum to width * height."""
    cells = spark.range(width * height).select(F.floor(F.col("id") / height).cast("int").alias("px"), (F.col("id") % height).cast("int").alias("py"))
    x, y = F.col("px") + 0.5, F.col("py") + 0.5
    centre = F.sqrt(F.pow(x - width * 0.5, F.lit(2.0)) + F.pow(y - height * 0.5, F.lit(2.0)))

    def edge(v, size):
        return F.sqrt(F.least(F.pow(v, F.lit(2.0)), F.pow(v - size, F.lit(2.0))) + 0.25)

    near = F.least(edge(x, width), edge(y, height))
    w = cells.withColumn("weight", near / (centre + near))
    return w.withColumn("weight", F.col("weight") * (width * height) / w.agg(F.sum("weight")).scalar())


def apply_weights(patches: DataFrame, weights: DataFrame, columns) -> DataFrame:
    """Multiply columns by the weight of their place in the patch; the table has one row per patch cell."""
    return (patches.join(weights, ["px", "py"])
            .select(*[(F.col(c) * F.col("weight")).alias(c) if c in columns else F.col(c) for c in patches.columns]))


def replicate(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))


def crop(grid: DataFrame, y0, x0, ch: int, cw: int) -> DataFrame:
    y, x = F.col("y") - y0, F.col("x") - x0
    return grid.filter(y.between(0, ch - 1) & x.between(0, cw - 1)).withColumn("y", y.cast("int")).withColumn("x", x.cast("int"))


def center_crop(grid: DataFrame, height: int, width: int, ch: int, cw: int) -> DataFrame:
    return crop(grid, height // 2 - ch // 2, width // 2 - cw // 2, ch, cw)


def hash_choice(n: int, seed: int, *cols: str) -> Column:
    """A stable pseudo-random number in 0..n-1 per key."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(n)).cast("int")


def rigid_transform(patches: DataFrame, side: int, choice: Column | None = None, seed: int = 0, y: str = "py", x: str = "px") -> DataFrame:
    """One of the eight square symmetries per patch, the same for every column of a pixel: identity, three quarter turns,
    left-right, up-down, both diagonals."""
    choice = hash_choice(8, seed, "image_id", "patch_id") if choice is None else choice
    r, c, m = F.col(y), F.col(x), side - 1
    moves = [(r, c), (m - c, r), (m - r, m - c), (c, m - r), (r, m - c), (m - r, c), (c, r), (m - c, m - r)]

    def pick(axis: int) -> Column:
        out = F.when(F.col("_k") == 0, moves[0][axis])
        for k, mv in enumerate(moves[1:], 1):
            out = out.when(F.col("_k") == k, mv[axis])
        return out

    d = patches.withColumn("_k", choice)
    return d.select(*[pick(0).alias(y) if n == y else pick(1).alias(x) if n == x else F.col(n) for n in patches.columns])


def random_crop(grid: DataFrame, height: int, width: int, ch: int, cw: int, seed: int = 0, keys=("image_id",)) -> DataFrame:
    """A crop whose place follows from a hash of the keys, so a retried task cuts the same window."""
    return crop(grid, hash_choice(height - ch + 1, seed, *keys), hash_choice(width - cw + 1, seed + 1, *keys), ch, cw)


def five_crops(grid: DataFrame, height: int, width: int) -> DataFrame:
    """The four quadrants and the centre; every pixel is sent to the crops that hold it, two at most."""
    h, w = height // 2, width // 2
    boxes = [("upper_left", 0, 0), ("upper_right", 0, w), ("lower_left", h, 0), ("lower_right", h, w), ("center", h // 2, w // 2)]
    y, x = F.col("y"), F.col("x")
    hits = F.array_compact(F.array(*[
        F.when(y.between(y0, y0 + h - 1) & x.between(x0, x0 + w - 1), F.struct(F.lit(n).alias("crop"), (y - y0).alias("y"), (x - x0).alias("x")))
        for n, y0, x0 in boxes]))
    return grid.withColumn("_c", F.explode(hits)).select("_c.crop", *[F.col(f"_c.{c}") if c in ("y", "x") else F.col(c) for c in grid.columns])


def assign_batches(df: DataFrame, size: int, keys=("image_id",), order: str = "patch_id") -> DataFrame:
    """Batch number of each row: rows of a key in order, cut into pieces of `size`."""
    n = prefix_total(df, keys, order, F.floor(F.col(order) / 4096))
    return n.withColumn("batch", F.floor(F.col("before") / size).cast("int")).drop("before")


def route_by_size(df: DataFrame, patch_width: int) -> DataFrame:
    return df.withColumn("route", F.when(F.col("width") > patch_width, "tile").otherwise("direct"))


def score_patches(df: DataFrame, make_predict_fn: Callable[[], Callable[[np.ndarray], dict]], feature: str, keep: list[str],
                  branches=("instances", "types", "aux", "sem"), batch_size: int = 1024) -> DataFrame:
    """Apply a model to the array column `feature`. `make_predict_fn` runs once per task and returns a function from a
    (batch, n) array to a dict of branch -> (batch, k) array; a branch that is missing becomes null."""
    fields = [f for f in df.schema.fields if f.name in keep]
    schema = T.StructType(fields + [T.StructField(b, T.ArrayType(T.DoubleType())) for b in branches])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = make_predict_fn()
        for pdf in parts:
            for at in range(0, len(pdf), batch_size):
                piece = pdf.iloc[at:at + batch_size]
                got = predict(np.stack(piece[feature].to_numpy()).astype(np.float64))
                out = piece[keep].reset_index(drop=True)
                for b in branches:
                    out[b] = list(got[b]) if got.get(b) is not None else None
                yield out

    return df.select(*keep, feature).mapInPandas(run, schema)
