"""Exact Euclidean distances on pixel grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .raster import boundary_pixels

STRIP = 64
BLOCK = 64
# Fixed value: exp of anything below is 0.0 in a double.
EXP_ZERO = -746.0


def lower_envelope(g: np.ndarray) -> np.ndarray:
    """min over y' of (y - y')^2 + g[y', x] for every y and column x; g may be infinite.

    One pass down stacks, for all columns at once, the parabolas that are lowest somewhere and where each begins; one more
    reads them off.
    """
    n, m = g.shape
    cols, rows = np.arange(m), np.arange(n, dtype=float)
    root = np.zeros((n, m), np.int64)  # rows of the stacked parabolas
    begin = np.full((n + 1, m), np.inf)
    top = np.full(m, -1)
    lift = g + (rows * rows)[:, None]
    for y in range(n):
        c = cols[np.isfinite(g[y])]
        at = np.full(m, -np.inf)
        open_ = c[top[c] >= 0]
        while len(open_):
            under = root[top[open_], open_]
            at[open_] = (lift[y, open_] - lift[under, open_]) / (2.0 * (y - under))
            hidden = at[open_] <= begin[top[open_], open_]
            top[open_[hidden]] -= 1
            gone = open_[hidden]
            at[gone] = -np.inf
            open_ = gone[top[gone] >= 0]
        top[c] += 1
        root[top[c], c] = y
        begin[top[c], c], begin[top[c] + 1, c] = at[c], np.inf
    out = np.full((n, m), np.inf)
    cols = cols[top >= 0]
    now = np.zeros(len(cols), np.int64)
    for y in range(n if len(cols) else 0):
        while True:
            later = begin[now + 1, cols] < y
            if not later.any():
                break
            now += later
        under = root[now, cols]
        out[y, cols] = (y - under) ** 2 + g[under, cols]
    return out


def distance_map(grid: DataFrame, target: str, keys=("image_id",), rmax: int | None = None) -> DataFrame:
    """Adds `distance`: to the nearest pixel with a true `target` in the same image; null if there is none (or none within
    `rmax` rows and that distance). `grid` is dense.

    First the nearest target along the row, by running windows over single rows; then the minimum over the rows of each
    column, by the lower envelope of parabolas in Arrow batches of a few columns: linear in the pixels, and no task holds
    more than a strip of an image.
    """
    keys = list(keys)
    at = F.when(F.col(target), F.col("x"))
    left = F.last(at, ignorenulls=True).over(Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    right = F.last(at, ignorenulls=True).over(Window.partitionBy(*keys, "y").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0))
    rows = grid.withColumn("_g", F.least(F.col("x") - left, right - F.col("x")).cast("double"))
    schema = T.StructType([*grid.schema.fields, T.StructField("distance", T.DoubleType())])

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        y0, x0 = y.min(), x.min()
        g = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.inf)
        g[y - y0, x - x0] = pdf["_g"].to_numpy(dtype=float, na_value=np.inf) ** 2
        out = np.sqrt(lower_envelope(g)[y - y0, x - x0])
        out[~np.isfinite(out) | (out > rmax if rmax is not None else False)] = np.nan
        pdf["distance"] = pd.array(out, dtype="Float64")
        return pdf.drop(columns=["_g", "_s"])

    return rows.withColumn("_s", F.floor(F.col("x") / STRIP)).groupBy(*keys, "_s").applyInPandas(down, schema)


def weight_map(pixels: DataFrame, height: int, width: int, sigma: float = 5.0, w0: float = 10.0, keys=("image_id",)) -> DataFrame:
    """(keys, y, x, weight): w0 * exp(-((d1 + d2) / sigma)^2 / 2) outside the instances, d1 and d2 being the distances to the
    two nearest ones (equal distances count twice). Pixels not listed weigh 0, as do all of an image with one instance.

    Beyond a radius that follows from sigma the weight is 0.0 in a double, so each boundary pixel is sent only to the blocks
    within that radius; every block is solved from its own boundary pixels.
    """
    keys = list(keys)
    reach = int(math.ceil(sigma * math.sqrt(-2 * EXP_ZERO)))
    inst = pixels.filter("inst_id > 0").select(*keys, "inst_id", "y", "x")
    edge = boundary_pixels(inst, (*keys, "inst_id"))

    def span(c: str, size: int):
        lo, hi = F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(size - 1))
        return F.explode(F.sequence(F.floor(lo / BLOCK).cast("int"), F.floor(hi / BLOCK).cast("int")))

    sent = edge.withColumn("_by", span("y", height)).withColumn("_bx", span("x", width))
    key_fields = [f for f in inst.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("weight", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf["_by"].iloc[0]) * BLOCK, int(pdf["_bx"].iloc[0]) * BLOCK
        yy, xx = np.mgrid[y0:min(y0 + BLOCK, height), x0:min(x0 + BLOCK, width)]
        near = np.full((2, *yy.shape), np.inf)
        for _, g in pdf.groupby("inst_id"):
            ty, tx = g["y"].to_numpy(), g["x"].to_numpy()
            d = np.full(yy.shape, np.inf)
            for a in range(0, len(ty), 64):
                part = (yy[..., None] - ty[a:a + 64]) ** 2 + (xx[..., None] - tx[a:a + 64]) ** 2
                d = np.minimum(d, part.min(axis=2))
            near = np.sort(np.concatenate([near, d[None]]), axis=0)[:2]
        w = w0 * np.exp(-(((np.sqrt(near[0]) + np.sqrt(near[1])) / sigma) ** 2) / 2)
        ok = w > 0
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * int(ok.sum()) for k in keys})
        out["y"], out["x"], out["weight"] = yy[ok], xx[ok], w[ok]
        return out

    w = sent.groupBy(*keys, "_by", "_bx").applyInPandas(solve, schema)
    return w.join(inst.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
