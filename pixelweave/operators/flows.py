"""Instances from gradient flows: follow the flow of every pixel, then group pixels by where they end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .components import BLOCK, ROW
from .graph import dense_number

# Fixed values of the method.
MIN_FLOW = 1e-3
SEED_COUNT = 10
GROW_COUNT = 2
GROW_STEPS = 5
HALO = 2


def follow_flows(pixels: DataFrame, height: int, width: int, niter: int = 200, keys=("image_id",), block: int = BLOCK) -> DataFrame:
    """(keys, y, x, py, px): where each pixel of (keys, y, x, fy, fx) ends after `niter` Euler steps against the flow.

    The flow is sampled bilinearly at p * size / (size - 1) - 0.5 with zeros outside the image, and positions are clamped
    to the image; pixels with |fx| <= 1e-3 stay. A particle walks inside the block it is in; when it leaves, it is shuffled
    to the next block with the steps it has left. Rounds end when all particles are done, resting ones at once.
    """
    keys = list(keys)
    by, bx = F.floor(F.col("_py") / block).cast("int"), F.floor(F.col("_px") / block).cast("int")
    field = pixels.select(*keys, "y", "x", F.col("fy").cast("double").alias("fy"), F.col("fx").cast("double").alias("fx"))

    def spread(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - HALO) / block).cast("int"), F.floor((F.col(c) + HALO) / block).cast("int")))

    field_b = stage(field.withColumn("_by", spread("y")).withColumn("_bx", spread("x")))
    part = field.select(*keys, "y", "x", F.col("y").cast("double").alias("_py"), F.col("x").cast("double").alias("_px"),
                        F.when(F.abs("fx") > MIN_FLOW, niter).otherwise(0).cast("int").alias("left"))
    part = part.withColumn("_by", by).withColumn("_bx", bx)
    schema = part.schema

    def walk(p: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return p
        y0, x0 = int(p["_by"].iloc[0]) * block - HALO, int(p["_bx"].iloc[0]) * block - HALO
        size = block + 2 * HALO + 1
        dense = np.zeros((2, size, size))
        dense[:, f["y"].to_numpy() - y0, f["x"].to_numpy() - x0] = f[["fy", "fx"]].to_numpy().T
        pos = p[["_py", "_px"]].to_numpy()
        left = p["left"].to_numpy().copy()
        limit, scale = np.array([height - 1.0, width - 1.0]), np.array([height / (height - 1), width / (width - 1)])
        live = np.flatnonzero(left > 0)
        while len(live):
            at = pos[live]
            s = at * scale - 0.5
            lo = np.floor(s).astype(int)
            wy, wx = (s - lo).T
            i, j = (lo - [y0, x0]).T
            flow = (dense[:, i, j] * (1 - wy) * (1 - wx) + dense[:, i, j + 1] * (1 - wy) * wx
                    + dense[:, i + 1, j] * wy * (1 - wx) + dense[:, i + 1, j + 1] * wy * wx).T
            new = np.clip(at - flow, 0.0, limit)
            rest = (new == at).all(axis=1)
            pos[live] = new
            left[live] = np.where(rest, 0, left[live] - 1)
            home = (new >= [y0 + HALO, x0 + HALO]).all(axis=1) & (new < [y0 + HALO + block, x0 + HALO + block]).all(axis=1)
            live = live[home & (left[live] > 0)]
        p = p.assign(_py=pos[:, 0], _px=pos[:, 1], left=left)
        return p.assign(_by=np.floor(p["_py"] / block).astype(int), _bx=np.floor(p["_px"] / block).astype(int))

    done = part.filter("left = 0")
    todo = part.filter("left > 0")
    bk = [*keys, "_by", "_bx"]
    first = True
    while True:
        here = field_b if first else field_b.join(todo.select(*bk).distinct(), bk, "left_semi")
        moved = stage(todo.groupBy(*bk).cogroup(here.groupBy(*bk)).applyInPandas(walk, schema))
        done = done.unionByName(moved.filter("left = 0"))
        todo, first = moved.filter("left > 0"), False
        if todo.isEmpty():
            return done.select(*keys, "y", "x", F.col("_py").alias("py"), F.col("_px").alias("px"))


def _offsets(r: int):
    span = range(-r, r + 1)
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in span for b in span]))


def _shifted(df: DataFrame, r: int, *cols: str) -> DataFrame:
    d = df.withColumn("_o", _offsets(r))
    return d.select(*cols, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"))


def sink_masks(endpoints: DataFrame, height: int, width: int, keys=("image_id",)) -> DataFrame:
    """(keys, y, x, inst_id) from the end points (keys, y, x, py, px) of the foreground pixels.

    End points are counted per pixel, a background pixel counting itself. Seeds are cells with more than 10 that are the
    maximum of their 5 x 5 surroundings; each grows five times into neighbours with more than 2, later seeds on top. A
    pixel belongs to the seed its end point falls on.
    """
    keys = list(keys)
    ends = stage(endpoints.select(*keys, "y", "x", F.col("py").cast("int").alias("ey"), F.col("px").cast("int").alias("ex")))
    fg = ends.select(*keys, "y", "x", F.lit(0).alias("_bg"))
    h = ends.groupBy(*keys, F.col("ey").alias("y"), F.col("ex").alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    h = (h.join(fg, [*keys, "y", "x"], "left").select(*keys, "y", "x", (F.col("_n") + F.coalesce("_bg", F.lit(1))).alias("h"), F.col("_bg").isNull().alias("bg")))
    cells = stage(h.filter(F.col("h") > GROW_COUNT))
    high = cells.filter(F.col("h") > SEED_COUNT)
    peak = _shifted(high, 2, *keys, "h").groupBy(*keys, "y", "x").agg(F.max("h").alias("_top"))
    seeds = (high.join(peak, [*keys, "y", "x"]).filter("h >= _top")
             .select(*keys, (F.col("y").cast("long") * ROW + F.col("x")).alias("seed"), "y", "x"))
    region = stage(seeds)
    for _ in range(GROW_STEPS):
        region = _shifted(region, 1, *keys, "seed").distinct().join(cells.select(*keys, "y", "x"), [*keys, "y", "x"])
    owner = stage(region.groupBy(*keys, "y", "x").agg(F.max("seed").alias("seed")))
    got = ends.join(owner.select(*keys, F.col("y").alias("ey"), F.col("x").alias("ex"), "seed"), [*keys, "ey", "ex"]).select(*keys, "y", "x", "seed")
    # background pixels lie on themselves
    still = owner.join(cells.filter("bg").select(*keys, "y", "x"), [*keys, "y", "x"]).select(*keys, "y", "x", "seed")
    all_ = got.unionByName(still)
    return all_.join(dense_number(all_, keys, "seed", ROW * 64, "inst_id"), [*keys, "seed"]).select(*keys, "y", "x", "inst_id")
