"""Connected components of pixels that share a layer value.

Pixels are shuffled once by (keys, square block). Every block is labelled on its own in one Arrow batch of bounded size,
so one huge image is as parallel as many small ones. Only pixels on block borders take part in the join that links
blocks, and only those links, a table far smaller than the pixels, go through the star contraction of `graph`.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .graph import dense_number, graph_components

BLOCK = 256
ROW = 1 << 32      # a pixel position as one number: y * ROW + x


def _neighbour_roots(layer: np.ndarray, y: np.ndarray, x: np.ndarray, diagonal: bool) -> np.ndarray:
    """Index of the first pixel (by layer, y, x) of the component of every pixel; inputs are sorted that way."""
    width, height = int(x.max() - x.min()) + 2, int(y.max() - y.min()) + 2
    key = (layer * height + (y - y.min())) * width + (x - x.min())
    src, dst = [], []
    for step in (1, width) + ((width - 1, width + 1) if diagonal else ()):
        at = np.searchsorted(key, key + step)
        ok = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step)
        if step == width - 1:
            ok &= x > x.min()
        src.append(np.flatnonzero(ok))
        dst.append(at[ok])
    src, dst = np.concatenate(src), np.concatenate(dst)
    root = np.arange(len(key))
    while True:
        a, b = root[src], root[dst]
        if np.array_equal(a, b):
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _names(layer: str | list[str] | None) -> list[str]:
    return [layer] if isinstance(layer, str) else list(layer or [])


def connected_pixels(pixels: DataFrame, keys: Iterable[str] = ("image_id",), layer: str | list[str] | None = None,
                     connectivity: int = 1, block: int = BLOCK) -> DataFrame:
    """(keys, layer, y, x, root): root is the position of the raster-first pixel of the component."""
    keys = list(keys)
    lay = _names(layer)
    diagonal = connectivity > 1

    def label_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*lay, "y", "x"], ignore_index=True)
        y, x = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
        code = pdf.groupby(lay, sort=False).ngroup().to_numpy(np.int64) if lay else np.zeros(len(pdf), np.int64)
        root = _neighbour_roots(code, y, x, diagonal)
        pdf["root"] = y[root] * ROW + x[root]
        return pdf.drop(columns=["_by", "_bx"])

    src = pixels.select(*keys, *lay, "y", "x")
    schema = T.StructType([*src.schema.fields, T.StructField("root", T.LongType())])
    local = (src.withColumn("_by", F.floor(F.col("y") / block)).withColumn("_bx", F.floor(F.col("x") / block))
             .groupBy(*keys, "_by", "_bx").applyInPandas(label_block, schema))
    local = stage(local)

    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    on = [*keys, *lay, "y", "x"]
    last_row, last_col, first_col = F.col("y") % block == block - 1, F.col("x") % block == block - 1, F.col("x") % block == 0
    rim = local.filter(last_row | last_col | (first_col if diagonal else F.lit(False)))
    moved = rim.select(*keys, *lay, F.col("root").alias("a"), F.explode(F.array(*[
        F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("_n"))
    moved = moved.select(*keys, *lay, "a", "_n.y", "_n.x")
    first = local.filter((F.col("y") % block == 0) | first_col | (last_col if diagonal else F.lit(False)))
    links = (moved.join(first.withColumnRenamed("root", "b"), on).filter("a <> b")
             .select(*keys, *lay, "a", "b").distinct())
    links = stage(links)
    if links.isEmpty():
        return local
    roots = graph_components(links, [*keys, *lay]).withColumnRenamed("root", "_r").withColumnRenamed("node", "root")
    return (local.join(roots, [*keys, *lay, "root"], "left")
            .select(*keys, *lay, "y", "x", F.coalesce("_r", "root").alias("root")))


def label(pixels: DataFrame, keys=("image_id",), layer: str | list[str] | None = None, connectivity: int = 1,
          min_size: int = 0, block: int = BLOCK, out: str = "label") -> DataFrame:
    """(keys, layer, y, x, label): components numbered from 1 by raster order of their first pixel.

    Numbers run within keys and layer. Components under `min_size` pixels are left out before numbering.
    """
    comp = connected_pixels(pixels, keys, layer, connectivity, block)
    keys = [*keys, *_names(layer)]
    sizes = comp.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size)
    numbers = dense_number(sizes, keys, "root", ROW * 64, out)
    return comp.join(numbers, [*keys, "root"]).select(*keys, "y", "x", out)


def remove_small_components(pixels: DataFrame, min_size: int = 64, keys=("image_id",), connectivity: int = 1,
                            layer: str | list[str] | None = None) -> DataFrame:
    """Pixels of a sparse boolean map (or of each layer) whose component has at least `min_size` pixels."""
    ks = [*keys, *_names(layer)]
    if min_size == 0:
        return pixels.select(*ks, "y", "x")
    comp = connected_pixels(pixels, keys, layer, connectivity)
    keep = comp.groupBy(*ks, "root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size)
    return comp.join(keep.drop("_n"), [*ks, "root"], "left_semi").select(*ks, "y", "x")
