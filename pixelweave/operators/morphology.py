"""Binary morphology on sparse pixels: spans within blocks, or literal offset lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import disk, ellipse
from .components import BLOCK, label
from .spans import Rows, Sheet, element_rows, expand, runs_of


def _inside(y: Column, x: Column, height: int | Column, width: int | Column) -> Column:
    return y.between(0, height - 1) & x.between(0, width - 1)


def coverage(pixels: DataFrame, offsets, height: int, width: int, keys=("image_id",)) -> DataFrame:
    """(keys, y, x, hits): how many offsets around each pixel fall on the set.

    Every pixel is exploded over the offsets and counted, with the count reduced on the map side; pixels never meet
    pixels in a join.
    """
    shifts = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    near = pixels.select(*keys, "y", "x", F.explode(shifts).alias("_o"))
    near = near.select(*keys, (F.col("y") - F.col("_o.dy")).alias("y"), (F.col("x") - F.col("_o.dx")).alias("x"))
    return near.filter(_inside(F.col("y"), F.col("x"), height, width)).groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("hits"))


def full_hits(offsets, height: int, width: int) -> Column:
    """Number of offsets that stay inside the image: cells outside never erode."""
    cells = [_inside(F.col("y") + dy, F.col("x") + dx, height, width).cast("int") for dy, dx in offsets]
    deep = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    core = F.col("y").between(deep, height - 1 - deep) & F.col("x").between(deep, width - 1 - deep)
    return F.when(core, len(cells)).otherwise(sum(cells[1:], cells[0]))


def _in_blocks(pixels: DataFrame, steps: list[tuple[str, Rows]], height: int | str, width: int | str, keys, finish=None) -> DataFrame:
    """Run steps of dilation and erosion on every key's pixels, in square blocks that see as far around as all steps reach.

    One shuffle by the first key and block, whatever the number of steps and the size of the elements: a pixel is sent once,
    and again only to blocks within reach. In a block the pixels become spans. `finish` may compare the first and last spans.
    """
    keys, block = list(keys), BLOCK
    reach = sum(max(max(abs(dy), abs(lo), abs(hi)) for dy, lo, hi in rows) for _, rows in steps)
    size = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    near = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - reach) / block), F.lit(0)).cast("int"),
                                             F.floor(F.least(F.col(c) + reach, F.col(n) - 1) / block).cast("int")))
    src = pixels.select(*keys, "y", "x", size(height).alias("_h"), size(width).alias("_w")).filter(_inside(F.col("y"), F.col("x"), F.col("_h"), F.col("_w")))
    sent = src.withColumn("_by", near("y", "_h")).withColumn("_bx", near("x", "_w"))
    schema = pixels.select(*keys, "y", "x").schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        by, bx = int(pdf["_by"].iloc[0]) * block, int(pdf["_bx"].iloc[0]) * block
        code = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy(np.int64)
        first = np.unique(code, return_index=True)[1]
        sheet = Sheet(by - reach, block + 2 * reach, int(pdf["_h"].iloc[0]), int(pdf["_w"].iloc[0]))
        line, x = code * sheet.tall + pdf["y"].to_numpy(np.int64) - sheet.top, pdf["x"].to_numpy(np.int64)
        order = np.lexsort((x, line))
        spans = start = runs_of(line[order], x[order])
        for op, rows in steps:
            spans = sheet.dilate(spans, rows) if op == "dilate" else sheet.erode(spans, rows)
        line, x = expand(*spans) if finish is None else finish(sheet, start)
        y = line % sheet.tall + sheet.top
        own = (y >= by) & (y < by + block) & (x >= bx) & (x < bx + block)
        out = pdf[keys].iloc[first[line[own] // sheet.tall]].reset_index(drop=True)
        return out.assign(y=y[own], x=x[own])

    return sent.groupBy(*dict.fromkeys([keys[0], "_by", "_bx", "_h", "_w"])).applyInPandas(solve, schema)


def morph(pixels: DataFrame, op: str, offsets, height: int | str, width: int | str, keys=("image_id",)) -> DataFrame:
    """Dilate or erode; add the id to `keys` to treat every instance on its own.

    `height` and `width` are numbers, or names of columns with the size of each row's image. Cells outside the image never
    erode. Elements whose rows have gaps are counted offset by offset.
    """
    if op not in ("erode", "dilate"):
        raise ValueError(f"unknown operation {op}")
    rows = element_rows(offsets)
    if rows is not None:
        return _in_blocks(pixels, [(op, rows)], height, width, keys)
    c = coverage(pixels, offsets, height, width, keys)
    if op == "erode":
        c = c.filter(F.col("hits") == full_hits(offsets, height, width))
    return c.drop("hits")


def remove_1px_boundary(pixels: DataFrame, height: int, width: int, keys=("image_id",)) -> DataFrame:
    """Each instance eroded by a disk of 1."""
    return morph(pixels.filter("inst_id > 0"), "erode", disk(1), height, width, (*keys, "inst_id"))


def close_with_disk(pixels: DataFrame, radius: int, height: int | str, width: int | str, keys=("image_id",)) -> DataFrame:
    """Dilation and erosion by a disk in one exchange."""
    rows = element_rows(disk(radius))
    return _in_blocks(pixels, [("dilate", rows), ("erode", rows)], height, width, keys)


def open_pixels(pixels: DataFrame, height: int | str, width: int | str, iterations: int = 2, keys=("image_id",)) -> DataFrame:
    rows = element_rows(ellipse(5))
    return _in_blocks(pixels, [("erode", rows)] * iterations + [("dilate", rows)] * iterations, height, width, keys)


def close_pixels(pixels: DataFrame, height: int | str, width: int | str, iterations: int = 2, keys=("image_id",)) -> DataFrame:
    rows = element_rows(ellipse(5))
    return _in_blocks(pixels, [("dilate", rows)] * iterations + [("erode", rows)] * iterations, height, width, keys)


def opening(pixels: DataFrame, height: int, width: int, iterations: int = 2, keys=("image_id",)) -> DataFrame:
    """Foreground opened with a 5 x 5 ellipse and labelled again."""
    return label(open_pixels(pixels.filter("inst_id > 0"), height, width, iterations, keys), keys, out="inst_id")


def closing(pixels: DataFrame, height: int, width: int, iterations: int = 2, keys=("image_id",)) -> DataFrame:
    """Foreground closed with a 5 x 5 ellipse and labelled again."""
    return label(close_pixels(pixels.filter("inst_id > 0"), height, width, iterations, keys), keys, out="inst_id")


def contours(pixels: DataFrame, height: int | str, width: int | str, thickness: int = 1, keys=("image_id",)) -> DataFrame:
    """Pixels in the dilation but not in the erosion of some instance."""
    rows = element_rows(disk(thickness))

    def edge(sheet: Sheet, spans):
        (line, x), (inner, at) = expand(*sheet.dilate(spans, rows)), expand(*sheet.erode(spans, rows))
        wide = int(max(x.max(initial=0), at.max(initial=0))) + 1
        rim = ~np.isin(line * wide + x, inner * wide + at)
        return line[rim], x[rim]

    out = _in_blocks(pixels.filter("inst_id > 0"), [("dilate", rows)], height, width, (*keys, "inst_id"), edge)
    return out.select(*keys, "y", "x").distinct()
