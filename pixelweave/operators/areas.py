"""Cleaning of semantic area maps: small areas and holes take the label that surrounds them.

The definition handles components one after another, each seeing what earlier ones left. Only components whose padded
boxes overlap can influence each other, so they are put into rounds: a component waits for the earlier ones it overlaps,
and all components of a round are handled at once. The result is that of the sequential order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import connected_pixels
from .instances import BOX_PAD, bounding_box

CELL = 64


def _on_cells(boxes: DataFrame) -> DataFrame:
    """Each box once per grid cell it touches."""
    return (boxes.withColumn("_gy", F.explode(F.sequence(F.floor(F.col("y1") / CELL), F.floor((F.col("y2") - 1) / CELL))))
            .withColumn("_gx", F.explode(F.sequence(F.floor(F.col("x1") / CELL), F.floor((F.col("x2") - 1) / CELL)))))


def _inside(pixels: DataFrame, boxes: DataFrame, keys) -> DataFrame:
    """Pixels joined with the boxes that hold them: an equi-join on grid cells, then the exact test."""
    p = pixels.withColumn("_gy", F.floor(F.col("y") / CELL)).withColumn("_gx", F.floor(F.col("x") / CELL))
    return (p.join(_on_cells(boxes), [*keys, "_gy", "_gx"])
            .filter((F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")) & (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2"))))


def _rounds(boxes: DataFrame, keys) -> DataFrame:
    """Adds `round`: one more than the largest round among earlier overlapping boxes (order of `root`)."""
    b = _on_cells(boxes)
    o = b.select(*keys, "_gy", "_gx", F.col("root").alias("_r"), *[F.col(c).alias(f"_{c}") for c in ("y1", "y2", "x1", "x2")])
    deps = stage(b.join(o, [*keys, "_gy", "_gx"]).filter(
        (F.col("_r") < F.col("root")) & (F.col("_y1") < F.col("y2")) & (F.col("y1") < F.col("_y2")) & (F.col("_x1") < F.col("x2")) & (F.col("x1") < F.col("_x2")))
        .select(*keys, "root", "_r").distinct())
    out = boxes.withColumn("round", F.lit(0))
    if deps.isEmpty():
        return out
    out, before = stage(out), -1
    while True:
        total = out.agg(F.sum("round")).first()[0]
        if total == before:
            return out
        before = total
        late = (deps.join(out.select(*keys, F.col("root").alias("_r"), F.col("round").alias("_k")), [*keys, "_r"])
                .groupBy(*keys, "root").agg((F.max("_k") + 1).alias("_k")))
        out = stage(out.join(late, [*keys, "root"], "left").withColumn("round", F.coalesce("_k", F.lit(0))).drop("_k"))


def _mode(counts: DataFrame, by) -> DataFrame:
    """Most frequent label per group of (by, label, n), ties to the smaller label."""
    return counts.groupBy(*by).agg(F.max_by("_l", F.struct("_n", -F.col("_l"))).alias("fill"))


def remove_area_debris(pixels: DataFrame, height: int, width: int, min_size: int = 10000, keys=("image_id",), column: str = "sem_id",
                       classes: list[int] | None = None) -> DataFrame:
    """Components of a class under `min_size` pixels take the most frequent other label in their padded box (0 if none).

    Classes are handled in rising order. `pixels` is sparse: background rows may be missing and are left out of the result.
    """
    keys = list(keys)
    cur = stage(pixels.filter(F.col(column) > 0).select(*keys, "y", "x", F.col(column).alias("_l")))
    if classes is None:
        # class numbers only, as few as the class dictionary has entries
        classes = sorted(r[0] for r in cur.select("_l").distinct().collect())
    for c in classes:
        comp = connected_pixels(cur.filter(F.col("_l") == c), keys)
        small = (comp.groupBy(*keys, "root").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_size).drop("_n"))
        mine = stage(comp.join(small, [*keys, "root"], "left_semi"))
        boxes = stage(bounding_box(mine, (*keys, "root"), BOX_PAD, height, width))
        if boxes.isEmpty():
            continue
        boxes = _rounds(boxes, keys)
        cur = cur.join(mine.withColumnRenamed("root", "_own"), [*keys, "y", "x"], "left")
        for k in range(boxes.agg(F.max("round")).first()[0] + 1):
            now = boxes.filter(F.col("round") == k).drop("round")
            seen = _inside(cur, now, keys).filter(F.col("_own").isNull() | (F.col("_own") != F.col("root")))
            fill = _mode(seen.groupBy(*keys, "root", "_l").agg(F.count(F.lit(1)).alias("_n")), (*keys, "root"))
            fill = now.select(*keys, F.col("root").alias("_own")).join(fill.withColumnRenamed("root", "_own"), [*keys, "_own"], "left")
            fill = fill.select(*keys, "_own", F.coalesce("fill", F.lit(0)).alias("_f"))
            cur = stage(cur.join(fill, [*keys, "_own"], "left").withColumn("_l", F.coalesce("_f", "_l"))
                        .drop("_f").filter("_l > 0").select(*keys, "y", "x", "_l", "_own"))
        cur = cur.drop("_own")
    return cur.withColumnRenamed("_l", column)


def fill_holes(grid: DataFrame, height: int, width: int, min_size: int = 5000, keys=("image_id",), column: str = "sem_id") -> DataFrame:
    """Background components whose padded box holds at most `min_size` background pixels: all background pixels of the box
    take the most frequent other label there. `grid` must hold the background as rows.

    The box is judged as it is when the component's turn comes: earlier fills may have eaten into a large component.
    """
    keys = list(keys)
    cur = stage(grid.select(*keys, "y", "x", F.col(column).alias("_l")))
    comp = connected_pixels(cur.filter("_l = 0"), keys)
    boxes = stage(bounding_box(comp, (*keys, "root"), BOX_PAD, height, width))
    if boxes.isEmpty():
        return cur.withColumnRenamed("_l", column)
    boxes = _rounds(boxes, keys)
    for k in range(boxes.agg(F.max("round")).first()[0] + 1):
        now = boxes.filter(F.col("round") == k).drop("round")
        seen = stage(_inside(cur, now, keys).select(*keys, "root", "y", "x", "_l"))
        counts = seen.groupBy(*keys, "root", "_l").agg(F.count(F.lit(1)).alias("_n"))
        open_ = counts.filter((F.col("_l") == 0) & (F.col("_n") > min_size)).select(*keys, "root")
        fill = _mode(counts.filter("_l > 0").join(open_, [*keys, "root"], "left_anti"), (*keys, "root"))
        new = seen.filter("_l = 0").join(fill, [*keys, "root"]).select(*keys, "y", "x", "fill")
        cur = stage(cur.join(new, [*keys, "y", "x"], "left").withColumn("_l", F.coalesce("fill", "_l")).drop("fill"))
    return cur.withColumnRenamed("_l", column)
