"""Polygon rings to pixels and back. A ring is an ARRAY<STRUCT<x, y>> whose last point repeats the first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import disk
from ..session import spread
from .components import connected_pixels, remove_small_components

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def ring_edges(ring: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(
        F.get(ring, i - 1)["x"].alias("x1"), F.get(ring, i - 1)["y"].alias("y1"), F.get(ring, i)["x"].alias("x2"), F.get(ring, i)["y"].alias("y2")))


def rasterize(rings: DataFrame, keys, x_off=0, y_off=0, ring: str = "ring") -> DataFrame:
    """(keys, y, x): integer points inside each ring or on its boundary, without those strictly inside one of its `holes`."""
    return raster_spans(rings, keys, x_off, y_off, ring).select(*keys, "y", F.explode(F.sequence("_s.a", "_s.b")).alias("x")).distinct()


def raster_spans(rings: DataFrame, keys, x_off=0, y_off=0, ring: str = "ring") -> DataFrame:
    """(keys, y, _s): spans from a to b that together cover the points of `rasterize`, some of them more than once.

    Scan lines: every edge yields its crossing with each integer row, crossings of a row are paired in order to
    spans. Rows are independent, so a large polygon is spread over its rows. Edges of interior rings take part where
    there is a column `holes`, so their inside lies between two pairs; a point on the rim of a hole belongs to the polygon.
    """
    edges = ring_edges(F.col(ring))
    if "holes" in rings.columns:
        inner = F.flatten(F.transform(F.filter("holes", lambda r: F.size(r) > 1), ring_edges))
        edges = F.concat(edges, F.coalesce(inner, F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>")))
    rings = spread(rings.filter(F.size(ring) > 1), *keys)
    e = (rings.select(*keys, F.explode(edges).alias("_e"), F.lit(x_off).alias("_ox"), F.lit(y_off).alias("_oy"))
         if not isinstance(x_off, Column) else
         rings.select(*keys, F.explode(edges).alias("_e"), x_off.alias("_ox"), y_off.alias("_oy")))
    e = e.select(*keys, *[(F.col(f"_e.{c}{i}") - F.col(f"_o{c}")).alias(f"{c}{i}") for c in "xy" for i in (1, 2)])
    lo, hi = F.least("y1", "y2"), F.greatest("y1", "y2")
    flat = F.col("y1") == F.col("y2")
    first, last = F.ceil(lo).cast("int"), F.floor(hi).cast("int")
    rows = e.withColumn("y", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    at = F.when(flat, F.col("x1")).otherwise(F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    rows = rows.withColumn("_x", at).withColumn("_cut", ~flat & (F.col("y") < hi))
    a = F.when(flat, F.ceil(F.least("x1", "x2"))).otherwise(F.ceil(F.col("_x") - 1e-9)).cast("int")
    b = F.when(flat, F.floor(F.greatest("x1", "x2"))).otherwise(F.floor(F.col("_x") + 1e-9)).cast("int")
    # one exchange: edges that cross a row come first in it, and its pixels are made where its spans already are
    rows = spread(rows.select(*keys, "y", "_cut", "_x", a.alias("_a"), b.alias("_b")), *keys, "y")
    line = Window.partitionBy(*keys, "y").orderBy(F.desc("_cut"), "_x")
    rows = rows.withColumn("_next", F.lead(F.when(F.col("_cut"), F.col("_x"))).over(line)).withColumn("_n", F.row_number().over(line))
    inner = F.when(F.col("_cut") & (F.col("_n") % 2 == 1), F.struct(F.ceil("_x").cast("int").alias("a"), F.floor("_next").cast("int").alias("b")))
    return rows.select(*keys, "y", F.explode(F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")), inner)).alias("_s")).filter("_s.a <= _s.b")


def paint_instances(annotations: DataFrame, height: int, width: int, keys=("name",), order: str = "feature_id", min_size: int = 10,
                    x_off=0, y_off=0) -> DataFrame:
    """(keys, y, x, inst_id, type_id): polygons painted in file order, later ones on top, parts under `min_size` dropped."""
    part = ["part"] if "part" in annotations.columns else []
    layer = [order, *part, "class_id"]
    px = rasterize(annotations, [*keys, *layer], x_off, y_off).filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
    big = remove_small_components(px, min_size, keys, layer=layer)
    top = big.groupBy(*keys, "y", "x").agg(F.max(F.struct(*layer)).alias("_o"))
    return top.select(*keys, "y", "x", F.col(f"_o.{order}").alias("inst_id"), F.col("_o.class_id").alias("type_id"))


def paint_by_area(regions: DataFrame, keys=("name",), order: str = "feature_id") -> DataFrame:
    """(keys, y, x, inst_id): larger regions on top; the id is the rank by (painted value sum, file order).

    The value sum is pixels times the 8-bit paint value of a region, which stops at 255.
    """
    from .graph import prefix_total
    px = rasterize(regions, [*keys, order])
    size = px.groupBy(*keys, order).agg((F.count(F.lit(1)) * F.least(F.col(order), F.lit(255))).alias("_s"))
    rank = prefix_total(size, keys, ["_s", order], F.floor(F.col("_s") / 65536)).select(*keys, order, (F.col("before") + 1).cast("int").alias("inst_id"))
    return px.join(rank, [*keys, order]).groupBy(*keys, "y", "x").agg(F.max("inst_id").alias("inst_id"))


def boundary_pixels(pixels: DataFrame, keys=("image_id", "inst_id")) -> DataFrame:
    """Pixels of each instance with one of their four neighbours outside it; the image border counts as outside."""
    steps = [(0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)]
    near = pixels.select(*keys, "y", "x", F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in steps])).alias("_o"))
    near = near.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"),
                       ((F.col("_o.dy") == 0) & (F.col("_o.dx") == 0)).cast("int").alias("_self"))
    hits = near.groupBy(*keys, "y", "x").agg(F.count(F.lit(1)).alias("_n"), F.max("_self").alias("_self"))
    return hits.filter((F.col("_self") == 1) & (F.col("_n") < len(steps))).select(*keys, "y", "x")


# the eight neighbours counter-clockwise on screen, starting to the right
_TURN = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def _trace(cells: set[tuple[int, int]], start: tuple[int, int]) -> list[tuple[int, int]]:
    """Corner points of the outer border through `start`, walked downwards first; straight runs keep their ends only."""
    def look(cur, first, step):
        for k in range(8):
            d = (first + step * k) % 8
            nxt = (cur[0] + _TURN[d][0], cur[1] + _TURN[d][1])
            if nxt in cells:
                return d, nxt
        return None

    found = look(start, 4, -1)
    if found is None:
        return [start]
    back, last = found
    points, dirs, cur, came = [], [], start, back
    while True:
        d, nxt = look(cur, came + 1, 1)
        points.append(cur)
        dirs.append(d)
        if nxt == start and cur == last:
            break
        cur, came = nxt, (d + 4) % 8
    return [p for i, p in enumerate(points) if dirs[i] != dirs[i - 1]]


def outline(pixels: DataFrame, keys=("image_id", "inst_id"), x_off: int = 0, y_off: int = 0) -> DataFrame:
    """(keys, ring): outer contour of the raster-first component of each instance, closed; under three corners none.

    Only boundary pixels reach the tasks, sorted by instance. A task reads them batch by batch and holds one batch and the
    perimeter of one object at a time, so the number of objects in an image does not matter.
    """
    keys = list(keys)
    edge = boundary_pixels(pixels, keys)
    schema = T.StructType([*[edge.schema[k] for k in keys], T.StructField("ring", RING)])

    def rings(pdf: pd.DataFrame) -> pd.DataFrame:
        """One ring per run of equal keys; rows come sorted by keys, y, x, so a run starts with its first pixel."""
        new = (pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        ys, xs = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        kept, out = [], []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            pts = _trace(set(zip(ys[a:b].tolist(), xs[a:b].tolist())), (int(ys[a]), int(xs[a])))
            if len(pts) > 2:
                kept.append(a)
                out.append([{"x": float(x + x_off), "y": float(y + y_off)} for y, x in [*pts, pts[0]]])
        return pdf.iloc[kept][keys].assign(ring=pd.Series(out, dtype=object, index=pdf.index[kept]))

    def walk(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            open_ = (pdf[keys] == pdf[keys].iloc[-1]).all(axis=1).to_numpy()
            rest = pdf[open_].reset_index(drop=True)
            if not open_.all():
                yield rings(pdf[~open_].reset_index(drop=True))
        if rest is not None and len(rest):
            yield rings(rest)

    return edge.repartition(*keys).sortWithinPartitions(*keys, "y", "x").mapInPandas(walk, schema)


def touching_groups(rings: DataFrame, keys, member, gap: int = 1) -> DataFrame:
    """(keys, member, root): rings of the same keys whose pixel sets, each grown by `gap`, touch get the same root.

    Spans are grown, not pixels: a grown span lies in one component, that of its first pixel.
    """
    member = [member] if isinstance(member, str) else list(member)
    big = 1 << 30
    half = {dy: max(dx for d, dx in disk(gap) if d == dy) for dy, _ in disk(gap)}
    rows = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(h).alias("h")) for dy, h in half.items()]))
    spans = (raster_spans(rings, [*keys, *member]).withColumn("_d", rows)
             .select(*keys, *member, (F.col("y") + gap + F.col("_d.dy")).alias("y"), F.greatest(F.col("_s.a") + gap - F.col("_d.h"), F.lit(0)).alias("x"),
                     F.least(F.col("_s.b") + gap + F.col("_d.h"), F.lit(big - 1)).alias("_to"))
             .filter(F.col("y").between(0, big - 1) & (F.col("x") <= F.col("_to"))))
    grown = spread(spans.select(*keys, "y", "x", "_to"), *keys, "y").select(*keys, "y", F.explode(F.sequence("x", "_to")).alias("x")).distinct()
    roots = connected_pixels(grown, keys)
    return spans.select(*keys, *member, "y", "x").distinct().join(roots, [*keys, "y", "x"]).groupBy(*keys, *member).agg(F.min("root").alias("root"))
