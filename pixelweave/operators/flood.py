"""Marker flooding: each masked pixel goes to the marker it can reach with the lowest maximum elevation.

Two exchanges over square blocks: first the level at which every pixel is reached, then the smallest marker id along the
steps by which pixels are reached at their level. Both only ever lower a value, so blocks can be settled in any order, and
settled again when a neighbour improved, until nothing changes. Images inside one block take one round each.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .components import BLOCK

_STEPS = ((0, 1), (0, -1), (1, 0), (-1, 0))


def _settle_levels(elev, mark, cost, lab, near, rim) -> tuple[list, list]:
    """Lowest maximum elevation on a path from any marker; rim rows are (inner pixel, level outside, label outside)."""
    heap = [(elev[i], i) for i, m in enumerate(mark) if m] + [(max(c, elev[i]), i) for i, c, _ in rim if not mark[i]]
    heapq.heapify(heap)
    out = [float("inf")] * len(elev)
    while heap:
        c, i = heapq.heappop(heap)
        if c < out[i]:
            out[i] = c
            for j in near(i):
                if not mark[j] and max(c, elev[j]) < out[j]:
                    heapq.heappush(heap, (max(c, elev[j]), j))
    return out, lab


def _settle_labels(elev, mark, cost, lab, near, rim) -> tuple[list, list]:
    """Smallest marker id that arrives by steps at which the pixel is reached at its own level."""
    heap = [(m, i) for i, m in enumerate(mark) if m]
    heap += [(m, i) for i, c, m in rim if m and not mark[i] and max(c, elev[i]) == cost[i]]
    heapq.heapify(heap)
    out = [0] * len(elev)
    while heap:
        m, i = heapq.heappop(heap)
        if not out[i]:
            out[i] = m
            for j in near(i):
                if not out[j] and not mark[j] and max(cost[i], elev[j]) == cost[j]:
                    heapq.heappush(heap, (m, j))
    return cost, out


def _in_block(settle: Callable) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["halo"] == 0].reset_index(drop=True)
        places = list(zip(own["y"].tolist(), own["x"].tolist()))
        at = {p: i for i, p in enumerate(places)}

        def around(y, x):
            return [at[q] for q in ((y + dy, x + dx) for dy, dx in _STEPS) if q in at]

        outside = pdf.loc[pdf["halo"] == 1, ["y", "x", "cost", "label"]].drop_duplicates()
        rim = [(i, c, m) for y, x, c, m in outside.itertuples(index=False) for i in around(y, x)]
        cost, lab = settle(own["elevation"].tolist(), own["marker"].tolist(), own["cost"].tolist(), own["label"].tolist(),
                           lambda i: around(*places[i]), rim)
        own["changed"] = ((own["label"] != lab) | (own["cost"] != cost)).astype(int)
        own["cost"], own["label"] = cost, lab
        return own

    return solve


def _exchange(state: DataFrame, keys, block: int, settle: Callable, known: str) -> DataFrame:
    """Settle all blocks, then again those with a changed neighbour, until none is left. `known` selects rim rows to send."""
    schema, bk = state.schema, [*keys, "_by", "_bx"]
    solve = _in_block(settle)
    state = stage(state.groupBy(*bk).applyInPandas(solve, schema))
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _STEPS])

    def leaving(df: DataFrame) -> DataFrame:
        d = df.withColumn("_s", F.explode(steps))
        d = (d.withColumn("_ny", F.floor((F.col("y") + F.col("_s.dy")) / block).cast("int"))
             .withColumn("_nx", F.floor((F.col("x") + F.col("_s.dx")) / block).cast("int")))
        return d.filter((F.col("_ny") != F.col("_by")) | (F.col("_nx") != F.col("_bx"))).withColumn("_by", F.col("_ny")).withColumn("_bx", F.col("_nx"))

    while True:
        touched = leaving(state.filter(known).filter("changed > 0")).select(*bk).distinct()
        touched = stage(touched.join(state.select(*bk).distinct(), bk, "left_semi"))
        if touched.isEmpty():
            return state
        rim = leaving(state.filter(known)).withColumn("halo", F.lit(1)).select(*schema.names)
        again = state.unionByName(rim).join(touched, bk, "left_semi").groupBy(*bk).applyInPandas(solve, schema)
        calm = state.join(touched, bk, "left_anti").withColumn("changed", F.lit(0)).select(*schema.names)
        state = stage(calm.unionByName(again))


def flood(mask: DataFrame, markers: DataFrame, keys=("image_id",), block: int = BLOCK) -> DataFrame:
    """(keys, y, x, inst_id) from mask pixels (keys, y, x, elevation) and markers (keys, y, x, marker > 0), 4-neighbours.

    The level of a pixel is the lowest maximum elevation over all paths from a marker. Its id is the smallest marker id that
    arrives by a path which reaches every pixel on it at its level; marker pixels keep their own. Pixels no marker reaches are
    left out. On plateaus a queue-ordered watershed may draw a border elsewhere.
    """
    keys = list(keys)
    by, bx = F.floor(F.col("y") / block).cast("int"), F.floor(F.col("x") / block).cast("int")
    m = markers.filter("marker > 0").select(*keys, "y", "x", F.col("marker").cast("int").alias("marker"))
    state = (mask.select(*keys, "y", "x", F.col("elevation").cast("double").alias("elevation")).join(m, [*keys, "y", "x"], "left")
             .select(*keys, by.alias("_by"), bx.alias("_bx"), "y", "x", "elevation", F.coalesce("marker", F.lit(0)).alias("marker"),
                     F.lit(float("inf")).alias("cost"), F.lit(0).alias("label"), F.lit(0).alias("halo"), F.lit(1).alias("changed")))
    levels = _exchange(state, keys, block, _settle_levels, "cost < double('infinity')")
    done = _exchange(levels, keys, block, _settle_labels, "label > 0")
    return done.filter("label > 0").select(*keys, "y", "x", F.col("label").alias("inst_id"))
