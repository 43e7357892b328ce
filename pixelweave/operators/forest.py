"""Marker flooding as a minimum spanning forest, contracted block by block.

A priority-queue flood takes, again and again, the lowest edge between a flooded and a dry pixel, so what it draws is the
minimum spanning forest of the pixel grid rooted at the markers. An edge is as high as its higher pixel; equal heights are
told apart by the lower one; pixels are ordered by (elevation, tie, y, x), so no two edges are equally high and the forest
is unique, whatever the order of work.

Every block decides what it can on its own: a group of pixels that holds no marker and no pixel of the block's rim has
all its edges in the block, so its lowest one belongs to the forest. Groups join along such edges until each holds exactly one
rim pixel or marker. Of the edges between these groups only a spanning forest can matter outside (any other is the highest
edge of some cycle), and its edges number less than the rim pixels. The next level takes 4 x 4 blocks and treats their
rim pixels as it treated pixels, and so on up to the whole image; labels then come down the same levels. The number of
exchanges is the base-4 logarithm of the image side in blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Stages
from .components import BLOCK, ROW

FACTOR = 4
ROOT = -1  # the far end of an edge that leads to a marker
HEIGHT = ["e1", "t1", "p1", "e0", "t0", "p0"]  # the edge's higher pixel, then its lower one


def contract(n: int, a: np.ndarray, b: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Join every node that is not `fixed` to a neighbour along its lowest edge until only fixed nodes, or groups without any edge
    out, are left. Edges come by growing height.

    Returns the group of every node (named after its fixed node), and the edges left over as (end, end, place among the given).
    """
    group, at = np.arange(n), np.arange(len(a))
    while True:
        apart = a != b
        a, b, at = a[apart], b[apart], at[apart]
        lowest = np.full((2, n), len(at))
        back = np.arange(len(at))[::-1]
        lowest[0, a[::-1]], lowest[1, b[::-1]] = back, back  # the last write is that of the lowest edge
        lowest = lowest.min(0)
        moving = np.flatnonzero((lowest < len(at)) & ~fixed)
        if not len(moving):
            return group, a, b, at
        edge, to = lowest[moving], np.arange(n)
        to[moving] = np.where(a[edge] == moving, b[edge], a[edge])
        back_and_forth = moving[(to[to[moving]] == moving) & (moving < to[moving])]
        to[back_and_forth] = back_and_forth
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        group, a, b = to[group], to[a], to[b]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges of the minimum spanning forest; edges come by growing height."""
    at, taken = np.arange(len(a)), []
    while True:
        apart = a != b
        a, b, at = a[apart], b[apart], at[apart]
        if not len(at):
            return np.sort(np.concatenate(taken)) if taken else at
        lowest = np.full((2, n), len(at))
        back = np.arange(len(at))[::-1]
        lowest[0, a[::-1]], lowest[1, b[::-1]] = back, back
        lowest = lowest.min(0)
        moving = np.flatnonzero(lowest < len(at))
        edge, to = lowest[moving], np.arange(n)
        taken.append(at[np.unique(edge)])
        to[moving] = np.where(a[edge] == moving, b[edge], a[edge])
        back_and_forth = moving[(to[to[moving]] == moving) & (moving < to[moving])]
        to[back_and_forth] = back_and_forth
        while True:
            further = to[to]
            if np.array_equal(further, to):
                break
            to = further
        a, b = to[a], to[b]


def _on_rim(place: np.ndarray, side: int, whole: bool) -> np.ndarray:
    """Pixels with a neighbour in another square of this side; none if one square holds the whole image."""
    if whole:
        return np.zeros(len(place), bool)
    y, x = place // ROW % side, place % ROW % side
    return (y == 0) | (y == side - 1) | (x == 0) | (x == side - 1)


def _solve(place: np.ndarray, label: np.ndarray, rim: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Nodes and edges (by growing height) of one square. A labelled node is a marker.

    Returns for every node the rim node it belongs to (ROOT if none) and its label (0 if open), and the edges that matter
    outside as (end, end or ROOT, label, place among the given).
    """
    n, marker = len(place), label > 0
    group, ga, gb, at = contract(n, a, b, marker | rim)
    up = np.where(rim[group] & ~marker[group], place[group], ROOT)
    ra, rb = np.where(marker[ga], n, ga), np.where(marker[gb], n, gb)
    keep = spanning(n + 1, ra, rb)
    ra, rb, at, lab = ra[keep], rb[keep], at[keep], np.maximum(label[ga[keep]], label[gb[keep]])
    low, high = np.minimum(ra, rb), np.maximum(ra, rb)
    ends = np.append(place, ROOT)
    return up, label[group], ends[low], ends[high], np.where(high == n, lab, 0), at


def _square(pos, side: int, name: str):
    y, x = F.shiftright(pos, 32), F.col(pos) % ROW
    return F.floor(y / side).cast("int").alias(f"{name}y"), F.floor(x / side).cast("int").alias(f"{name}x")


def _frame(keys, first, size: int, **columns) -> pd.DataFrame:
    return pd.DataFrame({**{k: [first[k]] * size for k in keys}, **columns})


def _block_solver(keys, side: int, whole: bool):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ignore_index=True)
        pos, label = pdf["pos"].to_numpy(), pdf["marker"].to_numpy()
        e, t = pdf["elevation"].to_numpy(), pdf["tie"].to_numpy()
        rank = np.empty(len(pos), np.int64)
        rank[np.lexsort((pos, t, e))] = np.arange(len(pos))
        a, b = [], []
        for step in (1, ROW):
            at = np.searchsorted(pos, pos + step)
            ok = (at < len(pos)) & (pos[np.minimum(at, len(pos) - 1)] == pos + step)
            a.append(np.flatnonzero(ok))
            b.append(at[ok])
        a, b = np.concatenate(a), np.concatenate(b)
        high, low = np.maximum(rank[a], rank[b]), np.minimum(rank[a], rank[b])
        order = np.lexsort((low, high))
        a, b = a[order], b[order]
        up, lab, ea, eb, elab, at = _solve(pos, label, _on_rim(pos, side, whole), a, b)
        nodes = _frame(keys, pdf.iloc[0], len(pos), a=pos, b=up, label=lab)
        nodes = nodes[(up != ROOT) | (lab > 0)]
        top = np.where(rank[a[at]] > rank[b[at]], a[at], b[at])
        low = np.where(rank[a[at]] > rank[b[at]], b[at], a[at])
        edges = _frame(keys, pdf.iloc[0], len(ea), a=ea, b=eb, label=elab, e1=e[top], t1=t[top], p1=pos[top], e0=e[low], t0=t[low], p0=pos[low])
        return pd.concat([nodes.assign(is_edge=False), edges.assign(is_edge=True)], ignore_index=True)

    return solve


def _square_solver(keys, side: int, whole: bool):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(HEIGHT, ignore_index=True)
        a, b, label = (pdf[c].to_numpy() for c in ("a", "b", "label"))
        place = np.unique(np.concatenate([a, b[b != ROOT]]))
        marks = np.unique(label[b == ROOT])
        ia = np.searchsorted(place, a)
        ib = np.where(b == ROOT, len(place) + np.searchsorted(marks, label), np.searchsorted(place, b))
        rim = np.concatenate([_on_rim(place, side, whole), np.zeros(len(marks), bool)])
        every, labels = np.concatenate([place, np.full(len(marks), ROOT)]), np.concatenate([np.zeros(len(place), np.int64), marks])
        up, lab, ea, eb, elab, at = _solve(every, labels, rim, ia, ib)
        nodes = _frame(keys, pdf.iloc[0], len(place), a=place, b=up[:len(place)], label=lab[:len(place)])
        nodes = nodes[(nodes["b"] != ROOT) | (nodes["label"] > 0)]
        edges = pdf.iloc[at][[*keys, *HEIGHT]].assign(a=ea, b=eb, label=elab)
        return pd.concat([nodes.assign(is_edge=False), edges.assign(is_edge=True)], ignore_index=True)

    return solve


def _border_edges(pixels: DataFrame, keys, block: int) -> DataFrame:
    """Edges between neighbouring pixels of different blocks, in the form of edges between groups."""
    y, x = F.shiftright("pos", 32), F.col("pos") % ROW
    ends = pixels.filter((y % block == block - 1) | (x % block == block - 1))
    steps = F.array(*[F.when(c % block == block - 1, F.col("pos") + s) for c, s in ((y, ROW), (x, 1))])
    out = ends.select(*keys, F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("next"),
                      *[F.col(c).alias(f"{c}_a") for c in ("pos", "elevation", "tie", "marker")])
    into = pixels.filter((y % block == 0) | (x % block == 0)).withColumnRenamed("pos", "next")
    j = out.join(into, [*keys, "next"]).filter("marker_a = 0 OR marker = 0")
    height = lambda *names: F.struct(*[F.col(c).alias(k) for c, k in zip(names, "etp", strict=True)])
    one, two = height("elevation_a", "tie_a", "pos_a"), height("elevation", "tie", "next")
    top, low = F.when(one > two, one).otherwise(two), F.when(one > two, two).otherwise(one)
    a, b = F.when(F.col("marker_a") > 0, F.col("next")).otherwise(F.col("pos_a")), F.when((F.col("marker_a") > 0) | (F.col("marker") > 0), F.lit(ROOT)).otherwise(F.col("next"))
    j = j.select(*keys, a.alias("a"), b.cast("long").alias("b"), F.greatest("marker_a", "marker").alias("label"), top.alias("_t"), low.alias("_l"))
    return j.select(*keys, "a", "b", "label", *[F.col(f"_t.{c}").alias(f"{c}1") for c in "etp"], *[F.col(f"_l.{c}").alias(f"{c}0") for c in "etp"])


def flood_forest(mask: DataFrame, markers: DataFrame, keys=("image_id",), block: int = BLOCK) -> DataFrame:
    """(keys, y, x, inst_id): every mask pixel with the marker from which a priority-queue flood reaches it.

    `mask` has (keys, y, x, elevation) and may have `tie`, which orders pixels of equal elevation (on a plateau the distance to
    the nearest marker makes the flood advance evenly); after that comes raster order. `markers` has (keys, y, x, marker > 0);
    of a pixel listed twice the smallest marker counts. Steps go to the 4 neighbours. Marker pixels keep their marker; those
    outside the mask, and mask pixels no marker reaches, are left out; an empty mask gives no rows.

    One shuffle of the pixels by block; all later levels see at most the rim pixels of 4 x 4 squares of the level before.
    """
    keys, staged = list(keys), Stages()
    tie = F.col("tie").cast("double") if "tie" in mask.columns else F.lit(0.0)
    at = (F.col("y").cast("long") * ROW + F.col("x")).alias("pos")
    m = markers.filter("marker > 0").select(*keys, at, F.col("marker").cast("long").alias("marker")).groupBy(*keys, "pos").agg(F.min("marker").alias("marker"))
    pixels = staged.add(mask.select(*keys, at, F.col("elevation").cast("double").alias("elevation"), tie.alias("tie")).join(m, [*keys, "pos"], "left")
                        .withColumn("marker", F.coalesce("marker", F.lit(0).cast("long"))))
    far = pixels.agg(F.max(F.shiftright("pos", 32)).alias("y"), F.max(F.col("pos") % ROW).alias("x")).first()
    extent = max(far.y or 0, far.x or 0) + 1
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, a long, b long, label long, is_edge boolean, " + ", ".join(f"{c} {'long' if c[0] == 'p' else 'double'}" for c in HEIGHT)
    edge_columns = [*keys, "a", "b", "label", *HEIGHT]

    whole = extent <= block
    own = pixels.select("*", *_square("pos", block, "_s")).groupBy(*keys, "_sy", "_sx").applyInPandas(_block_solver(keys, block, whole), schema)
    base = staged.add(own)
    levels, side = [], block
    if not whole:
        edges = staged.add(base.filter("is_edge").select(edge_columns).unionByName(_border_edges(pixels, keys, block)))
        while not whole:
            side, whole = side * FACTOR, extent <= side * FACTOR
            placed = edges.select("*", *_square("a", side, "_s"), *_square("b", side, "_n"))
            inside = (F.col("b") == ROOT) | ((F.col("_sy") == F.col("_ny")) & (F.col("_sx") == F.col("_nx")))
            solved = staged.add(placed.filter(inside).groupBy(*keys, "_sy", "_sx").applyInPandas(_square_solver(keys, side, whole), schema))
            levels.append(solved.filter("NOT is_edge").select(*keys, "a", "b", "label"))
            edges, past = staged.add(placed.filter(~inside).select(edge_columns).unionByName(solved.filter("is_edge").select(edge_columns))), edges
            staged.drop(past)
    staged.drop(pixels)
    known = None  # (keys, a, label) of the nodes of the level above
    for nodes in reversed(levels):
        here = nodes.filter("label > 0").select(*keys, "a", "label")
        if known is not None:
            open_ = nodes.filter("label = 0").select(*keys, F.col("a").alias("_a"), F.col("b").alias("a"))
            here = (here.unionByName(open_.join(known, [*keys, "a"]).select(*keys, F.col("_a").alias("a"), "label"))
                    .unionByName(known.join(nodes, [*keys, "a"], "left_anti")))
        known = staged.add(here)
    pixels = base.filter("NOT is_edge")
    done = pixels.filter("label > 0").select(*keys, "a", "label")
    if known is not None:
        done = done.unionByName(pixels.filter("label = 0").select(*keys, F.col("a").alias("_p"), F.col("b").alias("a"))
                                .join(known, [*keys, "a"]).select(*keys, F.col("_p").alias("a"), "label"))
    return done.select(*keys, F.shiftright("a", 32).cast("int").alias("y"), (F.col("a") % ROW).cast("int").alias("x"), F.col("label").cast("int").alias("inst_id"))
