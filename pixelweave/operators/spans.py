"""Label maps as spans: one row (keys, y, x0, x1) for each run of pixels of a line, both ends included.

Spans are formed and taken apart by window and explode; components, overlaps and morphology work on them directly, in
Arrow batches of one square block or one strip of lines, so that no row stands for less than a run of pixels there.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .graph import dense_number, graph_components

ROW = 1 << 32
STRIP = 64  # lines that are handled together
Rows = list[tuple[int, int, int]]  # a structuring element by rows: (dy, least dx, largest dx)


def to_spans(pixels: DataFrame, keys: Sequence[str] = ("image_id", "inst_id")) -> DataFrame:
    """(keys, y, x0, x1) of the runs of pixels that agree in `keys`; repeated pixels count once."""
    px = pixels.select(*keys, "y", "x").distinct()
    line = Window.partitionBy(*keys, "y").orderBy("x")
    runs = px.withColumn("_r", F.col("x") - F.row_number().over(line))
    return runs.groupBy(*keys, "y", "_r").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_r")


def to_pixels(spans: DataFrame, keys: Sequence[str] = ("image_id", "inst_id")) -> DataFrame:
    return spans.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"))


# --- components and overlaps -------------------------------------------------------------------------------------------------


def touching(line: np.ndarray, x0: np.ndarray, x1: np.ndarray, other: np.ndarray, o0: np.ndarray, o1: np.ndarray, reach: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (span, other span) of one line whose columns meet, or come within `reach`. Both are sorted by (line, x0) and free of
    overlaps within a line, so the partners of a span stand together."""
    wide = int(max(x1.max(initial=0), o1.max(initial=0))) + 2 * reach + 2
    first = np.searchsorted(other * wide + o1 + reach, line * wide + x0)
    past = np.searchsorted(other * wide + o0, line * wide + x1 + reach, "right")
    n = np.maximum(past - first, 0)
    mine = np.repeat(np.arange(len(line)), n)
    return mine, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def connected_spans(spans: DataFrame, keys=("image_id",), layer: Sequence[str] = (), connectivity: int = 1) -> DataFrame:
    """(keys, layer, y, x0, x1, root): root is the position of the raster-first pixel of the component.

    `spans` are free of overlaps within (keys, layer). Strips of STRIP lines are solved on their own; the first line of each is
    also sent to the strip above, which finds the links; only these go through the star contraction.
    """
    keys, layer = list(keys), list(layer)
    reach = 1 if connectivity > 1 else 0
    src = spans.select(*keys, *layer, "y", "x0", "x1")
    schema = T.StructType([*src.schema.fields, T.StructField("root", T.LongType()), T.StructField("link", T.LongType())])
    strip = F.floor(F.col("y") / STRIP)
    sent = src.withColumn("_s", F.explode(F.when(F.col("y") % STRIP == 0, F.array(strip, strip - 1)).otherwise(F.array(strip))))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        code = pdf.groupby(layer, sort=True).ngroup().to_numpy(np.int64) if layer else np.zeros(len(pdf), np.int64)
        order = np.lexsort((pdf["x0"], pdf["y"], code))
        pdf, code = pdf.iloc[order].reset_index(drop=True), code[order]
        y, x0, x1 = (pdf[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
        here = y // STRIP == pdf["_s"].to_numpy()
        high = y - y.min()
        line = code * (int(high.max()) + 2) + high
        a, b = touching(line + 1, x0, x1, line, x0, x1, reach)
        at = y * ROW + x0
        inner = here[a] & here[b]
        root = _roots(len(pdf), a[inner], b[inner])
        cross = here[a] & ~here[b]
        own = pdf[here].drop(columns="_s").assign(root=at[root[here]], link=-1)
        links = pdf.iloc[a[cross]].drop(columns="_s").assign(root=at[root[a[cross]]], link=at[b[cross]])
        return pd.concat([own, links], ignore_index=True)

    local = stage(sent.groupBy(*keys, "_s").applyInPandas(solve, schema))
    own = local.filter("link < 0").drop("link")
    heads = own.filter(F.col("y") % STRIP == 0).select(*keys, *layer, (F.col("y").cast("long") * ROW + F.col("x0")).alias("link"), F.col("root").alias("b"))
    links = stage(local.filter("link >= 0").select(*keys, *layer, F.col("root").alias("a"), "link").join(heads, [*keys, *layer, "link"])
                  .select(*keys, *layer, "a", "b").distinct())
    if links.isEmpty():
        return own
    roots = graph_components(links, [*keys, *layer]).withColumnRenamed("root", "_r").withColumnRenamed("node", "root")
    return own.join(roots, [*keys, *layer, "root"], "left").select(*keys, *layer, "y", "x0", "x1", F.coalesce("_r", "root").alias("root"))


def label_spans(spans: DataFrame, keys=("image_id",), layer: Sequence[str] = (), connectivity: int = 1, min_size: int = 0, out: str = "label") -> DataFrame:
    """(keys, layer, y, x0, x1, label): components numbered from 1 by their raster-first pixel, as `components.label` does."""
    comp = connected_spans(spans, keys, layer, connectivity)
    ks = [*keys, *layer]
    sizes = comp.groupBy(*ks, "root").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("_n")).filter(F.col("_n") >= min_size)
    return comp.join(dense_number(sizes, ks, "root", ROW * 64, out), [*ks, "root"]).select(*ks, "y", "x0", "x1", out)


def joint_counts_of_spans(true: DataFrame, pred: DataFrame, keys=("image_id",), label: str = "inst_id") -> DataFrame:
    """(keys, t, p, n, both), what `metrics.joint_counts` gives for the pixels of two label maps.

    Both sides are spans (keys, label > 0, y, x0, x1) without overlaps within a side. Per strip of lines the two sorted lists are
    merged; pixels under one side alone are the span's length less what it shares.
    """
    keys = list(keys)
    side = lambda df, k: df.filter(F.col(label) > 0).select(*keys, F.col(label).cast("long").alias("id"), "y", "x0", "x1", F.lit(k).alias("side"))
    both = side(true, 0).unionByName(side(pred, 1)).withColumn("_s", F.floor(F.col("y") / STRIP))
    kinds = [f for f in both.schema.fields if f.name in keys]
    schema = T.StructType([*kinds, *(T.StructField(c, T.LongType()) for c in ("t", "p", "n"))])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = []
        for k in (0, 1):
            own = pdf[pdf["side"] == k].sort_values(["y", "x0"])
            lists.append([own[c].to_numpy(np.int64) for c in ("id", "y", "x0", "x1")])
        (t, ty, t0, t1), (p, py, p0, p1) = lists
        a, b = touching(ty, t0, t1, py, p0, p1)
        n = np.minimum(t1[a], p1[b]) - np.maximum(t0[a], p0[b]) + 1
        rest_t, rest_p = t1 - t0 + 1, p1 - p0 + 1
        np.subtract.at(rest_t, a, n)
        np.subtract.at(rest_p, b, n)
        none_t, none_p = np.zeros(len(t), np.int64), np.zeros(len(p), np.int64)
        out = pd.DataFrame({"t": np.concatenate([t[a], t, none_p]), "p": np.concatenate([p[b], none_t, p]), "n": np.concatenate([n, rest_t, rest_p])})
        out = out[out["n"] > 0].groupby(["t", "p"], as_index=False)["n"].sum()
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out

    n = F.col("n")
    parts = both.groupBy(*keys, "_s").applyInPandas(merge, schema).groupBy(*keys, "t", "p").agg(F.sum("n").alias("n"))
    kind = max((df.schema[label].dataType for df in (true, pred)), key=lambda d: isinstance(d, T.LongType))
    return parts.select(*keys, F.col("t").cast(kind).alias("t"), F.col("p").cast(kind).alias("p"), "n", F.when((F.col("t") > 0) & (F.col("p") > 0), n).otherwise(0).alias("both"))


# --- morphology --------------------------------------------------------------------------------------------------------------


def element_rows(offsets: Sequence[tuple[int, int]]) -> Rows | None:
    """An element by rows, or None if a row has a gap or leaves out dx = 0."""
    rows: dict[int, set[int]] = {}
    for dy, dx in offsets:
        rows.setdefault(dy, set()).add(dx)
    if any(0 not in r or len(r) != max(r) - min(r) + 1 for r in rows.values()):
        return None
    return [(dy, min(r), max(r)) for dy, r in sorted(rows.items())]


def runs_of(line: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, x0, x1) of sorted pixels; repeated ones count once."""
    if not len(x):
        return line, x, x
    step = np.diff(x, prepend=x[:1])
    head = np.flatnonzero((np.diff(line, prepend=line[:1] - 1) != 0) | (step > 1))
    return line[head], x[head], x[np.append(head[1:], len(x)) - 1]


class Sheet:
    """Spans of several layers of one part of the plane: line = layer * tall + y - top."""

    def __init__(self, top: int, tall: int, height: int, width: int) -> None:
        self.top, self.tall, self.height, self.width = top, tall, height, width

    def moved(self, line: np.ndarray, dy: int) -> tuple[np.ndarray, np.ndarray]:
        """Lines `dy` further up, and which of them lie in the image and on the sheet."""
        at = line % self.tall - dy
        y = at + self.top
        return line - dy, (at >= 0) & (at < self.tall) & (y >= 0) & (y < self.height)

    def dilate(self, spans, rows: Rows):
        line, x0, x1 = spans
        parts = []
        for dy, lo, hi in rows:
            at, ok = self.moved(line, dy)
            parts.append((at[ok], np.maximum(x0[ok] - hi, 0), np.minimum(x1[ok] - lo, self.width - 1)))
        line, x0, x1 = (np.concatenate(p) for p in zip(*parts, strict=True))
        if not len(line):
            return line, x0, x1
        least, wide = int(x0.min()), int(x1.max() - x0.min()) + 3
        order = np.argsort(line * wide + x0 - least, kind="stable")
        start, end = (line * wide + x0 - least)[order], (line * wide + x1 - least)[order]
        reach = np.maximum.accumulate(end)
        head = np.flatnonzero(np.append(True, start[1:] > reach[:-1] + 1))
        last = reach[np.append(head[1:], len(reach)) - 1]
        return start[head] // wide, start[head] % wide + least, last % wide + least

    def erode(self, spans, rows: Rows):
        line, x0, x1 = spans
        parts = []
        for dy, lo, hi in rows:
            at, ok = self.moved(line, dy)
            a = np.where(x0 == 0, 0, x0 - lo)[ok]
            b = np.where(x1 == self.width - 1, self.width - 1, x1 - hi)[ok]
            parts.append((at[ok][a <= b], a[a <= b], b[a <= b]))
        line, x0, x1 = (np.concatenate(p) for p in zip(*parts, strict=True))
        if not len(line):
            return line, x0, x1
        least, wide = int(x0.min()), int(x1.max() - x0.min()) + 3
        place = np.concatenate([line * wide + x0 - least, line * wide + x1 - least + 1])
        change = np.concatenate([np.ones(len(line), np.int64), -np.ones(len(line), np.int64)])
        place, inverse = np.unique(place, return_inverse=True)
        depth = np.cumsum(np.bincount(inverse, change, len(place))).astype(np.int64)
        line = place // wide
        y = line % self.tall + self.top
        need = sum(((y + dy >= 0) & (y + dy < self.height)).astype(np.int64) for dy, _, _ in rows)
        hit = np.flatnonzero(depth[:-1] == need[:-1]) if len(place) else place
        hit = hit[depth[hit] > 0]
        start, end = place[hit], place[hit + 1] - 1
        head = np.flatnonzero(np.append(True, start[1:] > end[:-1] + 1)) if len(hit) else hit
        last = end[np.append(head[1:], len(end)) - 1] if len(hit) else end
        return start[head] // wide, start[head] % wide + least, last % wide + least


def expand(line: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = x1 - x0 + 1
    return np.repeat(line, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(x0, n)
