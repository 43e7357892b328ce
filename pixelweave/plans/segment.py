"""Post-processing jobs: from soft maps to instance and area maps.

`grid` is a dense pixel table with `prob` and, by method, `contour`, or `xmap` and `ymap`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from ..functions.kernels import disk, sobel_separable
from ..operators.areas import fill_holes, remove_area_debris
from ..operators.components import label
from ..operators.distance import distance_map
from ..operators.filters import filter2d, local_mean
from ..operators.forest import flood_forest
from ..operators.flows import follow_flows, sink_masks
from ..operators.instances import fill_and_remove_small, fill_object_holes, remap_label, remove_debris
from ..operators.morphology import morph, open_pixels
from ..operators.normalize import CLAMP_EPS, percentile_normalize_and_clamp
from ..operators.thresholds import naive_thresh_prob
from ..session import stage

# Fixed values of the published pipelines.
CONTOUR_DISK = 3
MARKER_CUT = 0.4
SOBEL_SIZE = 21
BLUR = [0.25, 0.5, 0.25]
AREA_MIN = 10000
SMOOTH_RADIUS = 25


def segment_dcan(grid: DataFrame, height: int, width: int, eps: float = CLAMP_EPS, keys=("image_id",)) -> DataFrame:
    """Probability minus normalized contour, thresholded and labelled; each instance dilated and filled, later ids on top."""
    g = percentile_normalize_and_clamp(grid.select(*keys, "y", "x", "prob", "contour"), -1, 1, eps, keys, ("contour",))
    pre = naive_thresh_prob(g.withColumn("prob", F.col("prob") - F.col("contour")), keys=keys)
    big = morph(pre, "dilate", disk(CONTOUR_DISK), height, width, (*keys, "inst_id"))
    return fill_object_holes(big, keys).groupBy(*keys, "y", "x").agg(F.max("inst_id").alias("inst_id"))


def segment_dran(grid: DataFrame, height: int, width: int, eps: float = CLAMP_EPS, keys=("image_id",)) -> DataFrame:
    """Body minus dilated contour gives markers; the body is flooded on the negative distance inside the markers.

    Outside the markers that is one plateau, on which pixels are taken by growing distance to the nearest marker.
    """
    keys = list(keys)
    at = [*keys, "y", "x"]
    g = stage(percentile_normalize_and_clamp(grid.select(*at, "prob", "contour"), 0, 1, eps, keys, ("contour",)))
    line = naive_thresh_prob(g, prob="contour", keys=keys)
    line = morph(line, "dilate", disk(CONTOUR_DISK), height, width, keys)
    body = stage(naive_thresh_prob(g, keys=keys).select(*at))
    markers = stage(label(body.join(line, at, "left_anti"), keys, out="marker"))
    void = g.select(*at).join(markers, at, "left").withColumn("_void", F.col("marker").isNull())
    dist = distance_map(void.select(*at, "_void"), "_void", keys)
    top = dist.groupBy(*keys).agg(F.max("distance").alias("_top"))
    near = distance_map(void.select(*at, (~F.col("_void")).alias("_in")), "_in", keys).select(*at, F.coalesce("distance", F.lit(0.0)).alias("tie"))
    elev = (body.join(dist, at).join(top, keys).join(near, at)
            .select(*at, "tie", (-255.0 * (F.coalesce("distance", F.lit(0.0)) / (F.coalesce("_top", F.lit(0.0)) + 1e-7))).alias("elevation")))
    return flood_forest(elev, markers, keys)


def _unit(df: DataFrame, keys, columns) -> DataFrame:
    """1 minus the column scaled to 0..1 by its image range."""
    span = df.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    out = df.join(span, list(keys))
    for c in columns:
        d = F.col(f"_hi{c}") - F.col(f"_lo{c}")
        out = out.withColumn(c, 1.0 - F.when(d > 0, (F.col(c) - F.col(f"_lo{c}")) / d).otherwise(0.0))
    return out.drop(*[f"_{n}{c}" for c in columns for n in ("lo", "hi")])


def segment_hover(grid: DataFrame, height: int, width: int, eps: float = CLAMP_EPS, keys=("image_id",)) -> DataFrame:
    """Sobel responses of the offset maps mark the borders; what they leave of the foreground seeds a flood of it."""
    keys = list(keys)
    at = [*keys, "y", "x"]
    fg = naive_thresh_prob(grid, keys=keys).select(*at, F.lit(1).alias("fg"))
    g = percentile_normalize_and_clamp(grid.select(*at, "xmap", "ymap"), -1, 1, eps, keys, ("xmap", "ymap"))
    deriv, smooth = sobel_separable(SOBEL_SIZE)
    s = filter2d(g, {"sh": ("xmap", (smooth, deriv)), "sv": ("ymap", (deriv, smooth))}, height, width, keys, mode="reflect")
    s = _unit(s.select(*at, "sh", "sv"), keys, ("sh", "sv")).join(fg, at, "left").withColumn("fg", F.coalesce("fg", F.lit(0)))
    overall = F.greatest(F.greatest("sh", "sv") - (1 - F.col("fg")), F.lit(0.0))
    s = s.select(*at, "fg", overall.alias("overall")).withColumn("inner", (1.0 - F.col("overall")) * F.col("fg"))
    s = stage(filter2d(s, {"blur": ("inner", (BLUR, BLUR))}, height, width, keys, mode="reflect"))
    seeds = s.filter((F.col("fg") == 1) & (F.col("overall") < MARKER_CUT)).select(*at, F.lit(1).alias("inst_id"))
    seeds = open_pixels(fill_object_holes(seeds, keys), height, width, 1, keys)
    markers = label(seeds, keys, out="marker", min_size=10)
    body = s.filter("fg = 1").select(*at, (-F.col("blur")).alias("elevation"))
    return remap_label(stage(remove_debris(flood_forest(body, markers, keys), 18, keys)), keys)


def segment_flows(grid: DataFrame, height: int, width: int, niter: int = 3000, keys=("image_id",)) -> DataFrame:
    """Follow the masked offset maps, collect pixels at their sinks, fill and drop objects under 30 pixels."""
    at = [*keys, "y", "x"]
    fg = naive_thresh_prob(grid, keys=keys).select(*at)
    flow = grid.select(*at, F.col("ymap").alias("fy"), F.col("xmap").alias("fx")).join(fg, at, "left_semi")
    return fill_and_remove_small(sink_masks(follow_flows(flow, height, width, niter, keys), height, width, keys), 30, keys)


def process_semantic(grid: DataFrame, height: int, width: int, n_classes: int, probs: str = "sem_probs", radius: int = SMOOTH_RADIUS,
                     min_size: int = AREA_MIN, keys=("image_id",)) -> DataFrame:
    """(keys, y, x, sem_id): class maps smoothed with a disk, largest class per pixel, small areas and holes filled."""
    at = [*keys, "y", "x"]
    names = [f"_p{i}" for i in range(n_classes)]
    g = local_mean(grid.select(*at, *[F.get(probs, F.lit(i)).alias(n) for i, n in enumerate(names)]), names, radius, height, width, keys)
    sem = stage(g.select(*at, argmax(F.array(*names)).alias("sem_id")))
    clean = remove_area_debris(sem, height, width, min_size, keys, classes=list(range(1, n_classes)))
    full = sem.select(*at).join(clean, at, "left").withColumn("sem_id", F.coalesce("sem_id", F.lit(0)))
    return fill_holes(full, height, width, min_size, keys)


POST_PROCESSORS = {"dcan": segment_dcan, "dran": segment_dran, "hover": segment_hover, "flows": segment_flows}


def post_process(method: str, grid: DataFrame, height: int, width: int, **kw) -> DataFrame:
    if method not in POST_PROCESSORS:
        raise ValueError(f"method must be one of {sorted(POST_PROCESSORS)}")
    return POST_PROCESSORS[method](grid, height, width, **kw)


