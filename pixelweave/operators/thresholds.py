"""Thresholding of soft maps into instance maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import argmax
from .filters import box_mean_std
from .instances import to_inst_map
from .morphology import open_pixels

# Library defaults of the local thresholds; R is half the value range of a float image.
NIBLACK_K = 0.2
SAUVOLA_K = 0.2
SAUVOLA_R = 1.0


def foreground(df: DataFrame, t: float = 0.5, prob: str = "prob") -> DataFrame:
    if not 0 <= t <= 1:
        raise ValueError("threshold must lie in 0..1")
    return df.filter(F.col(prob) >= t)


def naive_thresh_prob(df: DataFrame, t: float = 0.5, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    return to_inst_map(foreground(df, t, prob), keys)


def soft_step(df: DataFrame, t: float = 2.0, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    """0 below max / t, 1 above, the value itself where equal."""
    top = df.groupBy(*keys).agg((F.max(prob) / t).alias("_c"))
    v, c = F.col(prob), F.col("_c")
    return df.join(top, list(keys)).withColumn(prob, F.when(v < c, 0.0).when(v > c, 1.0).otherwise(v)).drop("_c")


def naive_thresh(df: DataFrame, t: float = 2.0, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    return to_inst_map(soft_step(df, t, prob, keys).filter(F.col(prob) != 0), keys)


def niblack_mask(df: DataFrame, height: int, width: int, win: int = 13, k: float = NIBLACK_K, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    s = box_mean_std(df, prob, win, height, width, keys)
    return s.filter(F.col(prob) > F.col("local_mean") - k * F.col("local_std")).select(*keys, "y", "x")


def sauvola_mask(df: DataFrame, height: int, width: int, win: int = 33, k: float = SAUVOLA_K, r: float = SAUVOLA_R,
                 prob: str = "prob", keys=("image_id",)) -> DataFrame:
    s = box_mean_std(df, prob, win, height, width, keys)
    return s.filter(F.col(prob) > F.col("local_mean") * (1 + k * (F.col("local_std") / r - 1))).select(*keys, "y", "x")


def niblack_thresh(df: DataFrame, height: int, width: int, win: int = 13, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    return to_inst_map(open_pixels(niblack_mask(df, height, width, win, prob=prob, keys=keys), height, width, keys=keys), keys)


def sauvola_thresh(df: DataFrame, height: int, width: int, win: int = 33, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    return to_inst_map(open_pixels(sauvola_mask(df, height, width, win, prob=prob, keys=keys), height, width, keys=keys), keys)


def argmax_thresh(df: DataFrame, probs: str = "inst_probs", keys=("image_id",)) -> DataFrame:
    return to_inst_map(df.filter(argmax(F.col(probs)) > 0), keys)


def histogram_cut(df: DataFrame, eps: float = 0.01, bins: int = 256, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    """(keys, cut): centre of the bin before the steepest drop of the histogram, plus eps; the first one on ties. On a flat
    image it is the value plus eps, so that no pixel reaches it."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(prob).alias("_lo"), F.max(prob).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    hist = (df.join(span, keys).withColumn("_b", F.least(F.floor(F.coalesce(F.try_divide(F.col(prob) - F.col("_lo"), step), F.lit(0.0))), F.lit(bins - 1)).cast("int"))
            .groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")))
    full = span.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(hist, [*keys, "_b"], "left")
    n = F.coalesce("_n", F.lit(0))
    drop = full.withColumn("_d", F.lead(n).over(Window.partitionBy(*keys).orderBy("_b")) - n).filter("_d is not null")
    best = drop.groupBy(*keys).agg(F.min(F.struct("_d", "_b", "_lo", "_hi")).alias("m"))
    width = (F.col("m._hi") - F.col("m._lo")) / bins
    return best.select(*keys, (F.col("m._lo") + width * (F.col("m._b") + 0.5) + eps).alias("cut"))


def smoothed_thresh(df: DataFrame, eps: float = 0.01, prob: str = "prob", keys=("image_id",)) -> DataFrame:
    cut = histogram_cut(df, eps, prob=prob, keys=keys)
    return to_inst_map(df.join(cut, list(keys)).filter(F.col(prob) >= F.col("cut")), keys)


def threshold(df: DataFrame, method: str = "naive", t: float = 0.5, height: int = 0, width: int = 0, keys=("image_id",)) -> DataFrame:
    """Instance map from `prob` (or `inst_probs` for argmax) by the named method."""
    methods = {
        "naive": lambda: naive_thresh_prob(df, t, keys=keys),
        "argmax": lambda: argmax_thresh(df, keys=keys),
        "sauvola": lambda: sauvola_thresh(df, height, width, keys=keys),
        "niblack": lambda: niblack_thresh(df, height, width, keys=keys),
    }
    if method not in methods:
        raise ValueError(f"method must be one of {sorted(methods)}")
    return methods[method]()


def assemble_maps(df: DataFrame, method: str = "naive", t: float = 0.5, height: int = 0, width: int = 0, keys=("image_id",)) -> DataFrame:
    """(keys, y, x, inst_id, type_id): thresholded instances with the class of largest probability."""
    inst = threshold(df, method, t, height, width, keys)
    types = df.select(*keys, "y", "x", argmax(F.col("type_probs")).alias("type_id"))
    return inst.join(types, [*keys, "y", "x"])
