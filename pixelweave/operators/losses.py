"""Evaluation losses as aggregates (forward values) over class scores or pixel grids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import one_hot, softmax, total
from ..functions.kernels import gaussian, sobel_hv_kernel
from .filters import filter2d

# Guards and defaults of the published losses.
HOT_EPS = 1e-7
UNION_EPS = 1e-6
TVERSKY_EPS = 1e-7
SOFT_EPS = 1e-6
HOT_FLOOR = 1e-4
MS_SSIM_WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def _soft(df: DataFrame, scores: str, target: str, n: int) -> DataFrame:
    """Adds the softmax `_p` and the one-hot target `_t`."""
    return df.withColumn("_p", softmax(F.col(scores))).withColumn("_t", one_hot(F.col(target), n, HOT_EPS))


def _zip(f) -> Column:
    return total(F.zip_with("_p", "_t", f))


def pixel_cross_entropy(df: DataFrame, weights: list[float] | None = None, scores="scores", target="target", out="loss") -> DataFrame:
    """-log softmax[target] per row, times the weight of the target class."""
    loss = -F.log(F.get(softmax(F.col(scores)), F.col(target)))
    if weights is not None:
        loss = loss * F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col(target))
    return df.withColumn(out, loss)


def cross_entropy(df: DataFrame, weights: list[float] | None = None, scores="scores", target="target") -> DataFrame:
    return pixel_cross_entropy(df, weights, scores, target, "_l").agg(F.avg("_l").alias("loss"))


def _region_loss(df: DataFrame, n: int, terms: dict, score, scores, target, sample) -> DataFrame:
    per = _soft(df, scores, target, n).groupBy(sample).agg(*[F.sum(_zip(f)).alias(k) for k, f in terms.items()])
    return per.agg(F.avg(1.0 - score()).alias("loss"))


def dice_loss(df: DataFrame, n: int, scores="scores", target="target", sample="sample") -> DataFrame:
    return _region_loss(df, n, {"i": lambda p, t: p * t, "s": lambda p, t: p + t},
                        lambda: 2.0 * F.col("i") / F.greatest("s", F.lit(UNION_EPS)), scores, target, sample)


def iou_loss(df: DataFrame, n: int, scores="scores", target="target", sample="sample") -> DataFrame:
    """The denominator is the plain sum; the intersection is not taken off."""
    return _region_loss(df, n, {"i": lambda p, t: p * t, "s": lambda p, t: p + t},
                        lambda: F.col("i") / F.greatest("s", F.lit(UNION_EPS)), scores, target, sample)


def tversky_loss(df: DataFrame, n: int, a: float = 0.7, b: float = 0.3, scores="scores", target="target", sample="sample") -> DataFrame:
    terms = {"i": lambda p, t: p * t, "fp": lambda p, t: p * (1.0 - t), "fn": lambda p, t: t * (1.0 - p)}
    return _region_loss(df, n, terms, lambda: F.col("i") / F.greatest(F.col("i") + a * F.col("fp") + b * F.col("fn"), F.lit(TVERSKY_EPS)),
                        scores, target, sample)


def focal_loss(df: DataFrame, n: int, alpha: float = 0.5, gamma: float = 2.0, scores="scores", target="target") -> DataFrame:
    def term(p, t):
        q = p + SOFT_EPS
        return t * alpha * F.pow(1.0 - q, F.lit(gamma)) * F.log(q)

    return _soft(df, scores, target, n).agg(F.avg(-_zip(term)).alias("loss"))


def symmetric_ce(df: DataFrame, n: int, alpha: float = 0.5, beta: float = 1.0, scores="scores", target="target") -> DataFrame:
    def clamped(t):
        return F.greatest(F.least(t, F.lit(1.0)), F.lit(HOT_FLOOR))

    s = _soft(df, scores, target, n)
    fwd = F.avg(-_zip(lambda p, t: clamped(t) * F.log(p + SOFT_EPS)))
    rev = F.avg(-_zip(lambda p, t: (p + SOFT_EPS) * F.log(clamped(t))))
    return s.agg((alpha * fwd + beta * rev).alias("loss"))


def mse(df: DataFrame, yhat: str = "yhat", target: str = "target") -> DataFrame:
    d = F.col(yhat) - F.col(target)
    return df.agg(F.avg(d * d).alias("loss"))


def gradient_mse(grid: DataFrame, height: int, width: int, focus: str = "focus", keys=("image_id",),
                 pairs=(("xmap_hat", "xmap"), ("ymap_hat", "ymap"))) -> DataFrame:
    """Squared difference of Sobel responses, weighted by the focus mask, over the clamped mask sum.

    All responses of both maps come from the same two window passes.
    """
    kernels = sobel_hv_kernel(5)
    specs = {f"_g{i}{j}": (c, kernels[i]) for i, pair in enumerate(pairs) for j, c in enumerate(pair)}
    g = filter2d(grid.select(*keys, "y", "x", focus, *[c for p in pairs for c in p]), specs, height, width, keys)
    f = F.col(focus).cast("double")
    sq = [(F.col(f"_g{i}0") - F.col(f"_g{i}1")) * (F.col(f"_g{i}0") - F.col(f"_g{i}1")) for i in range(len(pairs))]
    num = F.sum(f * reduce(lambda a, b: a + b, sq))
    den = F.sum(F.greatest(f, F.lit(UNION_EPS))) * len(pairs)
    return g.agg((num / den).alias("loss"))


def _ssim_terms(grid: DataFrame, height: int, width: int, window: int, value_range: float, keys, yhat, target) -> DataFrame:
    """Per pixel: structural similarity and its contrast term."""
    a, b = F.col(yhat).cast("double"), F.col(target).cast("double")
    src = grid.select(*keys, "y", "x", a.alias("_a"), b.alias("_b"), (a * a).alias("_aa"), (b * b).alias("_bb"), (a * b).alias("_ab"))
    g = gaussian(min(window, height, width), 1.5)
    m = filter2d(src, {f"_m{c}": (f"_{c}", (g, g)) for c in ("a", "b", "aa", "bb", "ab")}, height, width, keys)
    ma, mb = F.col("_ma"), F.col("_mb")
    c1, c2 = (0.01 * value_range) ** 2, (0.03 * value_range) ** 2
    v1 = 2.0 * (F.col("_mab") - ma * mb) + c2
    v2 = (F.col("_maa") - ma * ma) + (F.col("_mbb") - mb * mb) + c2
    sim = ((2.0 * ma * mb + c1) * v1) / ((ma * ma + mb * mb + c1) * v2)
    return m.select(*keys, "y", "x", sim.alias("ssim"), (v1 / v2).alias("contrast"))


def _value_range(grid: DataFrame, yhat: str) -> float:
    """255 or 1 above, -1 or 0 below, by the extremes of the whole batch."""
    lo, hi = grid.agg(F.min(yhat), F.max(yhat)).first()
    return (255 if hi > 128 else 1) - (-1 if lo < -0.5 else 0)


def _clip01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def ssim(grid: DataFrame, height: int, width: int, window: int = 11, value_range: float | None = None, keys=("image_id",),
         yhat: str = "yhat", target: str = "target") -> DataFrame:
    """(loss, contrast): clip(1 - mean, 0, 1) / 2 of the similarity, and clip(1 - mean, 0, 1) of the contrast term."""
    value_range = _value_range(grid, yhat) if value_range is None else value_range
    t = _ssim_terms(grid, height, width, window, value_range, keys, yhat, target)
    return t.agg((_clip01(1.0 - F.avg("ssim")) / 2.0).alias("loss"), _clip01(1.0 - F.avg("contrast")).alias("contrast"))


def pool2(grid: DataFrame, height: int, width: int, columns, keys=("image_id",)) -> DataFrame:
    """Mean over 2 x 2 cells; an odd last line is dropped."""
    g = grid.filter((F.col("y") < height // 2 * 2) & (F.col("x") < width // 2 * 2))
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    return g.groupBy(*keys, half("y"), half("x")).agg(*[F.avg(c).alias(c) for c in columns])


def ms_ssim(grid: DataFrame, height: int, width: int, window: int = 11, keys=("image_id",), yhat="yhat", target="target") -> DataFrame:
    """Five levels with 2 x 2 mean pooling: the product of the contrast terms and of the last similarity, by fixed weights."""
    g = grid.select(*keys, "y", "x", F.col(yhat).cast("double").alias("yhat"), F.col(target).cast("double").alias("target"))
    rows = None
    for i, w in enumerate(MS_SSIM_WEIGHTS):
        level = ssim(g, height, width, window, None, keys).withColumn("i", F.lit(i)).withColumn("w", F.lit(w))
        rows = level if rows is None else rows.unionByName(level)
        g = pool2(g, height, width, ("yhat", "target"), keys)
        height, width = height // 2, width // 2
    n = len(MS_SSIM_WEIGHTS)
    cs, sim = F.pow((F.col("contrast") + 1) / 2, F.col("w")), F.pow((F.col("loss") + 1) / 2, F.col("w"))
    # every one of the first n - 1 contrast terms is multiplied by the last similarity
    return rows.agg((F.exp(F.sum(F.when(F.col("i") < n - 1, F.log(cs)).otherwise(0.0)))
                     * F.pow(F.max(F.when(F.col("i") == n - 1, sim)), F.lit(float(n - 1)))).alias("loss"))


def weight_loss(df: DataFrame, class_weights: DataFrame | None = None, edge_weight: float | None = None,
                target: str = "target", loss: str = "loss", weight_map: str = "weight_map") -> DataFrame:
    """Per-pixel loss times its class weight (class_id, weight; one row per class), and edge_weight ** weight map."""
    out = df
    if class_weights is not None:
        w = class_weights.select(F.col("class_id").alias(target), F.col("weight").alias("_w"))
        out = out.join(w, target).withColumn(loss, F.col(loss) * F.col("_w")).drop("_w")
    if edge_weight is not None:
        out = out.withColumn(loss, F.col(loss) * F.pow(F.lit(float(edge_weight)), F.col(weight_map)))
    return out


def joint_loss(parts: list[DataFrame | None], weights: list[float] | None = None) -> DataFrame:
    """Weighted sum of one-row losses; an absent branch (None) is skipped."""
    weights = weights or [1.0] * len(parts)
    rows = [p.select((F.col("loss") * w).alias("_l")) for p, w in zip(parts, weights) if p is not None]
    return reduce(DataFrame.unionAll, rows).agg(F.sum("_l").alias("loss"))
