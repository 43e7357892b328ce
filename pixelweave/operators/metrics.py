"""Segmentation scores from sparse label pixels.

Only `joint_counts` touches pixel volume: one partial-then-final count per (image, true id, predicted id). All scores are
additive sums over that table, so the plans after it carry instances, not pixels. Ids need not be contiguous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .matching import best_assignment

# Smoothing constants of the published scores.
PQ_EPS = 1e-6
AJI_EPS = 1e-6
IOU_EPS = 1e-7

SCORE_COLUMNS = ("AJI", "AJI_plus", "DICE2", "PQ", "SQ", "DQ", "inst_recall", "inst_precision", "splits", "merges")


def joint_counts(pixels: DataFrame, keys=("image_id",), true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """(keys, t, p, n, both): pixels per pair of labels; a missing label is background.

    Labels are made non-null, and `both` repeats n where neither side is background. Branches filter on such aggregates
    instead of on t and p: filters on grouping keys would sink below the aggregate, differ per branch, and make Spark
    scan the pixels once per branch instead of reusing one exchange.
    """
    return (pixels.select(*keys, F.coalesce(F.col(true), F.lit(0)).alias("t"), F.coalesce(F.col(pred), F.lit(0)).alias("p"))
            .groupBy(*keys, "t", "p")
            .agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("t") > 0) & (F.col("p") > 0), 1)).alias("both")))


def areas(joint: DataFrame, side: str, keys=("image_id",)) -> DataFrame:
    """(keys, id, area): pixels per label of one side, null for background."""
    return (joint.groupBy(*keys, side)
            .agg(F.sum(F.when(F.col(side) > 0, F.col("n"))).alias("area")))


def overlaps(pixels: DataFrame, keys=("image_id",), true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """Intersection size of every overlapping (true, predicted) pair, background left out."""
    return (joint_counts(pixels.filter((F.col(true) > 0) & (F.col(pred) > 0)), keys, true, pred)
            .select(*keys, F.col("t").alias(true), F.col("p").alias(pred), F.col("n").alias("inter")))


def pair_table(joint: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, t, p, inter, t_area, p_area) for overlapping pairs."""
    t = areas(joint, "t", keys).select(*keys, "t", F.col("area").alias("t_area"))
    p = areas(joint, "p", keys).select(*keys, "p", F.col("area").alias("p_area"))
    return (joint.join(t, [*keys, "t"]).join(p, [*keys, "p"])
            .filter("both > 0").select(*keys, "t", "p", F.col("both").alias("inter"), "t_area", "p_area"))


def iou(eps: float = 0.0) -> Column:
    union = F.col("t_area") + F.col("p_area") - F.col("inter")
    return F.col("inter") / (union + eps) if eps else F.col("inter") / union


def pair_iou(pixels: DataFrame, keys=("image_id",), eps: float = 0.0, true="true_id", pred="pred_id") -> DataFrame:
    return (pair_table(joint_counts(pixels, keys, true, pred), keys)
            .select(*keys, F.col("t").alias(true), F.col("p").alias(pred), "inter", "t_area", "p_area",
                    iou(eps).alias("iou")))


def _sums(keys, *parts: DataFrame) -> DataFrame:
    """Add up additive parts that share `keys`; each part may carry its own columns."""
    cols = [c for part in parts for c in part.columns if c not in keys]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in dict.fromkeys(cols)])


def _counts(joint: DataFrame, keys) -> list[DataFrame]:
    """Instances per side and the entropy terms of the marginals, from one aggregate per side."""
    out = []
    for side in ("t", "p"):
        a = areas(joint, side, keys)
        area = F.col("area")
        out.append(a.groupBy(*keys).agg(F.count(area).alias(f"n_{side}"), F.sum(area).alias(f"area_{side}"),
                                        F.sum(area * F.log2(area)).alias(f"xlog_{side}")))
    return out


def _pq_part(pairs: DataFrame, keys, match_iou: float) -> DataFrame:
    hit = iou() > match_iou
    return pairs.groupBy(*keys).agg(F.sum(hit.cast("long")).alias("tp"), F.sum(F.when(hit, iou())).alias("iou_sum"))


def _pq_columns() -> list[Column]:
    tp = F.col("tp")
    fp, fn = F.col("n_p") - tp, F.col("n_t") - tp
    dq = tp / (tp + 0.5 * fp + 0.5 * fn + PQ_EPS)
    sq = F.coalesce(F.col("iou_sum"), F.lit(0.0)) / (tp + PQ_EPS)
    return [(dq * sq).alias("PQ"), sq.alias("SQ"), dq.alias("DQ"), (tp / (tp + fn + PQ_EPS)).alias("inst_recall"),
            (tp / (tp + fp + PQ_EPS)).alias("inst_precision")]


def pq(pixels: DataFrame, match_iou: float = 0.5, keys=("image_id",), true="true_id", pred="pred_id") -> DataFrame:
    """Panoptic quality. From 0.5 on a pair over the limit is unique; below it a best one-to-one matching comes first."""
    if match_iou < 0:
        raise ValueError("match_iou can not be negative")
    joint = joint_counts(pixels, keys, true, pred)
    pairs = pair_table(joint, keys)
    if match_iou < 0.5:
        joint = stage(joint)
        pairs = stage(pair_table(joint, keys))
        chosen = best_assignment(pairs.select(*keys, "t", "p", iou().alias("w")), keys)
        pairs = pairs.join(chosen, [*keys, "t", "p"], "left_semi")
    return _sums(keys, _pq_part(pairs, keys, match_iou), *_counts(joint, keys)).select(*keys, *_pq_columns())


def _aji_part(best: DataFrame, joint: DataFrame, keys, prefix: str) -> DataFrame:
    """Intersection, union and what stays unpaired, for a set of chosen pairs (t, p, inter, union)."""
    used_t = best.select(*keys, "t").distinct()
    used_p = best.select(*keys, "p").distinct()
    chosen = best.groupBy(*keys).agg(F.sum("inter").alias(f"{prefix}_i"), F.sum("union").alias(f"{prefix}_u"))
    rest = []
    for side, used in (("t", used_t), ("p", used_p)):
        rest.append(areas(joint, side, keys).filter("area is not null").join(used, [*keys, side], "left_anti")
                    .groupBy(*keys).agg(F.sum("area").alias(f"{prefix}_u")))
    return _sums(keys, chosen, *rest)


def _best_per_true(pairs: DataFrame, keys) -> DataFrame:
    union = F.col("t_area") + F.col("p_area") - F.col("inter")
    top = F.max(F.struct(iou(AJI_EPS).alias("iou"), (-F.col("p")).alias("q"), "inter", union.alias("union")))
    return (pairs.groupBy(*keys, "t").agg(top.alias("b"))
            .select(*keys, "t", (-F.col("b.q")).alias("p"), "b.inter", "b.union"))


def _ratio(prefix: str) -> Column:
    return F.try_divide(F.col(f"{prefix}_i"), F.col(f"{prefix}_u"))


def aji(pixels: DataFrame, keys=("image_id",), true="true_id", pred="pred_id") -> DataFrame:
    """Aggregated Jaccard: every true label takes its best predicted label, which may be reused."""
    joint = joint_counts(pixels, keys, true, pred)
    best = _best_per_true(pair_table(joint, keys), keys)
    return _aji_part(best, joint, keys, "aji").select(*keys, _ratio("aji").alias("AJI"))


def _matched(pairs: DataFrame, keys) -> DataFrame:
    chosen = best_assignment(pairs.select(*keys, "t", "p", iou(AJI_EPS).alias("w")), keys)
    return (pairs.join(chosen, [*keys, "t", "p"], "left_semi")
            .withColumn("union", F.col("t_area") + F.col("p_area") - F.col("inter")))


def aji_plus(pixels: DataFrame, keys=("image_id",), true="true_id", pred="pred_id") -> DataFrame:
    """Aggregated Jaccard over the one-to-one matching with the largest summed IoU."""
    joint = stage(joint_counts(pixels, keys, true, pred))
    pairs = stage(pair_table(joint, keys))
    return _aji_part(_matched(pairs, keys), joint, keys, "ajp").select(*keys, _ratio("ajp").alias("AJI_plus"))


def _dice_part(pairs: DataFrame, keys) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.sum("inter").alias("d_i"), F.sum(F.col("t_area") + F.col("p_area")).alias("d_s"))


def _dice_column() -> Column:
    return (2 * F.col("d_i") / (F.col("d_s") + PQ_EPS)).alias("DICE2")


def dice2(pixels: DataFrame, keys=("image_id",), true="true_id", pred="pred_id") -> DataFrame:
    """Ensemble Dice: areas are counted once per overlapping pair."""
    joint = joint_counts(pixels, keys, true, pred)
    return _sums(keys, _dice_part(pair_table(joint, keys), keys), *_counts(joint, keys)).select(*keys, _dice_column())


def _entropy_part(joint: DataFrame, keys) -> DataFrame:
    n = F.when((F.col("t") > 0) | (F.col("p") > 0), F.col("n"))
    return joint.groupBy(*keys).agg(F.sum(n).alias("n_any"), F.sum(n * F.log2(n)).alias("xlog_tp"))


def _entropy_columns(n_pixels: int) -> list[Column]:
    """Conditional entropies in bits; the background cells a sparse table leaves out come from the image size."""
    def xlog(v):
        return F.when(v > 0, v * F.log2(v)).otherwise(0.0)

    total = F.lit(float(n_pixels))
    s_tp = F.col("xlog_tp") + xlog(total - F.col("n_any"))
    s_t = F.col("xlog_t") + xlog(total - F.col("area_t"))
    s_p = F.col("xlog_p") + xlog(total - F.col("area_p"))
    return [((s_t - s_tp) / total).alias("splits"), ((s_p - s_tp) / total).alias("merges")]


def split_merge(pixels: DataFrame, n_pixels: int, keys=("image_id",), true="true_id", pred="pred_id") -> DataFrame:
    """Splits H(pred | true) and merges H(true | pred), background counted as a label."""
    joint = joint_counts(pixels, keys, true, pred)
    return _sums(keys, _entropy_part(joint, keys), *_counts(joint, keys)).select(*keys, *_entropy_columns(n_pixels))


def conventional(grid: DataFrame, keys=("image_id",), true="true_id", pred="pred_id") -> DataFrame:
    """Dice, IoU, sensitivity, specificity of the binary masks on the full grid.

    The true-negative count holds every pixel on which both masks agree, hits included. A score without a
    denominator is null.
    """
    t, p = F.coalesce(F.col(true), F.lit(0)) > 0, F.coalesce(F.col(pred), F.lit(0)) > 0
    c = grid.groupBy(*keys).agg(
        F.sum((t & p).cast("long")).alias("tp"), F.sum((t == p).cast("long")).alias("tn"),
        F.sum((~t & p).cast("long")).alias("fp"), F.sum((t & ~p).cast("long")).alias("fn"))
    dice = F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select(*keys, dice.alias("dice"), (dice / (2 - dice)).alias("iou"),
                    F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
                    F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"))


def compute_metrics(pixels: DataFrame, n_pixels: int, keys=("image_id",), true="true_id", pred="pred_id") -> DataFrame:
    """The ten scores per key; a key without any true label yields no row."""
    joint = stage(joint_counts(pixels, keys, true, pred))
    pairs = stage(pair_table(joint, keys))
    parts = [_pq_part(pairs, keys, 0.5), _dice_part(pairs, keys), _entropy_part(joint, keys), *_counts(joint, keys),
             _aji_part(_best_per_true(pairs, keys), joint, keys, "aji"),
             _aji_part(_matched(pairs, keys), joint, keys, "ajp")]
    return (_sums(keys, *parts).filter("n_t > 0")
            .select(*keys, _ratio("aji").alias("AJI"), _ratio("ajp").alias("AJI_plus"), _dice_column(), *_pq_columns(),
                    *_entropy_columns(n_pixels)))


# --- class-level scores of dense predictions -------------------------------------------------------------------------

def confusion_matrix(df: DataFrame, n_classes: int, sample: str = "sample", pred: str = "pred", target: str = "target") -> DataFrame:
    """(sample, pred, target, n) with every cell of the class grid, empty cells as 0."""
    cells = df.groupBy(sample, pred, target).agg(F.count(F.lit(1)).alias("n"))
    classes = F.sequence(F.lit(0), F.lit(n_classes - 1))
    grid = (cells.select(sample).distinct().withColumn(pred, F.explode(classes)).withColumn(target, F.explode(classes))
            .withColumn("n", F.lit(0).cast("long")))
    return (cells.select(sample, F.col(pred).cast("int").alias(pred), F.col(target).cast("int").alias(target), "n")
            .unionByName(grid).groupBy(sample, pred, target).agg(F.sum("n").alias("n")))


def class_iou(cm: DataFrame, sample="sample", pred="pred", target="target", eps: float = IOU_EPS) -> DataFrame:
    """IoU per sample and class. A cell adds to its row class and its column class, so one explode replaces two joins."""
    n = F.col("n")
    side = cm.select(sample, F.explode(F.array(
        F.struct(F.col(pred).alias("class_id"), n.alias("all"), F.when(F.col(pred) == F.col(target), n).otherwise(0).alias("diag")),
        F.struct(F.col(target).alias("class_id"), n.alias("all"), F.lit(0).cast("long").alias("diag")))).alias("s")).select(sample, "s.*")
    s = side.groupBy(sample, "class_id").agg(F.sum("all").alias("a"), F.sum("diag").alias("d"))
    return s.select(sample, "class_id", ((F.col("d") + eps) / (F.col("a") - F.col("d") + eps)).alias("iou"))


def accuracy(cm: DataFrame, keys=(), n_classes: int | None = None, sample="sample", pred="pred", target="target",
             eps: float = IOU_EPS) -> DataFrame:
    """Sum over samples and classes of (diag + eps) / (total + eps), the total taken over the whole batch."""
    diag = F.when(F.col(pred) == F.col(target), F.col("n"))
    s = cm.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(diag).alias("d"), F.count(diag).alias("cells"))
    return s.select(*keys, ((F.col("d") + F.col("cells") * eps) / (F.col("total") + eps)).alias("accuracy"))


def metric_mean(df: DataFrame, batch: str = "batch", n_classes: int = 2, sample="sample", pred="pred", target="target") -> DataFrame:
    """Mean over batches of batch accuracy and batch mean IoU: (sum, count) states that merge in any order."""
    cm = (confusion_matrix(df.withColumn(sample, F.struct(F.col(batch).alias("b"), F.col(sample).alias("s"))),
                           n_classes, sample, pred, target))
    acc = accuracy(cm.withColumn(batch, F.col(f"{sample}.b")), (batch,), sample=sample, pred=pred, target=target)
    miou = (class_iou(cm, sample, pred, target).groupBy(F.col(f"{sample}.b").alias(batch)).agg(F.avg("iou").alias("miou")))
    return acc.join(miou, batch).agg(F.avg("accuracy").alias("accuracy"), F.avg("miou").alias("miou"),
                                     F.count(F.lit(1)).alias("n_batches"))


def epoch_means(log: DataFrame, keys=("phase", "epoch")) -> DataFrame:
    return log.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("accuracy", "miou", "loss")])
