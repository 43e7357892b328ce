"""Benchmark jobs: score tables per image, per class and per name pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.tables import check_same_keys

SET_AVERAGE = "averages_for_the_set"


def _numeric(scores: DataFrame) -> list[str]:
    return [c for c, t in scores.dtypes if t == "double"]


def _averages(scores: DataFrame, label, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in _numeric(scores)]).withColumn("name", label)


def merge_maps(pred: DataFrame, true: DataFrame, keys=("name",), typed: bool = False) -> DataFrame:
    """One row per labelled pixel with both ids, from two sparse maps (keys, y, x, inst_id[, type_id]).

    The maps are stacked and reduced by one aggregate: half the shuffles of a full outer join, and no null keys.
    """
    def side(df, this, other):
        cols = [F.col("inst_id").alias(f"{this}_id"), F.lit(0).alias(f"{other}_id")]
        if typed:
            cols += [F.col("type_id").alias(f"{this}_cls"), F.lit(0).alias(f"{other}_cls")]
        return df.filter("inst_id > 0").select(*keys, "y", "x", *cols)

    both = side(pred, "pred", "true").unionByName(side(true, "true", "pred"))
    cols = [c for c in both.columns if c not in (*keys, "y", "x")]
    return both.groupBy(*keys, "y", "x").agg(*[F.max(c).alias(c) for c in cols])


def benchmark_insts(pred: DataFrame, true: DataFrame, n_pixels: int, names: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Ten scores per sample name plus the row of set averages.

    `names` holds the sample names of both sides; they must be the same. A sample without true instances yields no row.
    """
    if names is not None:
        check_same_keys(*names)
    scores = metrics.compute_metrics(merge_maps(pred, true), n_pixels, keys=("name",))
    return scores.unionByName(_averages(scores, F.lit(SET_AVERAGE)))


def pattern_avgs(scores: DataFrame, patterns: list[str]) -> DataFrame:
    """Append one row `<pattern>_avg` per regular expression: the mean over the rows whose name contains it.

    The set-average row takes part like any other row. The patterns are a literal array, so no join is needed.
    """
    hit = (scores.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in patterns])))
           .filter(F.expr("name rlike _p")))
    avg = hit.groupBy("_p").agg(*[F.avg(c).alias(c) for c in _numeric(scores)])
    return scores.unionByName(avg.withColumn("name", F.concat("_p", F.lit("_avg"))).drop("_p"))


def per_class_pixels(pixels: DataFrame, keys=("name",)) -> DataFrame:
    """Each pixel once per class it carries on either side, with the ids of other classes set to background."""
    cls = F.array_distinct(F.filter(F.array("true_cls", "pred_cls"), lambda c: c > 0))
    c = F.col("class_id")
    return (pixels.withColumn("class_id", F.explode(cls))
            .select("class_id", *keys, "y", "x",
                    F.when(F.col("true_cls") == c, F.col("true_id")).otherwise(0).alias("true_id"),
                    F.when(F.col("pred_cls") == c, F.col("pred_id")).otherwise(0).alias("pred_id")))


def benchmark_per_type(pred: DataFrame, true: DataFrame, classes: dict[str, int], n_pixels: int,
                       patterns: list[str] | None = None) -> DataFrame:
    """Scores per class and sample in one pass keyed by (class, name), with one average row per class."""
    named = {i: n for n, i in list(classes.items())[1:]}
    px = per_class_pixels(merge_maps(pred, true, typed=True)).filter(F.col("class_id").isin(*named))
    lookup = F.create_map(*[F.lit(v) for kv in named.items() for v in kv])
    scores = (metrics.compute_metrics(px, n_pixels, keys=("class_id", "name"))
              .withColumn("class_name", lookup[F.col("class_id")]).drop("class_id"))
    avg = _averages(scores, F.concat("class_name", F.lit("_avg_for_the_set")), "class_name")
    out = scores.unionByName(avg)
    if patterns:
        hit = out.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in patterns]))).filter(F.expr("name rlike _p"))
        pat = hit.groupBy("class_name", "_p").agg(*[F.avg(c).alias(c) for c in _numeric(scores)])
        out = out.unionByName(pat.withColumn("name", F.concat_ws("_", "class_name", "_p", F.lit("avg"))).drop("_p"))
    return out
