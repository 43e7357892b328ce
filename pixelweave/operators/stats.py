"""Dataset statistics over patches, as additive sums that merge in any order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def patch_stats(df: DataFrame, column: str = "v") -> DataFrame:
    """(channel, pixel_num, channel_sum, channel_sum_sq) of v / 255. Sums of integers stay exact until the last division."""
    v = F.col(column).cast("long")
    return (df.groupBy("channel").agg(F.count(F.lit(1)).alias("pixel_num"), F.sum(v).alias("_s"), F.sum(v * v).alias("_q"))
            .select("channel", "pixel_num", (F.col("_s") / 255.0).alias("channel_sum"), (F.col("_q") / (255.0 * 255.0)).alias("channel_sum_sq")))


def merge_stats(*stats: DataFrame) -> DataFrame:
    both = stats[0]
    for s in stats[1:]:
        both = both.unionByName(s)
    return both.groupBy("channel").agg(*[F.sum(c).alias(c) for c in ("pixel_num", "channel_sum", "channel_sum_sq")])


def dataset_mean_std(stats: DataFrame) -> DataFrame:
    mean = F.col("channel_sum") / F.col("pixel_num")
    return stats.select("channel", mean.alias("mean"), F.sqrt(F.col("channel_sum_sq") / F.col("pixel_num") - mean * mean).alias("std"))


def class_table(spark: SparkSession, classes: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(n, i) for n, i in classes.items()], "class_name string, class_id int")


def class_pixels(df: DataFrame, classes: dict[str, int], column: str = "type_id") -> DataFrame:
    """(class_name, class_id, n) for every class of the dictionary, 0 where it does not occur."""
    n = df.groupBy(F.col(column).alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return (class_table(df.sparkSession, classes).join(n, "class_id", "left")
            .select("class_name", "class_id", F.coalesce("n", F.lit(0)).alias("n")))


def class_weights(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("class_id", (1 - F.col("n") / total).alias("weight"))


def binary_class_weights(counts: DataFrame) -> DataFrame:
    fg = counts.groupBy((F.col("class_id") > 0).cast("int").alias("class_id")).agg(F.sum("n").alias("n"))
    return class_weights(fg)
