"""Reading, pairing and writing of pixel, patch, instance and score tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import merge_stats, patch_stats

# The masks a label table can hold, with their column types.
MASK_COLUMNS = {"inst_map": ("inst_id", "int"), "type_map": ("type_id", "int"), "sem_map": ("sem_id", "int"),
                "inst_centroid": ("centroid", "struct<x:double,y:double>"), "inst_type": ("type_id", "int"),
                "inst_bbox": ("bbox", "struct<y1:int,y2:int,x1:int,x2:int>")}
PIXEL_MASKS = ("inst_map", "type_map", "sem_map")


def scan_masks(spark: SparkSession, path: str, key: str = "inst_map") -> DataFrame:
    """One named mask of a pixel or instance table; only its columns are read."""
    if key not in MASK_COLUMNS:
        raise KeyError(f"key must be one of {sorted(MASK_COLUMNS)}")
    column, kind = MASK_COLUMNS[key]
    place = ["image_id", "y", "x"] if key in PIXEL_MASKS else ["image_id", "inst_id"]
    return spark.read.parquet(path).select(*place, F.col(column).cast(kind).alias(column))


def read_patch(spark: SparkSession, path: str, ix: int) -> DataFrame:
    """Image, instance, type and area values of one patch; files are skipped by the min/max of the sorted patch id."""
    return spark.read.parquet(os.path.join(path, "patches")).filter(F.col("patch_id") == ix)


def pair(left: DataFrame, right: DataFrame, on="name") -> DataFrame:
    """Join images and masks by name; a name that one side lacks fails the job."""
    on = [on] if isinstance(on, str) else list(on)
    both = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), on, "full_outer")
    lone = F.col("_l").isNull() | F.col("_r").isNull()
    message = F.concat(F.lit("no partner for "), F.concat_ws("/", *on))
    return both.filter(F.when(lone, F.raise_error(message).cast("boolean")).otherwise(True)).drop("_l", "_r")


def check_same_keys(left: DataFrame, right: DataFrame, on: str = "name") -> None:
    """Raise when the two key sets differ, naming a few of the keys."""
    a, b = left.select(on).distinct(), right.select(on).distinct()
    odd = (a.withColumn("_l", F.lit(True)).join(b.withColumn("_r", F.lit(True)), on, "full_outer")
           .filter("_l is null or _r is null").select(on).limit(5).collect())
    if odd:
        raise ValueError(f"key sets differ, for example at {[r[0] for r in odd]}")


def reconcile_shape(pixels: DataFrame, dims: DataFrame, keys=("image_id",)) -> DataFrame:
    """Drop the last row or column of an image that is larger than its mask; `dims` holds the sizes of both per key."""
    d = pixels.join(dims, list(keys))
    h = F.when(F.col("height") > F.col("mask_height"), F.col("height") - 1).otherwise(F.col("height"))
    w = F.when(F.col("width") > F.col("mask_width"), F.col("width") - 1).otherwise(F.col("width"))
    return d.filter((F.col("y") < h) & (F.col("x") < w)).select(*pixels.columns)


def fold_to_samples(df: DataFrame, fold: int, phase: str, tissue: str = "tissue", order: str = "pos") -> DataFrame:
    """Adds the sample name tissue_fold<fold>_<j>, j counting inside the tissue, and the phase the fold goes to."""
    from ..operators.graph import prefix_total
    if phase not in ("train", "test"):
        raise ValueError("phase must be train or test")
    n = prefix_total(df, [tissue], order, F.floor(F.col(order) / 4096), out="_j")
    return (n.withColumn("name", F.concat_ws("_", F.col(tissue), F.lit(f"fold{fold}"), F.col("_j").cast("string")))
            .withColumn("phase", F.lit(phase)).drop("_j"))


def _metadata(spark: SparkSession, meta: dict, n_items: int) -> DataFrame:
    schema = "stride int, patch_height int, patch_width int, classes map<string,int>, sem_classes map<string,int>, n_items bigint"
    row = (meta["stride"], *meta["patch_shape"], meta["classes"], meta.get("sem_classes"), n_items)
    return spark.createDataFrame([row], schema)


def _channels(patches: DataFrame) -> DataFrame:
    return patches.select(F.posexplode(F.array("r", "g", "b")).alias("channel", "v"))


def write_patches(patches: DataFrame, path: str, meta: dict, mode: str = "overwrite") -> None:
    """Store patch pixels (split, image_id, patch_id, py, px, r, g, b, inst_id, type_id, sem_id), the additive channel sums
    and one row of metadata.

    The pixels are written once, clustered by split and patch so that readers skip files; sums and counts are taken from
    what was written, not from a second run of the plan.
    """
    spark = patches.sparkSession
    files = os.path.join(path, "patches")
    load = 0 if mode == "overwrite" else _next_load(spark, path)
    (patches.repartitionByRange("split", "patch_id", "image_id", "py").sortWithinPartitions("split", "patch_id", "image_id", "py", "px")
     .withColumn("load", F.lit(load)).write.mode(mode).partitionBy("load", "split").parquet(files))  # overwriting drops all earlier loads
    written = spark.read.parquet(os.path.join(files, f"load={load}"))
    patch_stats(_channels(written)).write.mode(mode).parquet(os.path.join(path, "stats"))
    # one aggregate row, of a known size
    n = written.select("image_id", "patch_id").distinct().count()
    _metadata(spark, meta, n).withColumn("load", F.lit(load)).write.mode(mode).parquet(os.path.join(path, "meta"))


def _next_load(spark: SparkSession, path: str) -> int:
    return 1 + (spark.read.parquet(os.path.join(path, "patches")).agg(F.max("load")).first()[0] or 0)


def append_patches(patches: DataFrame, path: str, **overrides) -> None:
    """Append to a stored set, with its own parameters unless overridden. Sums are additive, so the statistics stay exact."""
    stored = dataset_metadata(patches.sparkSession, path).first()
    meta = {"stride": stored.stride, "patch_shape": (stored.patch_height, stored.patch_width), "classes": stored.classes,
            "sem_classes": stored.sem_classes, **overrides}
    write_patches(patches, path, meta, mode="append")


def dataset_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row: stride, patch shape and class dictionaries of the first load, patches of all loads."""
    m = spark.read.parquet(os.path.join(path, "meta"))
    return m.agg(*[F.min_by(c, "load").alias(c) for c in ("stride", "patch_height", "patch_width", "classes", "sem_classes")], F.sum("n_items").alias("n_items"))


def dataset_stats(spark: SparkSession, path: str) -> DataFrame:
    return merge_stats(spark.read.parquet(os.path.join(path, "stats")))


def write_instances(pixels: DataFrame, path: str) -> None:
    from ..operators.instances import instance_table
    instance_table(pixels).write.mode("overwrite").parquet(path)


def write_scores(scores: DataFrame, directory: str, prefix: str = "", per_type: bool = False) -> str:
    """Score table as CSV with a header, below <prefix>_inst_benchmark.csv or <prefix>_type_benchmark.csv."""
    path = os.path.join(directory, f"{prefix}_{'type' if per_type else 'inst'}_benchmark.csv")
    scores.write.mode("overwrite").option("header", True).csv(path)
    return path
