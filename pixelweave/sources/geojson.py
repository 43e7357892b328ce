"""Tile annotation files: JSON features in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.annotations import bounds, ring_area

# Constant fields of an exported feature.
FEATURE_TYPE = "Feature"
FEATURE_ID = "PathCellDetection"
IS_LOCKED = "false"

SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("id", T.StringType()),
    T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
    T.StructField("properties", T.StructType([
        T.StructField("isLocked", T.StringType()), T.StructField("measurements", T.ArrayType(T.StringType())),
        T.StructField("classification", T.StructType([T.StructField("name", T.StringType())]))]))])

_POLYGON = "array<array<array<double>>>"


def _points(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))


def _closed(ring: Column) -> Column:
    return F.when(F.get(ring, F.lit(0)) != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)


def parse_features(raw: DataFrame, keep=("name",)) -> DataFrame:
    """(keep, feature_id, part, class_name, ring, holes, bounds): one row per polygon; a multipolygon yields one row per part, a
    line is closed. `holes` are the interior rings, an empty array without any. Rings that are empty or enclose no area are
    dropped; a geometry of another kind fails the job."""
    coords = F.col("geometry.coordinates")
    kind = F.col("geometry.type")
    polys = (F.when(kind == "MultiPolygon", F.from_json(coords, f"array<{_POLYGON}>"))
             .when(kind == "Polygon", F.array(F.from_json(coords, _POLYGON)))
             .when(kind == "LineString", F.array(F.array(F.from_json(coords, "array<array<double>>"))))
             .when(kind.isNotNull(), F.raise_error(F.concat(F.lit("unknown geometry: "), kind)).cast(f"array<{_POLYGON}>")))
    d = (raw.select(*keep, "feature_id", F.col("properties.classification.name").alias("class_name"), F.posexplode(polys).alias("part", "_poly"))
         .withColumn("ring", _points(F.get("_poly", F.lit(0)))).filter(F.size("ring") > 2))
    inner = F.filter(F.transform(F.slice("_poly", F.lit(2), F.size("_poly")), _points), lambda r: F.size(r) > 2)
    d = d.withColumn("ring", _closed(F.col("ring"))).withColumn("holes", F.filter(F.transform(inner, _closed), lambda r: ring_area(r) > 0))
    return bounds(d.filter(ring_area(F.col("ring")) > 0).drop("_poly"))


def scan_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Polygons of all annotation files below `path`, with the file name and the position in the file.

    A file is one JSON array of features; with `lines` it is one feature per line, which can be split between tasks.
    """
    raw = spark.read.schema(SCHEMA).option("multiLine", not lines).option("recursiveFileLookup", True).json(path)
    raw = raw.withColumn("name", F.col("_metadata.file_name")).withColumn("feature_id", F.monotonically_increasing_id())
    return parse_features(raw)


def to_features(df: DataFrame, class_name: str = "class_name", ring: str = "ring", keep=()) -> DataFrame:
    """(keep, value): one JSON feature per instance, with its `holes` where there is such a column."""
    rings = F.array(ring)
    if "holes" in df.columns:
        rings = F.concat(rings, F.coalesce("holes", F.array().cast(df.schema["holes"].dataType)))
    coords = F.transform(rings, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feature = F.struct(
        F.lit(FEATURE_TYPE).alias("type"), F.lit(FEATURE_ID).alias("id"),
        F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
        F.struct(F.lit(IS_LOCKED).alias("isLocked"), F.array().cast("array<string>").alias("measurements"),
                 F.struct(F.col(class_name).alias("name")).alias("classification")).alias("properties"))
    return df.select(*keep, F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, by: tuple[str, ...] = (), **kw) -> None:
    """Feature lines below `path`, in one folder per value of `by`. The rows of a folder are brought together
    first, unless they are too many for a task, so that its files are few."""
    out = to_features(df.hint("rebalance", *by) if by else df, keep=by, **kw)
    w = out.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).text(path)
