"""Region annotations in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERTEX = T.StructType([T.StructField("_X", T.DoubleType()), T.StructField("_Y", T.DoubleType())])
SCHEMA = T.StructType([
    T.StructField("_Id", T.LongType()),
    T.StructField("Vertices", T.StructType([T.StructField("Vertex", T.ArrayType(_VERTEX))]))])


def scan_xml_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(name, region, ring): one closed ring per region; a vertex plus one half, cut to an integer."""
    raw = spark.read.format("xml").schema(SCHEMA).option("rowTag", "Region").load(path)
    ring = F.transform("Vertices.Vertex", lambda v: F.struct(
        (v["_X"] + 0.5).cast("int").cast("double").alias("x"), (v["_Y"] + 0.5).cast("int").cast("double").alias("y")))
    d = raw.select(F.col("_metadata.file_name").alias("name"), F.col("_Id").alias("region"), ring.alias("ring"))
    return d.withColumn("ring", F.concat("ring", F.slice("ring", 1, 1)))
