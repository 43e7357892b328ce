"""Image files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Image suffixes that may be read.
SUFFIXES = (".jpeg", ".jpg", ".tif", ".tiff", ".png")


def is_image():
    """True for a `name` with the suffix of an image; any other fails the job."""
    suffix = F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1))
    return F.when(suffix.isin(*SUFFIXES), True).otherwise(F.raise_error(F.concat(F.lit("not an image file: "), F.col("name"))).cast("boolean"))


def scan_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, path, length, content) of the image files in a folder, sorted by name; another suffix fails the job."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
             .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    return files.filter(is_image()).select("name", "path", "length", "content").orderBy("name")


def scan_pixels(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, height, width, y, x, r, g, b) of 8-bit images, decoded by the JVM image source.

    The source stores blue, green, red; a grey image repeats its value. An image it cannot decode fails the job.
    """
    img = (spark.read.format("image").option("pathGlobFilter", pattern).option("dropInvalid", False).load(path).select("image.*")
           .withColumn("name", F.element_at(F.split("origin", "/"), -1)))
    decoded = F.when(F.col("height") > 0, True).otherwise(F.raise_error(F.concat(F.lit("not a readable image: "), F.col("name"))).cast("boolean"))
    rows = img.filter(decoded).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    line = F.substring(F.col("data"), F.col("y") * F.col("width") * F.col("nChannels") + 1, F.col("width") * F.col("nChannels"))
    px = rows.select("name", "height", "width", "nChannels", "y", line.alias("_row")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))

    def channel(i: int):
        n = F.col("nChannels")
        at = F.col("x") * n + F.when(n >= 3, i).otherwise(0) + 1
        return F.conv(F.hex(F.substring(F.col("_row"), at, F.lit(1))), 16, 10).cast("smallint")

    return px.select("name", "height", "width", "y", "x", channel(2).alias("r"), channel(1).alias("g"), channel(0).alias("b"))
