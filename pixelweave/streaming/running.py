"""Streaming forms of the incremental loops: ingest in chunks, running dataset statistics, running metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.images import is_image


def stream_files(spark: SparkSession, path: str, n: int, pattern: str = "*") -> DataFrame:
    """Image files as they arrive, `n` per trigger: (name, path, length, content); another suffix fails the stream."""
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", n).load(path)
             .withColumn("name", F.element_at(F.split("path", "/"), -1)))
    return files.filter(is_image()).select("name", "path", "length", "content")


def stream_table(spark: SparkSession, path: str, n: int = 1) -> DataFrame:
    """Rows of a parquet folder as files arrive, `n` files per trigger. The schema comes from the stored files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", n).parquet(path)


def stream_tiles(source: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every chunk to `process(batch, id)`; it must be idempotent per id, as a lost run repeats its last chunk."""
    return source.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_chunks(target: str) -> Callable[[DataFrame, int], None]:
    """A processor that writes each chunk to its own folder, so that a repeated chunk replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/chunk={batch_id}")

    return write


def keep_state(result: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run a streaming aggregate over what is available; the state after chunk i is in folder chunk=i of `target`."""
    return (result.writeStream.outputMode("complete").foreachBatch(append_chunks(target)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def final_state(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    last = rows.agg(F.max("chunk")).scalar()
    return rows.filter(F.col("chunk") == last).drop("chunk")


def stream_stats(source: DataFrame, column: str = "v") -> DataFrame:
    """Pixel count and channel sums that grow as images arrive; equal to the batch statistics at any point."""
    v = F.col(column).cast("long")
    return source.groupBy("channel").agg(F.count(F.lit(1)).alias("pixel_num"), F.sum(v).alias("s"), F.sum(v * v).alias("q")).select(
        "channel", "pixel_num", (F.col("s") / 255.0).alias("channel_sum"), (F.col("q") / (255.0 * 255.0)).alias("channel_sum_sq"))


def stream_metrics(source: DataFrame, key: str, metric: str) -> DataFrame:
    """Running (sum, count) and mean of a metric per group; the partial states merge across workers."""
    return source.groupBy(key).agg(F.sum(metric).alias("total"), F.count(metric).alias("n"), F.avg(metric).alias("mean"))


def stream_metrics_windowed(source: DataFrame, key: str, metric: str, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """The same per event-time window; windows older than the watermark are final and leave the state."""
    return (source.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key)
            .agg(F.sum(metric).alias("total"), F.count(metric).alias("n"))
            .select(F.col("w.start").alias("start"), key, "total", "n"))
