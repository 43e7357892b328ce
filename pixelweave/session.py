"""Session defaults and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ESTIMATED, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
EVERY_KEY = "spark.sql.requireAllClusterKeysForCoPartition"


def build_session(app: str = "pixelweave", master: str | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with adaptive execution on. On a cluster leave `master` and `shuffle_partitions` unset."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config(ESTIMATED, "-1")
         .config(MEASURED, "10MB")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false"))
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def measured_joins(spark: SparkSession) -> None:
    """From now on no join of the session is broadcast by an estimate; adaptive execution still broadcasts what it has measured.

    Estimates do not know how many rows an explode makes, and a staged pixel takes a few bits of a file: tables of hundreds of
    millions of pixels stay below the threshold and would be collected by the driver. The session's own threshold goes on to
    hold for measured sizes. Tables dealt by image are joined by pixel where they are, without another shuffle.
    """
    if spark.conf.get(MEASURED, None) is None:
        spark.conf.set(MEASURED, spark.conf.get(ESTIMATED))
    spark.conf.set(ESTIMATED, "-1")
    spark.conf.set(EVERY_KEY, "false")


def spread(df: DataFrame, *columns: str, least: int = 1) -> DataFrame:
    """Rows dealt by `columns` over all shuffle partitions, or over `least` if that is more, to be multiplied there.

    The count is given, since adaptive execution would put rows that are small before they are multiplied into a few tasks.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, least)
    return df.repartition(n, *columns)


def staging_dir(spark: SparkSession) -> str:
    """Shared folder for staged tables: what the cluster names in `spark.checkpoint.dir`.

    Only a local session without that setting falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    own = tempfile.mkdtemp(prefix="pixelweave-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def releasing(spark: SparkSession):
    """Actions inside give up their shuffle files as soon as they end, rather than when the driver collects its garbage."""
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def _write(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/stage-{uuid.uuid4().hex}"
    with releasing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once to shared storage and read it back.

    Cuts the lineage of iterative plans, keeps a loop's input stable when executors are lost, and gives the next plan
    real file sizes, so that broadcasts are decided on measured data.
    """
    return _write(df)[0]


class Stages:
    """Staged tables of one job, deleted as soon as `drop` names them: nothing may read a table from then on."""

    def __init__(self) -> None:
        self._paths: list[tuple[DataFrame, str]] = []

    def add(self, df: DataFrame) -> DataFrame:
        self._paths.append(_write(df))
        return self._paths[-1][0]

    def drop(self, *tables: DataFrame | None) -> None:
        """Tables that were not staged here, and None, are passed over."""
        gone = [x for x in self._paths if any(x[0] is t for t in tables)]
        self._paths = [x for x in self._paths if all(x[0] is not t for t in tables)]
        for table, path in gone:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
