"""Helpers the operators of this folder share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, so that no other column can clash; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


_MEMORIES: dict[str, dict] = {}


def memory(name: str) -> dict:
    """What the operator of this name remembers in this worker process. Workers outlive tasks: what other operators left is let go."""
    others = [k for k in _MEMORIES if k != name]
    for k in others:
        _MEMORIES.pop(k).clear()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
    return _MEMORIES.setdefault(name, {}) if name else {}


def map_rows(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str, keeps: str = "") -> DataFrame:
    """mapInArrow where `fn` yields one dict of columns for each output batch, beside the `memory` that it `keeps` alone."""
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches):
        memory(keeps)
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    kind = _parse_datatype_string(schema)
    assert isinstance(kind, StructType)
    return to_arrow_schema(kind)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes:
    """64-bit hashes of byte words, remembered between calls up to `limit` words."""

    def __init__(self, limit: int = 1_000_000) -> None:
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > self.limit:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words; with fewer words the whole sequence is one; no words, none."""
    if not len(h):
        return h
    n = max(1, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(h))):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return out


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a staged folder that later steps no longer read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
