"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next.

Toxic documents go, then repeated lines, near duplicates and documents that hold benchmark passages; what is left is encoded.
Rows with a null doc_id pass all stages; every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweave.llm.bpe import bpe_encode
from pixelweave.llm.common import table
from pixelweave.llm.decontamination import contaminated
from pixelweave.llm.lines import repeated_lines, without_lines
from pixelweave.llm.neardup import near_duplicates
from pixelweave.llm.toxicity import THRESHOLD, fit, score_column
from pixelweave.session import staging_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold by a model fitted on the labelled rows of `sf_dir`."""
    model = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return score_column(docs, model, "_score").filter(F.col("_score") < THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document with a smaller doc_id holds; n_chars follows the text."""
    return without_lines(docs, repeated_lines(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest doc_id."""
    gone = near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage and are not the larger part of one."""
    gone = contaminated(docs, table(spark, sf_dir, "benchmark"), short=True).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every document left."""
    return bpe_encode(docs, decode=False).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("bpe", encode)]

ORACLE_SQL = None  # a fitted model and byte-pair ids have no SQL form; tests compare each stage's operator with brute force by itself


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{staging_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
