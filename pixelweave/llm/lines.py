"""Line dedup over two Bloom filters: only lines the filters suspect are shuffled and confirmed."""

from __future__ import annotations

import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blooms import suspected, twice_filter
from .common import SPACES, map_rows, texts

FILTER_BITS = 26  # 8 MB a filter


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACES)), string.ascii_uppercase, string.ascii_lowercase)


def _keys(text: str, least: int) -> set[bytes]:
    stripped = (x.strip(SPACES) for x in text.split("\n"))
    return {x.encode().lower() for x in stripped if len(x) >= least}


def repeated_lines(docs: DataFrame, least: int = 10, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, keys): the line keys each document must lose, because a smaller doc_id holds them too.

    Rows without doc_id take no part. Rows that share a doc_id are one document.
    """
    import xxhash

    docs = docs.filter("doc_id IS NOT NULL")

    def hashes(batches):
        for b in batches:
            found: dict[int, set[int]] = {}
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found.setdefault(i, set()).update(map(xxhash.xxh3_64_intdigest, _keys(t, least)))
            yield np.fromiter((h for hs in found.values() for h in hs), np.uint64)

    twice = twice_filter(docs, hashes, bits)

    def suspects(batches):
        for b in batches:
            ids, keys = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = list(_keys(t, least))
                hit = suspected(twice.value, np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own)))
                for k in np.flatnonzero(hit):
                    ids.append(i)
                    keys.append(own[k].decode())
            yield {"doc_id": ids, "key": keys}

    lines = map_rows(docs, suspects, "doc_id long, key string")
    firsts = lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    return (lines.join(firsts.select("key", "first"), "key").filter("doc_id > first")
            .groupBy("doc_id").agg(F.collect_set("key").alias("keys")))


def without_lines(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """All columns of `docs`, the lines under the keys of `drop` taken out of `text` and `n_chars` following it."""
    rows = docs.join(drop.select(F.col("doc_id").alias("_drop_id"), F.col("keys").alias("_drop_keys")), F.col("doc_id") == F.col("_drop_id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x: ~F.array_contains("_drop_keys", line_key(x))), "\n")
    new = rows.withColumn("text", F.when(F.col("_drop_keys").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col("_drop_keys").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return new.select(*docs.columns)


def line_dedup(docs: DataFrame, least: int = 10, bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every text without the lines that a document with a smaller doc_id holds.

    A key is a line without white space ([ \\t-\\r]) at both ends, A-Z lower-cased; keys under `least` code points stay.
    Inside one document repeated lines stay together: all of them are kept or dropped. Null and empty texts are one empty
    line; a null doc_id loses nothing and is nobody's first; rows with one doc_id count as one document; an empty table
    gives an empty table; other columns are ignored. A text whose lines all go is an empty string.

    Lines reach the shuffle only if both filters suspect them; a minimum and a maximum of doc_id per key, combined before
    the shuffle, confirm repeats, so that a line in every document costs one row a task. Way back: an equi-join on the key,
    which adaptive execution splits when one key is hot.
    """
    docs = texts(docs)
    drop = repeated_lines(docs, least, bits)
    rows = docs.join(drop, "doc_id", "left")
    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains("keys", line_key(x))))
    return (rows.select("doc_id", "text", "keys", lines.alias("lines"), kept.alias("left_over"))
            .select("doc_id", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("left_over")).cast("long").alias("n_dropped"),
                    F.array_join("left_over", "\n").alias("kept")))


def op3(spark, sf_dir):
    from .common import table

    d = line_dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


OP3_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
k AS (SELECT doc_id, lines, list_transform(lines, lambda x: translate(trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS keys FROM d),
u AS (SELECT DISTINCT doc_id, key FROM (SELECT doc_id, unnest(keys) AS key FROM k) q WHERE length(key) >= 10),
f AS (SELECT key, min(doc_id) AS first FROM u GROUP BY key HAVING count(*) > 1),
g AS (SELECT u.doc_id, list(u.key) AS gone FROM u JOIN f ON u.key = f.key WHERE u.doc_id > f.first GROUP BY u.doc_id),
r AS (SELECT k.doc_id, lines, list_filter(lines, lambda x, i: NOT list_contains(coalesce(gone, []), keys[i])) AS kept
      FROM k LEFT JOIN g ON k.doc_id = g.doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM r"""
