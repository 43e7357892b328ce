"""Connected components of an edge table, and rank numbers that do not gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages, releasing


def _stars(edges: DataFrame, keys) -> bool:
    """Is every node on an edge (a, b) either the root b of others or an `a` of one root? Then each component is its own star."""
    ends = (edges.select(*keys, F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .union(edges.select(*keys, "b", F.lit(0), F.lit(1))))
    with releasing(edges.sparkSession):
        most = ends.groupBy(*keys, "node").agg((F.sum("up") + F.max("down")).alias("n")).agg(F.max("n")).first()[0]
    return most is None or most < 2


def graph_components(edges: DataFrame, keys=("image_id",)) -> DataFrame:
    """(keys, node, root) for every node on an edge (keys, a, b); root is the smallest node of its component.

    Alternating star contraction (Kiveris et al., 2014): every round is a minimum per node and an equi-join, neighbours
    are never collected, so a node of any degree is a sum over tasks; the number of rounds grows with the logarithm of
    the graph, and ends with the one that leaves only stars. Rounds are staged, and a round's tables are deleted once the next
    one is written. Edges with a null key are passed over.
    """
    stages = Stages()
    e = (edges.select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
         .filter("a <> b").dropna(subset=list(keys) or None).distinct())
    e = stages.add(e)
    while not _stars(e, keys):
        # large star: larger neighbours move to the smallest neighbour
        both = e.union(e.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.join(low, [*keys, "a"]).filter("b > a")
                 .select(*keys, F.col("b").alias("a"), F.col("m").alias("b")))
        large = stages.add(large)  # no more rows than before; the small star makes them distinct
        # small star: smaller neighbours and the node itself move to the smallest neighbour
        low = large.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = (large.join(low, [*keys, "a"]).select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select(*keys, "a", F.col("m").alias("b"))).filter("a <> b").distinct())
        past, e = e, stages.add(small)
        stages.drop(past, large)
    roots = e.select(*keys, F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(e.select(*keys, F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def prefix_total(df: DataFrame, keys, order, bucket: Column, value: Column | None = None, out: str = "before") -> DataFrame:
    """Sum of `value` (default 1) over the rows of the same keys that come earlier in `order`.

    `bucket` must not fall along `order`. Each (keys, bucket) is summed on its own and then shifted by the total of the
    buckets before it, so a key that holds most rows is still spread over many tasks.
    """
    value = F.lit(1) if value is None else value
    order = [order] if isinstance(order, (str, Column)) else list(order)
    b = df.withColumn("_b", bucket).withColumn("_v", value.cast("long"))
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = (b.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
             .select(*keys, "_b", F.coalesce(F.sum("_s").over(past), F.lit(0)).alias("_o")))
    inner = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (b.withColumn("_l", F.coalesce(F.sum("_v").over(inner), F.lit(0))).join(shift, [*keys, "_b"])
            .withColumn(out, F.col("_o") + F.col("_l")).drop("_b", "_v", "_l", "_o"))


def dense_number(df: DataFrame, keys, order: str, width: int, out: str = "label") -> DataFrame:
    """Number the distinct values of an integer column 1, 2, ... within keys: (keys, order, out)."""
    d = df.select(*keys, order).distinct()
    n = prefix_total(d, keys, order, F.floor(F.col(order) / width), out=out)
    return n.withColumn(out, (F.col(out) + 1).cast("int"))
