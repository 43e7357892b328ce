"""Per-image and per-dataset normalization of long pixel tables (image_id, y, x, channel, v).

Statistics are grouped aggregates with partial sums, joined back by key: an image that holds most rows neither ends up in
one window nor in one task, and adaptive execution broadcasts the small side after measuring it. Percentiles, one row a key, are
looked up in a hash table of each task's keys, so that pixels are not sorted for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Stages, stage

# Guards of the published normalizations.
PERCENTILE_EPS = 1e-7
CLAMP_EPS = 1e-7
ACCURACY = 10000  # equal parts into which a bucket is split as long as it holds several values
FINE, ZERO, NAN = 1024, 2_000_000, 4_000_000  # parts of an octave; buckets of zero and of NaN


def _bucket(x: Column) -> Column:
    """Number that never falls as `x` grows: of the sign and 1/1024 of an octave."""
    size = F.floor(F.least(F.log2(F.abs(x)), F.lit(1025.0)) * FINE).cast("int")
    return F.when(F.isnan(x), NAN).when(x == 0, 0).when(x > 0, size + ZERO).otherwise(-size - ZERO)


def order_values(df: DataFrame, keys, column: str, ranks: dict[str, tuple[float, Column]]) -> DataFrame:
    """(keys, n, least, largest, names): exact order statistics per key, nulls and null keys left out.

    `ranks` maps a name to (q, rank): the zero-based rank is an expression over `n` (rows per key). A scan counts the values of
    each key by buckets that do not fall as values grow; the bucket of a rank is known from the counts before it. A bucket of one
    value is settled. The rows of the others are scanned again and counted in ACCURACY equal parts between the least and the largest
    value of their bucket, until all are settled, whatever the distribution: the least and the largest value never share a part. Images of
    whole numbers take one scan. One row a bucket is all that is sorted, so a key that holds most rows is still many tasks.
    """
    keys, names = list(keys), list(ranks)
    stages = Stages()
    rows = df.select(*keys, (F.col(column).cast("double") + F.lit(0.0)).alias("_x")).filter("_x IS NOT NULL").dropna(subset=keys or None)

    def counted(inside: DataFrame, by: list[str], bucket: Column) -> DataFrame:
        """Buckets of the groups `by`: rows, least and largest value, and rows in the buckets before."""
        past = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        return (inside.groupBy(*by, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
                .withColumn("_before", F.coalesce(F.sum("_n").over(past), F.lit(0))))

    whole = Window.partitionBy(*keys)
    first = counted(rows, keys, _bucket(F.col("_x"))).select(
        "*", F.sum("_n").over(whole).alias("n"), F.min("_lo").over(whole).alias("least"), F.max("_hi").over(whole).alias("largest"))
    first = first.groupBy(*keys, "n", "least", "largest").agg(*[
        F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n")), F.struct(
            F.lit(name).alias("_name"), rank.cast("long").alias("_rank"), "_lo", "_hi", F.col("_before").alias("_base")))).alias(name)
        for name, (_, rank) in ranks.items()])
    first = stages.add(first)
    at = first.select(*keys, F.explode(F.array(*names)).alias("_at")).select(*keys, "_at.*")
    settled, todo, used = at.filter("_lo <=> _hi"), at.filter("NOT _lo <=> _hi"), [first]
    while not todo.isEmpty():
        lo, hi = F.col("_from"), F.col("_to")
        ends = todo.select(*keys, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")).distinct()
        inside = rows.join(ends.hint("shuffle_hash"), keys).filter(F.col("_x").between(lo, hi))
        part = counted(inside, [*keys, "_from", "_to"], F.floor((F.col("_x") - lo) / (hi - lo) * ACCURACY).cast("int"))
        open_ = todo.select(*keys, "_name", "_rank", "_base", F.col("_lo").alias("_from"), F.col("_hi").alias("_to"))
        base = F.col("_base") + F.col("_before")
        at = stages.add(part.join(open_.hint("shuffle_hash"), [*keys, "_from", "_to"]).filter((base <= F.col("_rank")) & (F.col("_rank") < base + F.col("_n")))
                        .select(*keys, "_name", "_rank", "_lo", "_hi", base.alias("_base")))
        settled, todo, used = settled.unionByName(at.filter("_lo <=> _hi")), at.filter("NOT _lo <=> _hi"), [*used, at]
    values = settled.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_lo"))).alias(name) for name in names])
    out = stage(first.drop(*names).join(values, keys) if keys else first.drop(*names).crossJoin(values))
    stages.drop(*used)
    return out


def percentiles(df: DataFrame, keys, column: str, qs: dict[str, float]) -> DataFrame:
    """(keys, varies, names): exact percentiles (q in 0..1) with linear interpolation between neighbouring order statistics;
    `varies` says whether there is more than one value."""
    ranks = {}
    for name, q in qs.items():
        k = F.floor((F.col("n") - 1) * F.lit(q))
        ranks[f"_{name}_a"], ranks[f"_{name}_b"] = (q, k), (q, F.least(k + 1, F.col("n") - 1))
    s = order_values(df, keys, column, ranks)
    outs = []
    for name, q in qs.items():
        h = (F.col("n") - 1) * F.lit(q)
        outs.append((F.col(f"_{name}_a") + (F.col(f"_{name}_b") - F.col(f"_{name}_a")) * (h - F.floor(h))).alias(name))
    return s.select(*keys, (F.col("least") < F.col("largest")).alias("varies"), *outs)


def percentile_nearest(df: DataFrame, q: float, keys=("image_id", "channel"), column: str = "v", out: str = "value") -> DataFrame:
    """The k-th smallest value with k = 1 + round(q / 100 * (n - 1)), halves to even, no interpolation."""
    rank = F.bround(F.lit(0.01 * q) * (F.col("n") - 1)).cast("long")
    return order_values(df, keys, column, {out: (0.01 * q, rank)}).select(*keys, out)


def _image(keys) -> list[str]:
    return [k for k in keys if k != "channel"]


def _varies(per: DataFrame, keys) -> DataFrame:
    """Per image: whether every channel has more than one value. Otherwise the image is left as it is."""
    return per.groupBy(*_image(keys)).agg(F.min("varies").alias("_varies"))


def percentile_normalize(df: DataFrame, keys=("image_id", "channel"), column: str = "v", eps: float = PERCENTILE_EPS) -> DataFrame:
    per = percentiles(df, keys, column, {"_p1": 0.01, "_p99": 0.99})
    p = per.drop("varies").join(_varies(per, keys), _image(keys))
    v = F.col(column).cast("double")
    return (df.join(p.hint("shuffle_hash"), list(keys)).withColumn(column, F.when(F.col("_varies"), (v - F.col("_p1")) / (F.col("_p99") - F.col("_p1") + eps)).otherwise(v))
            .drop("_p1", "_p99", "_varies"))


def percentile_normalize_and_clamp(df: DataFrame, lo: float = -1.0, hi: float = 1.0, eps: float = CLAMP_EPS,
                                   keys=("image_id",), columns=("v",)) -> DataFrame:
    """clip(v / (max(p99, p1) + eps), lo, hi) for each column."""
    out = df
    for c in columns:
        p = percentiles(df, keys, c, {"_p1": 0.01, "_p99": 0.99}).drop("varies")
        scaled = F.col(c).cast("double") / (F.greatest("_p99", "_p1") + eps)
        out = out.join(p.hint("shuffle_hash"), list(keys)).withColumn(c, F.greatest(F.least(scaled, F.lit(float(hi))), F.lit(float(lo)))).drop("_p1", "_p99")
    return out


def percentile_normalize_nearest(df: DataFrame, keys=("image_id", "channel"), column: str = "v") -> DataFrame:
    """(v - p1) / (p99 - p1) with nearest percentiles; null where the two are equal."""
    n1 = F.col("n") - 1
    p = order_values(df, keys, column, {"_p1": (0.01, F.bround(F.lit(0.01) * n1).cast("long")), "_p99": (0.99, F.bround(F.lit(0.99) * n1).cast("long"))}).drop("least", "largest")
    return (df.join(p.hint("shuffle_hash"), list(keys)).withColumn(column, F.try_divide(F.col(column) - F.col("_p1"), F.col("_p99") - F.col("_p1")))
            .drop("_p1", "_p99", "n"))


def normalize(df: DataFrame, standardize: bool = True, keys=("image_id", "channel"), column: str = "v", sample: bool = False) -> DataFrame:
    """Mean-centre per channel and divide by the deviation. The population form leaves images with a constant channel;
    in the sample form a constant channel, or one of a single pixel, is null."""
    std = F.stddev_samp(column) if sample else F.stddev_pop(column)
    s = df.groupBy(*keys).agg(F.avg(column).alias("_m"), std.alias("_s"), (F.max(column) > F.min(column)).alias("_v"))
    v = F.col(column).cast("double")
    new = v - F.col("_m")
    if standardize:
        new = F.try_divide(new, F.col("_s"))
    if sample:
        return df.join(s, list(keys)).withColumn(column, new).drop("_m", "_s", "_v")
    ok = s.groupBy(*_image(keys)).agg(F.min("_v").alias("_varies"))
    s = s.drop("_v").join(ok, _image(keys))
    return df.join(s, list(keys)).withColumn(column, F.when(F.col("_varies"), new).otherwise(v)).drop("_m", "_s", "_varies")


def normalize_sample(df: DataFrame, keys=("image_id", "channel"), column: str = "v") -> DataFrame:
    return normalize(df, True, keys, column, sample=True)


def minmax_normalize(df: DataFrame, per_channel: bool = False, keys=("image_id", "channel"), column: str = "v") -> DataFrame:
    """Scale to 0..1 by one range over all channels (images with a constant channel stay), or by one range per channel (a
    constant channel is null)."""
    per = df.groupBy(*keys).agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    v = F.col(column).cast("double")
    scaled = F.try_divide(v - F.col("_lo"), (F.col("_hi") - F.col("_lo")).cast("double"))
    if per_channel:
        return df.join(per, list(keys)).withColumn(column, scaled).drop("_lo", "_hi")
    img = _image(keys)
    s = per.groupBy(*img).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min(F.col("_hi") > F.col("_lo")).alias("_ok"))
    return df.join(s, img).withColumn(column, F.when(F.col("_ok"), scaled).otherwise(v)).drop("_lo", "_hi", "_ok")


def dataset_normalize(df: DataFrame, stats: DataFrame, to_uint8: bool = True, column: str = "v") -> DataFrame:
    """(v - mean) / std with dataset statistics (channel, mean, std); a zero deviation fails. `stats` has one row per channel."""
    k = 255.0 if to_uint8 else 1.0
    std = F.when(F.col("std") == 0, F.raise_error(F.lit("zero deviation in dataset statistics"))).otherwise(F.col("std"))
    return (df.join(F.broadcast(stats.select("channel", "mean", "std")), "channel")
            .withColumn(column, (F.col(column) - F.col("mean") * k) / (std * k)).drop("mean", "std"))


def float2ubyte(df: DataFrame, normalize: bool = False, keys=("image_id", "channel"), column: str = "v") -> DataFrame:
    """Clip to [-1, 1], or scale to 0..1 first, then map to 0..255; negatives become 0."""
    src = minmax_normalize(df, keys=keys, column=column) if normalize else df
    v = F.greatest(F.least(F.col(column).cast("double"), F.lit(1.0)), F.lit(0.0))
    return src.withColumn(column, F.rint(v * 255).cast("int"))


def overlay(image: DataFrame, mask: DataFrame, keys=("image_id", "y", "x"), channels=("r", "g", "b")) -> DataFrame:
    """Image channels where the mask is set, 0 elsewhere."""
    m = mask.select(*keys).distinct().withColumn("_on", F.lit(True))
    return (image.join(m, list(keys), "left")
            .select(*[F.when(F.col("_on"), F.col(c)).otherwise(0).alias(c) if c in channels else F.col(c) for c in image.columns]))
