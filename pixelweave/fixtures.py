"""Tables derived from the given parquet files (FIXTURES.md, part 2), as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import spread

SIDE = 64          # height and width of a derived image, also the tile size
N_CLASSES = 6      # background and five classes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(c: Column) -> Column:
    return c.cast("int")


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rectangle per part row, twenty per image, one image per supplier."""
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()
    pk, sz = F.col("pk"), F.col("sz")
    i = (table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), F.col("p_size").alias("sz"), n.alias("n"))
         .select(pk, sz, _int(pk % F.col("n")).alias("image_id"), _int(F.floor(pk / F.col("n"))).alias("k")))
    k = F.col("k")
    return i.select(
        "image_id", (k + 1).alias("id"), _int(1 + (k * 7) % 5).alias("cls"), "pk",
        ((k % 5) * 12 + 1 + sz % 3).alias("x0"), (_int(F.floor(k / 5)) * 16 + 1 + sz % 4).alias("y0"),
        (4 + sz % 5).alias("w"), (6 + _int(pk % 7)).alias("h"), (sz % 4 - 1).alias("dx"), (_int(pk % 3) - 1).alias("dy"))


# Lines of a table of pixels that one task paints, so that its sorts stay small whatever the number of images.
LINES = 8192
VALUES = ("true_id", "true_cls", "pred_id", "pred_cls")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the rectangles of both sides: image_id, y, x0, x1 and the four values."""
    pk, end = F.col("pk"), F.col("x0") + F.col("w") - 1
    lines = rects(spark, sf_dir).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    lines = lines.select("*", F.greatest("x0", end).alias("x1"), F.least("x0", end).alias("_x0")).drop("x0").withColumnRenamed("_x0", "x0")
    true = lines.select("image_id", (F.col("y0") + F.col("j")).alias("y"), "x0", "x1",
                        F.col("id").alias("true_id"), F.col("cls").alias("true_cls"),
                        F.lit(0).alias("pred_id"), F.lit(0).alias("pred_cls"))
    pred = (lines.filter(pk % 11 != 0)
            .select("image_id", (F.col("y0") + F.col("dy") + F.col("j")).alias("y"),
                    F.greatest(F.lit(0), F.col("x0") + F.col("dx")).alias("x0"), F.least(F.lit(SIDE - 1), F.col("x1") + F.col("dx")).alias("x1"),
                    F.lit(0).alias("true_id"), F.lit(0).alias("true_cls"),
                    F.when(pk % 17 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("pred_id"),
                    F.when(pk % 19 == 0, 1 + F.col("cls") % 5).otherwise(F.col("cls")).alias("pred_cls"))
            .filter(F.col("y").between(0, SIDE - 1) & (F.col("x0") <= F.col("x1"))))
    return true.unionByName(pred).filter("y IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL")


def _dealt(lines: DataFrame, images: int) -> DataFrame:
    """Lines dealt by image over as many tasks as the images need: what goes by image, line or place afterwards stays there."""
    return spread(lines, "image_id", least=-(-images * SIDE // LINES))


def _per_line(lines: DataFrame, images: int) -> DataFrame:
    """(image_id, y, _s): the distinct stretches of each image line."""
    return _dealt(lines, images).groupBy("image_id", "y").agg(F.collect_set(F.struct("x0", "x1", *VALUES)).alias("_s"))


def _ends(*more: Column) -> Column:
    """Where the stretches `_s` of a line begin and where they have ended."""
    return F.array_sort(F.array_distinct(F.concat(F.col("_s.x0"), F.transform("_s", lambda r: r["x1"] + 1), *more)))


def _painted(lines: DataFrame) -> DataFrame:
    """(image_id, y, x0, x1, values): the line between neighbouring `_cuts`, each value the largest of the stretches of `_s` that cover
    the piece, null where none does. No end of a stretch lies inside a piece."""
    def over(lo):
        def more(acc, r):
            return F.when((r["x0"] <= lo) & (r["x1"] >= lo), F.struct(*[F.greatest(acc[v], r[v]).alias(v) for v in VALUES])).otherwise(acc)
        return F.aggregate("_s", F.struct(*[F.lit(None).cast("int").alias(v) for v in VALUES]), more)

    cuts = F.col("_cuts")
    runs = F.transform(F.slice(cuts, F.lit(1), F.size(cuts) - 1),
                       lambda lo, i: F.struct(lo.alias("x0"), (F.get(cuts, i + 1) - 1).alias("x1"), over(lo).alias("v")))
    return (lines.withColumn("_r", F.explode(runs))
            .select("image_id", "y", "_r.x0", "_r.x1", *[F.col(f"_r.v.{v}").alias(v) for v in VALUES]))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse label maps: true and predicted id and class per pixel, one row where either id is set.

    What is shuffled are lines of rectangles, by image. Those of one image line are cut into stretches without an end inside,
    and a stretch becomes pixels: no pixel is shuffled, sorted or looked up.
    """
    lines = _per_line(_lines(spark, sf_dir), table(spark, sf_dir, "supplier").count())
    runs = _painted(lines.withColumn("_cuts", _ends())).filter("true_id IS NOT NULL")
    return runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *VALUES)


def true_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (pixels(spark, sf_dir).filter("true_id > 0")
            .select("image_id", "y", "x", F.col("true_id").alias("inst_id"), F.col("true_cls").alias("type_id")))


def pred_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (pixels(spark, sf_dir).filter("pred_id > 0")
            .select("image_id", "y", "x", F.col("pred_id").alias("inst_id"), F.col("pred_cls").alias("type_id")))


def image_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full 64 x 64 grid with three channels, both label pairs and a foreground probability.

    Images are dealt like the lines of rectangles and joined with them by line; the pixels of a line are made where it is painted.
    """
    images = table(spark, sf_dir, "supplier")
    n, side = images.count(), F.sequence(F.lit(0), F.lit(SIDE - 1))
    grid = _dealt(images.select(_int(F.col("s_suppkey")).alias("image_id")), n).withColumn("y", F.explode(side))
    inside = (_lines(spark, sf_dir).withColumn("x0", F.greatest("x0", F.lit(0))).withColumn("x1", F.least("x1", F.lit(SIDE - 1)))
              .filter(F.col("y").between(0, SIDE - 1) & (F.col("x0") <= F.col("x1"))))
    lines = grid.join(_per_line(inside, n), ["image_id", "y"], "left").withColumn("_s", F.coalesce("_s", F.array()))
    runs = _painted(lines.withColumn("_cuts", _ends(F.array(F.lit(0), F.lit(SIDE)))))
    g = runs.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), *VALUES)
    x, y, im = F.col("x"), F.col("y"), F.col("image_id")
    return g.select(
        "image_id", "y", "x",
        ((x * 3 + y * 5 + im * 7 + F.when(F.col("true_id") > 0, 60).otherwise(0)) % 256).alias("r"),
        ((x * 11 + y + im) % 256).alias("g"), ((x + y * 13) % 256).alias("b"),
        ((50 + F.when(F.col("pred_id") > 0, 30).otherwise(-30) + (x * 31 + y * 17 + im * 7) % 21 - 10).cast("double")
         / F.lit(100.0)).alias("prob"),
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("true_id", "true_cls", "pred_id", "pred_cls")])


def channels_long(df: DataFrame) -> DataFrame:
    """(image_id, y, x, channel, v SMALLINT) from the three channel columns."""
    return (df.select("image_id", "y", "x", F.posexplode(F.array("r", "g", "b")).alias("channel", "v"))
            .withColumn("v", F.col("v").cast("smallint")))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangle annotations in slide coordinates; ten tiles per slide row; bounds have exclusive maxima."""
    r = rects(spark, sf_dir)
    pk, i = F.col("pk"), F.col("id")
    ox = (F.col("image_id") % 10) * SIDE
    oy = _int(F.floor(F.col("image_id") / 10)) * SIDE
    return r.select(
        F.concat(F.lit("slide_x-"), ox.cast("string"), F.lit("_y-"), oy.cast("string"), F.lit(".json")).alias("name"),
        i.alias("feature_id"), F.col("cls").alias("class_id"),
        (ox + F.when((i % 5 == 1) & (pk % 3 != 2), 0).otherwise(F.col("x0"))).alias("xmin"),
        (oy + F.when((i <= 5) & (pk % 3 != 1), 0).otherwise(F.col("y0"))).alias("ymin"),
        (ox + F.when((i % 5 == 0) & (pk % 2 == 0), SIDE).otherwise(F.col("x0") + F.col("w"))).alias("xmax"),
        (oy + F.when((i > 15) & (pk % 2 == 1), SIDE).otherwise(F.col("y0") + F.col("h"))).alias("ymax"))


def box_ring(chamfer: int = 0) -> Column:
    """Closed ring through the corner pixels of (xmin, ymin, xmax, ymax); `chamfer` cuts every corner."""
    x0, y0 = F.col("xmin").cast("double"), F.col("ymin").cast("double")
    x1, y1 = F.col("xmax").cast("double") - 1, F.col("ymax").cast("double") - 1
    c = chamfer

    def p(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    if not c:
        return F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0))
    return F.array(p(x0 + c, y0), p(x1 - c, y0), p(x1, y0 + c), p(x1, y1 - c), p(x1 - c, y1), p(x0 + c, y1),
                   p(x0, y1 - c), p(x0, y0 + c), p(x0 + c, y0))


def ring_annotations(spark: SparkSession, sf_dir: str, chamfer: int = 0) -> DataFrame:
    return annotations(spark, sf_dir).withColumn("ring", box_ring(chamfer))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile per image: name and slide coordinates."""
    i = table(spark, sf_dir, "supplier").select(_int(F.col("s_suppkey")).alias("image_id"))
    x = (F.col("image_id") % 10) * SIDE
    y = _int(F.floor(F.col("image_id") / 10)) * SIDE
    return i.select(F.concat(F.lit("slide_x-"), x.cast("string"), F.lit("_y-"), y.cast("string"), F.lit(".json"))
                    .alias("name"), x.alias("x"), y.alias("y"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six class scores per vector (sums of eight elements each), target and sample id."""
    e = table(spark, sf_dir, "embeddings")

    def score(c: int) -> Column:
        total = F.lit(0.0)
        for j in range(8 * c, 8 * c + 8):
            total = total + F.col("embedding")[j].cast("double")
        return total

    return e.select("vec_id", (F.col("vec_id") % 10).cast("int").alias("sample"),
                    (F.col("label") % N_CLASSES).alias("target"),
                    F.array(*[score(c) for c in range(N_CLASSES)]).alias("scores"))
