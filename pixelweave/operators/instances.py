"""Label maps and per-instance attributes, from sparse pixels (keys, y, x, inst_id, type_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .components import ROW, connected_pixels, label, remove_small_components
from .graph import dense_number, prefix_total

# Class dictionaries of the supported datasets (background is 0).
CLASS_DICTIONARIES = {
    "pannuke": {"bg": 0, "neoplastic": 1, "inflammatory": 2, "connective": 3, "dead": 4, "epithelial": 5},
    "consep": {"bg": 0, "miscellanous": 1, "inflammatory": 2, "epithelial": 3, "spindle": 4},
    "consep_original": {"bg": 0, "miscellanous": 1, "inflammatory": 2, "healty_epithelial": 3,
                        "malignant_epithelial": 4, "fibroblast": 5, "muscle": 6, "endothelial": 7},
    "kumar": {"bg": 0, "fg": 1},
}
# Which original classes fall together.
CONSEP_REMAP = {3: 3, 4: 3, 5: 4, 6: 4, 7: 4}

BOX_PAD = 2


def remove_small_objects(pixels: DataFrame, min_size: int = 64, keys=("image_id",), inst: str = "inst_id") -> DataFrame:
    """Labels with fewer than `min_size` pixels become 0. The count is aggregated before it meets the pixels again."""
    if min_size == 0:
        return pixels
    small = (pixels.groupBy(*keys, inst).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_size)
             .select(*keys, inst, F.lit(True).alias("_small")))
    return (pixels.join(small, [*keys, inst], "left")
            .withColumn(inst, F.when(F.col("_small"), F.lit(0)).otherwise(F.col(inst)).cast("int")).drop("_small"))


def remap_label(pixels: DataFrame, keys=("image_id",), inst: str = "inst_id") -> DataFrame:
    """Contiguous ids 1..n in id order. A map without background is numbered the same way."""
    numbers = dense_number(pixels.filter(F.col(inst) > 0), keys, inst, 4096, "_new")
    return (pixels.join(numbers, [*keys, inst], "left")
            .withColumn(inst, F.coalesce("_new", F.lit(0)).cast("int")).drop("_new"))


def fix_duplicates(pixels: DataFrame, keys=("image_id",), inst: str = "inst_id") -> DataFrame:
    """Split ids that cover several components: the first keeps the id, component j gets j plus the running maximum.

    The running maximum starts at the largest id and grows by the component count of every split id, in id order.
    """
    keys = list(keys)
    comp = stage(label(pixels.filter(F.col(inst) > 0), keys, layer=inst, out="_j"))
    top = comp.groupBy(*keys).agg(F.max(inst).alias("_top"))
    split = comp.groupBy(*keys, inst).agg(F.max("_j").alias("_k")).filter("_k > 1")
    shift = prefix_total(split, keys, inst, F.floor(F.col(inst) / 4096), F.col("_k"), "_before").drop("_k")
    return (comp.join(shift, [*keys, inst], "left").join(top, keys)
            .withColumn(inst, F.when(F.col("_j") == 1, F.col(inst)).otherwise(F.col("_j") + F.col("_top") + F.col("_before")).cast("int"))
            .select(*keys, "y", "x", inst))


def _low(c: Column, pad: int) -> Column:
    return F.when(c - pad >= 0, c - pad).otherwise(c)


def _high(c: Column, pad: int, size: int) -> Column:
    return F.when(c + pad <= size - 1, c + pad).otherwise(c)


def bounding_box(pixels: DataFrame, keys=("image_id", "inst_id"), pad: int = 0, height: int = 0, width: int = 0) -> DataFrame:
    """(keys, y1, y2, x1, x2) with exclusive maxima; a padding that would leave the image is not applied."""
    box = pixels.groupBy(*keys).agg(F.min("y").alias("y1"), (F.max("y") + 1).alias("y2"),
                                    F.min("x").alias("x1"), (F.max("x") + 1).alias("x2"))
    if not pad:
        return box
    return box.select(*keys, _low(F.col("y1"), pad).alias("y1"), _high(F.col("y2"), pad, height).alias("y2"),
                      _low(F.col("x1"), pad).alias("x1"), _high(F.col("x2"), pad, width).alias("x2"))


def centroids(pixels: DataFrame, keys=("image_id", "inst_id")) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def inst_types(pixels: DataFrame, keys=("image_id", "inst_id")) -> DataFrame:
    """The smallest type value under each instance (not the most frequent one)."""
    return pixels.groupBy(*keys).agg(F.min("type_id").alias("type_id"))


def instance_table(pixels: DataFrame, keys=("image_id", "inst_id")) -> DataFrame:
    """Type, centroid, box and area of every instance in one aggregate."""
    return (pixels.filter("inst_id > 0").groupBy(*keys).agg(
        F.min("type_id").alias("type_id"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("y").alias("y1"),
        (F.max("y") + 1).alias("y2"), F.min("x").alias("x1"), (F.max("x") + 1).alias("x2"), F.count(F.lit(1)).alias("area"))
        .select(*keys, "type_id", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("centroid"),
                F.struct("y1", "y2", "x1", "x2").alias("bbox"), "area"))


def type_instances(pixels: DataFrame, class_id: int) -> DataFrame:
    """Ids of pixels of one class; every other pixel becomes background."""
    return pixels.withColumn("inst_id", F.when(F.col("type_id") == class_id, F.col("inst_id")).otherwise(0).cast("int"))


def majority_type(pixels: DataFrame, keys=("image_id", "inst_id")) -> DataFrame:
    """Most frequent type per instance, ties to the smaller one. Background gives way to the best other type; an
    instance on background alone stays null."""
    n = pixels.groupBy(*keys, "type_id").agg(F.count(F.lit(1)).alias("_n"))
    rank = F.struct("_n", -F.col("type_id"))
    return (n.groupBy(*keys).agg(F.max_by("type_id", rank).alias("_a"),
                                 F.max_by("type_id", F.when(F.col("type_id") > 0, rank)).alias("_b"),
                                 F.max("type_id").alias("_top"))
            .select(*keys, F.when(F.col("_a") > 0, F.col("_a")).when(F.col("_top") > 0, F.col("_b")).alias("type_id")))


def nearest_typed_fill(instances: DataFrame, keys=("image_id",), cell: float = 32.0) -> DataFrame:
    """(keys, inst_id, type_id): an untyped instance takes the type of the nearest typed centroid, ties to the smaller id.

    `instances` holds (keys, inst_id, cx, cy, type_id or null). Centroids meet over the nine grid cells around them; a
    neighbour at most one cell width away is certainly the nearest. What finds none goes on with cells twice as wide, so
    no pair list over a whole image is ever built. Images with fewer than two typed instances get type 0 throughout.
    """
    keys = list(keys)
    inst = stage(instances.select(*keys, "inst_id", "cx", "cy", "type_id"))
    enough = inst.groupBy(*keys).agg(F.count("type_id").alias("_t")).filter("_t > 1").drop("_t")
    live = inst.join(enough, keys, "left_semi")
    typed = live.filter("type_id is not null")
    done = typed.select(*keys, "inst_id", "type_id")
    todo = stage(live.filter("type_id is null").drop("type_id"))
    around = F.sequence(F.lit(-1), F.lit(1))
    while not todo.isEmpty():
        def cells(df):
            return df.withColumn("_gx", F.floor(F.col("cx") / cell)).withColumn("_gy", F.floor(F.col("cy") / cell))

        ask = cells(todo).withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
        ask = ask.withColumn("_gx", F.col("_gx") + F.col("_i")).withColumn("_gy", F.col("_gy") + F.col("_j"))
        have = cells(typed.select(*keys, F.col("inst_id").alias("_id"), F.col("cx").alias("_x"), F.col("cy").alias("_y"),
                                  "type_id").withColumnRenamed("_x", "cx").withColumnRenamed("_y", "cy"))
        have = have.withColumnRenamed("cx", "_x").withColumnRenamed("cy", "_y")
        dx, dy = F.col("cx") - F.col("_x"), F.col("cy") - F.col("_y")
        near = (ask.join(have, [*keys, "_gx", "_gy"]).groupBy(*keys, "inst_id")
                .agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "_id", "type_id")).alias("_m"))
                .filter(F.col("_m.d") <= cell * cell).select(*keys, "inst_id", F.col("_m.type_id").alias("type_id")))
        near = stage(near)
        done = done.unionByName(near)
        todo = stage(todo.join(near, [*keys, "inst_id"], "left_anti"))
        cell *= 2
    return (inst.select(*keys, "inst_id").join(done, [*keys, "inst_id"], "left")
            .withColumn("type_id", F.coalesce("type_id", F.lit(0)).cast("int")))


def to_inst_map(pixels: DataFrame, keys=("image_id",), min_size: int = 10) -> DataFrame:
    """(keys, y, x, inst_id): components of a sparse foreground of at least `min_size` pixels; holes are not filled."""
    return label(pixels, keys, min_size=min_size, out="inst_id")


def remove_debris(pixels: DataFrame, min_size: int = 10, keys=("image_id",)) -> DataFrame:
    """Drop components under `min_size` pixels inside each instance."""
    return remove_small_components(pixels.filter("inst_id > 0"), min_size, keys, layer="inst_id").select(*keys, "y", "x", "inst_id")


def class_counts(pixels: DataFrame, column: str = "sem_id", keys=("image_id",)) -> DataFrame:
    return pixels.filter(F.col(column) > 0).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))


def label_sem_map(pixels: DataFrame, keys=("image_id",), sort: bool = True) -> DataFrame:
    """(keys, y, x, sem_id, area_id): component ids over the classes of an image, larger classes first."""
    keys = list(keys)
    comp = stage(label(pixels.filter("sem_id > 0"), keys, layer="sem_id", out="_j"))
    per = comp.groupBy(*keys, "sem_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_j").alias("_k"))
    order = [F.desc("_n"), F.col("sem_id")] if sort else [F.col("sem_id")]
    shift = prefix_total(per, keys, order, F.lit(0), F.col("_k"), "_before").drop("_n", "_k")
    return comp.join(shift, [*keys, "sem_id"]).select(*keys, "y", "x", "sem_id", (F.col("_j") + F.col("_before")).cast("int").alias("area_id"))


def hover_maps(pixels: DataFrame, min_size: int = 30, keys=("image_id",)) -> DataFrame:
    """Horizontal and vertical offset of each pixel from its instance centre, scaled to [-1, 1] per instance.

    The box-relative arithmetic of the definition cancels: the offset is x + 1 - floor(mean(x) + 0.5), its extremes
    follow from the box, so one aggregate and one join suffice.
    """
    keys = [*keys, "inst_id"]
    px = pixels.filter("inst_id > 0").select(*keys, "y", "x")
    inst = (px.groupBy(*keys).agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max), ("av", F.avg))],
                                  F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_size))

    def scaled(c: str) -> Column:
        centre = F.floor(F.col(f"_av{c}") + 0.5)
        off, lo, hi = (F.col(v) + 1 - centre for v in (c, f"_lo{c}", f"_hi{c}"))
        return F.when(off < 0, off / -lo).when(off > 0, off / hi).otherwise(0.0)

    return px.join(inst, keys).select(*keys, "y", "x", scaled("x").alias("xmap"), scaled("y").alias("ymap"))


def _gaps(obj: DataFrame, box: DataFrame, ks) -> DataFrame:
    """(ks, y, x): pixels of each box that its object, distinct pixels, leaves free. Only runs of pixels and lines meet the boxes."""
    line = Window.partitionBy(*ks, "y")
    runs = (obj.filter("y IS NOT NULL AND x IS NOT NULL").withColumn("_r", F.col("x") - F.row_number().over(line.orderBy("x")))
            .groupBy(*ks, "y", "_r").agg(F.min("x").alias("_a"), F.max("x").alias("_b")))
    near = (runs.withColumn("_past", F.lag("_b").over(line.orderBy("_a")) + 1).withColumn("_last", F.lead("_a").over(line.orderBy("_a")).isNull())
            .join(box.select(*ks, "x1", "x2"), ks))
    sides = F.array(F.struct(F.coalesce("_past", "x1").alias("a"), (F.col("_a") - 1).alias("b")),
                    F.when(F.col("_last"), F.struct((F.col("_b") + 1).alias("a"), (F.col("x2") - 1).alias("b"))))
    between = near.select(*ks, "y", F.explode(sides).alias("_s")).select(*ks, "y", "_s.a", "_s.b")
    lines = box.withColumn("y", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)))
    bare = lines.join(runs.select(*ks, "y").distinct(), [*ks, "y"], "left_anti").select(*ks, "y", F.col("x1").alias("a"), (F.col("x2") - 1).alias("b"))
    return between.unionByName(bare).filter("a <= b").select(*ks, "y", F.explode(F.sequence("a", "b")).alias("x"))


def fill_object_holes(pixels: DataFrame, keys=("image_id",), inst: str = "inst_id") -> DataFrame:
    """Each object plus the background it encloses (4-connected background, as seen from the object's own box)."""
    ks = [*keys, inst]
    obj = stage(pixels.filter(F.col(inst) > 0).select(*ks, "y", "x").distinct())
    box = bounding_box(obj, ks)
    empty = stage(_gaps(obj, box, ks))
    comp = connected_pixels(empty, keys, layer=inst)
    edge = ((F.col("y") == F.col("y1")) | (F.col("y") == F.col("y2") - 1) | (F.col("x") == F.col("x1")) | (F.col("x") == F.col("x2") - 1))
    outside = comp.join(box, ks).filter(edge).select(*ks, "root").distinct()
    return obj.unionByName(comp.join(outside, [*ks, "root"], "left_anti").select(*ks, "y", "x"))


def fill_and_remove_small(pixels: DataFrame, min_size: int = 15, keys=("image_id",)) -> DataFrame:
    """Objects under `min_size` pixels dropped, the others filled and renumbered in id order.

    Where a filled object covers another one, the object with the larger filled area, the enclosing one, wins.
    """
    keys = list(keys)
    kept = remove_small_objects(pixels.filter("inst_id > 0").select(*keys, "y", "x", "inst_id"), min_size, keys).filter("inst_id > 0")
    full = stage(fill_object_holes(kept, keys))
    size = full.groupBy(*keys, "inst_id").agg(F.count(F.lit(1)).alias("_n"))
    top = (full.join(size, [*keys, "inst_id"]).groupBy(*keys, "y", "x")
           .agg(F.max(F.struct("_n", F.col("inst_id").alias("i"))).alias("_m")).select(*keys, "y", "x", F.col("_m.i").alias("inst_id")))
    return remap_label(stage(top), keys)


def channels_to_type(stack: Column) -> Column:
    """Class index from a stack of instance channels whose last channel is background."""
    from ..functions.arrays import argmax
    hot = F.transform(stack, lambda v: (v > 0).cast("int"))
    n = F.size(stack)
    return argmax(F.concat(F.slice(hot, n, 1), F.slice(hot, F.lit(1), n - 1)))


def channels_to_inst(df: DataFrame, stack: str = "channels", keys=("image_id",)) -> DataFrame:
    """Ids summed over channels, then split where an id covers several components."""
    total = F.aggregate(F.col(stack), F.lit(0), lambda a, v: a + v)
    return fix_duplicates(df.select(*keys, "y", "x", total.cast("int").alias("inst_id")), keys)


def remap_classes(df: DataFrame, mapping: dict[int, int], column: str = "type_id") -> DataFrame:
    pairs = F.create_map(*[F.lit(v) for kv in mapping.items() for v in kv])
    return df.withColumn(column, F.coalesce(pairs[F.col(column)], F.col(column)).cast("int"))


def finalize(pixels: DataFrame, keys=("image_id",), min_size: int = 10) -> tuple[DataFrame, DataFrame]:
    """Typed map (majority type, then nearest typed instance) of the uncleaned instances, and the instances without debris."""
    keys = list(keys)
    inst = pixels.filter("inst_id > 0")
    attrs = majority_type(inst, (*keys, "inst_id")).join(centroids(inst, (*keys, "inst_id")), [*keys, "inst_id"])
    types = nearest_typed_fill(attrs, keys)
    typed = inst.drop("type_id").join(types, [*keys, "inst_id"]).select(*keys, "y", "x", "inst_id", "type_id")
    return typed, remove_debris(inst, min_size, keys)
