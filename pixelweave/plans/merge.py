"""Slide-level jobs: merging cells split at tile borders, uniting areas, exporting annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import annotations as an
from ..operators.instances import label_sem_map
from ..operators.morphology import close_with_disk
from ..operators.raster import outline, raster_spans, rasterize, touching_groups
from ..session import spread

# Fixed value: radius by which merged polygons are grown and shrunk to smooth them.
SMOOTH = 10
STRIP = 256      # length of the border pieces on which candidates meet
PLANE = 1 << 30  # slides have no right or bottom limit


def split_pairs(annotations: DataFrame, tile=an.DEFAULT_TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of annotations that meet across a shared tile border.

    `annotations` holds (name, feature_id, class_id, bounds, ring) with slide coordinates. Both sides of a border carry the
    border and the pieces of it they reach as an equi-join key; the exact polygon test runs on what is left. Each border is
    handled once. The tile whose name sorts first is the main one and gives its class. `by` names the columns of the slide:
    only annotations of one slide meet, whatever their tiles are called on others.
    """
    e = an.edge(an.with_tile(annotations), tile)
    vertical = F.col("side").isin("left", "right")
    past = F.col("side").isin("right", "bottom")
    e = (e.withColumn("axis", F.when(vertical, "v").otherwise("h"))
         .withColumn("_bx", F.when(vertical & past, F.col("tile_x") + tile[0]).otherwise(F.col("tile_x")))
         .withColumn("_by", F.when(~vertical & past, F.col("tile_y") + tile[1]).otherwise(F.col("tile_y")))
         .withColumn("_lo", F.when(vertical, F.col("ymin")).otherwise(F.col("xmin")))
         .withColumn("_hi", F.when(vertical, F.col("ymax")).otherwise(F.col("xmax"))))
    e = e.withColumn("_s0", F.floor(F.col("_lo") / STRIP)).withColumn("_s", F.explode(F.sequence("_s0", F.floor((F.col("_hi") - 1) / STRIP))))
    cols = ["name", "feature_id", "class_id", "ring", "_lo", "_hi", "_s0"]
    a = e.filter(past).select(*by, "axis", "_bx", "_by", "_s", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = e.filter(~past).select(*by, "axis", "_bx", "_by", "_s", *[F.col(c).alias(f"b_{c}") for c in cols])
    p = a.join(b, [*by, "axis", "_bx", "_by", "_s"]).filter(
        (F.col("_s") == F.greatest("a__s0", "b__s0")) & (F.col("a__lo") < F.col("b__hi")) & (F.col("b__lo") < F.col("a__hi")))
    p = p.filter(an.rings_meet(F.col("a_ring"), F.col("b_ring")))
    main = F.col("a_name") < F.col("b_name")

    def pick(c: str, first: bool):
        yes, no = (f"a_{c}", f"b_{c}") if first else (f"b_{c}", f"a_{c}")
        return F.when(main, F.col(yes)).otherwise(F.col(no))

    return p.select(*by, "axis", pick("name", True).alias("name"), pick("feature_id", True).alias("feature_id"),
                    pick("class_id", True).alias("class_id"), pick("ring", True).alias("ring"), pick("name", False).alias("adj_name"),
                    pick("feature_id", False).alias("adj_feature_id"), pick("ring", False).alias("adj_ring"))


PAIR_KEYS = ("name", "feature_id", "adj_name", "adj_feature_id")


def union_pixels(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixels of the union of both rings of each pair."""
    keys = [*by, *PAIR_KEYS]
    both = pairs.select(*keys, F.posexplode(F.array("ring", "adj_ring")).alias("_p", "ring"))
    return rasterize(both, [*keys, "_p"]).select(*keys, "y", "x").distinct()


def smoothed_rings(pixels: DataFrame, keys, radius: int = SMOOTH) -> DataFrame:
    """Outline of each pixel set after closing it with a disk, the raster form of growing and shrinking a polygon."""
    moved = pixels.withColumn("y", F.col("y") + radius).withColumn("x", F.col("x") + radius)
    return outline(close_with_disk(moved, radius, PLANE, PLANE, keys), keys, -radius, -radius)


def merge_split_cells(annotations: DataFrame, tile=an.DEFAULT_TILE, radius: int = SMOOTH, by: tuple[str, ...] = ()) -> DataFrame:
    """One annotation per meeting pair: the smoothed union of both rings, with the class of the main tile."""
    pairs, keys = split_pairs(annotations, tile, by), (*by, *PAIR_KEYS)
    rings = smoothed_rings(union_pixels(pairs, by), keys, radius)
    return rings.join(pairs.select(*keys, "class_id").distinct(), list(keys)).select(*keys, "class_id", "ring")


def keep_inner(annotations: DataFrame, tile=an.DEFAULT_TILE) -> DataFrame:
    """Cells away from every tile border, kept once."""
    return an.non_border(an.with_tile(annotations), tile)


def merge_cells(annotations: DataFrame, tile=an.DEFAULT_TILE, keep_unmatched: bool = True, smooth: bool = True, radius: int = SMOOTH, by: tuple[str, ...] = ()) -> DataFrame:
    """(kind, name, feature_id, adj_name, adj_feature_id, class_id, ring) of a whole slide, or of every slide that `by` tells apart.

    Border cells without a partner are kept unless `keep_unmatched` is unset; a cell that meets two neighbours appears in
    two merged cells.
    """
    inner = keep_inner(annotations, tile)
    pairs = split_pairs(annotations, tile, by)
    none = F.lit(None)
    own, cols = [*by, "name", "feature_id"], ["kind", *by, *PAIR_KEYS, "class_id", "ring"]

    def single(df, kind):
        return (df.withColumn("kind", F.lit(kind)).withColumn("adj_name", none.cast("string"))
                .withColumn("adj_feature_id", none.cast("int")).select(*cols))

    kept = single(inner, "inner")
    if smooth:
        px = rasterize(inner, [*own, "class_id"])
        rings = smoothed_rings(px, (*own, "class_id"), radius)
        kept = single(rings, "inner")
        merged = merge_split_cells(annotations, tile, radius, by).withColumn("kind", F.lit("merged")).select(*cols)
    else:
        merged = pairs.withColumn("kind", F.lit("merged")).select(*cols)
    out = kept.unionByName(merged)
    if keep_unmatched:
        used = pairs.select(*own).union(pairs.select(*by, "adj_name", "adj_feature_id")).distinct()
        border = an.edge(an.with_tile(annotations), tile).select(*own).distinct()
        lone = annotations.join(border.join(used, own, "left_anti"), own, "left_semi")
        out = out.unionByName(single(lone, "unmatched"))
    return out


def collect_tiles(*frames: DataFrame) -> DataFrame:
    """All annotations of all tiles; empty tiles add nothing."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def area_groups(annotations: DataFrame, gap: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """(slide, class_id, name, feature_id, root): areas of one slide and class that touch after growing by `gap` share a root, across tiles."""
    return touching_groups(annotations, [*by, "class_id"], ["name", "feature_id"], gap)


def merge_areas(annotations: DataFrame, gap: int = 1, radius: int = SMOOTH, by: tuple[str, ...] = ()) -> DataFrame:
    """(slide, class_id, root, ring): outer ring of each united area, smoothed; `by` names the columns of the slide."""
    keys = [*by, "class_id", "name", "feature_id"]
    own = [*by, "class_id", "root"]
    spans = raster_spans(annotations, keys).join(area_groups(annotations, gap, by), keys).select(*own, "y", "_s")
    # the spans of a line meet before they become pixels
    px = spread(spans, *own, "y").select(*own, "y", F.explode(F.sequence("_s.a", "_s.b")).alias("x")).distinct()
    return smoothed_rings(px, own, max(radius, gap))


def explode_parts(multi: DataFrame, keys, rings: str = "rings") -> DataFrame:
    """(keys, part, ring, root): parts of a multipolygon; parts that touch share a root."""
    parts = multi.select(*keys, F.posexplode(rings).alias("part", "ring"))
    return parts.join(touching_groups(parts, list(keys), "part"), [*keys, "part"])


def export_annotations(pixels: DataFrame, keys=("image_id",), class_names: dict[int, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Cells and areas of every image as rings with class names; areas are numbered per class first.

    `pixels` holds inst_id, type_id and sem_id.
    """
    from ..operators.instances import inst_types
    ks = [*keys, "inst_id"]
    cells = pixels.filter("inst_id > 0")
    cells = outline(cells, ks).join(inst_types(cells, ks), ks)
    areas = label_sem_map(pixels, keys)
    names = areas.groupBy(*keys, "area_id").agg(F.min("sem_id").alias("type_id"))
    areas = outline(areas.withColumnRenamed("area_id", "inst_id"), ks).join(names.withColumnRenamed("area_id", "inst_id"), ks)
    if class_names:
        lookup = F.create_map(*[F.lit(v) for kv in class_names.items() for v in kv])
        cells, areas = (df.withColumn("class_name", lookup[F.col("type_id")]) for df in (cells, areas))
    return cells, areas
