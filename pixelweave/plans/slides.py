"""Queries of tiles, annotations, polygons, sources and sinks."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import annotations as an
from ..operators import instances, raster, tiling
from ..session import staging_dir
from ..sources import geojson, tables, xml
from . import merge
from .masks import raw
from .sqlkit import Catalog, components_sql, rounded, sql

H = W = fx.SIDE
TILE = (fx.SIDE, fx.SIDE)
catalog = Catalog()
add = catalog.add


def scratch(s) -> str:
    """A new folder on the session's shared staging path."""
    return os.path.join(staging_dir(s), f"io-{uuid.uuid4().hex}")


# --- tiles ------------------------------------------------------------------------------------------------------------------

add("sample_key", lambda s, d: fx.tiles(s, d).select("name", an.sample_key("name").alias("key")),
    sql("SELECT name, substr(name, 1, length(name) - 4) AS key FROM tiles"))
add("parse_tile_xy", lambda s, d: an.parse_tile_xy(fx.tiles(s, d).select("name")),
    sql("SELECT name, x, y FROM tiles"))
add("order_tiles", lambda s, d: an.order_tiles(fx.tiles(s, d), by="y"), sql("SELECT name, x, y FROM tiles ORDER BY y, name"))
add("filter_tiles", lambda s, d: an.filter_tiles(fx.tiles(s, d), xmax=320, ymax=256), sql("SELECT name, x, y FROM tiles WHERE x <= 320 AND y <= 256"))


def _gappy(s, d):
    """Tile rows by order date, with days missing, so that there are several sections."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return (fx.table(s, d, "orders").select((day * 64).cast("int").alias("y"), F.col("o_custkey").alias("x")).distinct())


GAPPY = "SELECT DISTINCT CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 64 AS INTEGER) AS y, o_custkey AS x FROM orders"
AUTO = dict(gappy=GAPPY, isl="SELECT min(y) AS lo, max(y) AS hi, count(*) AS n FROM (SELECT y, y - 64 * row_number() OVER (ORDER BY y) AS g FROM (SELECT DISTINCT y FROM gappy) a) b GROUP BY g",
            pick="SELECT lo, hi FROM (SELECT *, row_number() OVER (ORDER BY lo) - 1 AS k FROM isl WHERE n >= 3) q WHERE k = {k}",
            span="SELECT coalesce((SELECT lo FROM pick), (SELECT min(lo) FROM isl)) AS lo, coalesce((SELECT hi FROM pick), (SELECT max(hi) FROM isl)) AS hi")
for _k in (0, 1):
    add(f"auto_range_{_k}", lambda s, d, k=_k: an.auto_range(_gappy(s, d), "y", k, 192, 64).groupBy("y").agg(F.count(F.lit(1)).alias("n")),
        sql("SELECT y, count(*) AS n FROM gappy CROSS JOIN span WHERE y BETWEEN lo AND hi GROUP BY y", **{n: q.format(k=_k) for n, q in AUTO.items()}))

# several slides in one table: customers stand for slides
add("auto_range_by_slide", lambda s, d: an.auto_range(_gappy(s, d).withColumn("slide", F.col("x") % 3), "y", 0, 192, 64, by=("slide",)).groupBy("slide", "y").agg(F.count(F.lit(1)).alias("n")),
    sql("""SELECT g.slide, y, count(*) AS n FROM (SELECT *, x % 3 AS slide FROM gappy) g JOIN (SELECT slide,
          coalesce(arg_min(lo, lo) FILTER (WHERE n >= 3), min(lo)) AS lo, coalesce(arg_min(hi, lo) FILTER (WHERE n >= 3), max(hi)) AS hi FROM isl GROUP BY slide) w
        ON w.slide = g.slide AND y BETWEEN lo AND hi GROUP BY g.slide, y""", gappy=GAPPY,
        isl="""SELECT slide, min(y) AS lo, max(y) AS hi, count(*) AS n FROM (SELECT slide, y, y - 64 * row_number() OVER (PARTITION BY slide ORDER BY y) AS g
          FROM (SELECT DISTINCT x % 3 AS slide, y FROM gappy) a) b GROUP BY slide, g"""))
OFF8 = "(VALUES ('right', 64, 0), ('left', -64, 0), ('bottom', 0, 64), ('top', 0, -64), ('bottom_right', 64, 64), ('bottom_left', -64, 64), ('top_right', 64, -64), ('top_left', -64, -64)) o(side, dx, dy)"
NBR = f"SELECT t.name, side, n.name AS neighbor FROM tiles t CROSS JOIN (SELECT * FROM {OFF8}) o LEFT JOIN tiles n ON n.x = t.x + dx AND n.y = t.y + dy"
add("neighbors", lambda s, d: an.neighbors(fx.tiles(s, d), TILE), sql(NBR))
add("adjacent", lambda s, d: an.adjacent(fx.tiles(s, d), TILE), sql(NBR + " WHERE side IN ('left', 'right', 'bottom', 'top')"))
add("adjacent_by_slide", lambda s, d: an.adjacent(fx.tiles(s, d).withColumn("slide", (F.col("y") / 128).cast("int") % 2), TILE, by=("slide",)),
    sql("WITH st AS (SELECT *, CAST((y // 128) % 2 AS INTEGER) AS slide FROM tiles) " + NBR.replace("SELECT t.name", "SELECT t.slide, t.name").replace("tiles t", "st t")
        .replace("tiles n ON", "st n ON n.slide = t.slide AND") + " WHERE side IN ('left', 'right', 'bottom', 'top')"))

# --- annotations --------------------------------------------------------------------------------------------------------------

BASE = "name, feature_id, class_id"
add("bounds", lambda s, d: an.bounds(fx.ring_annotations(s, d).select("name", "feature_id", "ring")).drop("ring"),
    sql("SELECT name, feature_id, xmin, ymin, xmax, ymax FROM annotations"))


def _tiled(s, d):
    return an.with_tile(fx.ring_annotations(s, d))


add("non_border", lambda s, d: an.non_border(_tiled(s, d), TILE).select("name", "feature_id", "class_id"),
    sql(f"SELECT {BASE} FROM annotations WHERE xmin <> tx AND ymin <> ty AND xmax <> tx + 64 AND ymax <> ty + 64"))


def _corner_point(df):
    p = F.get("ring", F.lit(0))
    return df.select("name", "feature_id", "side", p["x"].cast("int").alias("rx"), p["y"].cast("int").alias("ry"))


add("edge_annotations", lambda s, d: _corner_point(an.edge(_tiled(s, d), TILE)),
    sql("""SELECT name, feature_id, 'right' AS side, xmin + 1 AS rx, ymin AS ry FROM annotations WHERE xmax = tx + 64 UNION ALL
        SELECT name, feature_id, 'left', xmin, ymin FROM annotations WHERE xmin = tx UNION ALL
        SELECT name, feature_id, 'bottom', xmin, ymin + 1 FROM annotations WHERE ymax = ty + 64 UNION ALL
        SELECT name, feature_id, 'top', xmin, ymin FROM annotations WHERE ymin = ty"""))
add("corner_annotations", lambda s, d: _corner_point(an.corner(_tiled(s, d), TILE)),
    sql("""SELECT name, feature_id, 'bottom_left' AS side, xmin AS rx, ymin + 1 AS ry FROM annotations WHERE ymax = ty + 64 AND xmin = tx UNION ALL
        SELECT name, feature_id, 'bottom_right', xmin + 1, ymin + 1 FROM annotations WHERE ymax = ty + 64 AND xmax = tx + 64 UNION ALL
        SELECT name, feature_id, 'top_right', xmin + 1, ymin FROM annotations WHERE ymin = ty AND xmax = tx + 64 UNION ALL
        SELECT name, feature_id, 'top_left', xmin, ymin FROM annotations WHERE ymin = ty AND xmin = tx"""))
PAIRS = dict(pr="""SELECT CASE WHEN a.name < b.name THEN a.name ELSE b.name END AS name, CASE WHEN a.name < b.name THEN a.feature_id ELSE b.feature_id END AS feature_id,
      CASE WHEN a.name < b.name THEN b.name ELSE a.name END AS adj_name, CASE WHEN a.name < b.name THEN b.feature_id ELSE a.feature_id END AS adj_feature_id,
      CASE WHEN a.name < b.name THEN a.class_id ELSE b.class_id END AS class_id, axis, (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin)
        - CASE WHEN axis = 'v' THEN least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) ELSE least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) END AS area
    FROM annotations a JOIN annotations b ON (b.tx = a.tx + 64 AND b.ty = a.ty) OR (b.tx = a.tx AND b.ty = a.ty + 64)
    CROSS JOIN LATERAL (SELECT CASE WHEN b.tx > a.tx THEN 'v' ELSE 'h' END AS axis) ax
    WHERE (axis = 'v' AND a.xmax = a.tx + 64 AND b.xmin = b.tx AND a.ymin < b.ymax AND b.ymin < a.ymax)
       OR (axis = 'h' AND a.ymax = a.ty + 64 AND b.ymin = b.ty AND a.xmin < b.xmax AND b.xmin < a.xmax)""".replace(
    "CROSS JOIN LATERAL (SELECT CASE WHEN b.tx > a.tx THEN 'v' ELSE 'h' END AS axis) ax", "").replace("CASE WHEN axis = 'v'", "CASE WHEN b.tx > a.tx")
    .replace("class_id, axis,", "class_id, CASE WHEN b.tx > a.tx THEN 'v' ELSE 'h' END AS axis,").replace("(axis = 'v' AND", "(b.tx > a.tx AND").replace("(axis = 'h' AND", "(b.tx = a.tx AND"))
PK = "name, feature_id, adj_name, adj_feature_id"
add("split_pairs", lambda s, d: merge.split_pairs(fx.ring_annotations(s, d), TILE).select(*merge.PAIR_KEYS, "class_id", "axis"),
    sql(f"SELECT {PK}, class_id, axis FROM pr", **PAIRS))
add("merged_cell_area", lambda s, d: merge.union_pixels(merge.split_pairs(fx.ring_annotations(s, d), TILE)).groupBy(*merge.PAIR_KEYS).agg(F.count(F.lit(1)).alias("area")),
    sql(f"SELECT {PK}, CAST(area AS BIGINT) AS area FROM pr", **PAIRS))
add("keep_inner", lambda s, d: merge.keep_inner(fx.ring_annotations(s, d), TILE).groupBy("name").agg(F.count(F.lit(1)).alias("n")),
    sql("SELECT name, count(*) AS n FROM annotations WHERE xmin <> tx AND ymin <> ty AND xmax <> tx + 64 AND ymax <> ty + 64 GROUP BY name"))
CELLS = f"""SELECT 'inner' AS kind, name, feature_id, NULL AS adj_name, CAST(NULL AS INTEGER) AS adj_feature_id, class_id FROM annotations
    WHERE xmin <> tx AND ymin <> ty AND xmax <> tx + 64 AND ymax <> ty + 64 UNION ALL SELECT 'merged', {PK}, class_id FROM pr"""
add("merge_cells", lambda s, d: merge.merge_cells(fx.ring_annotations(s, d), TILE, keep_unmatched=False, smooth=False).drop("ring"), sql(CELLS, **PAIRS))
add("merge_cells_keep_unmatched", lambda s, d: merge.merge_cells(fx.ring_annotations(s, d), TILE, keep_unmatched=True, smooth=False).drop("ring"),
    sql(CELLS + """ UNION ALL SELECT 'unmatched', name, feature_id, NULL, NULL, class_id FROM annotations a WHERE (xmin = tx OR ymin = ty OR xmax = tx + 64 OR ymax = ty + 64)
        AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.name = a.name AND pr.feature_id = a.feature_id) AND NOT EXISTS (SELECT 1 FROM pr WHERE pr.adj_name = a.name AND pr.adj_feature_id = a.feature_id)""", **PAIRS))
# even and odd annotations as two slides whose tiles have the same names
add("merge_cells_by_slide", lambda s, d: merge.merge_cells(fx.ring_annotations(s, d).withColumn("slide", F.col("feature_id") % 2), TILE, keep_unmatched=False, smooth=False, by=("slide",)).drop("ring"),
    sql(f"SELECT feature_id % 2 AS slide, kind, {PK}, class_id FROM ({CELLS}) c WHERE adj_feature_id IS NULL OR adj_feature_id % 2 = feature_id % 2", **PAIRS))
# outlines after smoothing; the traced points are checked in the tests
add("merge_split_cells", lambda s, d: merge.merge_split_cells(fx.ring_annotations(s, d), TILE))
add("collect_tiles", lambda s, d: merge.collect_tiles(fx.annotations(s, d)).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("tiles")),
    sql("SELECT class_id, count(*) AS n, count(DISTINCT name) AS tiles FROM annotations GROUP BY class_id"))
BOXPX = """SELECT {cols}, CAST(a.i AS INTEGER) + ymin AS y, CAST(b.i AS INTEGER) + xmin AS x FROM annotations
   JOIN (SELECT unnest(range(0, 64)) AS i) a ON a.i < ymax - ymin JOIN (SELECT unnest(range(0, 64)) AS i) b ON b.i < xmax - xmin"""
GROW = "SELECT DISTINCT {cols}, y + dy AS y, x + dx AS x FROM bp CROSS JOIN (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) v(dy, dx)) o"
AREAS = dict(bp=BOXPX.format(cols="class_id, name, feature_id"), gp=GROW.format(cols="class_id, name, feature_id"),
             gd="SELECT DISTINCT class_id, y + 1 AS y, x + 1 AS x FROM gp", ac=raw(components_sql("ac", "gd", keys="class_id")))
add("area_groups", lambda s, d: merge.area_groups(fx.ring_annotations(s, d)).select(
        "class_id", "name", "feature_id", (F.floor(F.col("root") / (1 << 32)) - 1).cast("int").alias("root_y"), (F.col("root") % (1 << 32) - 1).cast("int").alias("root_x")),
    sql("""SELECT class_id, name, feature_id, CAST(min(root) // 100000 - 1 AS INTEGER) AS root_y, CAST(min(root) % 100000 - 1 AS INTEGER) AS root_x FROM
        gp JOIN (SELECT class_id AS c2, y - 1 AS y2, x - 1 AS x2, root FROM ac) q ON c2 = class_id AND y2 = y AND x2 = x GROUP BY class_id, name, feature_id""", **AREAS))
add("merge_areas", lambda s, d: merge.merge_areas(fx.ring_annotations(s, d)))


def _multi(s, d):
    """One multipolygon per tile and class."""
    return (fx.ring_annotations(s, d).groupBy("name", "class_id")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "ring"))), lambda v: v["ring"]).alias("rings")))


PARTS = dict(num="SELECT *, CAST(row_number() OVER (PARTITION BY name, class_id ORDER BY feature_id) - 1 AS INTEGER) AS part FROM annotations",
             bp=BOXPX.format(cols="name, class_id, part").replace("FROM annotations", "FROM num"), gp=GROW.format(cols="name, class_id, part"),
             gd="SELECT DISTINCT name, class_id, y + 1 AS y, x + 1 AS x FROM gp", ac=raw(components_sql("ac", "gd", keys="name, class_id")))
add("explode_parts", lambda s, d: merge.explode_parts(_multi(s, d), ["name", "class_id"]).select(
        "name", "class_id", "part", (F.floor(F.col("root") / (1 << 32)) - 1).cast("int").alias("root_y"), (F.col("root") % (1 << 32) - 1).cast("int").alias("root_x")),
    sql("""SELECT gp.name, gp.class_id, part, CAST(min(root) // 100000 - 1 AS INTEGER) AS root_y, CAST(min(root) % 100000 - 1 AS INTEGER) AS root_x FROM
        gp JOIN (SELECT name, class_id, y - 1 AS y2, x - 1 AS x2, root FROM ac) q ON q.name = gp.name AND q.class_id = gp.class_id AND y2 = y AND x2 = x GROUP BY gp.name, gp.class_id, part""", **PARTS))


def _shapes(s, d):
    """Octagons for odd ids, rectangles for even ones."""
    a = fx.annotations(s, d)
    return a.withColumn("ring", F.when(F.col("feature_id") % 2 == 1, fx.box_ring(1)).otherwise(fx.box_ring()))


add("drop_rectangles", lambda s, d: an.drop_rectangles(_shapes(s, d)).select("name", "feature_id", "class_id"),
    sql(f"SELECT {BASE} FROM annotations WHERE feature_id % 2 = 1"))
add("ring_area", lambda s, d: _shapes(s, d).select("name", "feature_id", an.ring_area(F.col("ring")).alias("area")),
    sql("SELECT name, feature_id, CAST((xmax - xmin - 1) * (ymax - ymin - 1) - CASE WHEN feature_id % 2 = 1 THEN 2 ELSE 0 END AS DOUBLE) AS area FROM annotations"))
add("offset", lambda s, d: an.offset(fx.ring_annotations(s, d)).select("name", "feature_id", F.posexplode("ring").alias("i", "p")).select(
        "name", "feature_id", "i", "p.x", "p.y"),
    sql("""SELECT name, feature_id, CAST(i AS INTEGER) AS i, CAST(tx + CASE WHEN i IN (1, 2) THEN xmax - 1 ELSE xmin END AS DOUBLE) AS x,
        CAST(ty + CASE WHEN i IN (2, 3) THEN ymax - 1 ELSE ymin END AS DOUBLE) AS y FROM annotations CROSS JOIN (SELECT unnest(range(0, 5)) AS i) u"""))
add("tile_counts", lambda s, d: an.tile_counts(fx.annotations(s, d)), sql("SELECT name, count(*) AS n_features FROM annotations GROUP BY name"))

# --- polygons and pixels ------------------------------------------------------------------------------------------------------

OCT = BOXPX.format(cols="name, feature_id, class_id") + """ WHERE (feature_id % 2 = 0) OR (a.i + b.i >= 1 AND (ymax - ymin - 1 - a.i) + b.i >= 1
   AND a.i + (xmax - xmin - 1 - b.i) >= 1 AND (ymax - ymin - 1 - a.i) + (xmax - xmin - 1 - b.i) >= 1)"""
add("rasterize", lambda s, d: raster.rasterize(_shapes(s, d), ["name", "feature_id"]).groupBy("name", "feature_id", "y").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.count(F.lit(1)).alias("n")),
    sql("SELECT name, feature_id, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM op GROUP BY name, feature_id, y", op=OCT))


def _local_shapes(s, d):
    """Shapes stretched to overlap their neighbours, in slide coordinates."""
    a = fx.annotations(s, d).withColumn("xmax", F.col("xmax") + 5).withColumn("ymax", F.col("ymax") + 4)
    return a.withColumn("ring", fx.box_ring(2))


STRETCH = """SELECT name, feature_id, class_id, CAST(a.i AS INTEGER) + ymin - ty AS y, CAST(b.i AS INTEGER) + xmin - tx AS x FROM (SELECT name, feature_id, class_id, tx, ty, xmin, ymin, xmax + 5 AS xmax, ymax + 4 AS ymax FROM annotations) z
   JOIN (SELECT unnest(range(0, 80)) AS i) a ON a.i < ymax - ymin JOIN (SELECT unnest(range(0, 80)) AS i) b ON b.i < xmax - xmin
   WHERE a.i + b.i >= 2 AND (ymax - ymin - 1 - a.i) + b.i >= 2 AND a.i + (xmax - xmin - 1 - b.i) >= 2 AND (ymax - ymin - 1 - a.i) + (xmax - xmin - 1 - b.i) >= 2"""


def _tile_local(s, d):
    a = an.with_tile(_local_shapes(s, d))
    return a.withColumn("ring", an.shift_ring(F.col("ring"), -F.col("tile_x"), -F.col("tile_y"))).select("name", "feature_id", "class_id", "ring")


add("paint_instances", lambda s, d: raster.paint_instances(_tile_local(s, d), H, W),
    sql("""SELECT name, y, x, feature_id AS inst_id, class_id AS type_id FROM (SELECT *, row_number() OVER (PARTITION BY name, y, x ORDER BY feature_id DESC) AS rn
        FROM sp WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63) q WHERE rn = 1""", sp=STRETCH))
add("paint_by_area", lambda s, d: raster.paint_by_area(_tile_local(s, d)),
    sql("""SELECT sp.name, y, x, CAST(max(rk) AS INTEGER) AS inst_id FROM sp JOIN (SELECT name, feature_id, row_number() OVER (PARTITION BY name ORDER BY count(*) * least(feature_id, 255), feature_id) AS rk
        FROM sp GROUP BY name, feature_id) r ON r.name = sp.name AND r.feature_id = sp.feature_id GROUP BY sp.name, y, x""", sp=STRETCH))
add("outline", lambda s, d: raster.outline(fx.true_pixels(s, d)).select("image_id", "inst_id", F.posexplode("ring").alias("i", "p")).select(
        "image_id", "inst_id", "i", F.col("p.x").cast("int").alias("x"), F.col("p.y").cast("int").alias("y")),
    sql("""SELECT image_id, id AS inst_id, CAST(i AS INTEGER) AS i, CASE WHEN i IN (2, 3) THEN x0 + w - 1 ELSE x0 END AS x, CASE WHEN i IN (1, 2) THEN y0 + h - 1 ELSE y0 END AS y
        FROM rects CROSS JOIN (SELECT unnest(range(0, 5)) AS i) u"""))


def _export(s, d):
    px = fx.pred_pixels(s, d).withColumn("sem_id", F.col("type_id"))
    cells, areas = merge.export_annotations(px, class_names={v: k for k, v in instances.CLASS_DICTIONARIES["pannuke"].items()})
    both = cells.withColumn("kind", F.lit("cells")).unionByName(areas.withColumn("kind", F.lit("areas")))
    return geojson.to_features(both, keep=("kind", "image_id", "inst_id"))


add("export_annotations", _export)

# --- sources and sinks --------------------------------------------------------------------------------------------------------

NAMES = {v: k for k, v in instances.CLASS_DICTIONARIES["pannuke"].items()}
CLASS_CASE = "CASE class_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in NAMES.items()) + " END"


def _class_name():
    return F.create_map(*[F.lit(v) for kv in NAMES.items() for v in kv])[F.col("class_id")]


add("write_geojson", lambda s, d: geojson.to_features(fx.ring_annotations(s, d).withColumn("class_name", _class_name()), keep=("name", "feature_id")),
    sql(f"""SELECT name, feature_id, concat('{{"type":"Feature","id":"PathCellDetection","geometry":{{"type":"Polygon","coordinates":[[',
        '[', xmin, '.0,', ymin, '.0],[', xmax - 1, '.0,', ymin, '.0],[', xmax - 1, '.0,', ymax - 1, '.0],[', xmin, '.0,', ymax - 1, '.0],[', xmin, '.0,', ymin, '.0]',
        ']]}},"properties":{{"isLocked":"false","measurements":[],"classification":{{"name":"', {CLASS_CASE}, '"}}}}}}') AS value FROM annotations"""))


def _geojson_round(s, d):
    path = scratch(s)
    geojson.write_geojson(fx.ring_annotations(s, d).withColumn("class_name", _class_name()).withColumn("tile", F.col("name")), path, by=("tile",))
    raw_rows = (s.read.schema(geojson.SCHEMA.add("tile", "string")).option("basePath", path).json(path)
                .withColumn("feature_id", F.monotonically_increasing_id()))
    return geojson.parse_features(raw_rows, keep=("tile",)).groupBy("tile", "class_name").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


add("scan_geojson", _geojson_round,
    sql(f"""SELECT name AS tile, {CLASS_CASE} AS class_name, count(*) AS n, CAST(sum(xmin) AS BIGINT) AS xmin, CAST(sum(ymin) AS BIGINT) AS ymin,
        CAST(sum(xmax) AS BIGINT) AS xmax, CAST(sum(ymax) AS BIGINT) AS ymax FROM annotations GROUP BY ALL"""))


def _xml_round(s, d):
    path = scratch(s)
    v = F.transform(F.slice(F.col("ring"), F.lit(1), F.size("ring") - 1), lambda p: F.struct((p["x"] + 0.25).alias("_X"), (p["y"] + 0.75).alias("_Y")))
    r = fx.ring_annotations(s, d).select(F.hash("name", "feature_id").cast("long").alias("_Id"), F.struct(v.alias("Vertex")).alias("Vertices"))
    r.write.format("xml").option("rootTag", "Regions").option("rowTag", "Region").save(path)
    got = xml.scan_xml_annotations(s, path)
    return an.bounds(got).groupBy("xmin", "ymin", "xmax", "ymax").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ring")).alias("points"))


add("scan_xml_annotations", _xml_round,
    sql("""SELECT xmin, ymin + 1 AS ymin, xmax, ymax + 1 AS ymax, count(*) AS n, CAST(5 * count(*) AS BIGINT) AS points FROM annotations GROUP BY ALL"""))


def _masks(s, d):
    path = scratch(s)
    fx.pred_pixels(s, d).write.parquet(path)
    return tables.scan_masks(s, path, "type_map")


add("scan_masks", _masks, sql("SELECT image_id, y, x, type_id FROM pred"))


def _instances_round(s, d):
    path = scratch(s)
    tables.write_instances(fx.pred_pixels(s, d), path)
    return tables.scan_masks(s, path, "inst_bbox").select("image_id", "inst_id", "bbox.*")


add("write_instances", _instances_round,
    sql("SELECT image_id, inst_id, min(y) AS y1, max(y) + 1 AS y2, min(x) AS x1, max(x) + 1 AS x2 FROM pred GROUP BY image_id, inst_id"))


def _patch_rows(s, d):
    g = fx.image_pixels(s, d).select("image_id", "y", "x", "r", "g", "b", F.col("true_id").alias("inst_id"), F.col("true_cls").alias("type_id"), F.lit(0).alias("sem_id"))
    p = tiling.extract_patches(g, H, W, (32, 32), 32, padding=False)
    return p.withColumn("split", F.when(F.col("image_id") % 4 == 0, "test").otherwise("train"))


META = {"stride": 32, "patch_shape": (32, 32), "classes": instances.CLASS_DICTIONARIES["pannuke"]}


def _stored(s, d, append: bool = False) -> str:
    path = scratch(s)
    rows = _patch_rows(s, d)
    if append:
        tables.write_patches(rows.filter("split = 'train'"), path, META)
        tables.append_patches(rows.filter("split = 'test'"), path)
    else:
        tables.write_patches(rows, path, META)
    return path


def _read_stored(s, d):
    p = s.read.parquet(os.path.join(_stored(s, d), "patches"))
    return p.groupBy("split", "image_id", "patch_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("r", "g", "b", "inst_id", "type_id")])


add("write_patches", _read_stored,
    sql("""SELECT CASE WHEN image_id % 4 = 0 THEN 'test' ELSE 'train' END AS split, image_id, CAST(y // 32 * 2 + x // 32 AS INTEGER) AS patch_id, count(*) AS n,
        CAST(sum(r) AS BIGINT) AS r, CAST(sum(g) AS BIGINT) AS g, CAST(sum(b) AS BIGINT) AS b, CAST(sum(true_id) AS BIGINT) AS inst_id, CAST(sum(true_cls) AS BIGINT) AS type_id
        FROM image_pixels GROUP BY image_id, y // 32 * 2 + x // 32"""))
add("append_patches", lambda s, d: rounded(tables.dataset_stats(s, _stored(s, d, True)), 4),
    sql("SELECT channel, count(*) AS pixel_num, round(sum(v / CAST(255 AS DOUBLE)), 4) AS channel_sum, round(sum((v / CAST(255 AS DOUBLE)) * (v / CAST(255 AS DOUBLE))), 4) AS channel_sum_sq FROM chan GROUP BY channel"))
add("dataset_metadata", lambda s, d: tables.dataset_metadata(s, _stored(s, d)).select(
        "stride", "patch_height", "patch_width", "n_items", F.explode("classes").alias("class_name", "class_id")),
    sql(f"SELECT 32 AS stride, 32 AS patch_height, 32 AS patch_width, (SELECT CAST(4 * count(*) AS BIGINT) FROM supplier) AS n_items, class_name, class_id FROM (SELECT unnest({list(NAMES.values())!r}) AS class_name, CAST(unnest({list(NAMES)!r}) AS INTEGER) AS class_id) q"))
add("read_patch", lambda s, d: tables.read_patch(s, _stored(s, d), 3).select("image_id", "py", "px", "r", "inst_id", "type_id"),
    sql("SELECT image_id, CAST(y - 32 AS INTEGER) AS py, CAST(x - 32 AS INTEGER) AS px, r, true_id AS inst_id, true_cls AS type_id FROM image_pixels WHERE y >= 32 AND x >= 32"))


def _scores_round(s, d):
    from ..operators import metrics
    path = tables.write_scores(rounded(metrics.pq(fx.pixels(s, d))), scratch(s), "run")
    return s.read.option("header", True).schema("image_id int, PQ double, SQ double, DQ double, inst_recall double, inst_precision double").csv(path)


add("write_scores", _scores_round)
add("fold_to_samples", lambda s, d: tables.fold_to_samples(fx.table(s, d, "documents").select(F.col("lang").alias("tissue"), F.col("doc_id").alias("pos")), 2, "train"),
    "SELECT lang AS tissue, doc_id AS pos, concat(lang, '_fold2_', CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS VARCHAR)) AS name, 'train' AS phase FROM documents")
add("pair", lambda s, d: tables.pair(fx.image_pixels(s, d).groupBy("image_id").agg(F.sum("r").alias("r")),
                                     fx.true_pixels(s, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id"),
    sql("SELECT a.image_id, r, n FROM (SELECT image_id, CAST(sum(r) AS BIGINT) AS r FROM image_pixels GROUP BY image_id) a JOIN (SELECT image_id, count(*) AS n FROM truth GROUP BY image_id) b ON a.image_id = b.image_id"))


def _reconciled(s, d):
    i = fx.table(s, d, "supplier").select(F.col("s_suppkey").cast("int").alias("image_id"))
    dims = i.select("image_id", F.lit(64).alias("height"), F.lit(64).alias("width"), (64 - F.col("image_id") % 2).alias("mask_height"), (64 - F.col("image_id") % 3).alias("mask_width"))
    return tables.reconcile_shape(fx.image_pixels(s, d), dims).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("y"), F.max("x").alias("x"))


add("reconcile_shape", _reconciled,
    sql("""SELECT image_id, count(*) AS n, max(y) AS y, max(x) AS x FROM image_pixels WHERE y < 64 - CASE WHEN image_id % 2 > 0 THEN 1 ELSE 0 END
        AND x < 64 - CASE WHEN image_id % 3 > 0 THEN 1 ELSE 0 END GROUP BY image_id"""))
