"""Queries of label maps: components, cleaning, attributes and morphology."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.kernels import disk, ellipse
from ..operators import components, instances, morphology, spans
from .sqlkit import Catalog, components_sql, rounded, sql

H = W = fx.SIDE
catalog = Catalog()
add = catalog.add


def offsets_sql(offsets) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({dy}, {dx})" for dy, dx in offsets) + ") v(dy, dx))"


def dilate_sql(src: str, offsets, keys: str = "image_id") -> str:
    return (f"SELECT DISTINCT {keys}, y + dy AS y, x + dx AS x FROM {src} CROSS JOIN {offsets_sql(offsets)} o "
            "WHERE y + dy BETWEEN 0 AND 63 AND x + dx BETWEEN 0 AND 63")


def erode_sql(src: str, offsets, keys: str = "image_id") -> str:
    ks = [k.strip() for k in keys.split(",")]
    on = " AND ".join(f"n.{k} = s.{k}" for k in ks)
    return (f"SELECT {', '.join('s.' + k for k in ks)}, s.y, s.x FROM {src} s CROSS JOIN {offsets_sql(offsets)} o LEFT JOIN {src} n "
            f"ON {on} AND n.y = s.y + dy AND n.x = s.x + dx GROUP BY {', '.join('s.' + k for k in ks)}, s.y, s.x "
            "HAVING count(*) FILTER (WHERE n.y IS NULL AND s.y + dy BETWEEN 0 AND 63 AND s.x + dx BETWEEN 0 AND 63) = 0")


def raw(text: str) -> str:
    """Mark several CTE texts at once, to pass as one entry of `sql`."""
    return "@" + text


def _hidden_types(s, d):
    """Predicted instances over a type map that keeps only the classes 1 and 2."""
    return (fx.pixels(s, d).filter("pred_id > 0")
            .select("image_id", "y", "x", F.col("pred_id").alias("inst_id"),
                    F.when(F.col("true_cls") <= 2, F.col("true_cls")).otherwise(0).alias("type_id")))


def _mixed_types(s, d):
    return (fx.pixels(s, d).filter("pred_id > 0")
            .select("image_id", "y", "x", F.col("pred_id").alias("inst_id"), F.col("true_cls").alias("type_id")))


RANK = "CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER)"
COMP = dict(c=raw(components_sql("c", "pred")))
COMP_ID = dict(c=raw(components_sql("c", "pred", value="inst_id")))

add("label", lambda s, d: components.label(fx.pred_pixels(s, d)),
    sql(f"SELECT image_id, y, x, {RANK} AS label FROM c", **COMP))
add("label_spans", lambda s, d: spans.to_pixels(spans.label_spans(spans.to_spans(fx.pred_pixels(s, d), ["image_id"])), ["image_id", "label"]),
    sql(f"SELECT image_id, y, x, {RANK} AS label FROM c", **COMP))
add("instance_spans", lambda s, d: spans.to_spans(fx.pred_pixels(s, d)),
    sql("""SELECT image_id, inst_id, y, CAST(min(x) AS INTEGER) AS x0, CAST(max(x) AS INTEGER) AS x1 FROM (
           SELECT image_id, inst_id, y, x, x - row_number() OVER (PARTITION BY image_id, inst_id, y ORDER BY x) AS r FROM pred) q GROUP BY image_id, inst_id, y, r"""))
add("label_diagonal", lambda s, d: components.label(fx.pred_pixels(s, d), connectivity=2),
    sql(f"SELECT image_id, y, x, {RANK} AS label FROM c", c=raw(components_sql("c", "pred", diagonal=True))))
# blocks smaller than the images, so that components cross block borders
add("label_blocks", lambda s, d: components.label(fx.pred_pixels(s, d), block=16),
    sql(f"SELECT image_id, y, x, {RANK} AS label FROM c", **COMP))
add("remove_small_objects", lambda s, d: instances.remove_small_objects(fx.true_pixels(s, d), 64),
    sql("""SELECT image_id, y, x, CASE WHEN count(*) OVER (PARTITION BY image_id, inst_id) < 64 THEN 0 ELSE inst_id END AS inst_id,
        type_id FROM truth"""))
add("remove_small_components", lambda s, d: components.remove_small_components(fx.pred_pixels(s, d), 64),
    sql("SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM c) q WHERE n >= 64", **COMP))
add("to_inst_map", lambda s, d: instances.to_inst_map(fx.pred_pixels(s, d), min_size=30),
    sql(f"SELECT image_id, y, x, {RANK} AS inst_id FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM c) q WHERE n >= 30", **COMP))
FIX = """SELECT image_id, y, x, CAST(CASE WHEN j = 1 THEN inst_id ELSE j + top + before END AS INTEGER) AS inst_id FROM
 (SELECT *, dense_rank() OVER (PARTITION BY image_id, inst_id ORDER BY root) AS j FROM c) a
 JOIN (SELECT image_id, inst_id, max(inst_id) OVER (PARTITION BY image_id) AS top,
   coalesce(sum(CASE WHEN k > 1 THEN k ELSE 0 END) OVER (PARTITION BY image_id ORDER BY inst_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
   FROM (SELECT image_id, inst_id, count(DISTINCT root) AS k FROM c GROUP BY image_id, inst_id) q) b USING (image_id, inst_id)"""
add("fix_duplicates", lambda s, d: instances.fix_duplicates(fx.pred_pixels(s, d)), sql(FIX, **COMP_ID))
add("remap_label", lambda s, d: instances.remap_label(fx.pred_pixels(s, d)),
    sql("SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY inst_id) AS INTEGER) AS inst_id, type_id FROM pred"))
add("bounding_box", lambda s, d: instances.bounding_box(fx.pred_pixels(s, d)),
    sql("SELECT image_id, inst_id, min(y) AS y1, max(y) + 1 AS y2, min(x) AS x1, max(x) + 1 AS x2 FROM pred GROUP BY image_id, inst_id"))
add("bounding_box_padded", lambda s, d: instances.bounding_box(fx.pred_pixels(s, d), pad=2, height=H, width=W),
    sql("""SELECT image_id, inst_id, CASE WHEN y1 >= 2 THEN y1 - 2 ELSE y1 END AS y1, CASE WHEN y2 + 2 <= 63 THEN y2 + 2 ELSE y2 END AS y2,
        CASE WHEN x1 >= 2 THEN x1 - 2 ELSE x1 END AS x1, CASE WHEN x2 + 2 <= 63 THEN x2 + 2 ELSE x2 END AS x2 FROM
        (SELECT image_id, inst_id, min(y) AS y1, max(y) + 1 AS y2, min(x) AS x1, max(x) + 1 AS x2 FROM pred GROUP BY image_id, inst_id) q"""))
add("centroids", lambda s, d: rounded(instances.centroids(fx.pred_pixels(s, d))),
    sql("SELECT image_id, inst_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM pred GROUP BY image_id, inst_id"))
add("inst_types", lambda s, d: instances.inst_types(_mixed_types(s, d)),
    sql("SELECT image_id, pred_id AS inst_id, min(true_cls) AS type_id FROM pixels WHERE pred_id > 0 GROUP BY image_id, pred_id"))
add("type_instances", lambda s, d: instances.type_instances(fx.pred_pixels(s, d), 2),
    sql("SELECT image_id, y, x, CASE WHEN type_id = 2 THEN inst_id ELSE 0 END AS inst_id, type_id FROM pred"))
MAJ = """SELECT image_id, inst_id, CASE WHEN first > 0 THEN first ELSE second END AS type_id FROM (
 SELECT image_id, inst_id, max(type_id) FILTER (WHERE rn = 1) AS first, max(type_id) FILTER (WHERE rn = 2) AS second FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id, inst_id ORDER BY n DESC, type_id) AS rn FROM
   (SELECT image_id, inst_id, type_id, count(*) AS n FROM {src} GROUP BY image_id, inst_id, type_id) a) b GROUP BY image_id, inst_id) c"""
MIXED = "SELECT image_id, y, x, pred_id AS inst_id, true_cls AS type_id FROM pixels WHERE pred_id > 0"
HIDDEN = "SELECT image_id, y, x, pred_id AS inst_id, CASE WHEN true_cls <= 2 THEN true_cls ELSE 0 END AS type_id FROM pixels WHERE pred_id > 0"
add("majority_type", lambda s, d: instances.majority_type(_mixed_types(s, d)), sql(MAJ.format(src="mixed"), mixed=MIXED))
NEAR = dict(
    hidden=HIDDEN, maj=MAJ.format(src="hidden"),
    cen="SELECT image_id, inst_id, avg(x) AS cx, avg(y) AS cy FROM hidden GROUP BY image_id, inst_id",
    inst="SELECT cen.*, type_id, count(type_id) OVER (PARTITION BY cen.image_id) AS nt FROM cen JOIN maj USING (image_id, inst_id)",
    filled="""SELECT image_id, inst_id, CASE WHEN nt < 2 THEN 0 WHEN type_id IS NOT NULL THEN type_id ELSE
      (SELECT t.type_id FROM inst t WHERE t.image_id = i.image_id AND t.type_id IS NOT NULL
       ORDER BY (t.cx - i.cx) * (t.cx - i.cx) + (t.cy - i.cy) * (t.cy - i.cy), t.inst_id LIMIT 1) END AS type_id FROM inst i""")


def _near(s, d):
    px = _hidden_types(s, d)
    attrs = instances.majority_type(px).join(instances.centroids(px), ["image_id", "inst_id"])
    return instances.nearest_typed_fill(attrs, cell=8.0)


add("nearest_typed_fill", _near, sql("SELECT image_id, inst_id, type_id FROM filled", **NEAR))
add("finalize_types", lambda s, d: instances.finalize(_hidden_types(s, d))[0],
    sql("SELECT h.image_id, h.y, h.x, h.inst_id, f.type_id FROM hidden h JOIN filled f USING (image_id, inst_id)", **NEAR))
DEB = "SELECT image_id, y, x, inst_id FROM (SELECT *, count(*) OVER (PARTITION BY image_id, inst_id, root) AS n FROM c) q WHERE n >= {n}"
add("finalize_instances", lambda s, d: instances.finalize(_hidden_types(s, d))[1], sql(DEB.format(n=10), **COMP_ID))
add("remove_debris", lambda s, d: instances.remove_debris(fx.pred_pixels(s, d), 40), sql(DEB.format(n=40), **COMP_ID))
add("label_sem_map", lambda s, d: instances.label_sem_map(
        fx.pred_pixels(s, d).select("image_id", "y", "x", F.col("type_id").alias("sem_id"))),
    sql("""SELECT image_id, y, x, sem_id, CAST(j + before AS INTEGER) AS area_id FROM
        (SELECT *, dense_rank() OVER (PARTITION BY image_id, sem_id ORDER BY root) AS j FROM c) a JOIN
        (SELECT image_id, sem_id, coalesce(sum(k) OVER (PARTITION BY image_id ORDER BY n DESC, sem_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
         FROM (SELECT image_id, sem_id, count(*) AS n, count(DISTINCT root) AS k FROM c GROUP BY image_id, sem_id) q) b USING (image_id, sem_id)""",
        sem="SELECT image_id, y, x, type_id AS sem_id FROM pred", c=raw(components_sql("c", "sem", value="sem_id"))))
add("instance_table", lambda s, d: rounded(
        instances.instance_table(fx.pred_pixels(s, d)).select("image_id", "inst_id", "type_id", F.col("centroid.x").alias("cx"),
        F.col("centroid.y").alias("cy"), "bbox.y1", "bbox.y2", "bbox.x1", "bbox.x2", "area")),
    sql("""SELECT image_id, inst_id, min(type_id) AS type_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, min(y) AS y1, max(y) + 1 AS y2,
        min(x) AS x1, max(x) + 1 AS x2, count(*) AS area FROM pred GROUP BY image_id, inst_id"""))

add("dilate", lambda s, d: morphology.morph(fx.pred_pixels(s, d), "dilate", disk(2), H, W), sql(dilate_sql("pred", disk(2))))
add("erode", lambda s, d: morphology.morph(fx.pred_pixels(s, d), "erode", ellipse(5), H, W), sql(erode_sql("pred", ellipse(5))))
add("dilate_instances", lambda s, d: morphology.morph(fx.pred_pixels(s, d), "dilate", disk(3), H, W, ("image_id", "inst_id")),
    sql(dilate_sql("pred", disk(3), "image_id, inst_id")))
add("remove_1px_boundary", lambda s, d: morphology.remove_1px_boundary(fx.pred_pixels(s, d), H, W),
    sql(erode_sql("pred", disk(1), "image_id, inst_id")))


def _chain_sql(ops: str, n: int) -> dict:
    el, ctes, src = ellipse(5), {}, "pred"
    for op in ops:
        for _ in range(n):
            name = f"m{len(ctes)}"
            ctes[name] = (erode_sql if op == "e" else dilate_sql)(src, el)
            src = name
    return dict(ctes, c=raw(components_sql("c", src)))


add("opening", lambda s, d: morphology.opening(fx.pred_pixels(s, d), H, W),
    sql(f"SELECT image_id, y, x, {RANK} AS inst_id FROM c", **_chain_sql("ed", 2)))
add("opening_once", lambda s, d: morphology.opening(fx.pred_pixels(s, d), H, W, iterations=1),
    sql(f"SELECT image_id, y, x, {RANK} AS inst_id FROM c", **_chain_sql("ed", 1)))
add("closing", lambda s, d: morphology.closing(fx.pred_pixels(s, d), H, W),
    sql(f"SELECT image_id, y, x, {RANK} AS inst_id FROM c", **_chain_sql("de", 2)))
CONT = dict(dil=dilate_sql("pred", disk(1), "image_id, inst_id"), ero=erode_sql("pred", disk(1), "image_id, inst_id"),
            ring="SELECT image_id, inst_id, y, x FROM dil EXCEPT SELECT image_id, inst_id, y, x FROM ero")
add("contours", lambda s, d: morphology.contours(fx.pred_pixels(s, d), H, W),
    sql("SELECT DISTINCT image_id, y, x FROM ring", **CONT))
add("hover_maps", lambda s, d: rounded(instances.hover_maps(fx.pred_pixels(s, d))),
    sql("""SELECT image_id, inst_id, y, x, round(CASE WHEN ox < 0 THEN ox / -lx WHEN ox > 0 THEN ox / hx ELSE 0 END, 6) AS xmap,
        round(CASE WHEN oy < 0 THEN oy / -ly WHEN oy > 0 THEN oy / hy ELSE 0 END, 6) AS ymap FROM
        (SELECT *, min(ox) OVER w AS lx, max(ox) OVER w AS hx, min(oy) OVER w AS ly, max(oy) OVER w AS hy FROM
         (SELECT *, x - x1 + 1 - floor(mx - x1 + 0.5) AS ox, y - y1 + 1 - floor(my - y1 + 0.5) AS oy FROM
          (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, CASE WHEN min(x) OVER w >= 2 THEN min(x) OVER w - 2 ELSE min(x) OVER w END AS x1,
             CASE WHEN min(y) OVER w >= 2 THEN min(y) OVER w - 2 ELSE min(y) OVER w END AS y1, count(*) OVER w AS n
           FROM pred WINDOW w AS (PARTITION BY image_id, inst_id)) a WHERE n >= 30) b WINDOW w AS (PARTITION BY image_id, inst_id)) c"""))


def _rings(s, d):
    """Outlines of the true instances: every object is a closed ring around its interior."""
    el = disk(1)
    c = morphology.coverage(fx.true_pixels(s, d), el, H, W, ("image_id", "inst_id"))
    return c.filter(F.col("hits") < morphology.full_hits(el, H, W)).select("image_id", "inst_id", "y", "x")


RINGS = dict(tdil=dilate_sql("truth", disk(1), "image_id, inst_id"), tero=erode_sql("truth", disk(1), "image_id, inst_id"),
             trings="SELECT image_id, inst_id, y, x FROM tdil EXCEPT SELECT image_id, inst_id, y, x FROM tero",
             tbox="SELECT image_id, inst_id, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM trings GROUP BY image_id, inst_id",
             void="""SELECT image_id, inst_id, a.v AS y, b.v AS x FROM tbox JOIN r64 a ON a.v BETWEEN y1 AND y2 JOIN r64 b ON b.v BETWEEN x1 AND x2
                EXCEPT SELECT image_id, inst_id, y, x FROM trings""",
             h=raw(components_sql("h", "void", value="inst_id")),
             open="SELECT DISTINCT h.image_id, h.inst_id, h.root FROM h JOIN tbox USING (image_id, inst_id) WHERE h.y IN (y1, y2) OR h.x IN (x1, x2)",
             whole="""SELECT image_id, inst_id, y, x FROM trings UNION ALL SELECT image_id, inst_id, y, x FROM h
                WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.image_id = h.image_id AND o.inst_id = h.inst_id AND o.root = h.root)""")
add("fill_object_holes", lambda s, d: instances.fill_object_holes(_rings(s, d)),
    sql("SELECT image_id, inst_id, y, x FROM whole", **RINGS))
BIG = dict(big="SELECT image_id, y, x, inst_id FROM (SELECT *, count(*) OVER (PARTITION BY image_id, inst_id) AS n FROM pred) q WHERE n >= 40",
           tbox="SELECT image_id, inst_id, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM big GROUP BY image_id, inst_id",
           void="""SELECT image_id, inst_id, a.v AS y, b.v AS x FROM tbox JOIN r64 a ON a.v BETWEEN y1 AND y2 JOIN r64 b ON b.v BETWEEN x1 AND x2
                EXCEPT SELECT image_id, inst_id, y, x FROM big""",
           h=RINGS["h"], open=RINGS["open"],
           whole="""SELECT image_id, inst_id, y, x FROM big UNION ALL SELECT image_id, inst_id, y, x FROM h
                WHERE NOT EXISTS (SELECT 1 FROM open o WHERE o.image_id = h.image_id AND o.inst_id = h.inst_id AND o.root = h.root)""",
           one="""SELECT image_id, y, x, inst_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY n DESC, inst_id DESC) AS rn FROM
                (SELECT *, count(*) OVER (PARTITION BY image_id, inst_id) AS n FROM whole) a) b WHERE rn = 1""")
add("fill_and_remove_small", lambda s, d: instances.fill_and_remove_small(fx.pred_pixels(s, d), 40),
    sql("SELECT image_id, y, x, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY inst_id) AS INTEGER) AS inst_id FROM one", **BIG))


def _channels(s, d, background: bool):
    px = fx.pixels(s, d) if background else fx.pixels(s, d).filter("pred_id > 0")
    slots = [F.when(F.col("pred_cls") == c, F.col("pred_id")).otherwise(0) for c in range(1, 6)]
    if background:
        slots.append((F.col("pred_id") == 0).cast("int"))
    return px.select("image_id", "y", "x", F.array(*slots).alias("channels"))


add("channels_to_type", lambda s, d: _channels(s, d, True).select(
        "image_id", "y", "x", instances.channels_to_type(F.col("channels")).alias("type_id")),
    sql("SELECT image_id, y, x, CASE WHEN pred_id = 0 THEN 0 ELSE pred_cls END AS type_id FROM pixels"))
add("channels_to_inst", lambda s, d: instances.channels_to_inst(_channels(s, d, False)), sql(FIX, **COMP_ID))
add("remap_classes", lambda s, d: instances.remap_classes(
        fx.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast("int").alias("type_id")),
        instances.CONSEP_REMAP),
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber IN (3, 4) THEN 3 WHEN l_linenumber IN (5, 6, 7) THEN 4 ELSE l_linenumber END AS type_id FROM lineitem")
