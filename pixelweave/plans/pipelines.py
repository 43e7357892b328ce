"""Queries of the composed jobs: distances, flooding, flows, post-processing, area cleaning and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions.arrays import one_hot
from ..functions.kernels import disk
from ..operators import areas, distance, flood, flows, forest, instances, morphology
from ..streaming import running
from . import segment
from .masks import CONT, RINGS, _rings, dilate_sql, raw
from .rasters import LABELLED, line_sums, line_sums_sql
from .slides import scratch
from .sqlkit import Catalog, components_sql, rounded, sql

H = W = fx.SIDE
AT = ["image_id", "y", "x"]
catalog = Catalog()
add = catalog.add


def soft_grid(s, d):
    """Probability, contour and offset maps of the predicted side on the full grid."""
    line = morphology.contours(fx.pred_pixels(s, d), H, W).withColumn("contour", F.lit(0.6))
    hv = instances.hover_maps(fx.pred_pixels(s, d), min_size=1).drop("inst_id")
    g = fx.image_pixels(s, d).select(*AT, "prob").join(line, AT, "left").join(hv, AT, "left")
    return g.na.fill({"contour": 0.05, "xmap": 0.0, "ymap": 0.0})


# --- distances --------------------------------------------------------------------------------------------------------------

add("distance_map", lambda s, d: line_sums(distance.distance_map(
        fx.image_pixels(s, d).select(*AT, (F.col("pred_id") > 0).alias("fg")), "fg"), ["distance"]),
    sql(line_sums_sql("dm", ["distance"]),
        g="""SELECT i.image_id, i.y, i.x, min(abs(i.x - p.x)) AS g FROM image_pixels i JOIN pred p ON p.image_id = i.image_id AND p.y = i.y GROUP BY i.image_id, i.y, i.x""",
        dm="""SELECT i.image_id, i.y, i.x, sqrt(CAST(min(g.g * g.g + (g.y - i.y) * (g.y - i.y)) AS DOUBLE)) AS distance FROM image_pixels i JOIN g ON g.image_id = i.image_id AND g.x = i.x
            GROUP BY i.image_id, i.y, i.x"""))
add("weight_map", lambda s, d: line_sums(distance.weight_map(fx.true_pixels(s, d), H, W), ["weight"]),
    sql(line_sums_sql("wm", ["weight"]),
        tpix="SELECT image_id, inst_id, y, x FROM truth t WHERE (SELECT count(*) FROM (VALUES (0,1),(0,-1),(1,0),(-1,0)) v(dy, dx) JOIN truth n ON n.image_id = t.image_id AND n.inst_id = t.inst_id AND n.y = t.y + dy AND n.x = t.x + dx) < 4",
        # rectangles: the distance to an instance follows from its box
        tb="SELECT image_id, inst_id, min(y) AS y1, max(y) AS y2, min(x) AS x1, max(x) AS x2 FROM truth GROUP BY image_id, inst_id",
        dd="""SELECT i.image_id, i.y, i.x, sqrt(CAST(pow(greatest(y1 - y, 0, y - y2), 2) + pow(greatest(x1 - x, 0, x - x2), 2) AS DOUBLE)) AS dist
            FROM image_pixels i JOIN tb ON tb.image_id = i.image_id WHERE i.true_id = 0""",
        two="SELECT image_id, y, x, sum(dist) AS s FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY dist) AS rn FROM dd) q WHERE rn <= 2 GROUP BY image_id, y, x",
        wm="SELECT * FROM (SELECT image_id, y, x, 10 * exp(-(s / 5) * (s / 5) / 2) AS weight FROM two) q WHERE weight > 0"))

# --- flooding and flows: checked against brute force in the tests ------------------------------------------------------------


def _flood_parts(s, d):
    g = fx.image_pixels(s, d)
    mask = g.filter("prob >= 0.2").select(*AT, (1 - F.col("prob")).alias("elevation"))
    return mask, fx.true_pixels(s, d).select(*AT, F.col("inst_id").alias("marker")).join(mask.select(*AT), AT, "left_semi")


add("flood", lambda s, d: flood.flood(*_flood_parts(s, d)).groupBy("image_id", "inst_id").agg(F.count(F.lit(1)).alias("n")))
add("flood_forest", lambda s, d: forest.flood_forest(*_flood_parts(s, d)).groupBy("image_id", "inst_id").agg(F.count(F.lit(1)).alias("n")))
add("follow_flows", lambda s, d: line_sums(flows.follow_flows(
        instances.hover_maps(fx.pred_pixels(s, d)).withColumnRenamed("xmap", "fx").withColumnRenamed("ymap", "fy"), H, W, 200), ["py", "px"]))
add("sink_masks", lambda s, d: flows.sink_masks(flows.follow_flows(
        instances.hover_maps(fx.pred_pixels(s, d)).withColumnRenamed("xmap", "fx").withColumnRenamed("ymap", "fy"), H, W, 200), H, W)
    .groupBy("image_id", "inst_id").agg(F.count(F.lit(1)).alias("n")))

# --- post-processing ----------------------------------------------------------------------------------------------------------

DCAN = dict(
    **CONT, cr="SELECT DISTINCT image_id, y, x FROM ring",
    cg="SELECT i.image_id, i.y, i.x, prob, CASE WHEN r.y IS NULL THEN CAST(0.05 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS contour FROM image_pixels i LEFT JOIN cr r ON r.image_id = i.image_id AND r.y = i.y AND r.x = i.x",
    cq="SELECT image_id, greatest(quantile_cont(contour, 0.01), quantile_cont(contour, 0.99)) AS top FROM cg GROUP BY image_id",
    fg="SELECT image_id, y, x FROM cg JOIN cq USING (image_id) WHERE prob - greatest(least(contour / (top + CAST(1e-7 AS DOUBLE)), 1), -1) >= CAST(0.5 AS DOUBLE)",
    c=raw(components_sql("c", "fg")), pre=LABELLED, trings=dilate_sql("pre", disk(3), "image_id, inst_id"),
    tbox=RINGS["tbox"], void=RINGS["void"], h=RINGS["h"], open=RINGS["open"], whole=RINGS["whole"])
add("segment_dcan", lambda s, d: segment.segment_dcan(soft_grid(s, d), H, W),
    sql("SELECT image_id, y, x, max(inst_id) AS inst_id FROM whole GROUP BY image_id, y, x", **DCAN))


def _sizes(df, column="inst_id"):
    return df.groupBy("image_id", column).agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y1"), F.min("x").alias("x1"))


add("segment_dran", lambda s, d: _sizes(segment.segment_dran(soft_grid(s, d), H, W)))
add("segment_hover", lambda s, d: _sizes(segment.segment_hover(soft_grid(s, d), H, W)))
add("segment_flows", lambda s, d: _sizes(segment.segment_flows(soft_grid(s, d), H, W)))
add("remove_area_debris", lambda s, d: _sizes(areas.remove_area_debris(
        fx.pred_pixels(s, d).withColumnRenamed("type_id", "sem_id"), H, W, 40), "sem_id"))


def _ring_areas(s, d):
    r = _rings(s, d).groupBy(*AT).agg(F.max("inst_id").alias("i"))
    return fx.image_pixels(s, d).select(*AT).join(r, AT, "left").select(*AT, F.coalesce(1 + F.col("i") % 3, F.lit(0)).cast("int").alias("sem_id"))


add("fill_holes", lambda s, d: _sizes(areas.fill_holes(_ring_areas(s, d), H, W, 60), "sem_id"))
add("process_semantic", lambda s, d: _sizes(segment.process_semantic(
        fx.image_pixels(s, d).select(*AT, one_hot(F.col("pred_cls"), 6, 0.01).alias("sem_probs")), H, W, 6, radius=2, min_size=60), "sem_id"))

# --- streams -------------------------------------------------------------------------------------------------------------------


CHUNKS = 4


def _pieces(s, df, n: int = CHUNKS) -> str:
    """Store a table as `n` files, the chunks in which a stream meets it."""
    path = scratch(s)
    df.repartition(n).write.parquet(path)
    return path


def _chunked(s, df, n: int = CHUNKS):
    """A stream that meets a table in at most `n` chunks of the files in which its tasks store it: nothing is shuffled for that."""
    path = scratch(s)
    df.write.parquet(path)
    return running.stream_table(s, path, max(1, -(-len(s.read.parquet(path).inputFiles()) // n)))


def _run(query):
    query.awaitTermination()


def _stats(s, d):
    src, target = _chunked(s, fx.channels_long(fx.image_pixels(s, d))), scratch(s)
    _run(running.keep_state(running.stream_stats(src), target, scratch(s)))
    return rounded(running.final_state(s, target), 4)


add("stream_stats", _stats,
    sql("SELECT channel, count(*) AS pixel_num, round(sum(v / CAST(255 AS DOUBLE)), 4) AS channel_sum, round(sum((v / CAST(255 AS DOUBLE)) * (v / CAST(255 AS DOUBLE))), 4) AS channel_sum_sq FROM chan GROUP BY channel"))


def _metrics(s, d, windowed: bool):
    src, target = _pieces(s, fx.table(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")), scratch(s)
    rows = running.stream_table(s, src)
    state = running.stream_metrics_windowed(rows, "event_type", "value", late="3650 days") if windowed else running.stream_metrics(rows, "event_type", "value")
    _run(running.keep_state(state, target, scratch(s)))
    return rounded(running.final_state(s, target), 4)


add("stream_metrics", lambda s, d: _metrics(s, d, False),
    "SELECT event_type, round(sum(value), 4) AS total, count(value) AS n, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
add("stream_metrics_windowed", lambda s, d: _metrics(s, d, True).withColumn("start", F.date_format("start", "yyyy-MM-dd HH")),
    "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H') AS start, event_type, round(sum(value), 4) AS total, count(value) AS n FROM events GROUP BY ALL")


def _tiles(s, d):
    src, target = _pieces(s, fx.annotations(s, d)), scratch(s)
    _run(running.stream_tiles(running.stream_table(s, src, 1), running.append_chunks(target), scratch(s)))
    return s.read.parquet(target).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("xmin").cast("long")).alias("xmin"))


add("stream_tiles", _tiles, sql("SELECT name, count(*) AS n, CAST(sum(xmin) AS BIGINT) AS xmin FROM annotations GROUP BY name"))
