"""Queries of dataset statistics, losses on class scores, and patch cutting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import instances, losses, stats, tiling
from .rasters import line_sums, line_sums_sql
from .sqlkit import Catalog, rounded, sql

H = W = fx.SIDE
N = fx.N_CLASSES
catalog = Catalog()
add = catalog.add

# --- statistics -----------------------------------------------------------------------------------------------------------


def _chan(s, d):
    return fx.channels_long(fx.image_pixels(s, d))


PS = dict(ps="SELECT channel, count(*) AS n, sum(v / CAST(255 AS DOUBLE)) AS s, sum((v / CAST(255 AS DOUBLE)) * (v / CAST(255 AS DOUBLE))) AS q FROM chan GROUP BY channel")
add("patch_stats", lambda s, d: rounded(stats.patch_stats(_chan(s, d)), 4),
    sql("SELECT channel, n AS pixel_num, round(s, 4) AS channel_sum, round(q, 4) AS channel_sum_sq FROM ps", **PS))
add("dataset_mean_std", lambda s, d: rounded(stats.dataset_mean_std(stats.patch_stats(_chan(s, d)))),
    sql("SELECT channel, round(s / n, 6) AS mean, round(sqrt(q / n - (s / n) * (s / n)), 6) AS std FROM ps", **PS))
CP = dict(cls="SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS class_id, unnest(['bg', 'neoplastic', 'inflammatory', 'connective', 'dead', 'epithelial']) AS class_name",
          cp="SELECT class_name, class_id, coalesce(n, 0) AS n FROM cls LEFT JOIN (SELECT true_cls AS class_id, count(*) AS n FROM image_pixels GROUP BY true_cls) q USING (class_id)")


def _class_counts(s, d):
    return stats.class_pixels(fx.image_pixels(s, d), instances.CLASS_DICTIONARIES["pannuke"], "true_cls")


add("class_pixels", _class_counts, sql("SELECT class_name, class_id, n FROM cp", **CP))
add("class_weights", lambda s, d: rounded(stats.class_weights(_class_counts(s, d))),
    sql("SELECT class_id, round(1 - n / sum(n) OVER (), 6) AS weight FROM cp", **CP))
add("binary_class_weights", lambda s, d: rounded(stats.binary_class_weights(_class_counts(s, d))),
    sql("SELECT class_id, round(1 - n / sum(n) OVER (), 6) AS weight FROM (SELECT CASE WHEN class_id > 0 THEN 1 ELSE 0 END AS class_id, sum(n) AS n FROM cp GROUP BY ALL) q", **CP))
add("class_dictionary", lambda s, d: fx.pixels(s, d).groupBy(F.col("true_cls").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    .join(F.broadcast(stats.class_table(s, instances.CLASS_DICTIONARIES["pannuke"])), "class_id").select("class_name", "class_id", "n"),
    sql("SELECT class_name, class_id, count(*) AS n FROM pixels JOIN cls ON class_id = true_cls GROUP BY class_name, class_id", cls=CP["cls"]))

# --- losses ---------------------------------------------------------------------------------------------------------------

WEIGHTS = [0.1, 0.9, 0.8, 0.7, 0.6, 0.5]
WSQL = "[" + ", ".join(f"CAST({w} AS DOUBLE)" for w in WEIGHTS) + "]"
HOT = "(hot + CAST(1e-7 AS DOUBLE))"
PER = f"SELECT sample, sum(p * {HOT}) AS i, sum(p + {HOT}) AS s, sum(p * (1 - {HOT})) AS fp, sum({HOT} * (1 - p)) AS fn FROM sm GROUP BY sample"
EPS6, EPS7 = "CAST(1e-6 AS DOUBLE)", "CAST(1e-7 AS DOUBLE)"
LOSS_SQL = {
    "ce": "SELECT avg(-ln(p)) AS loss FROM sm WHERE hot = 1",
    "dice": f"SELECT avg(1 - 2 * i / greatest(s, {EPS6})) AS loss FROM per",
    "iou": f"SELECT avg(1 - i / greatest(s, {EPS6})) AS loss FROM per",
}
add("cross_entropy", lambda s, d: rounded(losses.cross_entropy(fx.logits(s, d))),
    sql("SELECT round(loss, 6) AS loss FROM l", l=LOSS_SQL["ce"]))
add("cross_entropy_weighted", lambda s, d: rounded(losses.cross_entropy(fx.logits(s, d), WEIGHTS)),
    sql(f"SELECT round(avg(-ln(p) * {WSQL}[target + 1]), 6) AS loss FROM sm WHERE hot = 1"))
add("dice_loss", lambda s, d: rounded(losses.dice_loss(fx.logits(s, d), N)), sql("SELECT round(loss, 6) AS loss FROM l", per=PER, l=LOSS_SQL["dice"]))
add("iou_loss", lambda s, d: rounded(losses.iou_loss(fx.logits(s, d), N)), sql("SELECT round(loss, 6) AS loss FROM l", per=PER, l=LOSS_SQL["iou"]))
add("tversky_loss", lambda s, d: rounded(losses.tversky_loss(fx.logits(s, d), N)),
    sql(f"SELECT round(avg(1 - i / greatest(i + CAST(0.7 AS DOUBLE) * fp + CAST(0.3 AS DOUBLE) * fn, {EPS7})), 6) AS loss FROM per", per=PER))
add("focal_loss", lambda s, d: rounded(losses.focal_loss(fx.logits(s, d), N)),
    sql(f"SELECT round(avg(l), 6) AS loss FROM (SELECT vec_id, -sum({HOT} * 0.5 * (1 - p - {EPS6}) * (1 - p - {EPS6}) * ln(p + {EPS6})) AS l FROM sm GROUP BY vec_id) q"))
add("symmetric_ce", lambda s, d: rounded(losses.symmetric_ce(fx.logits(s, d), N)),
    sql(f"""SELECT round(CAST(0.5 AS DOUBLE) * avg(f) + avg(r), 6) AS loss FROM (SELECT vec_id, -sum(t * ln(p + {EPS6})) AS f, -sum((p + {EPS6}) * ln(t)) AS r FROM
        (SELECT *, CASE WHEN hot = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(1e-4 AS DOUBLE) END AS t FROM sm) a GROUP BY vec_id) q"""))
add("mse", lambda s, d: rounded(losses.mse(fx.image_pixels(s, d).select(F.col("prob").alias("yhat"), (F.col("true_id") > 0).cast("int").alias("target")))),
    sql("SELECT round(avg((prob - t) * (prob - t)), 6) AS loss FROM (SELECT prob, CASE WHEN true_id > 0 THEN 1 ELSE 0 END AS t FROM image_pixels) q"))


def _weighted(s, d):
    """Cross entropy per row, weighted by class weights of the targets and by an edge weight."""
    df = losses.pixel_cross_entropy(fx.logits(s, d)).withColumn("weight_map", (F.col("vec_id") % 4).cast("double"))
    counts = df.groupBy(F.col("target").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    return losses.weight_loss(df, stats.class_weights(counts), 1.1).agg(F.avg("loss").alias("loss"))


add("weight_loss", lambda s, d: rounded(_weighted(s, d)),
    sql("""SELECT round(avg(-ln(p) * w * pow(CAST(1.1 AS DOUBLE), vec_id % 4)), 6) AS loss FROM sm JOIN
        (SELECT target AS c2, 1 - count(*) / sum(count(*)) OVER () AS w FROM logits GROUP BY target) q ON c2 = target WHERE hot = 1"""))
add("joint_loss", lambda s, d: rounded(losses.joint_loss(
        [losses.cross_entropy(fx.logits(s, d)), losses.dice_loss(fx.logits(s, d), N), None, losses.iou_loss(fx.logits(s, d), N)], [1.0, 0.5, 0.3, 0.25])),
    sql("SELECT round(sum(loss), 6) AS loss FROM (SELECT loss FROM l1 UNION ALL SELECT 0.5 * loss FROM l2 UNION ALL SELECT 0.25 * loss FROM l3) q",
        per=PER, l1=LOSS_SQL["ce"], l2=LOSS_SQL["dice"], l3=LOSS_SQL["iou"]))

# --- patches --------------------------------------------------------------------------------------------------------------

add("margins", lambda s, d: fx.table(s, d, "part").select(
        "p_partkey", tiling.margins(F.col("p_size") * 40, 256).alias("my"), tiling.margins(F.col("p_size") * 30, 512).alias("mx")),
    "SELECT p_partkey, CAST(ceil((p_size * 40 + 200) / 256) * 256 - p_size * 40 AS INTEGER) AS my, CAST(ceil((p_size * 30 + 200) / 512) * 512 - p_size * 30 AS INTEGER) AS mx FROM part")


def refl(m: int) -> str:
    """Padded positions 0..63 + 2m and their sources, for margins of any width."""
    return f"""SELECT CAST(p + {m} AS INTEGER) AS p, CAST(least(q, 126 - q) AS INTEGER) AS q FROM
      (SELECT p, ((p % 126) + 126) % 126 AS q FROM (SELECT unnest(range({-m}, {64 + m})) AS p) u) v"""


PADDED = "SELECT image_id, a.p AS y, b.p AS x, r, prob FROM image_pixels i JOIN pos a ON a.q = i.y JOIN pos b ON b.q = i.x"
add("reflect_pad", lambda s, d: line_sums(tiling.reflect_pad(fx.image_pixels(s, d).select("image_id", "y", "x", "r", "prob"), H, W, 70, 70), ["r", "prob"], digits=3),
    sql(line_sums_sql("big", ["r", "prob"], digits=3), pos=refl(70), big=PADDED))

PATCH, STRIDE, M = (32, 32), 16, (8, 8)
NT = tiling.tiles_along(64, 32, 16, 8)
PT = f"""SELECT image_id, CAST(a.t * {NT} + b.t AS INTEGER) AS patch_id, CAST(y - a.t * {STRIDE} AS INTEGER) AS py, CAST(x - b.t * {STRIDE} AS INTEGER) AS px, r, prob FROM big
  JOIN (SELECT unnest(range(0, {NT})) AS t) a ON y BETWEEN a.t * {STRIDE} AND a.t * {STRIDE} + 31 JOIN (SELECT unnest(range(0, {NT})) AS t) b ON x BETWEEN b.t * {STRIDE} AND b.t * {STRIDE} + 31"""
PCTES = dict(pos=refl(8), big=PADDED, pt=PT)


def _patches(s, d, margin=M):
    return tiling.extract_patches(fx.image_pixels(s, d).select("image_id", "y", "x", "r", "prob"), H, W, PATCH, STRIDE, margin)


def _patch_sums(df, *cols):
    return df.groupBy("image_id", "patch_id").agg(F.count(F.lit(1)).alias("n"), *[f for c in cols for f in (
        F.round(F.sum(c), 4).alias(f"{c}_sum"), F.round(F.sum(F.col(c) * (F.col("py") * 100 + F.col("px"))), 3).alias(f"{c}_place"))])


def _patch_sums_sql(src, *cols):
    return f"SELECT image_id, patch_id, count(*) AS n, " + ", ".join(
        f"round(sum({c}), 4) AS {c}_sum, round(sum({c} * (py * 100 + px)), 3) AS {c}_place" for c in cols) + f" FROM {src} GROUP BY image_id, patch_id"


add("extract_patches", lambda s, d: _patch_sums(_patches(s, d), "prob"), sql(_patch_sums_sql("pt", "prob"), **PCTES))
add("stitch_crop", lambda s, d: line_sums(tiling.stitch_crop(_patches(s, d, (24, 24)), H, W, PATCH, STRIDE, (24, 24)), ["r"]),
    sql(line_sums_sql("image_pixels", ["r"])))
add("stitch_mean", lambda s, d: line_sums(tiling.stitch_mean(_patches(s, d).withColumn("prob", F.col("prob") + F.col("patch_id")), H, W, PATCH, STRIDE, ["prob", "r"], M), ["prob", "r"]),
    sql(line_sums_sql("q", ["prob", "r"]), **PCTES,
        q=f"SELECT image_id, y, x, avg(prob + patch_id) AS prob, avg(r) AS r FROM (SELECT *, patch_id // {NT} * {STRIDE} + py - 8 AS y, patch_id % {NT} * {STRIDE} + px - 8 AS x FROM pt) z WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63 GROUP BY image_id, y, x"))
PYR = dict(
    wc="SELECT px, py, de / (dc + de) AS q FROM (SELECT px, py, sqrt(pow(px - 16 + 0.5, 2) + pow(py - 16 + 0.5, 2)) AS dc, "
       "least(sqrt(least(pow(px + 0.5, 2), pow(px - 32 + 0.5, 2)) + 0.25), sqrt(least(pow(py + 0.5, 2), pow(py - 32 + 0.5, 2)) + 0.25)) AS de FROM "
       "(SELECT unnest(range(0, 32)) AS px) a CROSS JOIN (SELECT unnest(range(0, 32)) AS py) b) c",
    wt="SELECT px, py, q * 1024 / sum(q) OVER () AS w FROM wc")
add("apply_weights", lambda s, d: _patch_sums(tiling.apply_weights(_patches(s, d), tiling.pyramid_weights(s, 32, 32), ["prob"]), "prob"),
    sql(_patch_sums_sql("(SELECT image_id, patch_id, px, py, prob * w AS prob FROM pt JOIN wt USING (px, py)) q", "prob"), **PCTES, **PYR))
add("replicate", lambda s, d: tiling.replicate(fx.tiles(s, d), 3),
    sql("SELECT tiles.*, CAST(k AS INTEGER) AS copy FROM tiles CROSS JOIN (SELECT unnest(range(1, 4)) AS k) u"))
add("center_crop", lambda s, d: line_sums(tiling.center_crop(fx.image_pixels(s, d), H, W, 41, 30), ["r", "prob"]),
    sql(line_sums_sql("(SELECT image_id, y - 12 AS y, x - 17 AS x, r, prob FROM image_pixels WHERE y BETWEEN 12 AND 52 AND x BETWEEN 17 AND 46) q", ["r", "prob"])))
add("rigid_transform", lambda s, d: _patch_sums(tiling.rigid_transform(_patches(s, d), 32, choice=F.col("patch_id") % 8), "r"),
    sql(_patch_sums_sql("""(SELECT image_id, patch_id, r, CASE patch_id % 8 WHEN 0 THEN py WHEN 1 THEN 31 - px WHEN 2 THEN 31 - py WHEN 3 THEN px WHEN 4 THEN py WHEN 5 THEN 31 - py WHEN 6 THEN px ELSE 31 - px END AS py,
        CASE patch_id % 8 WHEN 0 THEN px WHEN 1 THEN py WHEN 2 THEN 31 - px WHEN 3 THEN 31 - py WHEN 4 THEN 31 - px WHEN 5 THEN px WHEN 6 THEN py ELSE 31 - py END AS px FROM pt) q""", "r"), **PCTES))
add("random_crop", lambda s, d: line_sums(tiling.random_crop(fx.image_pixels(s, d), H, W, 24, 24), ["r"]))
add("five_crops", lambda s, d: line_sums(tiling.five_crops(fx.image_pixels(s, d), H, W), ["r"], ("image_id", "crop")),
    sql(line_sums_sql("""(SELECT image_id, crop, y - y0 AS y, x - x0 AS x, r FROM image_pixels JOIN (SELECT * FROM (VALUES ('upper_left', 0, 0), ('upper_right', 0, 32),
        ('lower_left', 32, 0), ('lower_right', 32, 32), ('center', 16, 16)) v(crop, y0, x0)) b ON y BETWEEN y0 AND y0 + 31 AND x BETWEEN x0 AND x0 + 31) q""", ["r"], "image_id, crop")))
add("assign_batches", lambda s, d: tiling.assign_batches(fx.table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("patch_id")).distinct(), 16),
    """SELECT image_id, patch_id, CAST((row_number() OVER (PARTITION BY image_id ORDER BY patch_id) - 1) // 16 AS INTEGER) AS batch FROM
       (SELECT DISTINCT l_suppkey AS image_id, l_orderkey * 10 + l_linenumber AS patch_id FROM lineitem) q""")
add("route_by_size", lambda s, d: tiling.route_by_size(fx.table(s, d, "part").select("p_partkey", (F.col("p_size") * 10).alias("width")), 256)
    .groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.sum("width").alias("total")),
    "SELECT CASE WHEN p_size * 10 > 256 THEN 'tile' ELSE 'direct' END AS route, count(*) AS n, CAST(sum(p_size * 10) AS BIGINT) AS total FROM part GROUP BY ALL")


def linear_model():
    """Six sums of eight elements: the stand-in for a trained network."""
    weight = np.zeros((64, 6))
    for c in range(6):
        weight[8 * c:8 * c + 8, c] = 1.0

    def predict(batch: np.ndarray) -> dict:
        return {"instances": batch[:, :48] @ weight[:48], "types": -(batch[:, :48] @ weight[:48])}

    return predict


add("score_patches", lambda s, d: tiling.score_patches(fx.table(s, d, "embeddings"), linear_model, "embedding", ["vec_id"]).select(
        "vec_id", *[F.round(F.col("instances")[c], 4).alias(f"s{c}") for c in range(6)], F.round(F.col("types")[0], 4).alias("t0"),
        F.col("aux").isNull().alias("no_aux")),
    sql("SELECT vec_id, " + ", ".join(f"round(scores[{c + 1}], 4) AS s{c}" for c in range(6)) + ", round(-scores[1], 4) AS t0, true AS no_aux FROM logits"))
