"""Queries on full pixel grids: class-axis functions, thresholds, normalization and filters.

Results that hold a value per grid cell are checked through two sums per image line, plain and weighted by the column, so
that a wrong value or a wrong place shows while the compared table stays small. The plans still compute every cell.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..functions import arrays
from ..functions.kernels import gaussian, gaussian_kernel, sobel_hv_kernel
from ..operators import filters, losses, normalize, stats, thresholds
from .masks import _chain_sql, raw
from .sqlkit import Catalog, components_sql, rounded, sql

H = W = fx.SIDE
catalog = Catalog()
add = catalog.add
RANK = "CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS INTEGER)"


def line_sums(df, columns, keys=("image_id",), digits: int = 4):
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [F.round(F.sum(v), digits).alias(f"{c}_sum"), F.round(F.sum(v * (F.col("x") + 1)), digits).alias(f"{c}_place")]
    return df.groupBy(*keys, "y").agg(*aggs)


def line_sums_sql(src: str, columns, keys: str = "image_id", digits: int = 4) -> str:
    cols = ", ".join(f"round(sum(CAST({c} AS DOUBLE)), {digits}) AS {c}_sum, round(sum(CAST({c} AS DOUBLE) * (x + 1)), {digits}) AS {c}_place"
                     for c in columns)
    return f"SELECT {keys}, y, count(*) AS n, {cols} FROM {src} GROUP BY {keys}, y"


# --- functions over the class axis ---------------------------------------------------------------------------------

def _spread(df, column, n=fx.N_CLASSES):
    return df.select("vec_id", F.posexplode(column).alias("c", "v"))


add("softmax", lambda s, d: rounded(_spread(fx.logits(s, d), arrays.softmax(F.col("scores")))),
    sql("SELECT vec_id, c, round(p, 6) AS v FROM sm"))
add("sigmoid", lambda s, d: rounded(_spread(fx.logits(s, d), F.transform("scores", arrays.sigmoid))),
    sql("SELECT vec_id, c, round(1 / (1 + exp(-s)), 6) AS v FROM lg"))
add("argmax", lambda s, d: fx.logits(s, d).select("vec_id", arrays.argmax(F.col("scores")).alias("c")),
    sql("SELECT vec_id, c FROM (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS rn FROM lg) q WHERE rn = 1"))
add("one_hot", lambda s, d: rounded(_spread(fx.logits(s, d), arrays.one_hot(F.col("target"), 7)), 8),
    sql("SELECT vec_id, CAST(k AS INTEGER) AS c, CASE WHEN k = target THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v "
        "FROM logits CROSS JOIN (SELECT unnest(range(0, 7)) AS k) u"))
add("one_hot_eps", lambda s, d: rounded(_spread(fx.logits(s, d), arrays.one_hot(F.col("target"), 6, losses.HOT_EPS)), 8),
    sql("SELECT vec_id, c, round(CASE WHEN c = target THEN 1 ELSE 0 END + CAST(1e-7 AS DOUBLE), 8) AS v FROM lg"))
add("type_map_flatten", lambda s, d: fx.logits(s, d).select(
        "vec_id", arrays.type_map_flatten(arrays.one_hot(F.col("target"), 7)).alias("type_id")),
    sql("SELECT vec_id, target AS type_id FROM logits"))
add("binarize", lambda s, d: fx.pixels(s, d).select("image_id", "y", "x", arrays.binarize(F.col("pred_id")).alias("fg")),
    sql("SELECT image_id, y, x, CASE WHEN pred_id > 0 THEN 1 ELSE 0 END AS fg FROM pixels"))

# --- thresholds -------------------------------------------------------------------------------------------------------

LABELLED = f"SELECT image_id, y, x, {RANK} AS inst_id FROM (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM c) q WHERE n >= 10"


def thresholded(cond: str, **ctes):
    return sql(LABELLED, **ctes, fg=f"SELECT image_id, y, x FROM {cond}", c=raw(components_sql("c", "fg")))


add("naive_thresh_prob", lambda s, d: thresholds.naive_thresh_prob(fx.image_pixels(s, d), 0.75),
    thresholded("image_pixels WHERE prob >= CAST(0.75 AS DOUBLE)"))
add("naive_thresh", lambda s, d: thresholds.naive_thresh(fx.image_pixels(s, d), 1.2),
    thresholded("(SELECT *, max(prob) OVER (PARTITION BY image_id) AS top FROM image_pixels) q WHERE prob >= top / CAST(1.2 AS DOUBLE)"))
add("naive_step", lambda s, d: line_sums(thresholds.soft_step(fx.image_pixels(s, d)), ["prob"]),
    sql(line_sums_sql("st", ["prob"]), st="""SELECT image_id, y, x, CASE WHEN prob < top / 2 THEN 0 WHEN prob > top / 2 THEN 1 ELSE prob END AS prob
        FROM (SELECT *, max(prob) OVER (PARTITION BY image_id) AS top FROM image_pixels) q"""))


def local_sql(win: int) -> dict:
    r = win // 2
    return dict(
        pos=f"SELECT CAST(p AS INTEGER) AS p, CAST(CASE WHEN p < 0 THEN -p WHEN p > 63 THEN 126 - p ELSE p END AS INTEGER) AS q FROM (SELECT unnest(range({-r}, {64 + r})) AS p) u",
        big="SELECT image_id, a.p AS y, b.p AS x, prob FROM image_pixels i JOIN pos a ON a.q = i.y JOIN pos b ON b.q = i.x",
        rs=f"""SELECT image_id, y, x, sum(prob) OVER w AS s, sum(prob * prob) OVER w AS q FROM big
            WINDOW w AS (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)""",
        cs=f"""SELECT image_id, y, x, sum(s) OVER w / {win * win} AS m, sum(q) OVER w / {win * win} AS v FROM rs WHERE x BETWEEN 0 AND 63
            WINDOW w AS (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)""",
        loc="SELECT i.image_id, i.y, i.x, prob, m AS local_mean, sqrt(greatest(v - m * m, 0)) AS local_std FROM image_pixels i JOIN cs ON cs.image_id = i.image_id AND cs.y = i.y AND cs.x = i.x")


NIB = dict(local_sql(13), mask="SELECT image_id, y, x FROM loc WHERE prob > local_mean - CAST(0.2 AS DOUBLE) * local_std")
SAU = dict(local_sql(33), mask="SELECT image_id, y, x FROM loc WHERE prob > local_mean * (1 + CAST(0.2 AS DOUBLE) * (local_std - 1))")
add("box_mean_std", lambda s, d: line_sums(filters.box_mean_std(fx.image_pixels(s, d), "prob", 13, H, W), ["local_mean", "local_std"]),
    sql(line_sums_sql("loc", ["local_mean", "local_std"]), **local_sql(13)))
add("niblack_mask", lambda s, d: line_sums(thresholds.niblack_mask(fx.image_pixels(s, d), H, W).withColumn("one", F.lit(1)), ["one"]),
    sql(line_sums_sql("(SELECT *, 1 AS one FROM mask) q", ["one"]), **NIB))
add("sauvola_mask", lambda s, d: line_sums(thresholds.sauvola_mask(fx.image_pixels(s, d), H, W).withColumn("one", F.lit(1)), ["one"]),
    sql(line_sums_sql("(SELECT *, 1 AS one FROM mask) q", ["one"]), **SAU))


def _opened(base: dict) -> str:
    chain = _chain_sql("ed", 2)
    chain = {k: v.replace(" pred ", " mask ") for k, v in chain.items()}
    return sql(LABELLED, **base, **chain)


add("niblack_thresh", lambda s, d: thresholds.niblack_thresh(fx.image_pixels(s, d), H, W), _opened(NIB))
add("sauvola_thresh", lambda s, d: thresholds.sauvola_thresh(fx.image_pixels(s, d), H, W), _opened(SAU))
CUT = dict(
    span="SELECT image_id, min(prob) AS lo, max(prob) AS hi FROM image_pixels GROUP BY image_id",
    hist="""SELECT i.image_id, CAST(least(floor((prob - lo) / ((hi - lo) / 256)), 255) AS INTEGER) AS b, count(*) AS n
        FROM image_pixels i JOIN span USING (image_id) GROUP BY ALL""",
    bins="SELECT span.*, CAST(k AS INTEGER) AS b, coalesce(n, 0) AS n FROM span CROSS JOIN (SELECT unnest(range(0, 256)) AS k) u LEFT JOIN hist ON hist.image_id = span.image_id AND hist.b = k",
    cuts="""SELECT image_id, lo + (hi - lo) / 256 * (b + CAST(0.5 AS DOUBLE)) + CAST(0.01 AS DOUBLE) AS cut FROM
        (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY dn, b) AS rn FROM
         (SELECT *, lead(n) OVER (PARTITION BY image_id ORDER BY b) - n AS dn FROM bins) a WHERE dn IS NOT NULL) q WHERE rn = 1""")
add("histogram_cut", lambda s, d: rounded(thresholds.histogram_cut(fx.image_pixels(s, d))),
    sql("SELECT image_id, round(cut, 6) AS cut FROM cuts", **CUT))
add("smoothed_thresh", lambda s, d: thresholds.smoothed_thresh(fx.image_pixels(s, d)),
    thresholded("image_pixels JOIN cuts USING (image_id) WHERE prob >= cut", **CUT))


def _with_probs(s, d):
    p = F.col("prob")
    return fx.image_pixels(s, d).select("image_id", "y", "x", "prob", F.array(1 - p, p).alias("inst_probs"),
                                        arrays.one_hot(F.col("pred_cls"), 6, 0.01).alias("type_probs"))


add("threshold_argmax", lambda s, d: thresholds.assemble_maps(_with_probs(s, d), "argmax"),
    sql("SELECT q.image_id, q.y, q.x, inst_id, pred_cls AS type_id FROM (" + LABELLED + ") q JOIN image_pixels i ON i.image_id = q.image_id AND i.y = q.y AND i.x = q.x",
        fg="SELECT image_id, y, x FROM image_pixels WHERE prob > 1 - prob", c=raw(components_sql("c", "fg"))))

# --- normalization ------------------------------------------------------------------------------------------------------


def _chan_sums(df):
    return line_sums(df, ["v"], ("image_id", "channel"))


def _chan_sql(expr: str, **ctes) -> str:
    return sql(line_sums_sql("nv", ["v"], "image_id, channel"), **ctes, nv=f"SELECT image_id, channel, y, x, {expr}")


def _chan(s, d):
    return fx.channels_long(fx.image_pixels(s, d))


PCT = dict(pc="SELECT image_id, channel, quantile_cont(CAST(v AS DOUBLE), 0.01) AS p1, quantile_cont(CAST(v AS DOUBLE), 0.99) AS p99 FROM chan GROUP BY image_id, channel")
add("percentile_normalize", lambda s, d: _chan_sums(normalize.percentile_normalize(_chan(s, d))),
    _chan_sql("(v - p1) / (p99 - p1 + CAST(1e-7 AS DOUBLE)) AS v FROM chan JOIN pc USING (image_id, channel)", **PCT))
add("percentiles", lambda s, d: rounded(normalize.percentiles(fx.image_pixels(s, d), ["image_id"], "prob", {"p1": 0.01, "p37": 0.37, "p99": 0.99}).drop("varies")),
    sql("SELECT image_id, round(quantile_cont(prob, 0.01), 6) AS p1, round(quantile_cont(prob, 0.37), 6) AS p37, round(quantile_cont(prob, 0.99), 6) AS p99 FROM image_pixels GROUP BY image_id"))
CLAMP = "greatest(least(v / (greatest(p99, p1) + CAST({eps} AS DOUBLE)), 1), {lo}) AS v FROM chan JOIN pc USING (image_id, channel)"
add("percentile_clamp", lambda s, d: _chan_sums(normalize.percentile_normalize_and_clamp(_chan(s, d), 0, 1, keys=("image_id", "channel"))),
    _chan_sql(CLAMP.format(eps="1e-7", lo=0), **PCT))
add("percentile_clamp_large_eps", lambda s, d: rounded(normalize.percentile_normalize_and_clamp(
        _chan(s, d), -1, 1, eps=1e7, keys=("image_id", "channel")).groupBy("image_id", "channel").agg(F.sum(F.col("v") * 1e6).alias("v")), 5),
    sql("SELECT image_id, channel, round(sum(v * 1000000), 5) AS v FROM nv GROUP BY image_id, channel", **PCT,
        nv="SELECT image_id, channel, " + CLAMP.format(eps="1e7", lo=-1)))
add("normalize", lambda s, d: _chan_sums(normalize.normalize(_chan(s, d))),
    _chan_sql("(v - avg(v) OVER w) / stddev_pop(v) OVER w AS v FROM chan WINDOW w AS (PARTITION BY image_id, channel)"))
add("normalize_sample", lambda s, d: _chan_sums(normalize.normalize_sample(_chan(s, d))),
    _chan_sql("(v - avg(v) OVER w) / stddev_samp(v) OVER w AS v FROM chan WINDOW w AS (PARTITION BY image_id, channel)"))
add("mean_center", lambda s, d: _chan_sums(normalize.normalize(_chan(s, d), standardize=False)),
    _chan_sql("v - avg(v) OVER w AS v FROM chan WINDOW w AS (PARTITION BY image_id, channel)"))
add("minmax_normalize", lambda s, d: _chan_sums(normalize.minmax_normalize(_chan(s, d))),
    _chan_sql("(CAST(v AS DOUBLE) - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM chan WINDOW w AS (PARTITION BY image_id)"))
add("minmax_normalize_channel", lambda s, d: _chan_sums(normalize.minmax_normalize(_chan(s, d), per_channel=True)),
    _chan_sql("(CAST(v AS DOUBLE) - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS v FROM chan WINDOW w AS (PARTITION BY image_id, channel)"))
MS = dict(ps="SELECT channel, count(*) AS n, sum(v / CAST(255 AS DOUBLE)) AS s, sum((v / CAST(255 AS DOUBLE)) * (v / CAST(255 AS DOUBLE))) AS q FROM chan GROUP BY channel",
          ms="SELECT channel, s / n AS mean, sqrt(q / n - (s / n) * (s / n)) AS std FROM ps")
add("dataset_normalize", lambda s, d: _chan_sums(normalize.dataset_normalize(
        _chan(s, d), stats.dataset_mean_std(stats.patch_stats(_chan(s, d))))),
    _chan_sql("(v - mean * 255) / (std * 255) AS v FROM chan JOIN ms USING (channel)", **MS))
NR = dict(rk="SELECT image_id, channel, v, row_number() OVER (PARTITION BY image_id, channel ORDER BY v) AS k, count(*) OVER (PARTITION BY image_id, channel) AS n FROM chan",
          pn="SELECT image_id, channel, max(v) FILTER (WHERE k = 1 + round_even(CAST(0.01 AS DOUBLE) * (n - 1), 0)) AS p1, max(v) FILTER (WHERE k = 1 + round_even(CAST(0.99 AS DOUBLE) * (n - 1), 0)) AS p99 FROM rk GROUP BY image_id, channel")
add("percentile_nearest", lambda s, d: normalize.percentile_nearest(_chan(s, d), 99),
    sql("SELECT image_id, channel, CAST(p99 AS DOUBLE) AS value FROM pn", **NR))
add("percentile_normalize_nearest", lambda s, d: _chan_sums(normalize.percentile_normalize_nearest(_chan(s, d))),
    _chan_sql("CAST(v - p1 AS DOUBLE) / (p99 - p1) AS v FROM chan JOIN pn USING (image_id, channel)", **NR))
add("float2ubyte", lambda s, d: line_sums(normalize.float2ubyte(
        fx.image_pixels(s, d).select("image_id", "y", "x", (F.col("prob") * 2 - 1).alias("v"))), ["v"]),
    sql(line_sums_sql("q", ["v"]), q="SELECT image_id, y, x, round_even(greatest(least(prob * 2 - 1, 1), 0) * 255, 0) AS v FROM image_pixels"))
add("overlay", lambda s, d: line_sums(normalize.overlay(fx.image_pixels(s, d), fx.true_pixels(s, d)), ["r", "g", "b"]),
    sql(line_sums_sql("q", ["r", "g", "b"]), q="SELECT image_id, y, x, " + ", ".join(f"CASE WHEN true_id > 0 THEN {c} ELSE 0 END AS {c}" for c in "rgb") + " FROM image_pixels"))

# --- filters ------------------------------------------------------------------------------------------------------------


def kernel_sql(kernel) -> str:
    r = len(kernel) // 2
    return "SELECT * FROM (VALUES " + ", ".join(f"({i - r}, {j - r}, CAST({v!r} AS DOUBLE))" for i, row in enumerate(kernel) for j, v in enumerate(row) if v) + ") k(dy, dx, w)"


def conv_sql(src: str, column: str, kernel: str) -> str:
    """Correlation with edge replication: padded cells are sent to the cells they serve."""
    edge = "SELECT p, CAST(greatest(0, least(63, p)) AS INTEGER) AS q FROM (SELECT unnest(range(-3, 67)) AS p) u"
    return f"""SELECT image_id, CAST(y - dy AS INTEGER) AS y, CAST(x - dx AS INTEGER) AS x, sum(w * v) AS v FROM
        (SELECT i.image_id, a.p AS y, b.p AS x, i.{column} AS v FROM {src} i JOIN ({edge}) a ON a.q = i.y JOIN ({edge}) b ON b.q = i.x) big
        CROSS JOIN {kernel} WHERE y - dy BETWEEN 0 AND 63 AND x - dx BETWEEN 0 AND 63 GROUP BY image_id, y - dy, x - dx"""


SH, SV = sobel_hv_kernel(5)
add("filter2d", lambda s, d: line_sums(filters.filter2d(fx.image_pixels(s, d), {"v": ("prob", [[0.0, 1.0, 2.0], [-1.0, 4.0, 1.0], [0.5, 0.0, -3.0]])}, H, W), ["v"]),
    sql(line_sums_sql("cv", ["v"]), k1=kernel_sql([[0.0, 1.0, 2.0], [-1.0, 4.0, 1.0], [0.5, 0.0, -3.0]]), cv=conv_sql("image_pixels", "prob", "k1")))
add("gaussian_filter", lambda s, d: line_sums(filters.filter2d(fx.image_pixels(s, d), {"v": ("prob", (gaussian(7, 1.5), gaussian(7, 1.5)))}, H, W), ["v"]),
    sql(line_sums_sql("cv", ["v"]), k1="""SELECT a.i AS dy, b.i AS dx, a.g * b.g AS w FROM g1 a CROSS JOIN g1 b""".replace("g1", """(SELECT i, exp(-(i * i) / 4.5) /
        sum(exp(-(i * i) / 4.5)) OVER () AS g FROM (SELECT unnest(range(-3, 4)) AS i) u)"""), cv=conv_sql("image_pixels", "prob", "k1")))
add("sobel_hv_filter", lambda s, d: line_sums(filters.filter2d(fx.image_pixels(s, d), {"gh": ("prob", SH), "gv": ("prob", SV)}, H, W), ["gh", "gv"]),
    sql(line_sums_sql("(SELECT a.image_id, a.y, a.x, a.v AS gh, b.v AS gv FROM cv a JOIN cw b USING (image_id, y, x)) q", ["gh", "gv"]),
        off="SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-2, 3)) AS i) a CROSS JOIN (SELECT unnest(range(-2, 3)) AS i) b",
        k1="SELECT dy, dx, dy / (dy * dy + dx * dx + CAST(1e-6 AS DOUBLE)) AS w FROM off", k2="SELECT dy, dx, dx / (dy * dy + dx * dx + CAST(1e-6 AS DOUBLE)) AS w FROM off",
        cv=conv_sql("image_pixels", "prob", "k1"), cw=conv_sql("image_pixels", "prob", "k2")))
add("local_mean", lambda s, d: line_sums(filters.local_mean(fx.image_pixels(s, d), ["prob"], 4, H, W), ["prob"]),
    sql(line_sums_sql("q", ["prob"]), off="SELECT a.i AS dy, b.i AS dx FROM (SELECT unnest(range(-4, 5)) AS i) a CROSS JOIN (SELECT unnest(range(-4, 5)) AS i) b WHERE a.i * a.i + b.i * b.i <= 16",
        ub="SELECT image_id, y, x, CAST(round_even(prob * 255, 0) AS BIGINT) AS v FROM image_pixels",
        q="SELECT image_id, CAST(y - dy AS INTEGER) AS y, CAST(x - dx AS INTEGER) AS x, floor(sum(v) / count(*)) AS prob FROM ub CROSS JOIN off WHERE y - dy BETWEEN 0 AND 63 AND x - dx BETWEEN 0 AND 63 GROUP BY image_id, y - dy, x - dx"))


# --- losses on grids ----------------------------------------------------------------------------------------------------

def _hover_grid(s, d):
    """Offset maps of both sides on the full grid, with the foreground of the truth as focus."""
    from ..operators.instances import hover_maps
    t = hover_maps(fx.true_pixels(s, d)).drop("inst_id")
    p = hover_maps(fx.pred_pixels(s, d)).drop("inst_id").withColumnRenamed("xmap", "xmap_hat").withColumnRenamed("ymap", "ymap_hat")
    g = fx.image_pixels(s, d).select("image_id", "y", "x", (F.col("true_id") > 0).cast("int").alias("focus"))
    on = ["image_id", "y", "x"]
    return g.join(t, on, "left").join(p, on, "left").na.fill(0.0, ["xmap", "ymap", "xmap_hat", "ymap_hat"])


def _hv_sql(src: str) -> str:
    return f"""SELECT image_id, y, x, CASE WHEN ox < 0 THEN ox / -lx WHEN ox > 0 THEN ox / hx ELSE 0 END AS xm,
        CASE WHEN oy < 0 THEN oy / -ly WHEN oy > 0 THEN oy / hy ELSE 0 END AS ym FROM
        (SELECT *, min(ox) OVER w AS lx, max(ox) OVER w AS hx, min(oy) OVER w AS ly, max(oy) OVER w AS hy FROM
         (SELECT *, x + 1 - floor(mx + 0.5) AS ox, y + 1 - floor(my + 0.5) AS oy FROM
          (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, count(*) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY image_id, inst_id)) a
          WHERE n >= 30) b WINDOW w AS (PARTITION BY image_id, inst_id)) c"""


add("gradient_mse", lambda s, d: rounded(losses.gradient_mse(_hover_grid(s, d), H, W)),
    sql("SELECT round(sum(CASE WHEN i.true_id > 0 THEN a.v * a.v + b.v * b.v ELSE 0 END) / sum(2 * greatest(CASE WHEN i.true_id > 0 THEN 1 ELSE 0 END, CAST(1e-6 AS DOUBLE))), 6) AS loss "
        "FROM image_pixels i JOIN cv a USING (image_id, y, x) JOIN cw b USING (image_id, y, x)",
        ht=_hv_sql("truth"), hp=_hv_sql("pred"),
        df="""SELECT i.image_id, i.y, i.x, coalesce(p.xm, 0) - coalesce(t.xm, 0) AS ex, coalesce(p.ym, 0) - coalesce(t.ym, 0) AS ey FROM image_pixels i
            LEFT JOIN ht t USING (image_id, y, x) LEFT JOIN hp p USING (image_id, y, x)""",
        k1=kernel_sql(SH), k2=kernel_sql(SV), cv=conv_sql("df", "ex", "k1"), cw=conv_sql("df", "ey", "k2")))


def _ssim_grid(s, d):
    return fx.image_pixels(s, d).select("image_id", "y", "x", F.col("prob").alias("yhat"), (F.col("true_id") > 0).cast("int").alias("target"))


def _taps_sql(axis: str, src: str) -> str:
    other = "x" if axis == "y" else "y"
    cols = ", ".join(f"sum(w * n.{c}) AS {c}" for c in ("a", "b", "aa", "bb", "ab"))
    return f"""SELECT g.image_id, g.y, g.x, {cols} FROM {src} g CROSS JOIN g11 JOIN {src} n ON n.image_id = g.image_id
        AND n.{axis} = greatest(0, least(63, g.{axis} + i)) AND n.{other} = g.{other} GROUP BY g.image_id, g.y, g.x"""


add("ssim", lambda s, d: rounded(losses.ssim(_ssim_grid(s, d), H, W)),
    sql("""SELECT round(greatest(least(1 - avg(((2 * a * b + CAST(0.0001 AS DOUBLE)) * v1) / ((a * a + b * b + CAST(0.0001 AS DOUBLE)) * v2)), 1), 0) / 2, 6) AS loss,
        round(greatest(least(1 - avg(v1 / v2), 1), 0), 6) AS contrast FROM
        (SELECT a, b, 2 * (ab - a * b) + CAST(0.0009 AS DOUBLE) AS v1, (aa - a * a) + (bb - b * b) + CAST(0.0009 AS DOUBLE) AS v2 FROM f2) q""",
        base="SELECT image_id, y, x, prob AS a, t AS b, prob * prob AS aa, t * t AS bb, prob * t AS ab FROM (SELECT *, CASE WHEN true_id > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS t FROM image_pixels) q",
        g11="SELECT i, exp(-(i * i) / 4.5) / sum(exp(-(i * i) / 4.5)) OVER () AS w FROM (SELECT unnest(range(-5, 6)) AS i) u",
        f1=_taps_sql("x", "base"), f2=_taps_sql("y", "f1")))
add("ms_ssim", lambda s, d: rounded(losses.ms_ssim(_ssim_grid(s, d), H, W)))
