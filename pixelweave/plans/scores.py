"""Queries of the score tables: benchmark metrics and class-level scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as fx
from ..operators import instances, metrics, spans
from . import benchmark
from .sqlkit import Catalog, rounded, sql

N = fx.SIDE * fx.SIDE
catalog = Catalog()
add = catalog.add

add("overlaps", lambda s, d: metrics.overlaps(fx.pixels(s, d)),
    sql("SELECT image_id, t AS true_id, p AS pred_id, n AS inter FROM joint WHERE t > 0 AND p > 0"))

add("overlaps_spans", lambda s, d: (spans.joint_counts_of_spans(spans.to_spans(fx.true_pixels(s, d)), spans.to_spans(fx.pred_pixels(s, d)))
                                   .filter("t > 0 AND p > 0").selectExpr("image_id", "t AS true_id", "p AS pred_id", "n AS inter")),
    sql("SELECT image_id, t AS true_id, p AS pred_id, n AS inter FROM joint WHERE t > 0 AND p > 0"))

add("pair_iou", lambda s, d: rounded(metrics.pair_iou(fx.pixels(s, d))),
    sql("SELECT image_id, t AS true_id, p AS pred_id, i AS inter, ta AS t_area, pa AS p_area, round(i / u, 6) AS iou FROM ov"))

add("pair_iou_eps", lambda s, d: rounded(metrics.pair_iou(fx.pixels(s, d), eps=metrics.AJI_EPS), 9),
    sql("SELECT image_id, t AS true_id, p AS pred_id, i AS inter, ta AS t_area, pa AS p_area, "
        "round(i / (u + CAST(1e-6 AS DOUBLE)), 9) AS iou FROM ov"))

PQ_SQL = """SELECT n.image_id, tp, nt - tp AS fn, np - tp AS fp, s FROM
 (SELECT image_id, count(DISTINCT CASE WHEN true_id > 0 THEN true_id END) AS nt,
         count(DISTINCT CASE WHEN pred_id > 0 THEN pred_id END) AS np FROM pixels GROUP BY image_id) n
 LEFT JOIN (SELECT image_id, count(*) FILTER (WHERE i / u > 0.5) AS tp, coalesce(sum(i / u) FILTER (WHERE i / u > 0.5), 0) AS s
            FROM ov GROUP BY image_id) m ON m.image_id = n.image_id"""
PQ_COLS = """(tp / (tp + CAST(0.5 AS DOUBLE) * fp + CAST(0.5 AS DOUBLE) * fn + CAST(1e-6 AS DOUBLE))) AS dq,
 s / (tp + CAST(1e-6 AS DOUBLE)) AS sq, tp / (tp + fn + CAST(1e-6 AS DOUBLE)) AS rec, tp / (tp + fp + CAST(1e-6 AS DOUBLE)) AS prec"""

add("pq", lambda s, d: rounded(metrics.pq(fx.pixels(s, d))),
    sql("""SELECT image_id, round(dq * sq, 6) AS "PQ", round(sq, 6) AS "SQ", round(dq, 6) AS "DQ",
        round(rec, 6) AS inst_recall, round(prec, 6) AS inst_precision FROM pqx""",
        pq0=PQ_SQL, pqx=f"SELECT image_id, {PQ_COLS} FROM pq0"))

# below 0.5 a matching decides; checked against brute force in the tests
add("pq_matched", lambda s, d: rounded(metrics.pq(fx.pixels(s, d), match_iou=0.3)))

AJI_CTES = dict(
    best="""SELECT image_id, t, p, i, u FROM (SELECT *, row_number() OVER (PARTITION BY image_id, t
            ORDER BY i / (u + CAST(1e-6 AS DOUBLE)) DESC, p) AS rn FROM ov) q WHERE rn = 1""",
    ajiu="""SELECT image_id, sum(u) AS u, sum(i) AS i FROM (
        SELECT image_id, u, i FROM best UNION ALL
        SELECT image_id, ta, 0 FROM tarea WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.image_id = tarea.image_id AND b.t = tarea.t) UNION ALL
        SELECT image_id, pa, 0 FROM parea WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.image_id = parea.image_id AND b.p = parea.p)) q
        GROUP BY image_id""")

add("aji", lambda s, d: rounded(metrics.aji(fx.pixels(s, d))),
    sql('SELECT image_id, round(CAST(i AS DOUBLE) / CAST(u AS DOUBLE), 6) AS "AJI" FROM ajiu', **AJI_CTES))

add("aji_plus", lambda s, d: rounded(metrics.aji_plus(fx.pixels(s, d))))

DICE_SQL = "SELECT image_id, 2 * sum(i) / (sum(ta + pa) + CAST(1e-6 AS DOUBLE)) AS dice FROM ov GROUP BY image_id"
add("dice2", lambda s, d: rounded(metrics.dice2(fx.pixels(s, d))),
    sql('SELECT image_id, round(dice, 6) AS "DICE2" FROM dc', dc=DICE_SQL))

add("conventional", lambda s, d: rounded(metrics.conventional(fx.image_pixels(s, d))),
    sql("""SELECT image_id, round(dice, 6) AS dice, round(dice / (2 - dice), 6) AS iou, round(tp / (tp + fn), 6) AS sensitivity,
        round(tn / (tn + fp), 6) AS specificity FROM (SELECT *, 2 * tp / (2 * tp + fp + fn) AS dice FROM (
        SELECT image_id, count(*) FILTER (WHERE true_id > 0 AND pred_id > 0) AS tp,
          count(*) FILTER (WHERE (true_id > 0) = (pred_id > 0)) AS tn,
          count(*) FILTER (WHERE true_id = 0 AND pred_id > 0) AS fp, count(*) FILTER (WHERE true_id > 0 AND pred_id = 0) AS fn
        FROM image_pixels GROUP BY image_id) a) b"""))

VI_CTES = dict(
    gj="SELECT image_id, true_id AS t, pred_id AS p, count(*) AS n FROM image_pixels GROUP BY image_id, true_id, pred_id",
    vi="""SELECT image_id, -sum(n / 4096 * log2(n / nt)) AS splits, -sum(n / 4096 * log2(n / np)) AS merges FROM
        (SELECT *, sum(n) OVER (PARTITION BY image_id, t) AS nt, sum(n) OVER (PARTITION BY image_id, p) AS np FROM gj) q
        GROUP BY image_id""")
add("split_merge", lambda s, d: rounded(metrics.split_merge(fx.pixels(s, d), N)),
    sql("SELECT image_id, round(splits, 6) AS splits, round(merges, 6) AS merges FROM vi", **VI_CTES))

SCORES_CTES = dict(pq0=PQ_SQL, pqx=f"SELECT image_id, {PQ_COLS} FROM pq0", **AJI_CTES, dc=DICE_SQL, **VI_CTES,
                   scores="""SELECT pqx.image_id, i / u AS "AJI", dice AS "DICE2", dq * sq AS "PQ", sq AS "SQ", dq AS "DQ",
                   rec AS inst_recall, prec AS inst_precision, splits, merges
                   FROM pqx JOIN ajiu ON pqx.image_id = ajiu.image_id JOIN dc ON dc.image_id = pqx.image_id
                   JOIN vi ON vi.image_id = pqx.image_id WHERE EXISTS (SELECT 1 FROM tarea WHERE tarea.image_id = pqx.image_id)""")
SCORE_NAMES = [c for c in metrics.SCORE_COLUMNS if c != "AJI_plus"]
SCORE_COLS = ", ".join(f'round("{c}", 6) AS "{c}"' for c in SCORE_NAMES)

add("compute_metrics", lambda s, d: rounded(metrics.compute_metrics(fx.pixels(s, d), N).drop("AJI_plus")),
    sql(f"SELECT image_id, {SCORE_COLS} FROM scores", **SCORES_CTES))


def _named(df):
    """Sample names as the benchmark sees them: tissue-like prefix and image number."""
    return df.withColumn("name", F.concat(F.when(F.col("image_id") % 2 == 0, "even_").otherwise("odd_"), F.col("image_id").cast("string")))


NAME_SQL = "concat(CASE WHEN image_id % 2 = 0 THEN 'even_' ELSE 'odd_' END, CAST(image_id AS VARCHAR))"
AVG_COLS = ", ".join(f'avg("{c}") AS "{c}"' for c in SCORE_NAMES)
ALL_COLS = ", ".join(f'"{c}"' for c in SCORE_NAMES)
BENCH = dict(SCORES_CTES, named=f"SELECT {NAME_SQL} AS name, {ALL_COLS} FROM scores",
             rows0=f"SELECT name, {ALL_COLS} FROM named UNION ALL SELECT 'averages_for_the_set', {AVG_COLS} FROM named")


def _sides(s, d):
    px = _named(fx.pixels(s, d))
    pred = px.filter("pred_id > 0").select("name", "y", "x", F.col("pred_id").alias("inst_id"), F.col("pred_cls").alias("type_id"))
    true = px.filter("true_id > 0").select("name", "y", "x", F.col("true_id").alias("inst_id"), F.col("true_cls").alias("type_id"))
    return pred, true


add("benchmark_insts", lambda s, d: rounded(benchmark.benchmark_insts(*_sides(s, d), N).drop("AJI_plus")),
    sql(f"SELECT name, {SCORE_COLS} FROM rows0", **BENCH))

add("pattern_avgs", lambda s, d: rounded(benchmark.pattern_avgs(
        benchmark.benchmark_insts(*_sides(s, d), N), ["even", "odd_", "^averages", "_1$"]).drop("AJI_plus")),
    sql(f"""SELECT name, {SCORE_COLS} FROM (SELECT name, {ALL_COLS} FROM rows0 UNION ALL
        SELECT concat(pat, '_avg'), {AVG_COLS} FROM rows0 JOIN (SELECT unnest(['even', 'odd_', '^averages', '_1$']) AS pat) q
        ON regexp_matches(name, pat) GROUP BY pat) z""", **BENCH))

# string patterns over page addresses: mean html length per pattern
add("pattern_match_pages", lambda s, d: rounded(benchmark.pattern_avgs(
        fx.table(s, d, "pages").select(F.col("url").alias("name"), F.length("html").cast("double").alias("n_html")),
        ["https", "example", r"/\d+", "org"]).groupBy("name").agg(F.sum("n_html").alias("n_html"), F.count(F.lit(1)).alias("n"))),
    sql(r"""SELECT name, round(sum(n_html), 6) AS n_html, count(*) AS n FROM (
        SELECT url AS name, CAST(length(html) AS DOUBLE) AS n_html FROM pages UNION ALL
        SELECT concat(pat, '_avg'), avg(CAST(length(html) AS DOUBLE)) FROM pages
        JOIN (SELECT unnest(['https', 'example', '/\d+', 'org']) AS pat) q ON regexp_matches(url, pat) GROUP BY pat) z GROUP BY name"""))

PT = "SELECT c.cls AS class_id, image_id, y, x, CASE WHEN true_cls = c.cls THEN true_id ELSE 0 END AS true_id, " \
     "CASE WHEN pred_cls = c.cls THEN pred_id ELSE 0 END AS pred_id FROM pixels JOIN " \
     "(SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS cls) c ON c.cls = true_cls OR c.cls = pred_cls"


def _per_type_sql() -> str:
    """Per-class scores: the same chain with the class as a second key."""
    k = "class_id, image_id"
    jn = lambda a, b: f"{a}.class_id = {b}.class_id AND {a}.image_id = {b}.image_id"
    ctes = dict(
        pt=PT,
        cj=f"SELECT {k}, true_id AS t, pred_id AS p, count(*) AS n FROM pt GROUP BY {k}, true_id, pred_id",
        ct=f"SELECT {k}, true_id AS t, count(*) AS ta FROM pt WHERE true_id > 0 GROUP BY {k}, true_id",
        cp=f"SELECT {k}, pred_id AS p, count(*) AS pa FROM pt WHERE pred_id > 0 GROUP BY {k}, pred_id",
        co=f"SELECT cj.class_id, cj.image_id, cj.t, cj.p, n AS i, ta, pa, ta + pa - n AS u FROM cj JOIN ct ON {jn('cj', 'ct')} AND ct.t = cj.t JOIN cp ON {jn('cj', 'cp')} AND cp.p = cj.p",
        cn=f"""SELECT {k}, count(DISTINCT CASE WHEN true_id > 0 THEN true_id END) AS nt,
            count(DISTINCT CASE WHEN pred_id > 0 THEN pred_id END) AS np FROM pt GROUP BY {k}""",
        cm=f"SELECT {k}, count(*) FILTER (WHERE i / u > 0.5) AS tp, coalesce(sum(i / u) FILTER (WHERE i / u > 0.5), 0) AS s, "
           f"2 * sum(i) / (sum(ta + pa) + CAST(1e-6 AS DOUBLE)) AS dice FROM co GROUP BY {k}",
        cb=f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}, t ORDER BY i / (u + CAST(1e-6 AS DOUBLE)) DESC, p) AS rn FROM co) q WHERE rn = 1",
        cu=f"""SELECT {k}, sum(u) AS u, sum(i) AS i FROM (SELECT {k}, u, i FROM cb UNION ALL
            SELECT {k}, ta, 0 FROM ct WHERE NOT EXISTS (SELECT 1 FROM cb WHERE {jn('cb', 'ct')} AND cb.t = ct.t) UNION ALL
            SELECT {k}, pa, 0 FROM cp WHERE NOT EXISTS (SELECT 1 FROM cb WHERE {jn('cb', 'cp')} AND cb.p = cp.p)) q GROUP BY {k}""",
        cg=f"SELECT {k}, t, p, n FROM cj WHERE t > 0 OR p > 0 UNION ALL SELECT {k}, 0, 0, 4096 - sum(n) FILTER (WHERE t > 0 OR p > 0) FROM cj GROUP BY {k}",
        cv=f"""SELECT {k}, -sum(n / 4096 * log2(n / nt)) AS splits, -sum(n / 4096 * log2(n / np)) AS merges FROM
            (SELECT *, sum(n) OVER (PARTITION BY {k}, t) AS nt, sum(n) OVER (PARTITION BY {k}, p) AS np FROM cg) q GROUP BY {k}""",
        c0=f"SELECT cn.class_id, cn.image_id, nt, coalesce(tp, 0) AS tp, nt - coalesce(tp, 0) AS fn, np - coalesce(tp, 0) AS fp, "
           f"coalesce(s, 0) AS s, coalesce(dice, 0) AS dice FROM cn LEFT JOIN cm ON {jn('cn', 'cm')}",
        csc=f"""SELECT x.class_id, {NAME_SQL.replace('image_id', 'x.image_id')} AS name, i / u AS "AJI", dice AS "DICE2",
            dq * sq AS "PQ", sq AS "SQ", dq AS "DQ", rec AS inst_recall, prec AS inst_precision, splits, merges
            FROM (SELECT *, {PQ_COLS} FROM c0) x JOIN cu ON {jn('cu', 'x')} JOIN cv ON {jn('cv', 'x')} WHERE nt > 0""",
        cn2="SELECT unnest(range(1, 6)) AS class_id, unnest(['neoplastic', 'inflammatory', 'connective', 'dead', 'epithelial']) AS class_name")
    body = f"""SELECT class_name, name, {SCORE_COLS} FROM (SELECT class_name, name, {ALL_COLS} FROM csc JOIN cn2 ON cn2.class_id = csc.class_id
        UNION ALL SELECT class_name, concat(class_name, '_avg_for_the_set'), {AVG_COLS} FROM csc JOIN cn2 ON cn2.class_id = csc.class_id
        GROUP BY class_name) z"""
    return sql(body, **ctes)


add("benchmark_per_type", lambda s, d: rounded(benchmark.benchmark_per_type(
        *_sides(s, d), instances.CLASS_DICTIONARIES["pannuke"], N).drop("AJI_plus")), _per_type_sql())


# --- class-level scores over the derived logits ----------------------------------------------------------------------

def _classified(s, d):
    from ..functions.arrays import argmax
    return fx.logits(s, d).select("sample", "target", argmax(F.col("scores")).alias("pred"),
                                  (F.col("sample") % 3).alias("batch"))


CM_CTES = dict(
    hits="SELECT sample, target, pred, count(*) AS n FROM (SELECT vec_id, sample, target, c AS pred, "
         "row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS rn FROM lg) q WHERE rn = 1 GROUP BY sample, target, pred",
    cells="SELECT s.sample, p.c AS pred, t.c AS target, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample FROM hits) s "
          "CROSS JOIN (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS c) p CROSS JOIN (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS c) t "
          "LEFT JOIN hits h ON h.sample = s.sample AND h.pred = p.c AND h.target = t.c",
    ious="""SELECT a.sample, a.c AS class_id, (d + CAST(1e-7 AS DOUBLE)) / (r + q - d + CAST(1e-7 AS DOUBLE)) AS iou FROM
       (SELECT sample, pred AS c, sum(n) AS r, sum(n) FILTER (WHERE pred = target) AS d FROM cells GROUP BY sample, pred) a
       JOIN (SELECT sample, target AS c, sum(n) AS q FROM cells GROUP BY sample, target) b ON a.sample = b.sample AND a.c = b.c""")

add("confusion_matrix", lambda s, d: metrics.confusion_matrix(_classified(s, d), fx.N_CLASSES),
    sql("SELECT sample, pred, target, n FROM cells", **CM_CTES))
add("class_iou", lambda s, d: rounded(metrics.class_iou(metrics.confusion_matrix(_classified(s, d), fx.N_CLASSES))),
    sql("SELECT sample, class_id, round(iou, 6) AS iou FROM ious", **CM_CTES))
add("accuracy", lambda s, d: rounded(metrics.accuracy(metrics.confusion_matrix(_classified(s, d), fx.N_CLASSES))),
    sql("SELECT round(sum((n + CAST(1e-7 AS DOUBLE)) / (tot + CAST(1e-7 AS DOUBLE))), 6) AS accuracy FROM "
        "(SELECT *, sum(n) OVER () AS tot FROM cells) q WHERE pred = target", **CM_CTES))
add("metric_mean", lambda s, d: rounded(metrics.metric_mean(_classified(s, d), n_classes=fx.N_CLASSES)),
    sql("""SELECT round(avg(acc), 6) AS accuracy, round(avg(miou), 6) AS miou, count(*) AS n_batches FROM
        (SELECT sample % 3 AS b, avg(iou) AS miou FROM ious GROUP BY sample % 3) a JOIN
        (SELECT b, sum((n + CAST(1e-7 AS DOUBLE)) / (tot + CAST(1e-7 AS DOUBLE))) AS acc FROM
          (SELECT *, sample % 3 AS b, sum(n) OVER (PARTITION BY sample % 3) AS tot FROM cells) q WHERE pred = target GROUP BY b) c
        ON a.b = c.b""", **CM_CTES))


def _epoch_log(s, d):
    e = fx.table(s, d, "events")
    v = F.col("value")
    return e.select(F.col("event_type").alias("phase"), (F.col("event_id") % 5).cast("int").alias("epoch"),
                    (v / (v + 1)).alias("accuracy"), (v / (v + 2)).alias("miou"), v.alias("loss"))


add("epoch_means", lambda s, d: rounded(metrics.epoch_means(_epoch_log(s, d))),
    "SELECT event_type AS phase, CAST(event_id % 5 AS INTEGER) AS epoch, round(avg(value / (value + 1)), 6) AS accuracy, "
    "round(avg(value / (value + 2)), 6) AS miou, round(avg(value), 6) AS loss FROM events GROUP BY event_type, event_id % 5")
