import itertools

import numpy as np
import pytest
from helpers import blobs
from pyspark.sql import functions as F

from pixelweave.operators import matching, metrics
from pixelweave.operators.matching import assign
from pixelweave.plans import benchmark


def table(spark, pairs):
    rows = []
    for k, (t, p) in enumerate(pairs):
        for y, x in zip(*np.nonzero((t > 0) | (p > 0))):
            rows.append((k, int(y), int(x), int(t[y, x]), int(p[y, x])))
    return spark.createDataFrame(rows, "image_id int, y int, x int, true_id int, pred_id int")


def dense(t, p, eps):
    ts, ps = np.unique(t)[1:], np.unique(p)[1:]
    inter = np.array([[((t == a) & (p == b)).sum() for b in ps] for a in ts], float)
    union = np.array([[((t == a) | (p == b)).sum() for b in ps] for a in ts], float)
    return ts, ps, inter, union, np.where(inter > 0, inter / (union + eps), 0.0)


def best_matching(w):
    """Optimal assignment by dynamic programming over subsets of columns."""
    best = {0: (0.0, ())}
    for i in range(w.shape[0]):
        new = dict(best)
        for used, (v, pairs) in best.items():
            for j in range(w.shape[1]):
                if w[i, j] > 0 and not used >> j & 1:
                    cand = (v + w[i, j], pairs + ((i, j),))
                    if cand[0] > new.get(used | 1 << j, (-1.0,))[0]:
                        new[used | 1 << j] = cand
        best = new
    return max(best.values(), key=lambda c: c[0])


def ref_aji_plus(t, p):
    ts, ps, inter, union, w = dense(t, p, 1e-6)
    _, pairs = best_matching(w)
    rest_t, rest_p = set(range(len(ts))) - {i for i, _ in pairs}, set(range(len(ps))) - {j for _, j in pairs}
    u = sum(union[i, j] for i, j in pairs) + sum((t == ts[i]).sum() for i in rest_t) + sum((p == ps[j]).sum() for j in rest_p)
    return sum(inter[i, j] for i, j in pairs) / u


def cases():
    rng = np.random.default_rng(11)
    out = []
    for k in range(6):
        t = blobs(rng, (30, 30), 9, 12)
        p = np.roll(t, (k % 3, 2), (0, 1)) if k < 3 else blobs(rng, (30, 30), 9, 12)
        out.append((t, p))
    return out


def matched(w):
    """Pairs of a dense matrix of whole numbers by the sparse solver, with its proof checked."""
    edges = [(i, j, int(w[i, j])) for i, j in zip(*np.nonzero(w))]
    partner, u, v = assign(edges, *w.shape)
    total = sum(int(w[i, j]) for i, j in enumerate(partner) if j >= 0)
    assert total == sum(u) + sum(v) and min([*u, *v], default=0) >= 0 and all(u[i] + v[j] >= x for i, j, x in edges)
    assert len({j for j in partner if j >= 0}) == sum(j >= 0 for j in partner)
    return total


def test_assign_matches_exhaustive_search():
    rng = np.random.default_rng(12)
    for _ in range(200):
        w = (rng.random(rng.integers(1, 6, 2)) * 50).astype(int) * (rng.random() < 0.8)
        small, large = sorted(w.shape)
        m = w if w.shape[0] <= w.shape[1] else w.T
        assert matched(w) == max(sum(m[i, c[i]] for i in range(small)) for c in itertools.permutations(range(large), small))
    for _ in range(20):  # larger ones: the dual prices are the proof
        w = rng.integers(0, 9, (40, 35)) * (rng.random((40, 35)) < 0.15)
        matched(w)


def chain(weights):
    """Largest total of edges of a path of which no two are neighbours."""
    take, skip = 0, 0
    for w in weights:
        take, skip = skip + w, max(skip, take)
    return max(take, skip)


@pytest.mark.parametrize("top", [3, 10 ** 9])
def test_chain_of_overlaps_ends(top):
    weights = np.random.default_rng(13).integers(1, top, 100_000).tolist()
    edges = [((k + 1) // 2, k // 2, w) for k, w in enumerate(weights)]
    partner, u, v = assign(edges, 50_001, 50_000)
    by = {(a, b): w for a, b, w in edges}
    assert sum(by[a, b] for a, b in enumerate(partner) if b >= 0) == sum(u) + sum(v) == chain(weights)


def test_best_assignment_of_a_chain(spark):
    weights = [1 + (7 * k) % 11 for k in range(3000)]
    rows = [(0, (k + 1) // 2, k // 2, w / 12) for k, w in enumerate(weights)] + [(1, 5, 5, 0.5), (1, 6, 6, 0.0)]
    got = matching.best_assignment(spark.createDataFrame(rows, "image_id int, t int, p int, w double")).collect()
    by = {(i, a, b): w for i, a, b, w in rows}
    assert len({(r.image_id, r.t) for r in got}) == len({(r.image_id, r.p) for r in got}) == len(got)
    assert abs(sum(by[0, r.t, r.p] for r in got if r.image_id == 0) - chain(weights) / 12) < 1e-9
    assert [(r.t, r.p) for r in got if r.image_id == 1] == [(5, 5)]


def test_aji_plus_against_exhaustive_matching(spark):
    pairs = cases()
    got = {r.image_id: r.AJI_plus for r in metrics.aji_plus(table(spark, pairs)).collect()}
    for k, (t, p) in enumerate(pairs):
        assert abs(got[k] - ref_aji_plus(t, p)) < 1e-9


def test_pq_below_half_matches_first(spark):
    pairs = cases()
    got = {r.image_id: r for r in metrics.pq(table(spark, pairs), match_iou=0.2).collect()}
    for k, (t, p) in enumerate(pairs):
        ts, ps, _, _, w = dense(t, p, 0.0)
        chosen = [w[i, j] for i, j in best_matching(w)[1] if w[i, j] > 0.2]
        tp, fp, fn = len(chosen), len(ps) - len(chosen), len(ts) - len(chosen)
        dq, sq = tp / (tp + fp / 2 + fn / 2 + 1e-6), sum(chosen) / (tp + 1e-6)
        assert abs(got[k].PQ - dq * sq) < 1e-6 and abs(got[k].inst_recall - tp / (tp + fn + 1e-6)) < 1e-9


def test_cycle_of_equal_overlaps_is_solved(spark):
    """A closed chain of equal overlaps, which no local rule can settle."""
    t, p = np.zeros((2, 40), int), np.zeros((2, 40), int)
    for i in range(10):
        t[:, 4 * i:4 * i + 4] = i + 1
        p[:, (4 * i + 2 + np.arange(4)) % 40] = i + 1
    got = metrics.aji_plus(table(spark, [(t, p)])).first().AJI_plus
    assert abs(got - ref_aji_plus(t, p)) < 1e-9


def test_identical_masks(spark):
    t = blobs(np.random.default_rng(3), (30, 30), 6, 9)
    r = metrics.compute_metrics(table(spark, [(t, t)]), 900).first()
    assert abs(r.AJI - 1) < 1e-9 and abs(r.AJI_plus - 1) < 1e-9 and abs(r.PQ - 1) < 1e-5
    assert abs(r.splits) < 1e-9 and abs(r.merges) < 1e-9


def test_iou_limit_is_strict_and_known_values(spark):
    t, p = np.zeros((4, 4), int), np.zeros((4, 4), int)
    t[0, 0:3], p[0, 1:4] = 1, 1          # IoU 2 / 4
    t[2, 0:2], p[2, 0:2] = 2, 5          # IoU 1; ids need not be contiguous
    r = metrics.compute_metrics(table(spark, [(t, p)]), 16).first()
    assert abs(r.DQ - 1 / (1 + 0.5 + 0.5 + 1e-6)) < 1e-9 and abs(r.AJI - 4 / 6) < 1e-9
    assert abs(r.DICE2 - 2 * 4 / (10 + 1e-6)) < 1e-9


def test_empty_truth_yields_no_row(spark):
    z, p = np.zeros((4, 4), int), np.ones((4, 4), int)
    t = np.eye(4, dtype=int)
    got = metrics.compute_metrics(table(spark, [(z, p), (t, p * 0)]), 16).collect()
    assert [r.image_id for r in got] == [1] and got[0].PQ == 0 and got[0].AJI == 0


def test_key_sets_must_match(spark):
    import pytest
    a = spark.createDataFrame([("a",), ("b",)], "name string")
    b = spark.createDataFrame([("a",), ("c",)], "name string")
    px = spark.createDataFrame([("a", 0, 0, 1, 1)], "name string, y int, x int, inst_id int, type_id int")
    with pytest.raises(ValueError):
        benchmark.benchmark_insts(px, px, 16, names=(a, b))


def test_pattern_rows_include_the_average_row(spark):
    s = spark.createDataFrame([("a_1", 1.0), ("b_1", 3.0), ("averages_for_the_set", 2.0)], "name string, PQ double")
    got = {r.name: r.PQ for r in benchmark.pattern_avgs(s, ["a", "_1"]).collect()}
    assert got["_1_avg"] == 2.0 and got["a_avg"] == 1.5


def test_per_type_ignores_other_classes(spark):
    rows = [("i", 0, x, 1, 1) for x in range(4)] + [("i", 2, x, 2, 2) for x in range(4)]
    px = spark.createDataFrame(rows, "name string, y int, x int, inst_id int, type_id int")
    other = px.withColumn("type_id", F.lit(1))
    got = {(r.class_name, r["name"]): r.PQ for r in benchmark.benchmark_per_type(other, px, {"bg": 0, "one": 1, "two": 2}, 16).collect()}
    assert abs(got["two", "i"]) < 1e-9 and 0.6 < got["one", "i"] < 0.7 and ("two", "two_avg_for_the_set") in got


def test_blank_images_do_not_stop_the_job(spark):
    from pyspark.sql import functions as F

    from pixelweave.operators import normalize, thresholds

    grid = spark.createDataFrame([(i, y, x, 1 if i and x else 0, 1 if i and y else 0) for i in (0, 1) for y in range(4) for x in range(4)], "image_id int, y int, x int, true_id int, pred_id int")
    got = {r.image_id: r for r in metrics.conventional(grid).collect()}
    assert got[0].dice is None and got[0].sensitivity is None and got[0].specificity == 1.0
    assert got[1].dice == 2 * 9 / (2 * 9 + 3 + 3)
    px = spark.createDataFrame([(i, 0, y, x, float(i * (x + 4 * y)) + 3) for i in (0, 1) for y in range(4) for x in range(4)], "image_id int, channel int, y int, x int, v double")
    for fn in (normalize.normalize_sample, normalize.percentile_normalize_nearest, lambda d: normalize.minmax_normalize(d, per_channel=True)):
        rows = {r.image_id: r for r in fn(px).groupBy("image_id").agg(F.count("v").alias("n"), F.max("v").alias("hi")).collect()}
        assert rows[0].n == 0 and rows[1].n == 16
    cuts = {r.image_id: r.cut for r in thresholds.histogram_cut(px.withColumnRenamed("v", "prob")).collect()}
    assert abs(cuts[0] - 3.01) < 1e-9 and cuts[1] > 3
