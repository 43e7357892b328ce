"""Area cleaning, flooding, flows, distances and outlines against plain dense references."""

import numpy as np
from helpers import blobs, label, padded_box, pixels, to_map
from pyspark.sql import functions as F

from pixelweave.operators import areas, distance, flood, flows, instances, morphology, raster


def ref_area_debris(m, min_size):
    res = m.copy()
    for c in [v for v in np.unique(m) if v]:
        comp = label(res == c)
        for i in range(1, comp.max() + 1):
            own = comp == i
            if own.sum() >= min_size:
                continue
            res[own] = 0
            y1, y2, x1, x2 = padded_box(own, m.shape)
            v, n = np.unique(res[y1:y2, x1:x2], return_counts=True)
            v, n = v[v > 0], n[v > 0]
            res[own] = v[np.argmax(n)] if len(v) else 0
    return res


def ref_fill_holes(m, min_size):
    res = m.copy()
    comp = label(m == 0)
    for i in range(1, comp.max() + 1):
        y1, y2, x1, x2 = padded_box(comp == i, m.shape)
        crop = res[y1:y2, x1:x2]
        v, n = np.unique(crop[crop > 0], return_counts=True)
        if (crop == 0).sum() > min_size or not len(v):
            continue
        crop[crop == 0] = v[np.argmax(n)]
    return res


def test_area_debris_keeps_the_sequential_order(spark):
    rng = np.random.default_rng(21)
    for k in range(2):
        m = rng.integers(0, 3, (7, 8)) if k else blobs(rng, (24, 24), 9, 8) % 4
        got = areas.remove_area_debris(pixels(spark, [m], "sem_id"), *m.shape, 9).collect()
        assert (to_map(got, m.shape, "sem_id") == ref_area_debris(m, 9)).all()


def test_fill_holes_keeps_the_sequential_order(spark):
    rng = np.random.default_rng(22)
    for k in range(2):
        m = (rng.random((14, 16)) < (0.9, 0.94)[k]) * rng.integers(1, 4, (14, 16))
        got = areas.fill_holes(pixels(spark, [m], "sem_id", dense=True), *m.shape, 6).collect()
        assert (to_map(got, m.shape, "sem_id") == ref_fill_holes(m, 6)).all()


def test_fill_holes_looks_at_large_components(spark):
    rng = np.random.default_rng(23)
    changed = 0
    for _ in range(4):
        m = (rng.random((10, 10)) < 0.75) * rng.integers(1, 3, (10, 10))
        got = areas.fill_holes(pixels(spark, [m], "sem_id", dense=True), *m.shape, 8).collect()
        assert (to_map(got, m.shape, "sem_id") == ref_fill_holes(m, 8)).all()
        changed += (ref_fill_holes(m, 8) != m).any()
    assert changed


def ref_flood(mask, elev, mark):
    """Levels by repeated relaxation, then ids by repeated minimum over steps that reach a pixel at its level."""
    cells = [(int(y), int(x)) for y, x in zip(*np.nonzero(mask))]
    level = {p: elev[p] if mark[p] else np.inf for p in cells}
    near = {p: [q for q in ((p[0], p[1] + 1), (p[0], p[1] - 1), (p[0] + 1, p[1]), (p[0] - 1, p[1])) if q in level] for p in cells}
    for _ in cells:
        for p in cells:
            if not mark[p]:
                level[p] = min([level[p]] + [max(level[q], elev[p]) for q in near[p]])
    ids = {p: mark[p] if mark[p] else np.inf for p in cells}
    for _ in cells:
        for p in cells:
            if not mark[p]:
                ids[p] = min([ids[p]] + [ids[q] for q in near[p] if max(level[q], elev[p]) == level[p]])
    out = np.zeros(mask.shape, int)
    for p, v in ids.items():
        out[p] = v if np.isfinite(v) else 0
    return out


def test_flood_within_and_across_blocks(spark):
    rng = np.random.default_rng(23)
    mask = rng.random((17, 16)) < 0.8
    elev = rng.integers(0, 6, mask.shape).astype(float)
    mark = np.where((rng.random(mask.shape) < 0.03) & mask, rng.integers(1, 9, mask.shape), 0)
    want = ref_flood(mask, elev, mark)
    m = pixels(spark, [mask.astype(int)], "one").join(pixels(spark, [elev], "elevation", dense=True), ["image_id", "y", "x"])
    k = pixels(spark, [mark], "marker")
    for block in (6, 256):
        got = flood.flood(m, k, block=block).collect()
        assert (to_map(got, mask.shape) == want).all()


def ref_follow(fy, fx, niter):
    h, w = fy.shape
    pad = np.zeros((2, h + 4, w + 4))
    pad[0, 2:-2, 2:-2], pad[1, 2:-2, 2:-2] = fy, fx
    out = {}
    for y in range(h):
        for x in range(w):
            p = np.array([y, x], float)
            for _ in range(niter if abs(fx[y, x]) > 1e-3 else 0):
                s = p * [h / (h - 1), w / (w - 1)] - 0.5
                i, j = np.floor(s).astype(int)
                a, b = s - [i, j]
                q = pad[:, i + 2:i + 4, j + 2:j + 4]
                step = (q * np.outer([1 - a, a], [1 - b, b])).sum((1, 2))
                p = np.clip(p - step, 0, [h - 1, w - 1])
            out[y, x] = p
    return out


def test_follow_flows_within_and_across_blocks(spark):
    rng = np.random.default_rng(24)
    fy, fx = rng.normal(0, 0.6, (2, 15, 17))
    fx[rng.random(fx.shape) < 0.2] = 0.0
    want = ref_follow(fy, fx, 25)
    px = pixels(spark, [fy], "fy", dense=True).join(pixels(spark, [fx], "fx", dense=True), ["image_id", "y", "x"])
    for block in (5, 256):
        got = {(r.y, r.x): (r.py, r.px) for r in flows.follow_flows(px, 15, 17, 25, block=block).collect()}
        assert len(got) == len(want)
        assert max(np.abs(np.array(got[k]) - v).max() for k, v in want.items()) < 1e-6


def ref_sinks(fg, ey, ex):
    hgt, wid = fg.shape
    yy, xx = np.mgrid[0:hgt, 0:wid]
    ey, ex = np.where(fg, ey, yy), np.where(fg, ex, xx)
    h = np.zeros((hgt + 40, wid + 40), int)
    np.add.at(h, (ey + 20, ex + 20), 1)
    top = np.array([[h[max(0, y - 2):y + 3, max(0, x - 2):x + 3].max() for x in range(h.shape[1])] for y in range(h.shape[0])])
    own = np.zeros(h.shape, int)
    for k, (y, x) in enumerate(zip(*np.nonzero((h == top) & (h > 10)))):
        reach = {(y, x)}
        for _ in range(5):
            reach = {(a + i, b + j) for a, b in reach for i in (-1, 0, 1) for j in (-1, 0, 1) if h[a + i, b + j] > 2}
        for p in reach:
            own[p] = k + 1
    m = own[ey + 20, ex + 20]
    return np.searchsorted(np.unique(np.append(m, 0)), m)


def test_sink_masks(spark):
    rng = np.random.default_rng(25)
    fg = rng.random((24, 24)) < 0.7
    cy, cx = np.array([4, 5, 15, 18]), np.array([4, 12, 6, 18])
    yy, xx = np.mgrid[0:24, 0:24]
    near = np.argmin((yy[..., None] - cy) ** 2 + (xx[..., None] - cx) ** 2, axis=2)
    ey = np.clip(cy[near] + rng.integers(-1, 2, fg.shape), 0, 23)
    ex = np.clip(cx[near] + rng.integers(-1, 2, fg.shape), 0, 23)
    rows = [(0, int(y), int(x), float(ey[y, x]) + 0.3, float(ex[y, x]) + 0.6) for y, x in zip(*np.nonzero(fg))]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, py double, px double")
    got = to_map(flows.sink_masks(df, 24, 24).collect(), fg.shape)
    assert got.max() > 2 and (got == ref_sinks(fg, ey, ex)).all()


def test_weight_map_on_free_shapes(spark):
    m = blobs(np.random.default_rng(26), (70, 75), 9, 14)
    ids = np.unique(m)[1:]
    yy, xx = np.mgrid[0:70, 0:75]
    d = np.sort([np.sqrt(np.min([(yy - a) ** 2 + (xx - b) ** 2 for a, b in zip(*np.nonzero(m == i))], axis=0)) for i in ids], axis=0)
    want = np.where(m > 0, 0, 10 * np.exp(-((d[0] + d[1]) / 5) ** 2 / 2))
    got = np.zeros(m.shape)
    for r in distance.weight_map(pixels(spark, [m, (m == ids[0]).astype(int)]), 70, 75).collect():
        assert r.image_id == 0           # one instance only: no weights
        got[r.y, r.x] = r.weight
    assert np.abs(got - want).max() < 1e-12


def test_distance_map_and_limit(spark):
    m = np.zeros((9, 40), int)
    m[2, 3] = m[7, 30] = 1
    g = pixels(spark, [m], "v", dense=True).withColumn("t", F.col("v") > 0)
    got = {(r.y, r.x): r.distance for r in distance.distance_map(g, "t").collect()}
    assert abs(got[0, 0] - np.hypot(2, 3)) < 1e-12 and abs(got[8, 20] - np.hypot(1, 10)) < 1e-12
    near = {(r.y, r.x): r.distance for r in distance.distance_map(g, "t", rmax=4).collect()}
    assert near[2, 5] == 2 and near[0, 20] is None


def test_outline_corners(spark):
    m = np.zeros((8, 8), int)
    m[1:6, 1:3] = 1
    m[4:6, 3:6] = 1                      # an L
    m[7, 2:7] = 2                        # a line: no outline
    m[0, 6], m[1, 5:8], m[2, 6] = 3, 3, 3  # a plus
    got = {r.inst_id: [(int(p.x), int(p.y)) for p in r.ring] for r in raster.outline(pixels(spark, [m])).collect()}
    assert got[1] == [(1, 1), (1, 5), (5, 5), (5, 4), (3, 4), (2, 3), (2, 1), (1, 1)]
    assert 2 not in got
    assert got[3] == [(6, 0), (5, 1), (6, 2), (7, 1), (6, 0)]


def test_outline_and_rasterize_are_inverse(spark):
    """Objects that are convex on the grid come back from their outline, also when traced far from the origin."""
    m = np.zeros((30, 30), int)
    yy, xx = np.mgrid[0:30, 0:30]
    m[(yy - 9) ** 2 + (xx - 9) ** 2 <= 30] = 1
    m[(np.abs(yy - 22) + np.abs(xx - 20)) <= 6] = 2
    rings = raster.outline(pixels(spark, [m]), x_off=1000, y_off=500)
    back = raster.rasterize(rings, ["image_id", "inst_id"], 1000, 500).collect()
    assert (to_map(back, m.shape) == m).all()


def test_holes_and_enclosed_objects(spark):
    m = np.zeros((9, 9), int)
    m[1:8, 1:8] = 1
    m[3:6, 3:6] = 0
    m[4, 4] = 2
    full = instances.fill_object_holes(pixels(spark, [m]).filter("inst_id = 1")).count()
    assert full == 49
    got = to_map(instances.fill_and_remove_small(pixels(spark, [m]), 1).collect(), m.shape)
    assert (got[1:8, 1:8] == 1).all() and got.sum() == 49


def test_outside_never_erodes(spark):
    m = np.ones((6, 6), int)
    assert morphology.remove_1px_boundary(pixels(spark, [m]), 6, 6).count() == 36
    m[0, 0] = 0
    assert morphology.remove_1px_boundary(pixels(spark, [m]), 6, 6).count() == 33


def test_lower_envelope_is_the_minimum():
    rng = np.random.default_rng(31)
    for n, m in ((1, 1), (40, 17), (97, 5)):
        for some in (0.0, 0.05, 0.6, 1.0):
            g = np.where(rng.random((n, m)) < some, rng.integers(0, 60, (n, m)) ** 2, np.inf).astype(float)
            y = np.arange(n)
            want = ((y[:, None] - y[None]) ** 2)[:, :, None] + g[None]
            assert (distance.lower_envelope(g) == want.min(1)).all()
