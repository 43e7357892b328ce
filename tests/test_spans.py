"""Spans against pixels: components, overlaps, morphology."""

import numpy as np
import pytest
from helpers import blobs, pixels

from pixelweave.functions.kernels import disk, ellipse
from pixelweave.operators import components, metrics, morphology, spans

RNG = np.random.default_rng(51)
MAPS = [blobs(RNG, (150, 90), 30, 25), (RNG.random((70, 131)) < 0.6) * RNG.integers(1, 3, (70, 131)), np.zeros((4, 4), int), np.ones((65, 3), int)]


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_round_trip(spark):
    px = pixels(spark, MAPS)
    s = spans.to_spans(px)
    assert rows(spans.to_pixels(s), "image_id", "inst_id", "y", "x") == rows(px, "image_id", "inst_id", "y", "x")
    assert rows(spans.to_spans(px.union(px)), *s.columns) == rows(s, *s.columns)
    by_line = sum(int(np.count_nonzero(np.diff(m, axis=1, prepend=0) * (m > 0))) for m in MAPS)
    assert s.count() == by_line


@pytest.mark.parametrize("connectivity", [1, 2])
@pytest.mark.parametrize("layer", [[], ["inst_id"]])
def test_components(spark, connectivity, layer):
    px = pixels(spark, MAPS)
    keys = ["image_id", *layer]
    want = components.label(px, layer=layer or None, connectivity=connectivity, min_size=3, block=32)
    s = spans.to_spans(px, keys)
    got = spans.label_spans(s, layer=layer, connectivity=connectivity, min_size=3)
    assert rows(spans.to_pixels(got, [*keys, "label"]), *keys, "y", "x", "label") == rows(want, *keys, "y", "x", "label")


def test_overlaps(spark):
    other = [np.roll(m, 3, axis=1) * (RNG.random(m.shape) < 0.9) for m in MAPS]
    a, b = pixels(spark, MAPS, "true_id"), pixels(spark, other, "pred_id")
    want = metrics.joint_counts(a.join(b, ["image_id", "y", "x"], "full"))
    named = lambda df, c: spans.to_spans(df.withColumnRenamed(c, "inst_id"))
    got = spans.joint_counts_of_spans(named(a, "true_id"), named(b, "pred_id"))
    assert got.dtypes == want.dtypes
    assert rows(got, *got.columns) == rows(want, *got.columns)
    assert spans.joint_counts_of_spans(named(a, "true_id"), named(b, "pred_id").limit(0)).count() == metrics.joint_counts(a.selectExpr("*", "0 AS pred_id")).count()


def dense(m, op, offsets):
    h, w = m.shape
    out = np.zeros(m.shape, bool)
    for y in range(h):
        for x in range(w):
            cells = [m[y + a, x + b] for a, b in offsets if 0 <= y + a < h and 0 <= x + b < w]
            out[y, x] = any(cells) if op == "dilate" else all(cells)
    return out


@pytest.mark.parametrize("element", [disk(1), disk(4), ellipse(5), [(0, 0), (0, 1), (1, 0)], [(-1, 0), (0, 0), (0, 1), (0, 2)]])
@pytest.mark.parametrize("op", ["dilate", "erode"])
def test_morphology_of_mixed_sizes(spark, monkeypatch, op, element):
    """Blocks smaller than the element's reach, images of different sizes, the size in columns."""
    monkeypatch.setattr(morphology, "BLOCK", 7)
    maps = [RNG.random((23, 31)) < 0.7, RNG.random((9, 12)) < 0.5, np.ones((8, 20), bool), np.ones((1, 5), bool)]
    px = pixels(spark, [m.astype(int) for m in maps]).join(
        spark.createDataFrame([(k, *m.shape) for k, m in enumerate(maps)], "image_id int, h int, w int"), "image_id")
    got = rows(morphology.morph(px, op, element, "h", "w"), "image_id", "y", "x")
    assert got == sorted((k, int(y), int(x)) for k, m in enumerate(maps) for y, x in zip(*np.nonzero(dense(m, op, element))))


def test_chains_and_contours_by_instance(spark, monkeypatch):
    monkeypatch.setattr(morphology, "BLOCK", 9)
    m = blobs(RNG, (40, 33), 12, 14)
    el = ellipse(5)
    one = m > 0
    for op in ("erode", "erode", "dilate", "dilate"):
        one = dense(one, op, el)
    got = rows(morphology.open_pixels(pixels(spark, [m]), 40, 33), "y", "x")
    assert got == sorted(map(tuple, np.argwhere(one).tolist()))
    rim = np.zeros(m.shape, bool)
    for i in np.unique(m[m > 0]):
        rim |= dense(m == i, "dilate", disk(2)) & ~dense(m == i, "erode", disk(2))
    assert rows(morphology.contours(pixels(spark, [m]), 40, 33, 2), "y", "x") == sorted(map(tuple, np.argwhere(rim).tolist()))


def test_sent_rows_do_not_follow_the_radius(spark):
    px = pixels(spark, [np.ones((64, 64), int)])
    plan = morphology.close_with_disk(px, 10, 64, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("explode") == 2
    assert morphology.close_with_disk(px, 10, 64, 64).count() == 64 * 64
