"""The spanning forest flood against a plain priority queue."""

import heapq

import numpy as np
import pytest
from helpers import pixels, to_map

from pixelweave.operators import forest


def queue_flood(mask, elev, mark, tie=None):
    tie = np.zeros_like(elev) if tie is None else tie
    key = lambda p: (elev[p], tie[p], *p)
    near = lambda p: [q for q in ((p[0], p[1] + 1), (p[0], p[1] - 1), (p[0] + 1, p[1]), (p[0] - 1, p[1]))
                      if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q]]
    out = np.where(mask, mark, 0)
    edge = lambda p, q: (max(key(p), key(q)), min(key(p), key(q)), q, out[p])
    heap = [edge(p, q) for p in zip(*map(np.ndarray.tolist, np.nonzero(out))) for q in near(p) if not out[q]]
    heapq.heapify(heap)
    while heap:
        *_, p, label = heapq.heappop(heap)
        if not out[p]:
            out[p] = label
            for q in near(p):
                if not out[q]:
                    heapq.heappush(heap, edge(p, q))
    return out


def case(rng, shape, steps, some=0.02):
    mask = rng.random(shape) < 0.8
    elev = rng.integers(0, steps, shape).astype(float) if steps else rng.normal(size=shape)
    mark = np.where(rng.random(shape) < some, rng.integers(1, 30, shape), 0)
    return mask, elev, mark


def flooded(spark, cases, block, ties=None):
    dense = lambda maps, name: pixels(spark, maps, name, dense=True)
    on = ["image_id", "y", "x"]
    m = pixels(spark, [c[0].astype(int) for c in cases], "one").join(dense([c[1] for c in cases], "elevation"), on)
    if ties:
        m = m.join(dense(ties, "tie"), on)
    return forest.flood_forest(m, pixels(spark, [c[2] for c in cases], "marker"), block=block).collect()


@pytest.mark.parametrize("block", [3, 5, 256])
def test_equals_a_queue(spark, block):
    rng = np.random.default_rng(41)
    cases = [case(rng, (37, 50), 0), case(rng, (64, 21), 3), case(rng, (9, 70), 1, 0.1), case(rng, (50, 50), 8, 0.002), (np.ones((20, 20), bool), np.zeros((20, 20)), np.zeros((20, 20), int))]
    got = flooded(spark, cases, block)
    for k, c in enumerate(cases):
        assert (to_map(got, c[0].shape, image=k) == queue_flood(*c)).all(), k


def test_ties_advance_evenly(spark):
    """On a plateau with the distance to the markers as tie, every pixel goes to its nearest marker."""
    mask, elev, mark = np.ones((12, 40), bool), np.zeros((12, 40)), np.zeros((12, 40), int)
    mark[6, 3], mark[6, 30] = 2, 1
    yy, xx = np.mgrid[:12, :40]
    one, two = np.hypot(yy - 6, xx - 30), np.hypot(yy - 6, xx - 3)
    got = to_map(flooded(spark, [(mask, elev, mark)], 8, [np.minimum(one, two)]), mask.shape)
    apart = np.abs(one - two) > 1.5
    assert (got[apart] == np.where(one < two, 1, 2)[apart]).all() and (got > 0).all()


def test_ramp_through_many_blocks(spark):
    """A spiral corridor makes paths far longer than the image; markers at both ends."""
    mask, elev = np.zeros((41, 41), bool), np.zeros((41, 41))
    mask[::2] = True
    mask[1::4, -1] = mask[3::4, 0] = True
    elev[:] = np.arange(41)[:, None] + np.arange(41)[None] / 100
    mark = np.zeros(mask.shape, int)
    mark[0, 0], mark[-1, 0 if mask[-2, 0] else -1] = 7, 9
    got = to_map(flooded(spark, [(mask, elev, mark)], 4), mask.shape)
    assert (got == queue_flood(mask, elev, mark)).all() and (got[mask] > 0).all()


def test_exchanges_do_not_follow_the_image(spark, monkeypatch):
    """Levels grow with the logarithm of the side: 3 at 16 and 64 blocks of side 2 would be 1 and 3 merges."""
    seen = []
    inner = forest._square_solver
    monkeypatch.setattr(forest, "_square_solver", lambda keys, side, whole: seen.append(side) or inner(keys, side, whole))
    for size, sides in ((8, [8]), (32, [8, 32]), (33, [8, 32, 128])):
        seen.clear()
        c = (np.ones((size, 3), bool), np.zeros((size, 3)), np.eye(size, 3, dtype=int))
        assert (to_map(flooded(spark, [c], 2), c[0].shape) == queue_flood(*c)).all()
        assert seen == sides


def test_nothing(spark):
    m = spark.createDataFrame([], "image_id int, y int, x int, elevation double")
    k = spark.createDataFrame([(0, 0, 0, 1)], "image_id int, y int, x int, marker int")
    assert forest.flood_forest(m, k).count() == 0
