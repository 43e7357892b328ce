import numpy as np
import pytest
from helpers import blobs, label as ref_label, pixels, to_map

from pixelweave.operators import components, graph, instances


def test_golden_small_components(spark):
    m = np.array([[0, 0, 0, 1, 0], [1, 1, 1, 0, 0], [1, 1, 1, 0, 1]])
    px = pixels(spark, [m])
    four = to_map(components.remove_small_components(px, 6).selectExpr("*", "1 as one").collect(), m.shape, "one")
    assert four.tolist() == [[0, 0, 0, 0, 0], [1, 1, 1, 0, 0], [1, 1, 1, 0, 0]]
    eight = to_map(components.remove_small_components(px, 7, connectivity=2).selectExpr("*", "1 as one").collect(), m.shape, "one")
    assert eight.tolist() == [[0, 0, 0, 1, 0], [1, 1, 1, 0, 0], [1, 1, 1, 0, 0]]


@pytest.mark.parametrize("diagonal", [False, True])
def test_label_across_blocks(spark, diagonal):
    rng = np.random.default_rng(5)
    maps = [(rng.random((40, 37)) < p).astype(int) for p in (0.45, 0.6, 0.7)]
    px = pixels(spark, maps)
    for block in (8, 256):
        got = components.label(px, connectivity=2 if diagonal else 1, block=block).collect()
        for k, m in enumerate(maps):
            assert (to_map(got, m.shape, "label", k) == ref_label(m, diagonal)).all()


def test_label_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(6)
    px = pixels(spark, [(rng.random((30, 30)) < 0.6).astype(int)])
    one = sorted(map(tuple, components.label(px.repartition(1), block=8).collect()))
    many = sorted(map(tuple, components.label(px.repartition(8), block=16).collect()))
    assert one == many


def test_spiral_is_one_component(spark):
    n = 17
    m = np.zeros((n, n), int)
    y, x, dy, dx = 0, 0, 0, 1
    m[0, 0] = 1
    while True:
        p, q = y + dy, x + dx
        r, s = y + 2 * dy, x + 2 * dx
        if not (0 <= p < n and 0 <= q < n) or (0 <= r < n and 0 <= s < n and m[r, s]):
            dy, dx = dx, -dy
            p, q, r, s = y + dy, x + dx, y + 2 * dy, x + 2 * dx
            if not (0 <= p < n and 0 <= q < n) or m[p, q] or (0 <= r < n and 0 <= s < n and m[r, s]):
                break
        y, x = p, q
        m[y, x] = 1
    assert ref_label(m).max() == 1
    assert components.label(pixels(spark, [m]), block=4).agg({"label": "max"}).first()[0] == 1


def test_graph_components_with_hub(spark):
    rng = np.random.default_rng(7)
    edges = [(1, 0, i) for i in range(1, 300)] + [(1, int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 400, (300, 2))]
    edges += [(2, i, i + 1) for i in range(0, 90)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for k, a, b in edges:
        if a != b:
            x, y = find((k, a)), find((k, b))
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "image_id int, a bigint, b bigint")
    got = {(r.image_id, r.node): (r.image_id, r.root) for r in graph.graph_components(df).collect()}
    want = {v: find(v) for v in root}
    assert got == want


def test_fix_duplicates_follows_running_maximum(spark):
    m = np.array([[1, 0, 2, 0, 1], [0, 0, 0, 0, 0], [3, 0, 2, 0, 1], [3, 0, 0, 0, 0]])
    got = to_map(instances.fix_duplicates(pixels(spark, [m])).collect(), m.shape)
    # id 1: components 1, 2, 3 -> 1, 2 + 3, 3 + 3; then the maximum is 6; id 2: 2, 2 + 6
    assert got.tolist() == [[1, 0, 2, 0, 5], [0, 0, 0, 0, 0], [3, 0, 8, 0, 6], [3, 0, 0, 0, 0]]


def test_fix_duplicates_random(spark):
    rng = np.random.default_rng(8)
    m = blobs(rng, (40, 40), 14, 12)
    want, top = m.copy(), m.max()
    for i in np.unique(m)[1:]:
        comp = ref_label(m == i)
        want[comp > 1] = comp[comp > 1] + top
        top = max(top, want.max())
    assert (to_map(instances.fix_duplicates(pixels(spark, [m])).collect(), m.shape) == want).all()


def test_remap_is_idempotent(spark):
    m = np.array([[0, 7, 7], [9, 0, 3]])
    once = instances.remap_label(pixels(spark, [m]))
    assert to_map(once.collect(), m.shape).tolist() == [[0, 2, 2], [3, 0, 1]]
    assert sorted(map(tuple, instances.remap_label(once).collect())) == sorted(map(tuple, once.collect()))


def test_fewer_than_two_typed_instances_give_no_types(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 1.0, 3), (0, 2, 5.0, 5.0, None), (1, 1, 1.0, 1.0, 3), (1, 2, 500.0, 5.0, 4), (1, 3, 260.0, 7.0, None)],
                               "image_id int, inst_id int, cx double, cy double, type_id int")
    got = {(r.image_id, r.inst_id): r.type_id for r in instances.nearest_typed_fill(df, cell=4.0).collect()}
    assert got == {(0, 1): 0, (0, 2): 0, (1, 1): 3, (1, 2): 4, (1, 3): 4}


def test_contraction_ends_with_stars(spark, monkeypatch):
    written = []
    add = graph.Stages.add
    monkeypatch.setattr(graph.Stages, "add", lambda self, df: written.append(1) or add(self, df))
    edges = lambda rows: spark.createDataFrame(rows, "image_id int, a long, b long")
    got = {tuple(r) for r in graph.graph_components(edges([(1, 5, 1), (1, 1, 7), (1, 5, 1), (2, 9, 8), (None, 4, 3), (2, None, 8), (2, 6, 6)])).collect()}
    assert got == {(1, 5, 1), (1, 7, 1), (1, 1, 1), (2, 9, 8), (2, 8, 8)}
    assert len(written) == 1  # stars from the start take no round
    written.clear()
    got = {tuple(r) for r in graph.graph_components(edges([(1, 1, 2), (1, 2, 3), (1, 5, 3)])).collect()}
    assert got == {(1, k, 1) for k in (1, 2, 3, 5)} and len(written) % 2 == 1 and len(written) < 7  # no round to see that nothing changes
    assert graph.graph_components(edges([])).count() == 0
