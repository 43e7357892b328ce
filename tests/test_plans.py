"""How plans are laid out: joins by measured sizes, rows multiplied over all tasks."""

import pytest

from pixelweave import fixtures
from pixelweave.operators import instances, raster
from pixelweave.plans.catalog import full_catalog
from pixelweave.session import ESTIMATED, MEASURED

QUERIES = full_catalog().queries


@pytest.fixture
def estimating(spark):
    """The session as Spark has it by default: joins broadcast by estimate."""
    before = {k: spark.conf.get(k, None) for k in (ESTIMATED, MEASURED)}
    spark.conf.set(ESTIMATED, "10MB")
    spark.conf.unset(MEASURED)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def first_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["overlay", "center_crop", "histogram_cut", "conventional", "gradient_mse"])
def test_no_join_is_broadcast_by_an_estimate(estimating, sf_dir, name):
    plan = first_plan(QUERIES[name](estimating, sf_dir))
    assert "Join" in plan and "Broadcast" not in plan
    assert estimating.conf.get(MEASURED) == "10MB"


@pytest.mark.parametrize("name", [
    "dataset_mean_std", "distance_map", "explode_parts", "export_annotations", "filter2d", "finalize_types", "float2ubyte", "flood", "flood_forest",
    "follow_flows", "gaussian_filter", "label_sem_map", "local_mean", "merge_areas", "minmax_normalize", "mse", "naive_step", "naive_thresh_prob"])
def test_nothing_is_collected_for_a_broadcast_by_an_estimate(estimating, sf_dir, name):
    """Among the joins of the last plan, staged tables included, which a file's size makes look small."""
    assert "BroadcastExchange" not in first_plan(QUERIES[name](estimating, sf_dir))


@pytest.mark.parametrize("make", [fixtures.pixels, fixtures.image_pixels])
def test_pixels_are_made_after_the_rows_are_dealt(spark, sf_dir, make):
    """The explode along a line stands above an exchange of a given count, which adaptive execution keeps."""
    assert "REPARTITION_BY_NUM" in first_plan(make(spark, sf_dir)).split("Generate explode", 1)[1]


def test_rasterized_pixels_are_not_shuffled(spark, sf_dir):
    """The pixels of a row are made where its spans are, and nothing is dealt anew above."""
    rings = fixtures.ring_annotations(spark, sf_dir)
    above, below = first_plan(raster.rasterize(rings, ["name", "feature_id"])).split("Generate explode", 1)
    assert "Exchange" not in above and "REPARTITION_BY_NUM" in below


def test_free_pixels_of_boxes(spark):
    """Gaps between runs, at both ends of a line and bare lines, as the whole boxes less their objects, which are not built."""
    cells = [(1, 0, 2), (1, 0, 3), (1, 2, 0), (1, 2, 4), (1, 2, 5), (1, 3, 1), (2, 5, 5), (None, 0, 0), (None, 1, 1), (3, 0, 0), (3, 4, 0)]
    obj = spark.createDataFrame(cells, "inst_id int, y int, x int")
    box = instances.bounding_box(obj, ["inst_id"])
    got = instances._gaps(obj, box, ["inst_id"])
    want = set()
    for i in {c[0] for c in cells}:
        ys, xs = [c[1] for c in cells if c[0] == i], [c[2] for c in cells if c[0] == i]
        want |= {(i, y, x) for y in range(min(ys), max(ys) + 1) for x in range(min(xs), max(xs) + 1) if i is None or (i, y, x) not in cells}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
