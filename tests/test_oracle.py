"""Queries against their SQL twins at the smallest scale; set PIXELWEAVE_ALL=1 to run every pair."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402
from pixelweave.plans.catalog import full_catalog  # noqa: E402

CATALOG = full_catalog()
SOME = ("pq", "aji", "pattern_avgs", "confusion_matrix", "label", "fix_duplicates", "majority_type", "opening_once", "hover_maps", "niblack_mask",
        "percentile_normalize", "local_mean", "ssim", "focal_loss", "stitch_mean", "rigid_transform", "auto_range_1", "split_pairs", "rasterize",
        "outline", "distance_map", "stream_stats")
NAMES = sorted(CATALOG.oracle) if os.environ.get("PIXELWEAVE_ALL") else SOME


@pytest.fixture(scope="module")
def con(sf_dir):
    return check.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, sf_dir, name):
    line = check.check(spark, con, sf_dir, name, CATALOG.queries[name], CATALOG.oracle[name])
    assert line.startswith("OK"), line


def test_every_twin_has_a_query():
    assert set(CATALOG.oracle) <= set(CATALOG.queries)
