"""Several slides in one table give what each slide gives by itself."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from pixelweave.operators import annotations as an
from pixelweave.plans import merge

TILE = (64, 64)
# slide, tile, feature, class, x0, y0, x1, y1 (inclusive); both slides have tiles of the same names
BOXES = [("a", (0, 0), 1, 1, 50, 10, 63, 20), ("a", (64, 0), 1, 1, 64, 12, 70, 18), ("b", (64, 0), 2, 2, 64, 10, 75, 22),
         ("b", (0, 0), 3, 2, 5, 5, 9, 9), ("a", (0, 0), 4, 2, 20, 50, 30, 63), ("b", (0, 64), 4, 2, 22, 64, 28, 70), ("b", (0, 0), 5, 2, 25, 55, 27, 63)]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(s, f"s_x-{t[0]}_y-{t[1]}", f, c, [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
            for s, t, f, c, x0, y0, x1, y1 in BOXES]
    df = spark.createDataFrame(rows, "slide string, name string, feature_id int, class_id int, ring array<struct<x:double,y:double>>")
    return an.bounds(df)


def plain(rows, **more):
    return [repr(sorted((r.asDict(True) | more).items())) for r in rows]


@pytest.mark.parametrize("job", [
    lambda d, by: merge.merge_cells(d, TILE, smooth=False, by=by),
    lambda d, by: merge.merge_split_cells(d, TILE, radius=2, by=by),
    lambda d, by: merge.area_groups(d, by=by)])
def test_by_slide(cells, job):
    want = [x for s in "ab" for x in plain(job(cells.filter(F.col("slide") == s).drop("slide"), ()).collect(), slide=s)]
    assert want and Counter(plain(job(cells, ("slide",)).collect())) == Counter(want)


def test_slides_do_not_mix(cells):
    mixed, apart = (merge.split_pairs(cells, TILE, by).count() for by in ((), ("slide",)))
    assert (mixed, apart) == (4, 2)


def test_section_of_each_slide(spark):
    rows = [(s, y) for s, ys in (("a", (0, 1, 5, 6, 7)), ("b", (2, 3, 4, 9)), ("c", (1, 8)), (None, (4, 5, 6, 20))) for y in ys]
    got = an.auto_range(spark.createDataFrame(rows, "slide string, y int"), "y", 0, 3, 1, by=("slide",)).collect()
    assert Counter((r.slide, r.y) for r in got) == Counter([("a", 5), ("a", 6), ("a", 7), ("b", 2), ("b", 3), ("b", 4), ("c", 1), ("c", 8), (None, 4), (None, 5), (None, 6)])
