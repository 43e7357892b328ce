"""Images are dealt once, as lines, and what goes by image, line or place stays where it is."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweave import fixtures
from pixelweave.operators import filters, normalize, stats, tiling
from pixelweave.plans.catalog import full_catalog
from pixelweave.session import measured_joins

QUERIES = full_catalog().queries
SIDE = fixtures.SIDE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_the_pixels(df):
    """The part of a plan that works on rows of pixels: all above the first explode along a line."""
    return plan(df).split("Generate explode(sequence(", 1)[0]


@pytest.fixture
def measured(spark):
    measured_joins(spark)
    return spark


@pytest.mark.parametrize("name", ["box_mean_std", "sauvola_mask", "sobel_hv_filter", "gaussian_filter", "ssim", "reflect_pad", "mse"])
def test_pixels_are_not_shuffled(measured, sf_dir, name):
    """Paddings, windows along lines and columns, and sums of lines need no exchange of pixels."""
    above = above_the_pixels(QUERIES[name](measured, sf_dir))
    assert "hashpartitioning(image_id" not in above and "rangepartitioning" not in above


def _tables(spark, tmp_path, suppliers, parts):
    for name, rows, schema in (("supplier", suppliers, "s_suppkey long"), ("part", parts, "p_partkey long, p_size int")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_painted_lines_hold_what_pixels_hold(spark, tmp_path):
    """Repeated and null keys and sizes: lines painted in pieces against a painting pixel by pixel."""
    parts = [(k, 1 + k * 13 % 50) for k in range(75)] + [(7, 3), (7, 3), (8, 44), (None, 5), (9, None)]
    suppliers = [(k,) for k in range(3)] + [(1,), (None,)]
    d = _tables(spark, tmp_path, suppliers, parts)
    n, want = len(suppliers), {}
    for pk, sz in parts:
        if pk is None or sz is None:
            continue
        i, k = pk % n, pk // n
        cls, x0, y0, w, h = 1 + k * 7 % 5, k % 5 * 12 + 1 + sz % 3, k // 5 * 16 + 1 + sz % 4, 4 + sz % 5, 6 + pk % 7
        for dy in range(h):
            for dx in range(w):
                at = want.setdefault((i, y0 + dy, x0 + dx), [0, 0, 0, 0])
                at[0], at[1] = max(at[0], k + 1), max(at[1], cls)
                y, x = y0 + dy + pk % 3 - 1, x0 + dx + sz % 4 - 1
                if pk % 11 and 0 <= y < SIDE and 0 <= x < SIDE:
                    at = want.setdefault((i, y, x), [0, 0, 0, 0])
                    at[2], at[3] = max(at[2], k + 1 + (pk % 17 == 0)), max(at[3], 1 + cls % 5 if pk % 19 == 0 else cls)
    got = [tuple(r) for r in fixtures.pixels(spark, d).select("image_id", "y", "x", *fixtures.VALUES).collect()]
    assert sorted(got) == sorted((*k, *v) for k, v in want.items())
    grid = fixtures.image_pixels(spark, d).select("image_id", "y", "x", *fixtures.VALUES).collect()
    every = [(i, y, x, *(want.get((i, y, x), [0] * 4) if i is not None else [0] * 4)) for (i,) in suppliers for y in range(SIDE) for x in range(SIDE)]
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted((tuple(r) for r in grid), key=key) == sorted(every, key=key)


def test_mirrored_positions_of_any_margin(spark):
    for n, before, after in ((1, 2, 3), (2, 5, 4), (5, 2, 2), (5, 4, 0), (5, 13, 9), (64, 70, 70)):
        got = spark.range(n).select(F.col("id").cast("int").alias("c")).select("c", F.explode(filters.padded_positions(F.col("c"), n, before, after, "reflect")).alias("p"))
        at = np.pad(np.arange(n), (before, after), mode="reflect") if n > 1 else np.zeros(1 + before + after, int)
        assert sorted(map(tuple, got.collect())) == sorted((int(c), k - before) for k, c in enumerate(at))
    text = plan(tiling.reflect_pad(spark.range(8).select(F.col("id").cast("int").alias("y"), F.col("id").cast("int").alias("x")), 8, 8, 3, 3))
    assert "lambdafunction" not in text  # evaluated once a pixel


def test_whole_numbers_take_one_scan_and_no_pixel_is_sorted(measured, sf_dir, monkeypatch):
    """Percentiles of 8-bit images are settled by one count of the pixels; a looked-up percentile needs no sort."""
    staged = []
    add = normalize.Stages.add
    monkeypatch.setattr(normalize.Stages, "add", lambda self, df: staged.append(1) or add(self, df))
    px = fixtures.channels_long(fixtures.image_pixels(measured, sf_dir))
    out = normalize.percentile_normalize(px)
    assert len(staged) == 1
    above = above_the_pixels(out)
    assert "ShuffledHashJoin" in above and "SortMergeJoin" not in above


def test_percentiles_of_crowded_values(spark):
    """Values that differ in their last bits only, signs, zeros, infinities, NaN and null keys."""
    close = [float(np.nextafter(1.0, 2.0)) if k % 3 else 1.0 + k * 1e-15 for k in range(4000)]
    wide = [0.0, -0.0, -1e-320, 5e-324, 1e308, -1e308, float("inf"), float("-inf"), 3.0, 3.0]
    nan = [1.0, float("nan"), 2.0]
    rows = [(0, v) for v in close] + [(1, v) for v in wide] + [(2, v) for v in nan] + [(None, 1.0)]
    df = spark.createDataFrame(pd.DataFrame({"k": pd.array([r[0] for r in rows], dtype="Int32"), "v": [0.0] * len(rows)}).drop(columns="v").assign(i=range(len(rows))))
    df = df.join(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "i long, v double"), "i").repartition(5)
    for q in (0.0, 0.5, 1.0):
        rank = F.bround(F.lit(q) * (F.col("n") - 1)).cast("long")
        got = {r.k: r for r in normalize.order_values(df, ["k"], "v", {"p": (q, rank)}).collect()}
        assert set(got) == {0, 1, 2}
        for k, values in enumerate((close, wide)):
            s = sorted(values)
            assert got[k].p == s[round(q * (len(s) - 1))] and (got[k].n, got[k].least, got[k].largest) == (len(s), s[0], s[-1])
        assert got[2].n == 3 and (np.isnan(got[2].p) if q == 1.0 else got[2].p in (1.0, 2.0))


def test_dataset_statistics_do_not_deal_pixels_by_channel(measured, sf_dir):
    px = fixtures.channels_long(fixtures.image_pixels(measured, sf_dir))
    out = normalize.dataset_normalize(px, stats.dataset_mean_std(stats.patch_stats(px)))
    assert "SortMergeJoin" not in above_the_pixels(out) and "BroadcastHashJoin" in plan(out)


def test_stream_chunks_are_not_dealt_anew(spark, tmp_path):
    from pixelweave.plans import pipelines

    rows = spark.range(100, numPartitions=10).select("id", (F.col("id") % 3).cast("int").alias("channel"), F.lit(1).cast("smallint").alias("v"))
    src = pipelines._chunked(spark, rows)
    q = src.writeStream.format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(q.recentProgress) <= 5 and spark.table("chunks").count() == 100


def test_a_folder_of_features_is_one_file(spark, tmp_path):
    """Rows of a tile that lie in many tasks are written to one file, whole."""
    from pixelweave.sources import geojson

    a = fixtures.ring_annotations(spark, _tables(spark, tmp_path, [(k,) for k in range(4)], [(k, 1 + k % 50) for k in range(80)]))
    rows = a.withColumn("class_name", F.lit("one")).withColumn("tile", F.col("name")).repartition(8)
    geojson.write_geojson(rows, f"{tmp_path}/out", by=("tile",))
    files = spark.read.text(f"{tmp_path}/out").select(F.input_file_name().alias("f"), "tile").groupBy("tile").agg(F.countDistinct("f").alias("files"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) == 4 and all(r.files == 1 and r.n == 20 for r in files)


def test_areas_are_grouped_by_their_spans(measured, sf_dir):
    """Pixels are made once, for the components; rings find theirs by the first pixel of each span."""
    from pixelweave.operators import raster

    groups = raster.touching_groups(fixtures.ring_annotations(measured, sf_dir), ["class_id"], ["name", "feature_id"])
    assert "Generate explode(sequence(" not in plan(groups)
