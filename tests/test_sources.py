import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import annotations, tiling
from pixelweave.sources import geojson, images, tables


def png(rgb: np.ndarray) -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w, _ = rgb.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in rgb.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_scan_images(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3))
    (tmp_path / "b.png").write_bytes(png(rgb))
    (tmp_path / "a.png").write_bytes(png(rgb[::-1]))
    assert [r.name for r in images.scan_images(spark, str(tmp_path)).collect()] == ["a.png", "b.png"]
    got = np.zeros_like(rgb)
    for r in images.scan_pixels(spark, str(tmp_path), "b*").collect():
        got[r.y, r.x] = (r.r, r.g, r.b)
    assert (got == rgb).all()
    (tmp_path / "c.txt").write_text("no image")
    with pytest.raises(Exception, match="not an image"):
        images.scan_images(spark, str(tmp_path)).collect()


def test_geojson_array_file_with_all_geometries(spark, tmp_path):
    def feature(kind, coords):
        return ('{"type":"Feature","id":"x","geometry":{"type":"%s","coordinates":%s},"properties":{"isLocked":"false",'
                '"measurements":[],"classification":{"name":"dead"}}}' % (kind, coords))

    square = "[[0,0],[0,4],[4,4],[4,0],[0,0]]"
    items = [feature("Polygon", f"[{square}]"), feature("MultiPolygon", f"[[{square}],[[[9,9],[9,12],[12,12],[9,9]]]]"),
             feature("LineString", "[[0,0],[0,3],[3,3]]"), feature("Polygon", "[[]]"), feature("Polygon", "[[[1,1],[2,2],[1,1]]]")]
    (tmp_path / "t_x-0_y-0.json").write_text("[" + ",".join(items) + "]")
    (tmp_path / "t_x-64_y-0.json").write_text("[]")
    rows = geojson.scan_geojson(spark, str(tmp_path)).collect()
    assert sorted((r.xmin, r.ymin, r.xmax, r.ymax) for r in rows) == [(0, 0, 4, 4), (0, 0, 5, 5), (0, 0, 5, 5), (9, 9, 13, 13)]
    assert {r.class_name for r in rows} == {"dead"} and {r["name"] for r in rows} == {"t_x-0_y-0.json"}


def test_holes_survive_scan_raster_and_export(spark, tmp_path):
    from pixelweave.operators import raster

    def feature(kind, coords):
        return '{"type":"Feature","id":"x","geometry":{"type":"%s","coordinates":%s},"properties":{"classification":{"name":"dead"}}}' % (kind, coords)

    def box(a, b):
        return f"[[{a},{a}],[{a},{b}],[{b},{b}],[{b},{a}]]"  # left open

    items = [feature("Polygon", f"[{box(0, 10)},{box(2, 5)},{box(6, 9)},[],[[1,1],[2,2],[1,1]]]"), feature("MultiPolygon", f"[[{box(20, 24)}],[{box(30, 36)},{box(31, 34)}]]"), feature("LineString", box(40, 43))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t_x-100_y-0.json").write_text("[" + ",".join(items) + "]")
    got = geojson.scan_geojson(spark, str(tmp_path / "in")).cache()
    assert {(r.xmin, len(r.holes)) for r in got.collect()} == {(0, 2), (20, 0), (30, 1), (40, 0)}
    inside = lambda v, a, b: a <= v <= b
    solid = {(a, y, x) for a, b in ((0, 10), (20, 24), (30, 36), (40, 43)) for y in range(a, b + 1) for x in range(a, b + 1)}
    want = {(k, y, x) for k, y, x in solid if not any(inside(y, a + 1, b - 1) and inside(x, a + 1, b - 1) for a, b in ((2, 5), (6, 9), (31, 34)))}
    assert {(r.xmin, r.y, r.x) for r in raster.rasterize(got, ["xmin"]).collect()} == want
    moved = annotations.offset(got)
    assert {(r.xmin, r.y, r.x) for r in raster.rasterize(moved, ["xmin"]).collect()} == {(k, y, x + 100) for k, y, x in want}
    geojson.write_geojson(got, str(tmp_path / "out"))
    again = geojson.scan_geojson(spark, str(tmp_path / "out"), lines=True)
    assert {(r.xmin, r.y, r.x) for r in raster.rasterize(again, ["xmin"]).collect()} == want


def test_bad_names_pairs_and_keys_fail(spark):
    df = spark.createDataFrame([("tile_1.json",)], "name string")
    with pytest.raises(Exception, match="x-<int>_y-<int>"):
        annotations.parse_tile_xy(df).collect()
    a, b = spark.createDataFrame([(1,), (2,)], "name int"), spark.createDataFrame([(1,)], "name int")
    with pytest.raises(Exception, match="no partner"):
        tables.pair(a, b).collect()
    with pytest.raises(KeyError):
        tables.scan_masks(spark, "/nowhere", "unknown")


def test_stitching_restores_the_image(spark):
    rows = [(0, y, x, y * 31 + x) for y in range(20) for x in range(27)]
    g = spark.createDataFrame(rows, "image_id int, y int, x int, v int")
    p = tiling.extract_patches(g, 20, 27, (8, 8), 4, (12, 12))
    want = sorted(r[1:] for r in rows)
    assert sorted((r.y, r.x, r.v) for r in tiling.stitch_crop(p, 20, 27, (8, 8), 4, (12, 12)).collect()) == want
    assert sorted((r.y, r.x, int(r.v)) for r in tiling.stitch_mean(p, 20, 27, (8, 8), 4, ["v"], (12, 12)).collect()) == want


def test_random_crop_is_stable(spark):
    g = spark.range(900).select(F.lit(0).alias("image_id"), F.floor(F.col("id") / 30).cast("int").alias("y"), (F.col("id") % 30).cast("int").alias("x"))
    once = sorted(map(tuple, tiling.random_crop(g, 30, 30, 8, 9, seed=3).collect()))
    assert len(once) == 72 and once == sorted(map(tuple, tiling.random_crop(g.repartition(5), 30, 30, 8, 9, seed=3).collect()))


def test_overwriting_patches_drops_earlier_loads(spark, tmp_path):
    from pixelweave.sources import tables

    row = spark.createDataFrame([("train", 0, 0, 0, 0, 1, 2, 3, 0, 0, 0)], "split string, image_id int, patch_id int, py int, px int, r int, g int, b int, inst_id int, type_id int, sem_id int")
    path, meta = str(tmp_path / "set"), {"stride": 80, "patch_shape": (4, 4), "classes": {"a": 1}, "sem_classes": {"b": 2}}
    tables.write_patches(row, path, meta)
    tables.append_patches(row, path, stride=7)
    assert tables.dataset_metadata(spark, path).first().stride == 80
    tables.write_patches(row, path, meta)
    assert spark.read.parquet(f"{path}/patches").count() == 1
    assert tables.dataset_metadata(spark, path).first().n_items == 1
