"""Polygon annotations of tiles: bounds, edges, neighbours and geometry tests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import ring_edges

# Fixed value: how a tile carries its coordinates in its name.
TILE_PATTERN = r"x-(\d+)_y-(\d+)"
DEFAULT_TILE = (1000, 1000)


def parse_tile_xy(df: DataFrame, name: str = "name", x: str = "x", y: str = "y") -> DataFrame:
    """Tile coordinates from the first match in the name; a name without them fails."""
    def part(i: int) -> Column:
        got = F.regexp_extract(name, TILE_PATTERN, i)
        return F.when(got == "", F.raise_error(F.concat(F.lit("no x-<int>_y-<int> in "), F.col(name)))).otherwise(got).cast("int")

    return df.withColumn(x, part(1)).withColumn(y, part(2))


def sample_key(name: str) -> Column:
    """The name without its last four characters, whatever the suffix is."""
    return F.expr(f"substr({name}, 1, length({name}) - 4)")


def order_tiles(df: DataFrame, by: str = "name") -> DataFrame:
    return df.orderBy("name") if by == "name" else df.orderBy("y", "name")


def filter_tiles(df: DataFrame, xmax: int | None = None, ymax: int | None = None, auto_range: bool = False) -> DataFrame:
    out = df if xmax is None else df.filter(F.col("x") <= xmax)
    return out if ymax is None or auto_range else out.filter(F.col("y") <= ymax)


def auto_range(df: DataFrame, coord: str = "y", section_ix: int = 0, section_length: int = 6000, tile: int = 1000, by: tuple[str, ...] = ()) -> DataFrame:
    """Tiles of one tissue section: the `section_ix`-th run of coordinates exactly one tile apart that is long enough.

    If no run qualifies all tiles stay. `by` names the columns of the slide; each slide has sections of its own. The distinct
    coordinates of one axis of a slide, one row per tile row, are all a window sees.
    """
    from pyspark.sql import Window
    order = Window.partitionBy(*by).orderBy(coord)
    c = df.select(*by, coord).distinct().withColumn("_new", F.coalesce((F.col(coord) - F.lag(coord).over(order) != tile).cast("int"), F.lit(0)))
    runs = (c.withColumn("_run", F.sum("_new").over(order)).groupBy(*by, "_run")
            .agg(F.min(coord).alias("lo"), F.max(coord).alias("hi"), F.count(F.lit(1)).alias("n")))
    ranked = (runs.filter(F.col("n") >= section_length // tile).withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("lo")) - 1)
              .filter(F.col("_k") == section_ix))
    span = runs.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    pick = (ranked.select(*by, "lo", "hi", F.lit(0).alias("p")).unionByName(span.withColumn("p", F.lit(1)))
            .groupBy(*by).agg(F.min(F.struct("p", "lo", "hi")).alias("m")))
    if by:
        limits = pick.select(*[F.col(k).alias(f"_by{i}") for i, k in enumerate(by)], "m")
        here = [df[k].eqNullSafe(F.col(f"_by{i}")) for i, k in enumerate(by)]
        return df.join(limits, here).filter((F.col(coord) >= F.col("m.lo")) & (F.col(coord) <= F.col("m.hi"))).select(*[df[x] for x in df.columns])
    lo, hi = pick.select("m.lo").scalar(), pick.select("m.hi").scalar()
    return df.filter((F.col(coord) >= lo) & (F.col(coord) <= hi))


def bounds(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Integer bounds with exclusive maxima."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return (df.withColumn("xmin", F.array_min(xs).cast("int")).withColumn("ymin", F.array_min(ys).cast("int"))
            .withColumn("xmax", F.array_max(xs).cast("int") + 1).withColumn("ymax", F.array_max(ys).cast("int") + 1))


def _sides(tile: tuple[int, int]) -> dict[str, Column]:
    tx, ty = F.col("tile_x"), F.col("tile_y")
    return {"right": F.col("xmax") == tx + tile[0], "left": F.col("xmin") == tx,
            "bottom": F.col("ymax") == ty + tile[1], "top": F.col("ymin") == ty}


def with_tile(df: DataFrame, name: str = "name") -> DataFrame:
    return parse_tile_xy(df, name, "tile_x", "tile_y")


def non_border(df: DataFrame, tile: tuple[int, int] = DEFAULT_TILE) -> DataFrame:
    """Annotations whose bounds touch none of the four tile edges."""
    s = _sides(tile)
    return df.filter(~s["right"] & ~s["left"] & ~s["bottom"] & ~s["top"])


def shift_ring(ring: Column, dx, dy) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def _shifted(df: DataFrame, ring: str, dx: Column, dy: Column) -> DataFrame:
    """The ring and, where there are any, its holes moved."""
    out = df.withColumn(ring, shift_ring(F.col(ring), dx, dy))
    return out.withColumn("holes", F.transform("holes", lambda r: shift_ring(r, dx, dy))) if "holes" in df.columns else out


def _sided(df: DataFrame, cases: dict[str, tuple[Column, int, int]]) -> DataFrame:
    """One row per side an annotation touches, with its ring shifted; a single pass over the annotations."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("side"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")))
                                     for n, (c, dx, dy) in cases.items()]))
    out = df.withColumn("_s", F.explode(hits)).withColumn("side", F.col("_s.side"))
    return _shifted(out, "ring", F.col("_s.dx"), F.col("_s.dy")).drop("_s")


def edge(df: DataFrame, tile: tuple[int, int] = DEFAULT_TILE) -> DataFrame:
    """Annotations per tile edge; rings on the right and bottom edge move one unit outwards."""
    s = _sides(tile)
    return _sided(df, {"right": (s["right"], 1, 0), "left": (s["left"], 0, 0), "bottom": (s["bottom"], 0, 1), "top": (s["top"], 0, 0)})


def corner(df: DataFrame, tile: tuple[int, int] = DEFAULT_TILE) -> DataFrame:
    s = _sides(tile)
    return _sided(df, {"bottom_left": (s["bottom"] & s["left"], 0, 1), "bottom_right": (s["bottom"] & s["right"], 1, 1),
                       "top_right": (s["top"] & s["right"], 1, 0), "top_left": (s["top"] & s["left"], 0, 0)})


NEIGHBOURS = {"right": (1, 0), "left": (-1, 0), "bottom": (0, 1), "top": (0, -1),
              "bottom_right": (1, 1), "bottom_left": (-1, 1), "top_right": (1, -1), "top_left": (-1, -1)}


def neighbors(tiles: DataFrame, tile: tuple[int, int] = DEFAULT_TILE, names=tuple(NEIGHBOURS), by: tuple[str, ...] = ()) -> DataFrame:
    """(name, side, neighbor): the tile at each offset, null where there is none. One equi-join on coordinates.

    `by` names the columns of the slide, which come first in the result: only tiles of one slide are neighbours.
    """
    steps = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(NEIGHBOURS[n][0] * tile[0]).alias("dx"), F.lit(NEIGHBOURS[n][1] * tile[1]).alias("dy"))
                      for n in names])
    ask = tiles.withColumn("_s", F.explode(steps)).select(*by, "name", "_s.side", (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y"))
    have = tiles.select(*by, F.col("name").alias("neighbor"), "x", "y")
    return ask.join(have, [*by, "x", "y"], "left").select(*by, "name", "side", "neighbor")


def adjacent(tiles: DataFrame, tile: tuple[int, int] = DEFAULT_TILE, by: tuple[str, ...] = ()) -> DataFrame:
    return neighbors(tiles, tile, ("left", "right", "bottom", "top"), by)


def offset(df: DataFrame, name: str = "name", ring: str = "ring") -> DataFrame:
    """Add the tile coordinates of the name to every point."""
    d = parse_tile_xy(df, name, "_tx", "_ty")
    return _shifted(d, ring, F.col("_tx"), F.col("_ty")).drop("_tx", "_ty")


def tile_counts(df: DataFrame, name: str = "name") -> DataFrame:
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("n_features"))


def ring_area(ring: Column) -> Column:
    """Shoelace area."""
    twice = F.aggregate(ring_edges(ring), F.lit(0.0), lambda a, e: a + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(twice) / 2


def _let(value: Column, f) -> Column:
    """Evaluate `value` once and hand it to `f`; a plain column expression would be repeated wherever it is used."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _corners(ring: Column) -> Column:
    """Vertices of a closed ring at which the direction changes."""
    def turning(pts):
        n = F.size(pts)

        def turns(p, i):
            a, b = F.get(pts, (i + n - 1) % n), F.get(pts, (i + 1) % n)
            return (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"]) != 0

        return F.filter(pts, turns)

    return _let(F.slice(ring, F.lit(1), F.size(ring) - 1), turning)


def is_rectangle(ring: Column) -> Column:
    """Whether the ring is a rectangle of any rotation: four corners, three of them right angles."""
    def test(c):
        def square(i: int) -> Column:
            a, p, b = F.get(c, F.lit(i)), F.get(c, F.lit(i + 1)), F.get(c, F.lit((i + 2) % 4))
            dot = (p["x"] - a["x"]) * (b["x"] - p["x"]) + (p["y"] - a["y"]) * (b["y"] - p["y"])
            return F.abs(dot) < 1e-9

        return (F.size(c) == 4) & square(0) & square(1) & square(2)

    return _let(_corners(ring), test)


def drop_rectangles(df: DataFrame, ring: str = "ring") -> DataFrame:
    return df.filter(~is_rectangle(F.col(ring)))


def _holds(ring: Column, p: Column) -> Column:
    """Even-odd test of a point against a closed ring."""
    def crosses(e):
        above = (e["y1"] > p["y"]) != (e["y2"] > p["y"])
        at = e["x1"] + (p["y"] - e["y1"]) * (e["x2"] - e["x1"]) / F.when(e["y2"] == e["y1"], 1.0).otherwise(e["y2"] - e["y1"])
        return above & (p["x"] < at)

    return F.size(F.filter(ring_edges(ring), crosses)) % 2 == 1


def _segments_meet(a: Column, b: Column) -> Column:
    def side(o, px, py):
        return F.signum((o["x2"] - o["x1"]) * (py - o["y1"]) - (o["y2"] - o["y1"]) * (px - o["x1"]))

    boxes = ((F.least(a["x1"], a["x2"]) <= F.greatest(b["x1"], b["x2"])) & (F.least(b["x1"], b["x2"]) <= F.greatest(a["x1"], a["x2"]))
             & (F.least(a["y1"], a["y2"]) <= F.greatest(b["y1"], b["y2"])) & (F.least(b["y1"], b["y2"]) <= F.greatest(a["y1"], a["y2"])))
    return (boxes & (side(a, b["x1"], b["y1"]) * side(a, b["x2"], b["y2"]) <= 0) & (side(b, a["x1"], a["y1"]) * side(b, a["x2"], a["y2"]) <= 0))


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: an edge of one meets an edge of the other, or one lies inside the other."""
    def edges_cross(ea):
        return _let(ring_edges(b), lambda eb: F.exists(ea, lambda e: F.exists(eb, lambda g: _segments_meet(e, g))))

    return _let(ring_edges(a), edges_cross) | _holds(a, F.get(b, F.lit(0))) | _holds(b, F.get(a, F.lit(0)))
