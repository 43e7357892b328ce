"""Neighbourhood filters on full pixel grids.

A filter is two window passes: along the rows of an image, then along its columns. Each pass shuffles the grid once by
(image, row) or (image, column), sorts short runs, and reads neighbours with lead and lag, so no pixel is multiplied by the
size of the window and no pixel is joined with another. The window partitions are single image lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def padded_positions(c: Column, n: int, before: int, after: int, mode: str) -> Column:
    """All positions in [-before, n - 1 + after] that show source index `c` (one axis of length n)."""
    if mode == "replicate":
        head = F.when(c == 0, F.sequence(F.lit(-before), F.lit(-1))) if before else None
        tail = F.when(c == n - 1, F.sequence(F.lit(n), F.lit(n - 1 + after))) if after else None
        none = F.array().cast("array<int>")
        return F.concat(*[F.coalesce(p, none) for p in (head, tail) if p is not None], F.array(c.cast("int")))
    if mode == "reflect":          # mirror without repeating the edge, period 2 (n - 1)
        if n == 1:
            return F.sequence(F.lit(-before), F.lit(after))
        period, end = 2 * (n - 1), n - 1 + after
        same, turned = ((s * c - period * F.floor((s * c + before) / period)).cast("int") for s in (1, -1))
        none = F.array().cast("array<int>")
        # the edges are their own mirror images
        other = F.when((c % (n - 1) != 0) & (turned <= end), F.sequence(turned, F.lit(end), F.lit(period))).otherwise(none)
        return F.concat(F.sequence(same, F.lit(end), F.lit(period)), other)
    raise ValueError(f"unknown border mode {mode}")


def pad(grid: DataFrame, height: int, width: int, my: int, mx: int, mode: str) -> DataFrame:
    """Extend a grid by `my` rows and `mx` columns on every side; edge pixels are exploded, nothing is joined."""
    out = grid
    for c, n, m in (("y", height, my), ("x", width, mx)):
        if m:
            out = out.withColumn(c, F.explode(padded_positions(F.col(c), n, m, m, mode)))
    return out


def _at(c: str, d: int, w) -> Column:
    if d == 0:
        return F.col(c)
    return (F.lead(c, d) if d > 0 else F.lag(c, -d)).over(w)


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def filter2d(grid: DataFrame, specs: dict[str, tuple], height: int, width: int, keys=("image_id",), mode: str = "replicate") -> DataFrame:
    """Same-size correlation of several columns at once: `specs` maps an output name to (column, kernel).

    A kernel is a list of rows, or a pair (column taps, row taps) when it is the product of two one-dimensional ones; the
    latter needs one intermediate column instead of one per kernel row. All other columns are kept.
    """
    plans, my, mx = {}, 0, 0
    for out, (col, kernel) in specs.items():
        if isinstance(kernel, tuple):
            ky, kx = kernel
            rows = {0: kx}
            combine = [(i - len(ky) // 2, 0, v) for i, v in enumerate(ky)]
        else:
            rows = {i - len(kernel) // 2: r for i, r in enumerate(kernel)}
            combine = [(dy, dy, 1.0) for dy in rows]
        plans[out] = (col, rows, combine)
        my = max(my, max(abs(dy) for dy, _, _ in combine))
        mx = max(mx, max(len(r) // 2 for r in rows.values()))
    big = pad(grid, height, width, my, mx, mode)
    line = Window.partitionBy(*keys, "y").orderBy("x")
    parts = {}
    for out, (col, rows, _) in plans.items():
        for dy, taps in rows.items():
            terms = [_at(col, i - len(taps) // 2, line) * F.lit(float(v)) for i, v in enumerate(taps) if v != 0]
            parts[f"_{out}_{dy}"] = _total(terms) if terms else F.lit(0.0)
    big = big.select("*", *[v.alias(k) for k, v in parts.items()]).filter(F.col("x").between(0, width - 1))
    post = Window.partitionBy(*keys, "x").orderBy("y")
    outs = [_total([_at(f"_{out}_{src}", dy, post) * F.lit(float(v)) for dy, src, v in combine if v != 0]).alias(out)
            for out, (_, _, combine) in plans.items()]
    return big.select(*grid.columns, *outs).filter(F.col("y").between(0, height - 1))


def box_mean_std(grid: DataFrame, column: str, window: int, height: int, width: int, keys=("image_id",)) -> DataFrame:
    """Mean and population deviation in a square window on a mirrored border (columns `local_mean`, `local_std`)."""
    r = window // 2
    big = pad(grid, height, width, r, r, "reflect")
    v = F.col(column).cast("double")

    def spans(df: DataFrame, line, values: dict) -> DataFrame:
        """Sums over r cells to both sides as differences of running sums, whatever r is."""
        upto = line.rowsBetween(Window.unboundedPreceding, 0)
        df = df.select("*", *[F.sum(c).over(upto).alias(f"_c{k}") for k, c in values.items()])
        return df.select("*", *[(F.lead(f"_c{k}", r).over(line) - F.coalesce(F.lag(f"_c{k}", r + 1).over(line), F.lit(0.0))).alias(k) for k in values])

    big = spans(big, Window.partitionBy(*keys, "y").orderBy("x"), {"_s": v, "_q": v * v}).filter(F.col("x").between(0, width - 1))
    big = spans(big.drop("_c_s", "_c_q"), Window.partitionBy(*keys, "x").orderBy("y"), {"_bs": F.col("_s"), "_bq": F.col("_q")})
    big = big.filter(F.col("y").between(0, height - 1))
    n = float(window * window)
    mean = F.col("_bs") / n
    var = F.greatest(F.col("_bq") / n - mean * mean, F.lit(0.0))
    return big.select(*grid.columns, mean.alias("local_mean"), F.sqrt(var).alias("local_std"))


def local_mean(grid: DataFrame, columns: list[str], radius: int, height: int, width: int, keys=("image_id",)) -> DataFrame:
    """Mean of the 8-bit version of each column over a disk clipped at the image border, as an integer 0..255.

    One running sum per line gives the sum of any span as a difference of two entries, so a wide disk costs two reads per
    disk row whatever its width.
    """
    half = {dy: int((radius * radius - dy * dy) ** 0.5) for dy in range(-radius, radius + 1)}
    widths = sorted(set(half.values()))
    line = Window.partitionBy(*keys, "y").orderBy("x")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    out = grid
    for c in columns:
        out = out.withColumn(f"_c_{c}", F.sum(F.rint(F.greatest(F.least(F.col(c), F.lit(1.0)), F.lit(0.0)) * 255).cast("long")).over(upto))
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = out.select("*", *[F.max(f"_c_{c}").over(whole).alias(f"_t_{c}") for c in columns])
    out = out.select("*", *[
        (F.coalesce(_at(f"_c_{c}", w, line), F.col(f"_t_{c}")) - F.coalesce(F.lag(f"_c_{c}", w + 1).over(line), F.lit(0))).alias(f"_r_{c}_{w}")
        for c in columns for w in widths])
    post = Window.partitionBy(*keys, "x").orderBy("y")
    x, y = F.col("x"), F.col("y")
    cells = _total([F.when((y + dy).between(0, height - 1), F.least(F.lit(width - 1), x + w) - F.greatest(F.lit(0), x - w) + 1).otherwise(0)
                    for dy, w in half.items()])
    means = {c: F.floor(_total([F.coalesce(_at(f"_r_{c}_{w}", dy, post), F.lit(0)) for dy, w in half.items()]) / cells).cast("int")
             for c in columns}
    return out.select(*[means[c].alias(c) if c in means else F.col(c) for c in grid.columns])
