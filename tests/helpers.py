"""Small dense references, written for clarity, and conversions between arrays and pixel tables."""

from collections import deque

import numpy as np


def pixels(spark, maps, column="inst_id", dense=False, image0=0):
    """Pixel table of a list of 2-d arrays."""
    rows = []
    for k, m in enumerate(maps):
        for y in range(m.shape[0]):
            for x in range(m.shape[1]):
                if dense or m[y, x]:
                    rows.append((k + image0, y, x, m[y, x].item()))
    kind = "double" if np.issubdtype(maps[0].dtype, np.floating) else "int"
    return spark.createDataFrame(rows, f"image_id int, y int, x int, {column} {kind}")


def to_map(rows, shape, column="inst_id", image=0):
    out = np.zeros(shape, int)
    for r in rows:
        if r["image_id"] == image:
            out[r["y"], r["x"]] = r[column]
    return out


def label(mask, diagonal=False):
    """Components numbered by raster order of the first pixel."""
    out = np.zeros(mask.shape, int)
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    n = 0
    for y, x in zip(*np.nonzero(mask)):
        if out[y, x]:
            continue
        n += 1
        queue = deque([(y, x)])
        out[y, x] = n
        while queue:
            a, b = queue.popleft()
            for dy, dx in steps:
                p, q = a + dy, b + dx
                if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and mask[p, q] and not out[p, q]:
                    out[p, q] = n
                    queue.append((p, q))
    return out


def padded_box(mask, shape):
    ys, xs = np.nonzero(mask)
    y1, y2, x1, x2 = ys.min(), ys.max() + 1, xs.min(), xs.max() + 1
    return (y1 - 2 if y1 - 2 >= 0 else y1, y2 + 2 if y2 + 2 <= shape[0] - 1 else y2,
            x1 - 2 if x1 - 2 >= 0 else x1, x2 + 2 if x2 + 2 <= shape[1] - 1 else x2)


def blobs(rng, shape, n, size, overlap=True):
    """Random rectangles numbered 1..n, later ones on top."""
    out = np.zeros(shape, int)
    for i in range(1, n + 1):
        h, w = rng.integers(2, size, 2)
        y, x = rng.integers(0, shape[0] - 1), rng.integers(0, shape[1] - 1)
        out[y:y + h, x:x + w] = i
    return out
