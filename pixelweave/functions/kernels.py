"""Structuring elements and convolution kernels as small literal tables."""

from __future__ import annotations

import math


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets (dy, dx) within a Euclidean radius."""
    r = range(-radius, radius + 1)
    return [(dy, dx) for dy in r for dx in r if dy * dy + dx * dx <= radius * radius]


def ellipse(size: int = 5) -> list[tuple[int, int]]:
    """Offsets of an elliptic element inscribed in an odd square; rows are as wide as the ellipse, rounded."""
    r = size // 2
    out = []
    for dy in range(-r, r + 1):
        half = round(r * math.sqrt((r * r - dy * dy) / (r * r)))
        out += [(dy, dx) for dx in range(-half, half + 1)]
    return out


def gaussian(n: int, sigma: float) -> list[float]:
    shift = 0.5 if n % 2 == 0 else 0.0
    g = [math.exp(-((i - n // 2 + shift) ** 2) / (2.0 * sigma * sigma)) for i in range(n)]
    return [v / sum(g) for v in g]


def gaussian_kernel(n: int, sigma: float) -> list[list[float]]:
    g = gaussian(n, sigma)
    return [[a * b for b in g] for a in g]


def sobel_hv_kernel(n: int = 5) -> tuple[list[list[float]], list[list[float]]]:
    """First-derivative kernels h / (h^2 + v^2 + 1e-6) and v / (...); h runs along rows, v along columns."""
    if n % 2 == 0:
        raise ValueError("window size must be odd")
    r = range(-(n // 2), n // 2 + 1)
    return ([[h / (h * h + v * v + 1e-6) for v in r] for h in r], [[v / (h * h + v * v + 1e-6) for v in r] for h in r])


def _binomial(n: int) -> list[float]:
    return [float(math.comb(n, k)) for k in range(n + 1)]


def sobel_separable(size: int = 21) -> tuple[list[float], list[float]]:
    """(derivative, smoothing) taps of a large Sobel operator."""
    b = _binomial(size - 2)
    return [hi - lo for hi, lo in zip([0.0] + b, b + [0.0])], _binomial(size - 1)
