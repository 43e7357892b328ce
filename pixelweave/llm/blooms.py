"""Two Bloom filters of fixed size: hashes seen at least once, and hashes seen at least twice.

Each task fills its own pair; pairs merge by blocks with
    once = once1 | once2,  twice = twice1 | twice2 | (once1 & once2),
which is associative, so a hash that two tasks hold once each is in the merged `twice`: no repeat is missed. False
positives only send more rows to the exact step that follows. The size is a parameter and does not follow the data; an
overfull filter lets everything through and results stay the same; less data takes less. The merged `twice` is broadcast: 2^bits / 8 bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..session import releasing
from .common import map_rows, mix

BLOCK = 1 << 16  # bytes of a filter that travel together
PROBES = 2


class Pair:
    def __init__(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.once, self.twice = (np.zeros(max(1 << (bits - 3), 1), np.uint8) for _ in range(2))

    def add(self, h: np.ndarray) -> None:
        """Take up hashes; equal ones in one call must come from different documents."""
        h, n = np.unique(h, return_counts=True)
        places = _places(h, self.mask)
        _set(self.twice, [p[_inside(self.once, places) | (n > 1)] for p in places])
        _set(self.once, places)


def _places(h: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    step = mix(h) | np.uint64(1)
    return [(h + np.uint64(k) * step) & mask for k in range(PROBES)]


def _inside(bits: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    hit = np.ones(len(places[0]), bool)
    for p in places:
        hit &= (bits[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return hit


def _set(bits: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(bits, (p >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (p & np.uint64(7)).astype(np.uint8)))


def bits_for(entries: float, most: int) -> int:
    """Size for about 6 to 12 bits an entry, `most` at most."""
    return int(min(most, max(16, np.ceil(np.log2(6 * max(entries, 1))))))


def twice_filter(docs: DataFrame, hashes: Callable[[Iterator], Iterator[np.ndarray]], bits: int, single: bool = False):
    """Broadcast `twice` filter over all rows (with `single` the `once` filter). `hashes` turns Arrow batches into arrays, each hash
    once per document."""

    def fill(batches):
        pair = Pair(bits)
        for h in hashes(batches):
            if len(h):
                pair.add(h)
        for k in range(0, len(pair.once), BLOCK):
            o, t = pair.once[k:k + BLOCK], pair.twice[k:k + BLOCK]
            if o.any():
                yield {"block": [k], "once": [zlib.compress(o.tobytes(), 1)], "twice": [zlib.compress(t.tobytes(), 1)]}

    def merge(batches):
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, o, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
                if k in sums:
                    once, twice = sums[k]
                    twice |= t | (once & o)
                    once |= o
                else:
                    sums[k] = [o.copy(), t.copy()]
        for k, pair in sums.items():
            bits_ = pair[0 if single else 1]
            if bits_.any():
                yield {"block": [k], "twice": [zlib.compress(bits_.tobytes(), 1)]}

    pairs = map_rows(docs, fill, "block long, once binary, twice binary")
    merged = map_rows(pairs.repartition("block"), merge, "block long, twice binary")
    whole = np.zeros(max(1 << (bits - 3), 1), np.uint8)
    with releasing(docs.sparkSession):
        rows = merged.collect()
    for row in rows:  # at most 2^bits / 8 bytes, whatever the input
        part = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
        whole[row.block:row.block + len(part)] = part
    return docs.sparkSession.sparkContext.broadcast(whole)


def filter_of(df: DataFrame, col: str, bits: int):
    """Broadcast filter of the distinct long values of a column."""

    def hashes(batches):
        for b in batches:
            yield b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)

    return twice_filter(df.select(col), hashes, bits, single=True)


def suspected(twice: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For each hash: may it occur in two documents?"""
    return _inside(twice, _places(h, np.uint64(len(twice) * 8 - 1))) if len(h) else np.zeros(0, bool)
