"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted similarity.

Words are lower-case runs of letters and digits. A window as long as an item is a multiset of five-word shingles (of all
its words where the item has fewer), each weighing the letters in it. Its 128-bit SimHash comes from running sums, so every
window costs the same. Fingerprints are cut into 8 blocks of 16 bits; two fingerprints within RADIUS bits agree in some
block to RADIUS // 8 bits, and the index holds every item under all block values that close, so one look-up per block finds
all fingerprints within the radius. What is found is confirmed by the exact weighted Jaccard similarity.

A window is similar enough only if shingles of items make up that share of its weight; all others are passed over before
fingerprinting.

A text shorter than an item has no such window. With `short` the whole text is one window for all longer items.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame

from .common import WordHashes, map_rows, mix, shingles, table, texts

RADIUS, BLOCKS, SHINGLE, SIMILARITY = 31, 8, 5, 0.8
SLICE = 1000  # items searched for in one scan; an index of so many takes about 25 MB
STRETCH = 1 << 14  # shingles fingerprinted at a time

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LOWER).split()


def weighted_shingles(words: list[bytes], hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and weight of every run of `size` words."""
    letters = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
    n = len(words) - size + 1
    return shingles(hashes, size)[:max(n, 0)], (letters[size:] - letters[:-size]) if n > 0 else np.zeros(0, np.int64)


def window_fingerprints(h: np.ndarray, w: np.ndarray, length: int) -> np.ndarray:
    """SimHash of every run of `length` shingles, as rows of 8 blocks of 16 bits."""
    return _window_prints(_running(h, w), length)


def _running(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.stack([mix(h), mix(h ^ np.uint64(0x5851F42D4C957F2D))], 1).view(np.uint8), axis=1)
    sums = np.zeros((len(h) + 1, 128), np.int32)
    np.cumsum((bits.astype(np.int32) * 2 - 1) * w[:, None].astype(np.int32), axis=0, out=sums[1:])
    return sums


def _window_prints(sums: np.ndarray, length: int) -> np.ndarray:
    return np.packbits(sums[length:] - sums[:-length] > 0, axis=1).view(np.uint16)


def _near_masks() -> np.ndarray:
    """All 16-bit patterns of at most RADIUS // BLOCKS bits."""
    return np.array([sum(1 << k for k in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), r)], np.uint16)


class Index:
    """Items of one slice: shingle sets, fingerprints, and for each block the items under every close value."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        hashes = WordHashes()
        self.ids, self.bags, self.total, self.words, prints = [], [], [], [], []
        for item, text in items:
            words = words_of(text or "")
            if not words:
                continue
            h, w = weighted_shingles(words, hashes(words), min(SHINGLE, len(words)))
            self.ids.append(item)
            self.words.append(len(words))
            self.bags.append(_bag(h, w))
            self.total.append(int(w.sum()))
            prints.append(window_fingerprints(h, w, len(h))[0])
        self.prints = np.stack(prints) if prints else np.zeros((0, BLOCKS), np.uint16)
        self.lengths = sorted(set(self.words))
        self.known = {size: np.array(sorted({h for n, bag in zip(self.words, self.bags, strict=True) if min(SHINGLE, n) == size for h in bag}), np.uint64)
                      for size in {min(SHINGLE, n) for n in self.words}}
        # for every block: items by (block value, length in words), so that a look-up reads only items of the length asked for
        self.at_length = {n: k for k, n in enumerate(self.lengths)}
        length = np.array([self.at_length[n] for n in self.words], np.int64)
        masks, self.places, self.items = _near_masks(), [], []
        for k in range(BLOCKS):
            value = (self.prints[:, k, None] ^ masks[None]).astype(np.int64) * len(self.lengths) + length[:, None]
            order = np.argsort(value.ravel(), kind="stable")
            self.items.append((order // len(masks)).astype(np.int32))
            self.places.append(value.ravel()[order])

    def within(self, prints: np.ndarray, length: int) -> list[tuple[int, int]]:
        """(window, item) for all items of `length` words within RADIUS of a window's fingerprint."""
        at = self.at_length[length]
        return self._near(prints, at, at + 1)

    def longer(self, prints: np.ndarray, length: int, size: int) -> list[tuple[int, int]]:
        """(window, item) for all items of more than `length` words and shingles of `size` within RADIUS of a fingerprint."""
        first = int(np.searchsorted(self.lengths, length, "right"))
        found = self._near(prints, first, len(self.lengths))
        return [(window, item) for window, item in found if min(SHINGLE, self.words[item]) == size]

    def _near(self, prints: np.ndarray, first: int, past: int) -> list[tuple[int, int]]:
        """(window, item) within RADIUS, of items whose length stands at `first` to `past` - 1 in the list of lengths."""
        found: list[np.ndarray] = []
        for k in range(BLOCKS):
            value = prints[:, k].astype(np.int64) * len(self.lengths)
            lo, hi = np.searchsorted(self.places[k], value + first), np.searchsorted(self.places[k], value + past)
            n = hi - lo
            if not n.any():
                continue
            window = np.repeat(np.arange(len(prints)), n)
            item = self.items[k][np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
            ok = np.bitwise_count(prints[window] ^ self.prints[item]).sum(1) <= RADIUS
            found.append(window[ok] * len(self.ids) + item[ok])
        return [divmod(int(x), len(self.ids)) for x in np.unique(np.concatenate(found))] if found else []


def _bag(h: np.ndarray, w: np.ndarray) -> dict[int, tuple[int, int]]:
    """shingle: (occurrences, weight)."""
    n = Counter(h.tolist())
    return {x: (n[x], weight) for x, weight in zip(h.tolist(), w.tolist(), strict=True)}


def similarity(a: dict, b: dict) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, b[x][0]) * w for x, (n, w) in a.items() if x in b)
    every = sum(n * w for n, w in a.values()) + sum(n * w for n, w in b.values()) - both
    return both / every if every else 0.0


def scan(index: Index, words: list[bytes], hashes: np.ndarray, least: float, short: bool = False) -> dict[int, tuple[float, int, int]]:
    """item: (similarity, -first word, words) of the best window of one text."""
    best: dict[int, tuple[float, int, int]] = {}
    for size, known in index.known.items():
        h, w = weighted_shingles(words, hashes, size)
        if not len(h):
            continue
        place = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[place] == h
        if not hit.any():
            continue
        # weights up to each shingle, and of those that items hold: a window has no more than these in common with an item
        weight, shared = (np.concatenate([[0], np.cumsum(x)]) for x in (w, w * hit))
        share = least * (1 - 1e-9)
        if short and len(words) < max(n for n in index.lengths if min(SHINGLE, n) == size) and shared[-1] >= share * weight[-1]:
            whole = _bag(h, w)
            for _, item in index.longer(window_fingerprints(h, w, len(h)), len(words), size):
                s = similarity(whole, index.bags[item])
                if s >= least:
                    best[item] = (s, 0, len(words))
        before = np.concatenate([[0], np.cumsum(hit)])
        lengths = [n for n in index.lengths if min(SHINGLE, n) == size]
        reach = max(lengths) - size + 1
        for lo in range(0, len(h), STRETCH):
            hi = min(lo + STRETCH + reach - 1, len(h))
            if before[hi] == before[lo]:
                continue
            # only what lies within a window of some hit
            at = np.flatnonzero(hit[lo:hi]) + lo
            cuts = np.flatnonzero(np.diff(at) >= reach) + 1
            for part in np.split(at, cuts):
                a, z = max(lo, int(part[0]) - reach + 1), min(hi, int(part[-1]) + reach)
                sums = None
                for n in lengths:
                    span = n - size + 1
                    if z - a < span:
                        continue
                    enough = shared[a + span:z + 1] - shared[a:z + 1 - span] >= share * (weight[a + span:z + 1] - weight[a:z + 1 - span])
                    starts = np.flatnonzero(enough & (before[a + span:z + 1] > before[a:z + 1 - span]))
                    if not len(starts):
                        continue
                    sums = _running(h[a:z], w[a:z]) if sums is None else sums
                    prints = _window_prints(sums, span)[starts]
                    for k, item in index.within(prints, n):
                        first = a + int(starts[k])
                        s = similarity(_bag(h[first:first + span], w[first:first + span]), index.bags[item])
                        found = (s, -first, n)
                        if s >= least and found > best.get(item, (0.0, 0, 0)):
                            best[item] = found
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, short: bool = False) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of a text for each benchmark item it holds.

    Documents are scanned once for every SLICE items, without a shuffle; the slice's index is the only broadcast. Null and
    empty texts and items hold nothing; a null doc_id is searched like any other; repeated rows give repeated rows; ties
    take the first window; long texts are scanned whole; other columns are ignored. With `short` a text of fewer words than an
    item is compared with it as a whole (n_words is then that of the text); otherwise it gives no row for that item.
    """
    spark = docs.sparkSession
    out, items = None, []
    rows = benchmark.select("item_id", "text").orderBy("item_id").toLocalIterator()
    while items is not None:
        items = [(r.item_id, r.text) for _, r in zip(range(SLICE), rows, strict=False)]
        if not items and out is not None:
            break
        index = spark.sparkContext.broadcast(Index(items))

        def run(batches, index=index):
            ix, hashes = index.value, WordHashes()
            for b in batches:
                found = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    words = words_of(text) if ix.ids else []
                    if words:
                        found += [(doc, ix.ids[k], s, -first, n) for k, (s, first, n) in scan(ix, words, hashes(words), least, short).items()]
                yield {c: [x[k] for x in found] for k, c in enumerate(("doc_id", "item_id", "similarity", "first_word", "n_words"))}

        part = map_rows(texts(docs), run, "doc_id long, item_id long, similarity double, first_word long, n_words long")
        out = part if out is None else out.unionByName(part)
        if len(items) < SLICE:
            break
    return out


def op5(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), short=True)
