"""Toxicity of restored text: character lattices are decoded under a character language model, then scored.

1. `character_model`: trigram counts of folded letters over all documents, one bounded table a task, summed.
2. `Restorer`: tokens with look-alike signs beside letters, letters set apart, or letters doubled or drawn out become a
   lattice of slots; the best path under channel costs and the trigram model is the restored word. All other tokens are
   their own only path; so are those of signs alone, which stay numbers. Results are remembered per token. Single letters
   are joined over any white space; neighbouring tokens where they make up a kept feature and the best path joins them.
3. Features of a restored word are the word and its first 4, 5 and 6 letters. Their document counts in toxic and other
   training rows give log-odds; only features with a clear excess are kept. A one-dimensional logistic fit of the summed
   log-odds gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, memory, table, texts

MAX_TRAIN = 50_000  # labelled rows a model is fitted on at most (lowest hashes of doc_id)
BUCKETS = 1 << 20  # feature buckets
THRESHOLD = 0.3

# What a sign may stand for, most likely first.
LOOK_ALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
              "+": "t", "€": "e", "*": "aeiou"}
SET_APART = " .-_*~"
COST_LOOK, COST_LATER, COST_GAP, COST_BREAK, COST_DOUBLE = -0.7, -0.3, -0.1, -2.0, -0.7

_SIGNS = re.escape("".join(LOOK_ALIKE))
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_INSIDE = re.compile(rf"[^\W\d_][{_SIGNS}]|[{_SIGNS}][^\W\d_]|[^\W\d_][.\-_~]+[^\W\d_]")
_SPACED = re.compile(r"(?<!\S)[^\W_](?:[\s.\-_*~]+[^\W_]){2,}(?!\w)")
_GAPS = re.compile(r"[\s.\-_*~]+")
_AROUND = ".,;:?\"'()[]{}«»“”„‘’…¿¡"
_WORD = re.compile(r"[^\W\d_]+")


def _fold(ch: str) -> int:
    """Letter class 1..26 of a character without its accents; 0 for everything else."""
    base = unicodedata.normalize("NFD", ch.lower())[:1]
    return ord(base) - 96 if "a" <= base <= "z" else 0


FOLD = np.array([*(_fold(chr(c)) for c in range(0x250)), 0], np.uint16)
STRETCH = 1 << 19  # characters counted at a time


def _stretches(batches) -> Iterator[str]:
    """All texts of the batches, two blanks between them, in pieces of some STRETCH characters."""
    for b in batches:
        held, size = [], 0
        for t in b.column(0):
            text = t.as_py() + "  "
            held.append(text)
            size += len(text)
            if size >= STRETCH:
                whole = "".join(held)
                yield from (whole[k:k + STRETCH] for k in range(0, size, STRETCH))
                held, size = [], 0
        yield "".join(held)


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(third | first two) over 27 letter classes from all rows of `docs`, shape (27, 27, 27)."""

    def count(batches):
        total, rest = np.zeros(27 ** 3, np.int64), np.zeros(0, np.uint16)
        for piece in _stretches(batches):
            cps = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
            c = np.concatenate([rest, FOLD[np.minimum(cps, 0x250)]])
            total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27 ** 3) if len(c) > 2 else 0
            rest = c[-2:]
        k = np.flatnonzero(total)
        yield {"gram": k, "n": total[k]}

    rows = map_rows(docs.select("text"), count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 27^3 rows at most
    n = np.zeros(27 ** 3)
    for r in rows:
        n[r.gram] = r.n
    n = n.reshape(27, 27, 27)
    one = (n.sum((0, 1)) + 1) / (n.sum() + 27)
    two = (n.sum(0) + 20 * one) / (n.sum(0).sum(1, keepdims=True) + 20)
    return np.log((n + 20 * two[None]) / (n.sum(2, keepdims=True) + 20))


class Restorer:
    """Best path through the lattice of a token."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()

        m = model
        # by letters (y, c, z): whether the best path through y c c z drops a c; runs do not bear on each other
        self.drops = m[:, :, :] - np.diagonal(m, axis1=1, axis2=2)[:, :, None] - m[range(27), range(27)][None] + 2 * COST_BREAK > 0
        self.shortened: dict[str, bool] = {}  # by the letters around: at most a few thousand

    def undoubles(self, token: str) -> bool:
        """Whether the best path of a token of letters shortens a doubled one."""
        for m in _DOUBLE.finditer(token):
            i, j = m.span()
            around = (token[i - 1] if i else " ") + token[i] + (token[j] if j < len(token) else " ")
            known = self.shortened.get(around)
            if known is None:
                known = self.shortened[around] = bool(self.drops[tuple(map(_fold, around))])
            if known:
                return True
        return False

    def slots(self, token: str) -> list[list[tuple[str, float]]]:
        out: list[list[tuple[str, float]]] = []
        i = 0
        while i < len(token):
            ch = token[i]
            j = i
            while j < len(token) and token[j] == ch:
                j += 1
            if ch in SET_APART and not (ch == "*" and j - i == 1):
                out.append([("", COST_GAP if j - i == 1 else COST_BREAK), (" ", COST_BREAK if j - i == 1 else COST_GAP)])
            else:
                reads = [(ch, 0.0)] if ch.isalpha() else [(c, COST_LOOK + COST_LATER * k) for k, c in enumerate(LOOK_ALIKE.get(ch, ""))]
                reads = reads or [(" ", 0.0)]
                if ch == "*":
                    reads.append(("", COST_BREAK))
                out.append(reads)
                if j - i >= 2 and reads[0][0] != " ":
                    out.append([(c, s) for c, s in reads] + [("", COST_DOUBLE if j - i > 2 else 2 * COST_BREAK)])
            i = j
        return out

    def __call__(self, token: str) -> str:
        """Viterbi over (last two letters); the text of the best path, word breaks as blanks."""
        model = self.model
        paths: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for slot in [*self.slots(token), [(" ", 0.0)]]:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, trail) in paths.items():
                row = model[a][b]
                for ch, cost in slot:
                    if ch:
                        k = _fold(ch)
                        state, s, t = (b, k), score + cost + row[k], (trail, ch)
                    else:
                        state, s, t = (a, b), score + cost, trail
                    if state not in new or s > new[state][0]:
                        new[state] = (s, t)
            paths = new
        trail = max(paths.values(), key=lambda x: x[0])[1]
        chars = []
        while trail:
            trail, ch = trail
            chars.append(ch)
        return "".join(reversed(chars)).strip()


def _bucket(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) & (BUCKETS - 1)


def _pieces(text: str) -> set[str]:
    """Words and their beginnings."""
    return {p for w in _WORD.findall(text) if len(w) >= 3 for p in (w, w[:4], w[:5], w[:6])}


class Parts:
    """Kept features as strings, and what a first part of one can be."""

    def __init__(self, strings: frozenset[str]) -> None:
        self.strings = strings
        self.bucket = {w: _bucket(w) for w in strings}
        self.heads = frozenset(w[:3] for w in strings)
        self.starts = frozenset(w[:k] for w in strings for k in range(1, len(w)))
        self.longest = max(map(len, strings), default=0)


class Features:
    """Feature buckets of a text, remembered per token."""

    def __init__(self, model: np.ndarray, limit: int = 400_000) -> None:
        self.restore, self.limit, self.known = Restorer(model), limit, {}

    def readings(self, token: str) -> str:
        """A token and what it is restored to."""
        token = token.lower()
        bare = token.strip(_AROUND)
        for form in {bare, bare.rstrip("!" + _AROUND)}:  # a last ! is a letter or punctuation
            if _INSIDE.search(form) or _DRAWN.search(form) or self.restore.undoubles(form):
                token += " " + self.restore(form)
        return token

    def spaced(self, text: str) -> Iterator[str]:
        """What single letters set apart are restored to: a wide gap ends a word, or all gaps are wide."""
        for m in _SPACED.finditer(text):
            letters = re.sub(r"\s", " ", m.group().lower())
            yield from map(self.restore, {letters, _GAPS.sub(" ", letters)})

    def spelled(self, texts: list[str], keep: set[int]) -> set[str]:
        """The words and beginnings of words that fall into buckets of `keep`."""
        known: set[str] = set()
        out: set[str] = set()
        for text in texts:
            tokens = set(text.split())
            for reading in [*map(self.readings, tokens - known), *self.spaced(text)]:
                out.update(p for p in _pieces(reading) if _bucket(p) in keep)
            known |= tokens
        return out

    def of_parts(self, text: str, parts: Parts) -> set[int]:
        """Buckets of words whose parts stand as neighbouring tokens."""
        out: set[int] = set()
        tokens = text.lower().split()
        for i, t in enumerate(tokens):
            joined = t if t in parts.starts else t.lstrip(_AROUND) if t[0] in _AROUND else ""
            if joined not in parts.starts:
                continue
            apart = joined
            for t in tokens[i + 1:i + 1 + parts.longest]:
                part = t.rstrip("!" + _AROUND)
                joined, apart = joined + part, f"{apart} {part}"
                if joined in parts.strings:
                    out.update(self.of_kept(self.restore(apart), parts))
                elif not parts.strings.isdisjoint((joined[:4], joined[:5], joined[:6])):  # only the beginning is known: a blank rather ends a word
                    out.update(self.of_kept(self.restore(apart.replace(" ", "  ")), parts))
                if part != t or joined not in parts.starts:
                    break
        return out

    @classmethod
    def shared(cls, model: np.ndarray, strings: frozenset[str] | None = None) -> Features:
        """One object for each worker process, character model and set of kept features, with what it remembers."""
        name = hash((model.tobytes(), strings))
        known = memory("toxicity")
        if name not in known:
            known.clear()
            known[name] = cls(model)
        return known[name]

    @staticmethod
    def of_words(text: str) -> tuple[int, ...]:
        return tuple({_bucket(p) for p in _pieces(text)})

    def __call__(self, text: str) -> set[int]:
        """Buckets of all features of a text."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        tokens = set(text.split())
        for t in tokens.difference(known):
            known[t] = self.of_words(self.readings(t))
        out: set[int] = set()
        for own in filter(None, map(known.__getitem__, tokens)):
            out.update(own)
        for reading in self.spaced(text):
            out.update(self.of_words(reading))
        return out

    def kept(self, text: str, parts: Parts) -> set[int]:
        """Buckets of the kept features in a text. A token that holds neither signs nor doubled letters is read as it stands, and
        no word without the first three letters of a kept feature is looked up."""
        known, heads = self.known, parts.heads
        if len(known) > self.limit:
            known.clear()
        tokens = set(text.split())
        for t in tokens.difference(known):
            bare = t.lower().strip(_AROUND)
            if bare.isalpha() and not _DOUBLE.search(bare):
                known[t] = self.of_kept(bare, parts) if bare[:3] in heads else ()
            else:
                known[t] = self.of_kept(self.readings(t), parts)
        out: set[int] = set()
        for own in filter(None, map(known.__getitem__, tokens)):
            out.update(own)
        for reading in self.spaced(text):
            out.update(self.of_kept(reading, parts))
        out.update(self.of_parts(text, parts))
        return out

    @staticmethod
    def of_kept(text: str, parts: Parts) -> tuple[int, ...]:
        words = [w for w in _WORD.findall(text) if w[:3] in parts.heads]
        return tuple({parts.bucket[p] for w in words for p in (w, w[:4], w[:5], w[:6]) if p in parts.strings}) if words else ()


@dataclass
class ToxicityModel:
    characters: np.ndarray
    weights: dict[int, float]
    slope: float
    offset: float
    strings: frozenset[str] = frozenset()  # the words and beginnings of words behind the weights

    def scores(self, features: Features, batch: Iterable[str]) -> list[float]:
        parts = self.parts
        return [self.score(sum(map(self.weights.__getitem__, features.kept(t, parts)))) for t in batch]

    @property
    def parts(self) -> Parts:
        return Parts(self.strings)

    @property
    def keep(self) -> set[int]:
        return set(self.weights)

    def score(self, total: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * min(total, 60.0) + self.offset))))


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """(doc_id, text, toxic) of at most `max_train` labelled rows; crc32(doc_id) mod 4 = 2 is held out."""
    sample = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
              .filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out())
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id")).limit(max_train))
    return texts(docs).join(F.broadcast(sample), "doc_id")  # max_train rows of 12 bytes


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> ToxicityModel:
    characters = character_model(texts(docs))
    rows = training_rows(docs, labels, max_train).select("text", "toxic")

    def count(batches):
        features = Features.shared(characters)
        toxic, every = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS + 1, np.int64)
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.fromiter(features(t), np.int64)
                every[own] += 1
                toxic[own] += y
                every[BUCKETS] += 1
                toxic[BUCKETS] += y
        k = np.flatnonzero(every)
        yield {"bucket": k, "toxic": toxic[k], "n": every[k]}

    counts = map_rows(rows, count, "bucket int, toxic long, n long", "toxicity").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("n").alias("n")).persist()
    whole = counts.filter(F.col("bucket") == BUCKETS).first()
    t_all, n_all = (whole.t, whole.n) if whole else (0, 0)
    base = (t_all + 0.5) / (n_all + 1)
    excess = (F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * base * (1 - base))
    chosen = counts.filter((F.col("bucket") < BUCKETS) & (excess >= 6) & ((F.col("t") + 0.5) / (F.col("n") + 1) >= 0.5)).collect()  # BUCKETS rows at most
    counts.unpersist()
    odds = lambda t, n: math.log((t + 0.5) / (t_all + 1)) - math.log((n - t + 0.5) / (n_all - t_all + 1))
    weights = {r.bucket: odds(r.t, r.n) for r in chosen}
    model = ToxicityModel(characters, weights, 1.0, math.log(base / (1 - base)))
    if not weights:
        return ToxicityModel(characters, {}, 1.0, -4.0)

    def spell(batches):
        features, keep, found = Features(characters), model.keep, set()
        for b in batches:
            found |= features.spelled(b.column(0).to_pylist(), keep)
        yield {"string": sorted(found)}

    spelled = map_rows(rows.filter("toxic = 1").select("text"), spell, "string string", "toxicity").distinct().collect()  # the words of BUCKETS buckets at most
    model.strings = frozenset(r.string for r in spelled)

    def tally(batches):
        parts = model.parts
        features = Features.shared(characters, model.strings)
        found: dict[tuple[float, int], int] = {}
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key = (round(min(sum(map(weights.__getitem__, features.kept(t, parts))), 60.0), 0), y)
                found[key] = found.get(key, 0) + 1
        yield {"total": [k[0] for k in found], "toxic": [k[1] for k in found], "n": list(found.values())}

    cells = map_rows(rows, tally, "total double, toxic int, n long", "toxicity").groupBy("total", "toxic").agg(F.sum("n").alias("n")).collect()  # 122 rows at most
    model.slope, model.offset = _logistic(np.array([(r.total, r.toxic, r.n) for r in cells], float))
    return model


def _logistic(cells: np.ndarray) -> tuple[float, float]:
    """Newton steps on (x, y, weight) with a small ridge."""
    x = np.stack([cells[:, 0], np.ones(len(cells))], 1)
    y, n = cells[:, 1], cells[:, 2]
    w = np.zeros(2)
    ridge = np.diag([1e-2, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - ridge @ w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, g)
        w = w + np.clip(step, -2, 2)
    return max(float(w[0]), 0.0), float(w[1])


def toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row; null and empty texts get the score of a text without any feature.

    One scan, no shuffle. Rows with equal texts get equal scores; a null doc_id is scored like any other; very long texts
    are scored whole; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights and 27^3 log-probabilities at most

    def run(batches):
        m = shared.value
        features = Features.shared(m.characters, m.strings)
        for b in batches:
            yield {"doc_id": b.column(0), "score": m.scores(features, (t.as_py() for t in b.column(1)))}

    return map_rows(texts(docs), run, "doc_id long, score double", "toxicity")


def score_column(docs: DataFrame, model: ToxicityModel, name: str) -> DataFrame:
    """All columns of `docs` and the score of their text, computed row by row beside them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features.shared(shared.value.characters, shared.value.strings)
        for t in parts:
            yield pd.Series(shared.value.scores(features, t), dtype="float64")

    return docs.withColumn(name, score(F.coalesce("text", F.lit(""))))


def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
