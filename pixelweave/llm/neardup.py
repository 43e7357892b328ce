"""Near-duplicate documents by SetSketch registers.

A document is its set of word shingles. Register i holds floor(1 - log_b(m_i)), cut off at the ends, where m_i is the smallest
of exponentially spaced values over the set: merging two sketches is a maximum, and equal registers get likelier with the
similarity. Bands of registers give candidates; the joint likelihood of the counts of larger, equal and smaller registers
estimates their similarity; what is not clearly below the threshold is confirmed on the full sets.

Equal sets are one class from the start. In a band bucket members are compared with a hub, not with one another, and what
the hub doesn't join with a second hub. For the buckets that still hold several components the rest is settled exactly:
inside a family of copies by what each document changes of the family's base, between families by the prefix rule; only
documents of different components that share a rare enough change or shingle are compared. Pairs inside one component
need no look. Nothing is capped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import graph_components
from ..session import Stages
from .blooms import bits_for, filter_of, suspected
from .common import WordHashes, map_rows, mix, shingles, table, texts

BASE, RATE, TOP = 1.02, 20.0, (1 << 15) - 2  # spacing of register values, rate of the smallest values, largest value
BANDS, ROWS = 24, 4  # at similarity 0.8 a pair shares no band with probability 3e-6
REGISTERS = BANDS * ROWS
SIGMAS = 5.0
HUB_ROUNDS = 2
SHARED = 2  # buckets a document has in common with a hub of its family
SALTED = 1000  # members of a family that share one copy of its base
FILTER_BITS = 28  # 32 MB a filter at most; a fuller one only sends more rows to the exact joins

_MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_set(text: str, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text."""
    words = text.encode().translate(_LOWER).split()
    return np.unique(shingles(hashes(words), size)) if words else np.zeros(0, np.uint64)


def registers(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers of a non-empty set of hashes."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(elements), 512):
        low = np.minimum(low, (elements[lo:lo + 512, None] * _MULTIPLIERS[None]).min(0))
    least = -np.log1p(-(low.astype(np.float64) + 1) / 2.0 ** 64) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP + 1).astype(np.int16)


def _larger(x: np.ndarray) -> np.ndarray:
    """Probability that one register exceeds the other, for the share of elements only one side has."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def estimate(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Similarity of largest joint likelihood, given set sizes and how many registers of a are larger or smaller."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    same = REGISTERS - more - less

    def likelihood(j):
        p, q = _larger(u - v * j), _larger(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one peak
        third = (hi - lo) / 3
        left = likelihood(lo + third) >= likelihood(hi - third)
        hi, lo = np.where(left, hi - third, hi), np.where(left, lo, lo + third)
    return (lo + hi) / 2


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, hi, lo, regs) of every row: set size, 128-bit key of the set, registers."""

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            n, key, regs = [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text, hashes, size)
                n.append(len(s))
                key.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist() if len(s) else (None, None))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield {"doc_id": b.column(0), "n": n, "hi": [k[0] for k in key], "lo": [k[1] for k in key], "regs": regs}

    return map_rows(docs, run, "doc_id long, n long, hi long, lo long, regs binary")


def _bands(reps: DataFrame, full=None) -> DataFrame:
    """(doc_id, n, key): one row for each band of each sketch; with a filter of keys those it lets through."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            packed = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint64).reshape(-1, BANDS)
            key = mix(packed + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).ravel()
            ids, n = (np.repeat(b.column(i).to_numpy(), BANDS) for i in (0, 1))
            ok = suspected(full.value, key) if full else slice(None)
            yield {"doc_id": ids[ok], "n": n[ok], "key": key.view(np.int64)[ok]}

    return map_rows(reps.select("doc_id", "n", "regs"), run, "doc_id long, n long, key long")


def _shared_buckets(reps: DataFrame, stages: Stages) -> DataFrame:
    """(doc_id, n, key, label) of the band buckets with several documents, each its own label; what the filter of their keys clears is not shuffled."""
    full = stages.add(_bands(reps).groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).filter("x < y").select("key"))
    keys = filter_of(full, "key", bits_for(full.count(), FILTER_BITS))
    buckets = stages.add(_bands(reps, keys).join(full, "key").withColumn("label", F.col("doc_id")))
    stages.drop(full)
    return buckets


def _likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs whose estimated similarity is not clearly below the threshold."""
    least = threshold - SIGMAS * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            n_a, n_b = (np.asarray(b.column(i).to_numpy(zero_copy_only=False), float) for i in (2, 3))
            r_a, r_b = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.int16).reshape(-1, REGISTERS) for i in (4, 5))
            ok = (np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9) & (estimate(n_a, n_b, (r_a > r_b).sum(1), (r_a < r_b).sum(1)) >= least)
            yield {"a": b.column(0).to_numpy()[ok], "b": b.column(1).to_numpy()[ok]}

    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return map_rows(both.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, elements) of the wanted documents; only texts that a filter of their ids lets through are shuffled."""
    ids = filter_of(wanted, "doc_id", bits_for(wanted.count(), FILTER_BITS))

    def some(batches):
        for b in batches:
            b = b.filter(pa.array(suspected(ids.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            yield {"doc_id": b.column(0), "text": b.column(1)}

    def run(batches):
        hashes = WordHashes()
        for b in batches:
            yield {"doc_id": b.column(0), "elements": [shingle_set(t, hashes, size).view(np.int64) for t in b.column(1).to_pylist()]}

    texts_ = map_rows(docs.filter("doc_id IS NOT NULL"), some, "doc_id long, text string")
    return map_rows(texts_.join(wanted, "doc_id", "left_semi"), run, "doc_id long, elements array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs with 100 * |intersection| >= percent * |union| on full sets."""
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("e_a")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("e_b")), "b"))
    common = F.size(F.array_intersect("e_a", "e_b"))
    return (both.select("a", "b", common.alias("common"), (F.size("e_a") + F.size("e_b")).alias("sum"))
            .filter(F.col("common") * 100 >= (F.col("sum") - F.col("common")) * percent).select("a", "b").distinct())


def _hub_pairs(labelled: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): every bucket member with the bucket's k-th hub, unless both are in one component or the sizes are too far apart."""
    pick = F.struct((F.col("doc_id") if k == 0 else F.xxhash64("doc_id", F.lit(k))).alias("order"), F.col("doc_id"), F.col("n"), F.col("label"))
    hubs = (labelled.groupBy("key").agg(F.min(pick).alias("hub"))
            .select("key", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.label").alias("hub_label")))
    near = f"label <> hub_label AND 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)"
    return labelled.join(hubs, "key").filter(near).select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()


def _families(labelled: DataFrame) -> DataFrame:
    """(doc_id, label, family, members, salts): documents that share SHARED buckets with a hub of them, and so on, are one family.

    Any partition gives right pairs; one that follows the groups of copies gives few of them. Families of one component hold no
    pair to compare, but meet other families.
    """
    hubs = labelled.groupBy("key").agg(F.min("doc_id").alias("b"))
    edges = (labelled.join(hubs, "key").filter("doc_id <> b").groupBy(F.col("doc_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("c"))
             .filter(F.col("c") >= SHARED).select("a", "b"))
    roots = graph_components(edges, keys=()).select(F.col("node").alias("doc_id"), F.col("root").alias("family"))
    nodes = labelled.select("doc_id", "label").distinct().join(roots, "doc_id", "left").withColumn("family", F.coalesce("family", "doc_id"))
    sizes = nodes.groupBy("family").agg(F.count(F.lit(1)).alias("members"), (F.min("label") < F.max("label")).alias("several"))
    return nodes.join(sizes, "family").withColumn("salts", F.floor(F.col("members") / SALTED).cast("int") + 1)


def _from_base(members: DataFrame) -> DataFrame:
    """Members (family, ..., elements) with `x`: what the document has beyond its family's base set and what it lacks of it.

    The base is what more than half of a family hold, so it has at most twice as many shingles as its documents have on average;
    a large family takes it in several copies, a share of the documents each.
    """
    held = members.select("family", "members", F.explode("elements").alias("s")).groupBy("family", "members", "s").agg(F.count(F.lit(1)).alias("c"))
    base = (held.filter("2 * c > members").groupBy("family", "members").agg(F.collect_list("s").alias("base"))
            .select("family", "base", F.explode(F.sequence(F.lit(0), F.floor(F.col("members") / SALTED).cast("int"))).alias("salt")))
    dealt = members.withColumn("salt", F.pmod(F.col("own"), F.col("salts")).cast("int")).join(base, ["family", "salt"], "left")
    apart = F.concat(F.array_except("elements", "base"), F.array_except("base", "elements"))
    return dealt.withColumn("x", F.coalesce(apart, F.col("elements"))).drop("base", "salt")


def _first_common(members: DataFrame, keys: list[str], differ: list[str], percent: int, stages: Stages) -> DataFrame:
    """(a, b) of members (doc_id, label, family, n, own, x, w) of equal `keys` that differ in the columns `differ`, whose sets x
    may have a first common shingle that leaves the threshold in reach.

    Shingles are ordered from the rarest on, those that no pair can share first. What stands before the first common one
    differs, so both places together are at most the greatest difference; and from there on both have the needed overlap.
    The rows that meet are staged: they are few beside all shingles, and both sides of the join read them.
    """
    e = members.select("doc_id", "label", "family", "n", "own", "w", F.size("x").alias("size"), F.explode("x").alias("s"))
    useful = F.lit(True)
    for c in differ:
        useful = useful & (F.min(c) < F.max(c))
    df = e.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("df"), useful.alias("useful"))
    ranked = e.join(df, [*keys, "s"]).groupBy("doc_id", "label", "family", "n", "own", "w", "size").agg(F.sort_array(F.collect_list(F.struct("useful", "df", "s"))).alias("all"))
    # a partner has at most n * 100 / percent shingles
    reach = F.floor((100 - percent) * (F.col("n") + F.col("n") * 100 / percent) / (100 + percent)).cast("int") + 1
    prefix = (ranked.select("doc_id", "label", "family", "n", "own", "w", "size", F.posexplode(F.slice("all", F.lit(1), reach)).alias("at", "p"))
              .filter("p.useful").select("doc_id", "label", "family", "n", "own", "w", "at", F.col("p.s").alias("s"), (F.col("size") - F.col("at")).alias("rest")))
    prefix = stages.add(prefix)
    own = [c for c in ("label", "family", "n", "own", "w", "at", "rest") if c not in keys]
    x, y = (prefix.select("s", *keys, *(F.col(v).alias(f"{v}_{c}") for v in own), F.col("doc_id").alias(c)) for c in "ab")
    near = " AND ".join(["a < b", *(f"{c}_a <> {c}_b" for c in differ), f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)", "w_a + w_b > 0",
                         f"(100 + {percent}) * (at_a + at_b) <= (100 - {percent}) * (n_a + n_b)", f"2 * (100 + {percent}) * least(rest_a, rest_b) >= w_a + w_b"])
    pairs = stages.add(x.join(y, [*keys, "s"]).filter(near).select("a", "b").distinct())
    stages.drop(prefix)
    return pairs


def _prefix_pairs(labelled: DataFrame, sets: DataFrame, percent: int, stages: Stages | None = None) -> DataFrame:
    """(a, b) of different components that can reach the threshold.

    Copies of one text with changes of their own share nearly all of it, so their common shingles tell nothing. Inside a
    family a document is its difference x to the family's base instead, with the same differences between documents:
    |a - b| + |b - a| <= d wherever |x_a| + |x_b| <= d, and else x_a and x_b share some change. With
    w = (100 + percent) * |x| - (100 - percent) * n, pairs with w_a + w_b <= 0 are links for certain; the document of
    the smallest w of a family is then linked with both, so a star around it settles them. All others meet at the first
    common change, documents of different families at the first common shingle that several families hold.
    """
    stages = stages or Stages()
    weight = (100 + percent) * F.size("x") - (100 - percent) * F.col("n")
    nodes = stages.add(_families(labelled))
    # staged one after another, so that the shuffles of a step are gone before the next one begins
    members = stages.add(sets.join(nodes, "doc_id").withColumn("n", F.size("elements")).withColumn("own", F.xxhash64("elements")))
    stages.drop(nodes)
    inside = stages.add(_from_base(members.filter("several")).withColumn("w", weight).drop("elements"))
    least = inside.groupBy("family", "salts").agg(F.min(F.struct("w", "doc_id", "label")).alias("low"))
    spread = least.select("family", "low", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    star = stages.add(inside.select("family", "doc_id", "label", "w", F.pmod(F.col("own"), F.col("salts")).cast("int").alias("salt")).join(spread, ["family", "salt"])
                      .filter("w + low.w <= 0 AND label <> low.label").select(F.least("doc_id", "low.doc_id").alias("a"), F.greatest("doc_id", "low.doc_id").alias("b")))
    near = _first_common(inside, ["family"], ["label"], percent, stages)
    stages.drop(inside)
    far = _first_common(members.withColumn("x", F.col("elements")).withColumn("w", weight), [], ["label", "family"], percent, stages)
    stages.drop(members)
    return star.union(near).union(far).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Shingles are runs of `size` words (white space [\\t-\\r ] between, A-Z lower-cased); fewer words are one shingle; a text
    without words, or null, has none and is linked with nothing. Documents are linked when 100 * intersection >= percent *
    union; component_id is the smallest doc_id reachable; kept marks the row whose doc_id it is. Rows with one doc_id are
    one node, so repeated rows get equal answers; a null doc_id is a node of no component (component_id null, kept true);
    an empty table gives an empty one; other columns are ignored.
    """
    docs = texts(docs)
    threshold = percent / 100
    stages = Stages()
    sk = stages.add(sketches(docs, size))
    known = sk.filter("doc_id IS NOT NULL AND n > 0")
    classes = stages.add(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
    reps = stages.add(known.join(classes.select(F.col("rep").alias("doc_id"), "hi", "lo"), ["doc_id", "hi", "lo"], "left_semi").dropDuplicates(["doc_id", "hi", "lo"]).select("doc_id", "n", "regs"))
    labelled = _shared_buckets(reps, stages)
    # rows of one doc_id with different texts are one node from the start
    same = known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("doc_id")
    links = stages.add(known.join(classes, ["hi", "lo"]).join(same, "doc_id", "left_semi").filter("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct())
    sets = stages.add(_sets(docs, labelled.select("doc_id").distinct(), size).dropDuplicates(["doc_id", "elements"]))
    tested, roots = None, None
    for k in range(HUB_ROUNDS + 1):
        if k:
            past = labelled
            if roots is not None:
                labelled = labelled.drop("label").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("doc_id", "n", "key", F.coalesce("root", "doc_id").alias("label"))
            # a bucket of two is settled by its hub; one of a single component never needs another look
            mixed = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("c")).filter("x < y AND c > 2")
            labelled = stages.add(labelled.join(mixed.select("key"), "key", "left_semi"))
            stages.drop(past)
            if labelled.isEmpty():
                break
        pairs = _hub_pairs(labelled, k, percent) if k < HUB_ROUNDS else _prefix_pairs(labelled, sets, percent, stages)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stages.add(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        likely = stages.add(_likely(pairs, reps, threshold))
        found = stages.add(_confirmed(likely, sets, percent))
        stages.drop(likely)
        if not found.isEmpty():
            links = links.union(found)
            stages.drop(roots)
            roots = stages.add(graph_components(links, keys=()))
    if roots is None and not links.isEmpty():
        roots = stages.add(graph_components(links, keys=()))
    stages.drop(sets, reps, labelled)
    out = sk.select("doc_id", "n", "hi", "lo").join(classes, ["hi", "lo"], "left")
    if roots is not None:
        out = out.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)
