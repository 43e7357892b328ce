"""Lines, byte strings and near duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.llm import lines, neardup, suffixes
from pixelweave.llm.blooms import Pair, _inside, _places

SPACE = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(SPACE))
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n") if i is not None else ():
            first[key(x)] = min(i, first.get(key(x), i))
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or len(key(x)) < 10 or first[key(x)] == i]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


def brute_bytes(rows, length=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1) if i is not None else ():
            s = b[k:k + length]
            first[s] = min(i, first.get(s, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k:k + length]] < i:
                gone[k:k + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def brute_near(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            by[x].append(k)
    common = Counter()
    for own in by.values():
        for a in own:
            for b in own:
                if a < b:
                    common[a, b] += 1
    for (a, b), n in common.items():
        i, j = rows[a][0], rows[b][0]
        if i is not None and j is not None and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [(i, len(s), None if i is None else find(i), i is None or find(i) == i) for (i, _), s in zip(rows, sets, strict=True)]


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


@pytest.mark.parametrize("bits", [27, 6])
def test_lines(edge, edge_rows, bits):
    same(lines.line_dedup(edge, bits=bits).collect(), brute_lines(edge_rows))


def test_lines_in_place(edge, edge_rows):
    out = lines.without_lines(edge, lines.repeated_lines(edge.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    assert out.columns == edge.columns
    want = Counter((i, None if t is None else kept) for (i, t), (_, _, _, kept) in zip(edge_rows, brute_lines(edge_rows), strict=True))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == want
    assert out.filter(F.length("text") != F.col("n_chars")).count() == 0


def test_lines_whole_table(docs, doc_rows):
    same(lines.line_dedup(docs).collect(), brute_lines(doc_rows))


@pytest.mark.parametrize(("bits", "group"), [(24, 1000), (24, 1), (6, 3)])
def test_bytes(edge, edge_rows, bits, group):
    got = suffixes.suffix_dedup(edge, bits=bits, group=group).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, brute_bytes(edge_rows))


def test_bytes_of_several_texts_under_one_id(spark):
    rnd = random.Random(4)
    u, v, w = ("".join(rnd.choice("abcdefgh ") for _ in range(400)) for _ in range(3))
    rows = [(1, u), (2, u), (2, v), (2, v), (3, w + v[:80]), (3, v[100:200] + w), (3, ""), (4, w), (4, None), (None, u)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, brute_bytes(rows))
    assert sorted(r.n_removed for r in got if r.doc_id == 2) == [0, 0, 400]


def test_bytes_whole_table(docs, doc_rows):
    same(suffixes.suffix_dedup(docs, bits=24).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect(), brute_bytes(doc_rows))


def test_longest_previous_factors():
    rnd = random.Random(8)
    for n in (1, 2, 7, 150):
        rows = [(rnd.randrange(3), rnd.randrange(1, 1 + n), bytes(rnd.choice(b"ab") for _ in range(rnd.choice((2, 5, 50)))).ljust(50, b"c")) for _ in range(n)]
        rows += [(g, d + rnd.randrange(3), s) for g, d, s in rows[:n // 2]]
        group, docs, strings = zip(*rows, strict=True)

        def common(a, b):
            return next((k for k in range(50) if a[k] != b[k]), 50)

        want = [max((common(s, t) for h, e, t in rows if h == g and e < d), default=0) for g, d, s in rows]
        got = suffixes.longest_previous_factors(np.array(group), np.array(docs), np.array([list(s) for s in strings], np.uint8))
        assert got.tolist() == want


def test_bytes_frequent_contents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "FREQUENT", 3)  # read by the driver: the passage is spread over salts
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(120))
    rows = [(k, "".join(rnd.choice("ijklmnop ") for _ in range(70)) + passage + str(k)) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffixes.suffix_dedup(df, bits=16, group=20).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    same(got, brute_bytes(rows))
    assert sum(r.n_removed >= 120 for r in got) == 79


def test_bytes_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 700)  # driver side; the workers cut by their own value
    rng = np.random.default_rng(3)
    body = bytes(rng.integers(97, 100, 9000, dtype=np.uint8)).decode()
    data = np.frombuffer(body.encode(), np.uint8)
    whole = suffixes.segments(data, np.array([len(data)]))
    import pyarrow as pa

    batch = pa.record_batch([pa.array([5, 6]), pa.array([body.encode(), b"short"], pa.binary())], names=["doc_id", "text"])
    seen = set()
    for part, ends, ids, base in suffixes.pieces(batch):
        first, n, anchor, _ = suffixes.segments(part, ends)
        doc = np.searchsorted(ends, first, "right")
        assert set(ids[doc]) <= {5}
        for f, k, a, d in zip(first, n, anchor, doc, strict=True):
            seen |= {(base[d] + f + x, base[d] + a) for x in range(k)}
    assert seen == {(f + x, a) for f, k, a in zip(*whole[:3], strict=True) for x in range(k)}
    assert len(seen) == len(body) - 49


@pytest.mark.parametrize(("size", "percent"), [(2, 80), (5, 80), (2, 50)])
def test_near(edge, edge_rows, size, percent):
    same(neardup.near_duplicates(edge, size, percent).collect(), brute_near(edge_rows, size, percent))


def test_near_whole_table(docs, doc_rows):
    same(neardup.near_duplicates(docs, 2).collect(), brute_near(doc_rows, 2, 80))


def test_near_chains(spark):
    """Groups that one hub does not join: each text is near the next one only."""
    words = [f"w{k}" for k in range(260)]
    rows = [(1000 * g + k, " ".join(f"g{g}" + w for w in words[4 * k:4 * k + 100])) for g in range(3) for k in (5, 3, 0, 8, 12, 20, 21, 16)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    same(neardup.near_duplicates(df, 2).collect(), brute_near(rows, 2, 80))


@pytest.mark.parametrize("percent", [50, 80])
def test_prefix_rule_misses_no_pair(spark, percent):
    """Copies of one set with up to a quarter replaced, half of them from a small stock, in many components."""
    rnd = random.Random(percent)
    sets = {}
    for d in range(90):
        kept = rnd.sample(range(100), rnd.randrange(75, 101))
        sets[d] = sorted(set(kept + [rnd.choice([rnd.randrange(200, 230), rnd.randrange(1000, 9000)]) for _ in range(rnd.randrange(25))]))
    label = {d: rnd.choice([d, 0, 1]) for d in sets}
    labelled = spark.createDataFrame([(d, len(e), 1, label[d]) for d, e in sets.items()], "doc_id long, n long, key long, label long")
    got = {(r.a, r.b) for r in neardup._prefix_pairs(labelled, spark.createDataFrame(list(sets.items()), "doc_id long, elements array<long>"), percent).collect()}
    share = lambda a, b: len({*sets[a]} & {*sets[b]}) * 100 / len({*sets[a]} | {*sets[b]})
    pairs = [(a, b) for a in sets for b in sets if a < b and label[a] != label[b]]
    wanted = {(a, b) for a, b in pairs if share(a, b) >= percent}
    assert wanted and wanted <= got <= set(pairs)


def test_prefix_rule_goes_step_by_step(spark, monkeypatch):
    """No single plan holds all its shuffles at once, and large tables of its steps are gone at the end."""
    added, dropped, shuffles = [], [], lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    add, drop = neardup.Stages.add, neardup.Stages.drop
    monkeypatch.setattr(neardup.Stages, "add", lambda self, df: added.append((shuffles(df), add(self, df))) or added[-1][1])
    monkeypatch.setattr(neardup.Stages, "drop", lambda self, *x: dropped.extend(x) or drop(self, *x))
    sets = [(d, [*range(40), 100 + d]) for d in range(12)]
    labelled = spark.createDataFrame([(d, len(e), d % 3, d) for d, e in sets], "doc_id long, n long, key long, label long")
    pairs = neardup._prefix_pairs(labelled, spark.createDataFrame(sets, "doc_id long, elements array<long>"), 80)
    assert max([shuffles(pairs), *(n for n, _ in added)]) <= 12
    assert all(any(t is x for x in dropped) for _, t in added if "elements" in t.columns or "x" in t.columns)
    assert {x for r in pairs.collect() for x in r} == set(range(12))


def test_estimate_follows_similarity():
    rng = np.random.default_rng(0)
    for share in (0.5, 0.8, 0.95):
        got = []
        for _ in range(60):
            x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
            n = int(400 * share)
            a, b = neardup.registers(x), neardup.registers(np.concatenate([x[:n], rng.integers(0, 1 << 63, 400 - n, dtype=np.uint64)]))
            got.append(neardup.estimate(np.array([400.0]), np.array([400.0]), np.array([(a > b).sum()]), np.array([(a < b).sum()]))[0])
        assert abs(np.mean(got) - n / (800 - n)) < 0.03


def test_registers_merge():
    rng = np.random.default_rng(1)
    x, y = (rng.integers(0, 1 << 63, 1500, dtype=np.uint64) for _ in range(2))
    assert (neardup.registers(np.concatenate([x, y])) == np.maximum(neardup.registers(x), neardup.registers(y))).all()


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for bits in (6, 12, 20):
        a, b = Pair(bits), Pair(bits)
        a.add(h[:2000])
        b.add(h[1500:])
        a.add(h[:100])
        twice = a.twice | b.twice | a.once & b.once
        assert _inside(twice, _places(np.concatenate([h[:100], h[1500:2000]]), a.mask)).all()


def test_empty(nothing):
    assert lines.line_dedup(nothing).count() == suffixes.suffix_dedup(nothing, bits=10).count() == neardup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("rounds", [2, 0])
def test_near_of_several_texts_under_one_id(spark, monkeypatch, rounds):
    """Two sets of equal size under one doc_id, and repeated rows; without hub rounds the prefix rule finds all links."""
    monkeypatch.setattr(neardup, "HUB_ROUNDS", rounds)
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(10 ** 6)}" for _ in range(60)] for _ in range(3)]

    def near(words, k):
        out = list(words)
        for _ in range(k):
            out[rnd.randrange(len(out))] = f"x{rnd.randrange(10 ** 6)}"
        return " ".join(out)

    rows = [(1, " ".join(base[0])), (2, " ".join(base[1])), (9, near(base[0], 2)), (9, near(base[1], 2)), (5, near(base[2], 1)), (5, near(base[2], 1)), (6, " ".join(base[2])), (6, " ".join(base[2])),
            (7, near(base[0], 9)), (8, near(base[0], 3)), (8, near(base[0], 4))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(neardup.near_duplicates(df, 2, 80).collect(), brute_near(rows, 2, 80))


@pytest.mark.parametrize("percent", [50, 80])
def test_families_lose_no_component(spark, percent, monkeypatch):
    """Copies of two bases with shared and own changes, spread over components and buckets: the pairs that reach the threshold join the same components as all of them."""
    monkeypatch.setattr(neardup, "SALTED", 20)
    rnd = random.Random(100 + percent)
    sets, family = {}, {}
    for d in range(160):
        family[d] = rnd.randrange(2)
        base = range(100) if family[d] else range(60, 160)
        lost = set(rnd.sample([x for x in base if x % 4 == 0 or rnd.random() < 0.1], rnd.randrange(3, 18)))
        sets[d] = sorted((set(base) - lost) | {rnd.choice([rnd.randrange(200, 215), rnd.randrange(1000, 9000)]) for _ in range(rnd.randrange(12))})
    sets[500] = list(range(60, 160))
    family[500] = 0
    label = {d: rnd.choice([d, d, 0, 1]) for d in sets}
    buckets = [(d, len(sets[d]), k, label[d]) for d in sets for k in range(8) if k == 7 or (k < 4) == bool(family[d])]
    labelled = spark.createDataFrame(buckets, "doc_id long, n long, key long, label long")
    assert neardup._families(labelled).filter("members > 20").select("family").distinct().count() == 2
    got = {(r.a, r.b) for r in neardup._prefix_pairs(labelled, spark.createDataFrame(list(sets.items()), "doc_id long, elements array<long>"), percent).collect()}
    pairs = {(a, b) for a in sets for b in sets if a < b and label[a] != label[b]}
    wanted = {(a, b) for a, b in pairs if 100 * len({*sets[a]} & {*sets[b]}) >= percent * len({*sets[a]} | {*sets[b]})}
    assert wanted and got <= pairs

    def components(links):
        root = {x: x for x in label.values()}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            x, y = sorted((find(label[a]), find(label[b])))
            root[y] = x
        return {x: find(x) for x in root}

    assert components(got & wanted) == components(wanted)
