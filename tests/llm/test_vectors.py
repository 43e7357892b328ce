"""Filter orders, nearest neighbours and clusters against brute force."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from pixelweave.llm import centroids, filter_audit, neighbours

F32 = np.float32


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {x for x, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                                               bool(re.search("[#$%&*|]", t)), i is not None and first[t] < i), strict=True) if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for order in permutations("ABCDE"):
        for step, x in enumerate(order):
            before = set(order[:step])
            for part in {d[0] for d in docs}:
                own = [d for d in docs if d[0] == part]
                gone = [d for d in own if x in d[1] and not d[1] & before]
                out[part, "".join(order), step + 1] = [sum(not d[1] & (before | {x}) for d in own), len(gone), sum(x in d[1] and bool(d[1] & before) for d in own),
                                                       sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
    share = Counter()
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] += v[1]
    return sorted((*k, *v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def audit_rows(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, g, 1, "x", 2) for i, t, g in rows], "doc_id long, text string, lang string, n int, h1 string, bits int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(map(tuple, filter_audit.filter_audit(docs, marks).collect()))


def test_audit_edge_rows(spark, edge_rows, monkeypatch):
    monkeypatch.setattr(filter_audit, "COPIES_PER_SALT", 3)
    kinds = [None, "", "en", "de"]
    rows = [(i, t, kinds[k % 4]) for k, (i, t) in enumerate(edge_rows)] + [(300 + k, "Same | text", "en") for k in range(40)]
    rows += [(500, "own text", "en"), (500, "Same | text", "de"), (1, "own text", "en"), (-5, "own text", "fr")]
    labels = [(k, k % 2, k % 3 == 0) for k in range(-5, 340)] + [(4, None, 1), (None, 1, 1), (4, 1, None)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    assert audit_rows(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_nothing(spark):
    assert audit_rows(spark, [], []) == []


def brute_near(ids, x, asked, k):
    out = {}
    for q in asked:
        scores = []
        for i, v in zip(ids, x, strict=True):
            if i != ids[q]:
                scores.append((-math.fsum(v * x[q]) / math.sqrt(math.fsum(v * v) * math.fsum(x[q] * x[q])), i))
        out[ids[q]] = sorted(scores)[:k]
    return out


def vector_rows(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, t string, bucket int").repartition(4)


def test_neighbours_of_the_given_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in table.collect())
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    want = brute_near(ids, x, [k for k, i in enumerate(ids) if i % 50 == 0], 5)
    got = neighbours.op12(spark, sf_dir.replace("0.001", "0.1")).collect()
    assert {r.query_id for r in got} == set(want) and Counter(r.query_id for r in got) == Counter({q: 5 for q in want})
    by = {q: sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q) for q in want}
    hit = 0
    for q, near in want.items():
        assert [r for r, _, _ in by[q]] == [1, 2, 3, 4, 5] and [s for _, _, s in by[q]] == sorted((s for _, _, s in by[q]), reverse=True)
        hit += len({v for _, v, _ in by[q]} & {i for _, i in near})
        k = {i: n for n, i in enumerate(ids)}
        for _, v, s in by[q]:
            a, b = x[k[q]], x[k[v]]
            assert abs(s - math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))) < 1e-12
    assert hit >= 0.93 * 5 * len(want)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_edge_rows(spark, monkeypatch, kind):
    """One block size for all buckets, a hot group of copies, ties, odd lengths, and rows that take no part."""
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    monkeypatch.setattr(neighbours, "ASKED", 4)
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=6).astype(F32).tolist()) for k in range(150)]
    rows += [(200 + k, rows[7][1]) for k in range(80)] + [(300 + k, (np.array(rows[7][1], F32) * F32(2)).tolist()) for k in range(10)] + [rows[3], rows[3]]
    rows += [(400, [1.0, 2.0]), (401, [1.0, 2.0, 0.0, 0.0]), (402, [1e30, -1e30, 1e-30]), (403, [0.5, 0.5, 0.5])]
    none = [(None, [1.0] * 6), (500, None), (501, []), (502, [0.0] * 6), (503, [float("nan")] * 6), (504, [1.0, None]), (550, [float("inf"), 1.0]), (600, [float("nan")] * 2)]
    df = vector_rows(spark, rows + none, kind)
    got = neighbours.nearest_neighbours(df, df.filter("vec_id % 50 = 0 OR vec_id IN (7, 210, 3, 402)"), bucket=30).collect()
    once = dict(rows)
    ids, x = list(once), np.array([v + [0.0] * (6 - len(v)) for v in once.values()])
    asked = [k for k, i in enumerate(ids) if i % 50 == 0 or i in (7, 210, 3, 402)]
    want = brute_near(ids, x, asked, 5)
    assert Counter(r.query_id for r in got) == Counter({q: 5 for q in want})
    hits = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in near}) for q, near in want.items())
    assert hits >= 0.9 * 5 * len(want)
    for q in (7, 210):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [i for i in (7, 200, 201, 202, 203, 204) if i != q][:5]


def test_few_and_no_vectors(spark):
    few = vector_rows(spark, [(50, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])])
    got = sorted((r.rank, r.vec_id, round(r.score, 12)) for r in neighbours.nearest_neighbours(few, few.filter("vec_id = 50")).collect())
    assert got == [(1, 1, round(math.sqrt(0.5), 12)), (2, 2, 0.0)]
    assert neighbours.nearest_neighbours(few.limit(0), few).count() == 0
    assert neighbours.nearest_neighbours(few, few.filter("vec_id = 9")).count() == 0
    assert neighbours.nearest_neighbours(few.filter("vec_id = 50"), few.filter("vec_id = 50")).count() == 0


def test_blocks_serve_what_the_tables_miss(spark):
    """A query far from all others, whose buckets are empty, still gets its neighbours."""
    rng = np.random.default_rng(8)
    rows = [(k, (np.eye(32)[0] + 0.01 * rng.normal(size=32)).tolist()) for k in range(1, 900)] + [(1000, (-np.eye(32)[3]).tolist())]
    df = vector_rows(spark, rows, "double")
    got = neighbours.nearest_neighbours(df, df.filter("vec_id = 1000 OR vec_id < 300"), bucket=4).filter("query_id = 1000").collect()
    x = np.array([v for _, v in rows])
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank)] == [i for _, i in brute_near([i for i, _ in rows], x, [899], 5)[1000]]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(neighbours.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    h = neighbours.Hashing(13, 9)
    u = neighbours.unit(np.random.default_rng(2).normal(size=(40, 13)))
    for t in range(h.tables):
        probes = h.probes(u, t, 600)
        assert (probes[:, 0] == h.bucket(u, t)).all() and probes.shape[1] == 512 and all(len(set(p)) == 512 for p in probes.tolist())


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cents = [v for _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        for n, vs in own.items():
            cents[n] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, n in last:
        inertia[n] += d
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, cents[n])).encode()).hexdigest()) for i, d, n in last), key=str)


@pytest.mark.parametrize(("k", "rounds"), [(5, 3), (60, 2)])
def test_clusters(spark, k, rounds):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).astype(F32).tolist()) for i in range(40)]
    rows += [(100 + i, rows[4][1]) for i in range(30)] + [rows[0], rows[0], (7, [0.0, 1.0, -1.0, 2.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    rows += [(900, None), (901, []), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [float("nan")] * 4), (905, [1.0, 2.0, 3.0, float("-inf")])]
    got = centroids.cluster_vectors(vector_rows(spark, rows), k, rounds, 4).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters(rows, k, rounds, 4)


def test_clusters_of_nothing(spark):
    df = vector_rows(spark, [(1, None), (None, [1.0])])
    assert centroids.cluster_vectors(df, dim=1).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster_vectors(df, dim=1).count() == 0 and centroids.cluster_vectors(df.limit(0)).count() == 0
