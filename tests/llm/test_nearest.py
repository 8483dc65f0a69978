import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import nearest as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k=5):
    def good(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    table = {(i, tuple(v)) for i, v in rows if i is not None and good(v)}
    out = set()
    asked = {(i, tuple(v)) for i, v in queries if i is not None and good(v)}
    for q in {i for i, _ in asked}:
        best = {}
        for i, v, w in [(i, v, w) for i, v in table for a, w in asked if a == q]:
            if i != q and len(v) == len(w):
                s = float(N.cosines(np.array(w, np.float64), np.array([v], np.float64))[0])
                best[i] = max(s, best.get(i, -2))
        for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1):
            out.add((q, rank, i, round(s, 12)))
    return out


ODD = [
    (1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]),
    (8, [float("nan"), 1.0, 0.0]), (9, [float("inf"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [1e30, 1e30, 0.0]), (11, [1e-30, 1e-30, 0.0]), (12, [-1.0, 0.0, -0.0]), (13, [1.0, 2.0]), (16, [2.0, 1.0]), (17, [2.0, 1.0]), (17, [1.0, 1.0]), (18, [5.0]),
    (14, [0.3, 0.4, 0.5]), (14, [0.3, 0.4, 0.5]), (15, []), *[(20 + i, [0.5, 0.5, 0.5]) for i in range(12)],
]


def test_odd_rows_as_brute_force(spark):
    df = spark.createDataFrame([(i, v, 1) for i, v in ODD], SCHEMA).withColumn("vector", F.lit(3)).withColumn("ids", F.lit(3)).withColumn("list", F.lit(3))
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in N.nearest(df, df).collect()}
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in ODD]
    assert got == brute(rows, rows)


def test_mixed_lengths_and_repeated_ids_as_brute_force(spark):
    """Two lengths with lists of their own, rare lengths, and one id with more vectors near each other than there are places."""
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=2 if i % 3 else 3).astype(np.float32).tolist()) for i in range(300)]
    rows += [(500, [1.0, j / 100]) for j in range(30)] + [(501 + j, [1.0, 0.5 + j / 50]) for j in range(5)] + [(600 + j, [1.0] * (4 + j % 9)) for j in range(30)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    asked = [r for r in rows if r[0] % 50 == 0 or r[0] >= 500]
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 12)) for r in N.nearest(df, df.where("vec_id % 50 = 0 or vec_id >= 500"), list_rows=1000, most_lengths=2).collect()}
    assert got == brute(rows, asked)


@pytest.mark.parametrize("spread,least", [(0.25, 0.95), (3.0, 0.9)])
def test_recall_through_the_graph_on_many_lists(spread, least):
    """Lists of 50 among 20000 vectors, in clusters and without structure: 400 centroids, walked by the graph."""
    draw = np.random.default_rng(4)
    middles = draw.normal(size=(60, 24))
    points = N.unit((middles[draw.integers(0, 60, 20_000)] + spread * draw.normal(size=(20_000, 24))).astype(np.float32))
    lists = N.fit(points[:8000], len(points), list_rows=50)
    owner, home = lists.homes(points)
    held = [set() for _ in lists.centroids]
    for o, h in zip(owner, home):
        held[h].add(o)
    asked = points[:200]
    at, which = lists.searched(asked)
    hit = read = 0
    for i in range(200):
        found = set().union(*(held[x] for x in which[at == i]))
        like = points @ asked[i]
        hit += len(found & set(np.argsort(-like)[:6]))
        read += len(found)
    assert hit / 1200 >= least
    assert spread > 1 or read / 200 < 0.25 * len(points)


def test_recall_on_real_vectors(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = N.nearest(df, df.where("vec_id % 5 = 0"), list_rows=20).collect()
    ids, v = zip(*[(r.vec_id, r.embedding) for r in df.collect()])
    m = N.unit64(np.array(v, np.float64))
    hit = total = 0
    by = {}
    for r in got:
        by.setdefault(r.query_id, set()).add(r.vec_id)
    for q, i in ((i, n) for n, i in enumerate(ids) if i % 5 == 0 for q in [0]):
        pass
    for n, i in enumerate(ids):
        if i % 5 == 0:
            like = m @ m[n]
            like[n] = -2
            true = {ids[j] for j in np.argsort(-like)[:5]}
            hit += len(true & by[i])
            total += 5
    assert hit / total >= 0.9


def test_graph_walk_finds_near_centroids():
    draw = np.random.default_rng(1)
    points = N.unit(draw.normal(size=(3000, 16)).astype(np.float32))
    lists = N.Lists(N.balanced_centroids(points, 512), None)
    lists.graph = N.centroid_graph(lists.centroids)
    at, d = lists.near(points[:200], 24)
    true = np.argsort(-(points[:200] @ lists.centroids.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(t)) / 8 for a, t in zip(at, true)]) > 0.95
    assert (np.diff(d, axis=1) >= 0).all()


def test_lists_are_balanced_and_boundaries_replicated():
    draw = np.random.default_rng(2)
    points = N.unit(np.concatenate([draw.normal(size=(1500, 8)) * 0.05 + 1, draw.normal(size=(500, 8))]).astype(np.float32))
    lists = N.fit(points, len(points), list_rows=60)
    owner, home = lists.homes(points)
    assert set(owner) == set(range(len(points))) and len(owner) > len(points)
    assert np.bincount(owner).max() <= lists.replicas
    assert np.bincount(home).max() < 8 * len(owner) / len(lists.centroids)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0, 3.0], 0)], [(1, None, 0)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert N.nearest(df, df).count() == 0
