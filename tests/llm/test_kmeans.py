"""Yinyang k-means against plain rounds of k-means in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from flowgauge.llm import kmeans as K

SCHEMA = "vec_id long, embedding array<double>, cluster string, x int"


def brute(rows, k, rounds, dim, scale=64):
    """Rows (vec_id, vector) to (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = [(i, [math.floor(scale * e) for e in v]) for i, v in rows if v is not None and len(v) == dim and all(e is not None and math.isfinite(e) for e in v)]
    name = lambda i: (i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest())
    cs = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        owned = [near(v)[1] for _, v in kept]
        for n in range(len(cs)):
            mine = [v for (_, v), o in zip(kept, owned) if o == n]
            if mine:
                cs[n] = [sum(col) // len(mine) for col in zip(*mine)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = lambda c: sum(d for _, d, n in last if c in (n, None))
    cap = lambda d: min(d, K.LONGEST)
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, n, cap(d), cap(inertia(n)), cap(inertia(None)), text[n]) for i, d, n in last), key=str)


def check(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "c", 1) for i, v in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, K.kmeans(table, **options).collect()), key=str)
    assert got == brute(rows, options["k"], options.get("rounds", 3), options["dim"])


def test_ties_repeats_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 4) / 64).tolist()) for i in range(400)]  # a small grid: many ties and equal vectors
    rows += [(7, [0.1, 0.2, 0.3, 0.4])] * 3 + [(None, [0.0, 0.0, 0.0, 0.1]), (None, [0.0, 0.0, 0.0, 0.1])]
    rows += [(500, None), (501, [0.1, None, 0.2, 0.3]), (502, [0.1, float("nan"), 0.2, 0.3]), (503, [0.1] * 3), (504, [float("inf")] * 4), (505, [])]
    check(spark, rows, k=9, dim=4)


def test_fewer_vectors_than_centroids_and_none(spark):
    check(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (None, [1.0, -1.0])], k=5, dim=2)
    assert K.kmeans(spark.createDataFrame([], SCHEMA)).count() == 0
    assert K.kmeans(spark.createDataFrame([(1, None, "c", 1)], SCHEMA)).count() == 0


def test_large_components(spark):
    """Beyond what doubles hold exactly, and distances beyond 64 bits."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 12)).tolist()) for i in range(200)]
    check(spark, rows, k=6, dim=3)


@pytest.mark.parametrize("k,groups", [(16, 4), (1, 1), (7, 7), (12, 1)])
def test_filters_lose_nothing(k, groups):
    """Assignments under moving centroids equal a full scan; after the first round most distances are not computed."""
    rng = np.random.default_rng(k)
    centres = rng.integers(-200, 200, (k, 8))
    x = (centres[rng.integers(0, k, 3000)] + rng.integers(-20, 21, (3000, 8))).astype(float)
    c = centres.astype(object) + rng.integers(-30, 31, (k, 8))
    of = K.group_centroids(c, groups)
    cluster, upper, lower = np.zeros(3000, np.int32), np.full(3000, np.inf), np.full((3000, of.max() + 1), -np.inf)
    work = []
    for _ in range(6):
        cluster, upper, lower, n = K.assign(x, c, of, cluster, upper, lower)
        d = K._square(x, c.astype(float))
        assert (cluster == d.argmin(axis=1)).all()
        root = np.sqrt(d)
        assert (upper >= root[np.arange(3000), cluster]).all()
        root[np.arange(3000), cluster] = np.inf
        assert all((lower[:, g] <= root[:, of == g].min(axis=1)).all() for g in range(of.max() + 1))
        work.append(n)
        old = c.copy()
        for j in range(k):
            if (cluster == j).any():
                c[j] = [int(s) // int((cluster == j).sum()) for s in x[cluster == j].sum(axis=0)]
        far, farthest = K._moves(old, c, of)
        upper, lower = upper + far[cluster], lower - farthest
    assert work[0] >= 3000 * k and (k == 1 or sum(work[3:]) < 0.2 * 3 * 3000 * k)
