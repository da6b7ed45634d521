"""Centroid clustering against Lloyd's rounds in plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from leadmill.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster string, row string, key string"


def brute(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    centres = [v for _, v in sorted(((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None))[:k]]
    near = lambda v: min(range(len(centres)), key=lambda c: (apart(v, centres[c]), c))
    for _ in range(rounds):
        held = [[] for _ in centres]
        for _, v in kept:
            held[near(v)].append(v)
        centres = [[sum(x) // len(h) for x in zip(*h, strict=True)] if h else c for h, c in zip(held, centres, strict=True)]
    found = [(i, near(v), apart(v, centres[near(v)])) for i, v in kept]
    inertia = {c: sum(d for _, x, d in found if x == c) for c in range(len(centres))}
    most = centroids.MOST
    return sorted((str(i), c, min(d, most), min(inertia[c], most), min(sum(inertia.values()), most), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found)


def ours(spark, rows, **more):
    df = centroids.cluster(spark.createDataFrame([(i, v, "x", "y", "z") for i, v in rows], SCHEMA), **more)
    assert df.columns == ["vec_id", "row", "key", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((str(r["vec_id"]), *r[3:]) for r in df.collect())


def vectors(n, seed, dims=64, spread=1.0):
    r = random.Random(seed)
    middles = [[r.uniform(-spread, spread) for _ in range(dims)] for _ in range(5)]
    return [[x + r.gauss(0, spread / 3) for x in r.choice(middles)] for _ in range(n)]


@pytest.mark.parametrize("case", ["plain", "odd rows", "few", "equal", "huge"])
def test_clusters_equal_plain_integers(spark, case):
    rows = list(enumerate(vectors(120, 5)))
    if case == "odd rows":
        v = rows[0][1]
        rows += [(500, None), (501, []), (502, v[:63]), (503, [*v, 0.0]), (504, [None, *v[1:]]), (505, [math.nan, *v[1:]]), (506, [math.inf, *v[1:]]), (None, v), (3, rows[3][1]), (3, rows[3][1]), (3, v)]
    if case == "few":
        rows = rows[:3]
    if case == "equal":
        rows = [(i, [0.5] * 64) for i in range(20)] + [(30 + i, [0.5] * 63 + [0.25 * i]) for i in range(4)]
    if case == "huge":
        rows = [(i, [x * (1e30 if i % 3 else 1.7e308) for x in v]) for i, v in enumerate(vectors(30, 7))]
        rows = [(i, [max(min(x, 1.7e308), -1.7e308) for x in v]) for i, v in rows]
    assert ours(spark, rows) == brute(rows)


def test_no_vectors(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(1, None), (2, [1.0])]) == []


def test_the_walk_is_exact_and_ends_early():
    r = np.random.default_rng(1)
    for dims, k in ((1, 1), (2, 40), (3, 200), (64, 8)):
        centres = r.integers(-50, 50, (k, dims))
        x = np.concatenate([r.integers(-60, 60, (200, dims)), centres[:5]])
        near, far = centroids.Nearest(centres.tolist()).find(x)
        every = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (near == every.argmin(1)).all() and (far == every.min(1)).all()
