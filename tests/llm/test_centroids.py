"""Centroid clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from cohortspark.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, cluster int, x string"


def plain(rows, dims, count=16, rounds=3):
    kept = [(v, [math.floor(64 * float(np.float32(c))) for c in e]) for v, e in rows if e is not None and len(e) == dims and all(c is not None and math.isfinite(c) for c in e)]
    cents = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:count]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        cents = [[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else old for k, old in enumerate(cents)]
    at = [(v, *nearest(x)) for v, x in kept]
    whole = sum(d for _, d, _ in at)
    return sorted(((v, k, d, sum(e for _, e, j in at if j == k), whole, hashlib.sha256(",".join(map(str, cents[k])).encode()).hexdigest()) for v, d, k in at), key=repr)


def run(spark, rows, dims=64):
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], SCHEMA)
    return sorted((tuple(r) for r in centroids.centroid_clusters(df, dimensions=dims).drop("centroid").collect()), key=repr)


def test_equals_plain_rounds(spark):
    r = random.Random(3)
    rows = [(k, [r.gauss((k % 20) / 10, 0.3) for _ in range(64)]) for k in range(300)]
    assert run(spark, rows) == plain(rows, 64)


@pytest.mark.parametrize("seed", range(3))
def test_ties_and_repeats(spark, seed):
    """Few values in few dimensions: many centroids are equally near, equal or empty."""
    r = random.Random(seed)
    rows = [(r.choice([None, *range(40)]), [r.choice([-0.02, 0.0, 0.02, 0.5]) for _ in range(3)]) for _ in range(150)]
    assert run(spark, rows, 3) == plain(rows, 3)


def test_rows_left_out(spark):
    good = [0.5] * 4
    rows = [(1, good), (1, good), (2, None), (3, [0.5] * 3), (4, []), (5, [0.1, None, 0.2, 0.3]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, -1.0, 0.0, -0.001])]
    assert run(spark, rows, 4) == plain(rows, 4)
    assert run(spark, rows[2:3], 4) == [] and run(spark, [], 4) == []
    huge = run(spark, [(1, [3e38, 0.0]), (2, [-3e38, 0.0])], 2)
    assert [x[1:3] for x in huge] == [(0, 0), (1, 0)] or [x[1:3] for x in huge] == [(1, 0), (0, 0)]


def test_threshold_walk_equals_all_distances():
    g = np.random.default_rng(5)
    for dims in (1, 2, 64):
        cents, x = g.integers(-6, 6, (16, dims)), g.integers(-8, 8, (500, dims))
        every = ((x[:, None] - cents) ** 2).sum(axis=2)
        at, best = centroids.Lists(cents).nearest(x)
        assert (at == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all()
