"""Centroid clusters against plain Lloyd rounds in Python's integers, and what the trees save."""

import hashlib
import math
import random

import numpy as np
import pytest

from millrace.llm.balltree import TREE, assigned, built, centroid_clusters, integers


def plain(rows, clusters=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * v) if abs(v) < 1e300 else int(v) * 1024 for v in x]) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    begin = sorted(((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", x) for i, x in kept), key=lambda t: (t[0], t[1], t[2]))[:clusters]
    centroids = [x for *_, x in begin]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            own = [x for (_, x), c in zip(kept, of, strict=True) if c == k]
            if own:
                centroids[k] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    found = [(i, *nearest(x)[::-1]) for i, x in kept]
    fits = lambda v: v if v < 1 << 63 else None
    per = {}
    for _, c, d in found:
        per.setdefault(c, []).append(d)
    total = lambda ds: None if any(d >= 1 << 63 for d in ds) else fits(sum(ds))
    every = total([d for _, _, d in found])
    return sorted(((i, c, fits(d), total(per[c]), every, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def vectors(seed=0, n=300, dims=64):
    r = random.Random(seed)
    middles = [[r.uniform(-1, 1) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [m + r.gauss(0, 0.05) for m in r.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    return rows, [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [None] + [0.5] * 63), (2005, [math.nan] * 64), (2006, [math.inf] + [0.0] * 63)]


SCHEMA = "vec_id long, embedding array<double>, id string, x string, cluster string, c int"
extra = lambda rows: [(*r, "a", "b", "c", 1) for r in rows]


@pytest.mark.parametrize("tree", [TREE, 70])
def test_against_plain_rounds(spark, tree):
    good, odd = vectors()
    df = spark.createDataFrame(extra(good + odd), SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in centroid_clusters(df, tree=tree).collect()), key=repr) == plain(good + odd)


def test_huge_components_stay_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 3, 5, 20, 300, 306]) for _ in range(64)]) for i in range(40)]
    df = spark.createDataFrame(extra(rows), SCHEMA).repartition(2)
    assert sorted((tuple(x) for x in centroid_clusters(df).collect()), key=repr) == plain(rows)


def test_few_equal_and_no_vectors(spark):
    for rows in ([], [(1, [0.25] * 64)], [(i, [0.25] * 64) for i in range(20)], [(i, [float(i)] * 64) for i in range(3)]):
        df = spark.createDataFrame(extra(rows), SCHEMA)
        assert sorted((tuple(x) for x in centroid_clusters(df).collect()), key=repr) == plain(rows)


def test_whole_balls_are_given_away():
    r = np.random.default_rng(5)
    middles = r.uniform(-1, 1, (8, 64))
    points = integers(np.repeat(middles, 500, axis=0) + r.normal(0, 0.01, (4000, 64)))
    tree, _ = built(points)
    compared: list[int] = []
    counts, sums, of = assigned(tree, integers(middles), compared)
    near = ((tree.points[:, None] - integers(middles)[None]) ** 2).sum(2).argmin(1)
    assert (of == near).all() and counts.sum() == 4000 and sum(compared) < 400
    assert all((sums[k] == tree.points[of == k].sum(axis=0)).all() for k in range(8))


def test_ties_go_to_the_smaller_number():
    points = np.zeros((100, 2), np.int64)
    tree, _ = built(points)
    assert (assigned(tree, np.array([[1, 0], [-1, 0], [1, 0]]))[2] == 0).all()
    assert (assigned(tree, np.array([[5, 0], [0, 1], [0, 1]]))[2] == 1).all()
