"""Image operators against plain versions that go cell by cell."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import imaging as I
from millrace.operators.sampling import weighted_with_replacement
from millrace.operators.setops import collated


def slow_dct(g):
    n = len(g)
    c = [[2 * math.cos(math.pi * k * (2 * j + 1) / (2 * n)) for j in range(n)] for k in range(8)]
    return [[sum(c[u][y] * g[y][x] * c[v][x] for y in range(n) for x in range(n)) for v in range(8)] for u in range(8)]


@pytest.mark.parametrize("seed", range(3))
def test_perceptual_hash(seed):
    g = np.random.default_rng(seed).integers(0, 256, (32, 32)).astype(float)
    low = [x for row in slow_dct(g.tolist()) for x in row]
    want = int("".join("1" if x > np.median(low) else "0" for x in low), 2)
    code = I.phash(g)
    assert code % (1 << 64) == want
    assert ((I.phash(g * 0.9 + 3) ^ code) & ((1 << 64) - 1)).bit_count() <= 2  # brightness and contrast hardly matter
    assert ((I.phash(g.T) ^ code) & ((1 << 64) - 1)).bit_count() > 8


def test_resizing_keeps_planes_and_constants():
    y, x = np.mgrid[:16, :16].astype(float)
    assert np.allclose(I.resized(np.full((5, 9), 3.0), 32), 3)
    assert np.allclose(I.resized(2 * x + y, 8), 2 * ((np.arange(8) + 0.5) * 2 - 0.5) + ((np.arange(8) + 0.5) * 2 - 0.5)[:, None])


def slow_clahe(g, clip, tiles, bins):
    n, t = len(g), len(g) // tiles
    limit = max(1, int(clip * t * t / bins))
    maps = {}
    for i in range(tiles):
        for j in range(tiles):
            counts = [0] * bins
            for y in range(i * t, (i + 1) * t):
                for x in range(j * t, (j + 1) * t):
                    counts[int(g[y][x])] += 1
            over, total, maps[i, j] = sum(max(0, c - limit) for c in counts), 0.0, []
            for c in counts:
                total += min(c, limit) + over / bins
                maps[i, j].append(total * (bins - 1) / (t * t))
    out = np.zeros((n, n))
    for y in range(n):
        for x in range(n):
            py, px = (min(max((k + 0.5) / t - 0.5, 0), tiles - 1) for k in (y, x))
            i, j = int(py), int(px)
            k, m = min(i + 1, tiles - 1), min(j + 1, tiles - 1)
            v = int(g[y][x])
            up = maps[i, j][v] * (1 - (px - j)) + maps[i, m][v] * (px - j)
            down = maps[k, j][v] * (1 - (px - j)) + maps[k, m][v] * (px - j)
            out[y, x] = min(max(up * (1 - (py - i)) + down * (py - i), 0), bins - 1)
    return out


def test_local_contrast():
    g = np.random.default_rng(5).normal(120, 12, (32, 32)).clip(0, 255).round()
    got = I.clahe(g, clip=3.0, tiles=4)
    assert np.abs(got - slow_clahe(g.tolist(), 3.0, 4, 256)).max() <= 0.5 + 1e-9
    assert got.std() > g.std() and I.clahe(np.zeros((7, 7)), tiles=2).shape == (7, 7)


def flood(mask):
    seen, best = set(), []
    for start in map(tuple, np.argwhere(mask).tolist()):
        if start in seen:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            y, x = todo.pop()
            group.append((y, x))
            for near in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                if all(0 <= k < len(mask) for k in near) and mask[near] and near not in seen:
                    seen.add(near)
                    todo.append(near)
        if len(group) > len(best):
            best = group
    return set(best)


@pytest.mark.parametrize("seed", range(6))
def test_largest_component(seed):
    mask = np.random.default_rng(seed).random((14, 14)) < 0.3
    assert set(map(tuple, np.argwhere(I.largest_component(mask)).tolist())) == flood(mask)
    assert not I.largest_component(np.zeros((3, 3), bool)).any()


@pytest.mark.parametrize("seed", range(5))
def test_polygons_hold_their_insides_and_edges(seed):
    rng = np.random.default_rng(seed)
    polygon = rng.uniform(0, 100, (int(rng.integers(3, 8)), 2)).tolist()
    got = I.filled([polygon], 40, 50)
    points = [(int(x / 100 * 50), int(y / 100 * 40)) for x, y in polygon]
    for y in range(40):
        for x in range(50):
            odd, near = False, 9.0
            for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1], strict=True):
                if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                    odd = not odd
                d2 = (bx - ax) ** 2 + (by - ay) ** 2
                t = 0 if not d2 else min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / d2))
                near = min(near, math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay)))
            assert got[y, x] if odd else (not got[y, x] or near <= 0.75), (x, y)
    assert not I.filled([], 4, 4).any() and I.filled([[(0, 0), (100, 100)]], 8, 8)[:7, :7].trace() == 7


def test_batches_leave_out_what_is_null(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, None), (3, 1), (3, 2)], "b int, v long")
    assert sorted(map(tuple, collated(df, "b", "v", F.sum("v")).collect())) == [(1, 1, 1, 5), (3, 2, 0, 3)]


def test_draws_with_replacement_follow_the_weights(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([1, 0, 700, 3, 296])], "k long, w long")
    got = [r["k"] for r in weighted_with_replacement(df, "k", "w", 4000).collect()]
    assert len(got) == 4000 and set(got) <= {0, 2, 3, 4} and abs(got.count(2) / 4000 - 0.7) < 0.03 and abs(got.count(4) / 4000 - 0.296) < 0.03
    assert weighted_with_replacement(df.filter("w < 0"), "k", "w", 10).count() == 0


def test_kernels_pass_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, [float(i) for i in range(64)]), (3, [])], "k int, v array<float>")
    rows = {r["k"]: r for r in df.select("k", I.perceptual_hash("v").alias("h"), I.main_region("v").alias("r"), I.local_contrast("v").alias("c")).collect()}
    assert rows[1]["h"] is None and rows[3]["h"] is None and rows[2]["h"] is not None
    assert rows[1]["r"]["area"] == 0 and rows[2]["r"]["area"] == 63 and rows[1]["c"] is None and len(rows[2]["c"]) == 64


def test_polygons_of_a_small_file_are_dealt(spark):
    from millrace.queries import QUERIES

    df = QUERIES["udf_polygon_cells"](spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
