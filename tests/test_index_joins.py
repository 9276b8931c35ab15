"""Pivots, trigrams and medians: exact results, and how little they look at."""

import random
import statistics

import numpy as np
import pytest

from millrace.operators.joins import contains_match, hamming_blocks, hamming_pairs, suffix_match
from millrace.operators.medians import medians
from millrace.operators.neighbours import nearest_distances

VECTORS = "id long, v array<double>"


def brute(items, reference, k=3):
    out = {}
    for i, x in items:
        if x is None or None in x:
            continue
        d = sorted(float(np.linalg.norm(np.array(x) - np.array(y))) for j, y in reference if j != i and y is not None and None not in y)[:k]
        if d:
            out[i] = [round(v, 9) for v in d]
    return out


@pytest.mark.parametrize(("pivots", "block"), [(1024, 4096), (3, 20), (1, 50)])
def test_nearest_neighbours(spark, pivots, block):
    """Cells of fewer than k vectors among them, copies, and a key with another vector in the reference."""
    r = random.Random(1)
    middles = [[r.uniform(-9, 9) for _ in range(6)] for _ in range(9)]
    point = lambda: [m + r.gauss(0, 0.3) for m in r.choice(middles)]
    items = [(i, point()) for i in range(300)] + [(i, [0.0] * 6) for i in range(300, 380)] + [(990, None), (991, [None] * 6)]
    reference = [*items[100:], *[(i, point()) for i in range(1000, 1200)], (5, point())]
    df, ref = spark.createDataFrame(items, VECTORS).repartition(3), spark.createDataFrame(reference, VECTORS).repartition(2)
    got = {r["id"]: [round(v, 9) for v in r["d"]] for r in nearest_distances(df, ref, "id", "v", pivots=pivots, block=block).collect()}
    want = brute(items, reference)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def test_few_pairs_are_compared(spark):
    r = np.random.default_rng(2)
    middles = r.uniform(-50, 50, (40, 16))
    rows = [(i, (middles[i % 40] + r.normal(0, 0.5, 16)).tolist()) for i in range(4000)]
    df, seen = spark.createDataFrame(rows, VECTORS).repartition(4), []
    assert nearest_distances(df, df, "id", "v", block=100, visited=seen).count() == 4000
    assert seen[:2] == [4000, 4000] and seen[2] < 0.1 * 4000 * 4000


def test_no_reference(spark):
    df = spark.createDataFrame([(1, [1.0])], VECTORS)
    assert nearest_distances(df, df.limit(0), "id", "v").count() == nearest_distances(df, df, "id", "v").count() == nearest_distances(df.limit(0), df, "id", "v").count() == 0


def test_contains(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice("abé") for _ in range(n))
    texts = [(i, word(r.randint(0, 14))) for i in range(80)] + [(i, "aaaaaaaa") for i in range(80, 140)] + [(200, None)]
    tokens = [(word(r.randint(0, 6)),) for _ in range(50)] + [("a",), ("aa",), ("aaaa",), (None,), ("b",), ("b",)]
    found = contains_match(spark.createDataFrame(texts, "i int, t string"), spark.createDataFrame(tokens, "k string"), "t", "k")
    got = sorted((x["i"], x["k"]) for x in found.collect())
    assert got == sorted((i, k) for i, t in texts for (k,) in tokens if t is not None and k is not None and k in t)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_suffixes_of_repeated_rows(spark):
    left = spark.createDataFrame([("x_ab", 1), ("x_ab", 1), ("ab", 1), (None, 1)], "name string, n int")
    right = spark.createDataFrame([("ab", 7), ("b", 3)], "t string, o int")
    assert sorted(map(tuple, suffix_match(left, right, "name", "t", "o").collect()), key=str) == [("ab", 1, 7), ("x_ab", 1, 3), ("x_ab", 1, 3), (None, 1, None)]


@pytest.mark.parametrize("inside", [1 << 20, 40, 1])
def test_medians(spark, inside):
    r = random.Random(4)
    groups = {
        "even": [r.gauss(0, 1) for _ in range(2000)], "odd": [r.uniform(0, 9) for _ in range(1501)], "ties": [5.0] * 900 + [r.random() for _ in range(300)], "same": [1.0] * 500,
        "two": [1.0] * 400 + [2.0] * 400, "one": [3.5], "few": [4.0, 1.0], None: [r.expovariate(1) for _ in range(700)],
    }
    rows = [(k, "x", v) for k, vs in groups.items() for v in vs] + [("none", "x", None), ("none", "x", float("nan"))]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, l string, v double").repartition(4)
    got = {x["k"]: x["median"] for x in medians(df, "v", "k", "l", inside=inside).collect()}
    assert got == {k: statistics.median(v) for k, v in groups.items()}
    every = [v for vs in groups.values() for v in vs]
    assert [x[0] for x in medians(df, "v", inside=inside).collect()] == [statistics.median(every)]


@pytest.mark.parametrize("blocks", [None, 3, 4, 6])
def test_hamming_pairs_with_more_blocks(spark, blocks):
    r = random.Random(5)
    codes = []
    for _ in range(40):
        base = r.getrandbits(64)
        codes += [base, base ^ (1 << r.randrange(64)), base ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)), base ^ 7]
    rows = [(i, c - (1 << 64) * (c >> 63)) for i, c in enumerate(codes)]
    got = {(x["a"], x["b"]) for x in hamming_pairs(spark.createDataFrame(rows, "k long, c long"), "k", "c", 2, blocks=blocks).collect()}
    assert got == {(i, j) for j in range(len(codes)) for i in range(j) if (codes[i] ^ codes[j]).bit_count() <= 2}
    assert [hamming_blocks(n) for n in (1000, 10**6, 10**9, 10**11)] == [3, 4, 5, 6]


def test_items_that_are_reference_rows_travel_with_one_vector(spark, monkeypatch):
    from millrace.operators import neighbours as N

    sent = []
    met = N._met
    monkeypatch.setattr(N, "_met", lambda visits, *rest: sent.append(visits) or met(visits, *rest))
    rows = [(k, [float(k * 7 % 31), float(k * k % 17)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    found = {r["id"]: r["d"] for r in N.nearest_distances(df, df, "id", "v", k=3, block=8).collect()}
    assert all(v.filter("own IS NOT NULL OR NOT same").isEmpty() for v in sent)
    for k, v in rows:
        plain = sorted(((v[0] - w[0]) ** 2 + (v[1] - w[1]) ** 2) ** 0.5 for m, w in rows if m != k)[:3]
        assert all(abs(a - b) < 1e-9 for a, b in zip(found[k], plain, strict=True))
