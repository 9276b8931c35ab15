"""Masks as runs against decoded cells."""

import random

from pyspark.sql import functions as F

from millrace.functions.runs import area, filled, from_lengths, intersection, iou, to_lengths, union

W = H = 17


def cells(lengths):
    out, at = set(), 0
    for i, n in enumerate(lengths):
        out |= set(range(at, at + n)) if i % 2 else set()
        at += n
    return out


def inside(points, x, y):
    hit = 0
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        if (x0 <= x + 0.5) != (x1 <= x + 0.5):
            hit += y0 + (x + 0.5 - x0) * (y1 - y0) / (x1 - x0) <= y + 0.5
    return hit % 2 == 1


def held(runs):
    return {k for r in runs for k in range(r["start"], r["end"])}


def canonical(runs):
    return all(a["start"] < a["end"] for a in runs) and all(a["end"] < b["start"] for a, b in zip(runs, runs[1:], strict=False))


def test_runs_of_lengths(spark):
    r = random.Random(1)
    rows = [([r.randint(0, 4) for _ in range(r.randint(0, 12))], [r.randint(0, 4) for _ in range(r.randint(0, 12))]) for _ in range(120)] + [([], [0, 5]), ([3], [0, 0, 0, 2])]
    a, b = from_lengths(F.col("a")), from_lengths(F.col("b"))
    df = spark.createDataFrame(rows, "a array<int>, b array<int>").select("a", "b", a.alias("x"), b.alias("y"))
    x, y = F.col("x"), F.col("y")
    for t in df.select("*", union(x, y).alias("u"), intersection(x, y).alias("i"), area(x).alias("n"), iou(x, y).alias("iou"), from_lengths(to_lengths(x, F.lit(60))).alias("back"), to_lengths(x, F.lit(60)).alias("l")).collect():
        p, q = cells(t["a"]), cells(t["b"])
        assert held(t["u"]) == p | q and held(t["i"]) == p & q and t["n"] == len(p) and held(t["back"]) == p and sum(t["l"]) == 60
        assert canonical(t["u"]) and canonical(t["i"]) and canonical(t["x"])
        assert t["iou"] == (len(p & q) / len(p | q) if p | q else 1.0)


def test_polygons(spark):
    r = random.Random(2)
    at = lambda: r.choice([float(r.randint(-4, 21)), r.uniform(-4, 21)])
    rows = [([[at(), at()] for _ in range(r.randint(3, 9))],) for _ in range(150)] + [([[0.0, 0.0], [1.0, 1.0]],), ([],), (None,), ([[-9.0, 1.0], [-5.0, 2.0], [-7.0, 9.0]],)]
    for t in spark.createDataFrame(rows, "p array<array<double>>").select("p", filled(F.col("p"), F.lit(W), F.lit(H)).alias("m")).collect():
        want = {x * H + y for x in range(W) for y in range(H) if t["p"] and len(t["p"]) > 2 and inside(t["p"], x, y)}
        assert held(t["m"]) == want and canonical(t["m"])


def test_a_large_frame_stays_runs(spark):
    p = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (2000.0, 0.0), (2000.0, 2000.0), (0.0, 2000.0))])
    m = filled(p, F.lit(2000), F.lit(2000))
    assert spark.range(1).select(F.size(m), area(m)).first()[:] == (1, 4_000_000)


def test_batches_of_runs_equal_runs_of_rows(spark):
    """The polygon queries' kernels on whole batches, against the column functions; rows are dealt, however few files there are."""
    from millrace.functions.run_batches import polygon_mask_overlap, polygon_overlap
    from millrace.functions.runs import intersection
    from millrace.plans.relations import dealt

    r = random.Random(3)
    polygon = lambda: [[r.choice([float(r.randint(-3, 27)), r.uniform(-5, 30)]), r.uniform(-5, 30)] for _ in range(r.randint(0, 7))]
    rows = [(k, polygon(), polygon(), [r.randint(0, 90) for _ in range(r.randint(0, 9))]) for k in range(300)] + [(300, None, polygon(), None)]
    df = spark.createDataFrame(rows, "k int, p array<array<double>>, q array<array<double>>, n array<bigint>").coalesce(1)
    assert dealt(df).rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism
    frame = F.lit(24)
    a, b, m = filled(F.col("p"), frame, frame), filled(F.col("q"), frame, frame), from_lengths(F.coalesce("n", F.array().cast("array<bigint>")))
    plain = df.select("k", a.alias("a"), b.alias("b"), m.alias("m")).select("k", *[area(F.col(c)) for c in "abm"], area(intersection(F.col("a"), F.col("b"))), area(intersection(F.col("a"), F.col("m"))))
    got = dealt(df).select("k", polygon_overlap("p", "q").alias("o"), polygon_mask_overlap("p", "n").alias("l")).select("k", "o.a", "o.b", "l.b", "o.both", "l.both")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
