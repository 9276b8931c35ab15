"""The incomplete beta function, p-values, and sums that no layout changes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.exact import exact_avg, exact_sum
from millrace.functions.ranks import spearman
from millrace.functions.special import beta_regularised, correlation_p
from millrace.queries import QUERIES


def integral(x, a, b, n=400_001):
    """By Simpson's rule over the angle whose squared sine is the variable."""
    t = np.linspace(0, math.asin(math.sqrt(x)), n)
    with np.errstate(divide="ignore", invalid="ignore"):
        f = 2 * np.exp((2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t)) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    f[0] = 0.0 if a > 0.5 else f[1]
    return t[1] / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())


def test_beta_against_integration(spark):
    cases = [(x, a, 0.5) for a in (0.5, 1.0, 1.5, 4.0, 20.5, 500.0, 75000.0) for x in (1e-4, 0.1, 0.5, 0.9, 0.99, 0.9999, 0.99999999)] + [(0.3, 2.0, 3.0), (0.95, 10.0, 0.7), (0.4, 30.0, 40.0)]
    df = spark.createDataFrame(cases, "x double, a double, b double")
    for r in df.select("*", beta_regularised(F.col("x"), F.col("a"), F.col("b")).alias("i")).collect():
        assert abs(r["i"] - integral(r["x"], r["a"], r["b"])) < 1e-9, r
    ends = spark.createDataFrame([(0.0, 2.0, 0.5), (1.0, 2.0, 0.5), (None, 2.0, 0.5)], "x double, a double, b double")
    assert [r[0] for r in ends.select(beta_regularised(F.col("x"), F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, None]


def test_p_values(spark):
    cases = [(0.5, 2), (0.5, 3), (1.0, 10), (-1.0, 10), (0.0, 10), (0.3, 40), (None, 40), (float("nan"), 40), (1e-4, 10**9)]
    got = [r[0] for r in spark.createDataFrame(cases, "rho double, n long").select(correlation_p(F.col("rho"), F.col("n"))).collect()]
    assert got[0] is None and got[6] is None and got[7] is None
    assert abs(got[1] - integral(0.75, 0.5, 0.5)) < 1e-9 and got[2] == got[3] == 0.0 and got[4] == 1.0
    assert abs(got[5] - integral(1 - 0.09, 19.0, 0.5)) < 1e-9 and 0.0015 < got[8] < 0.0017  # about 3.16 standard errors


def test_spearman_of_few_rows(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("b", 2, 3), ("b", 3, 2), ("b", 4, 4)], "k string, x int, y int")
    got = {r["k"]: (r["n"], round(r["rho"], 9), r["p"]) for r in spearman(df, "x", "y", "k").collect()}
    assert got["a"] == (2, -1.0, None) and got["b"][:2] == (4, 0.8) and abs(got["b"][2] - 0.2) < 1e-9


def test_exact_sums_on_any_layout(spark):
    r = random.Random(0)
    values = [r.choice([r.uniform(-1, 1), r.uniform(0, 1) * 10 ** r.randint(-9, 15), 0.1, -0.3, None]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").cache()
    found = {df.repartition(n).agg(exact_sum("v"), exact_avg(F.col("v"))).first()[:] for n in (1, 2, 3, 7, 16, 31)}
    true = math.fsum(v for v in values if v is not None)
    assert len(found) == 1 and abs(found.pop()[0] - true) <= abs(true) * 1e-15
    odd = spark.createDataFrame([(1.0,), (float("inf"),)], "v double").agg(exact_sum("v")).first()[0]
    nothing = spark.createDataFrame([(None,)], "v double").agg(exact_sum("v"), exact_avg("v")).first()
    assert odd == float("inf") and tuple(nothing) == (None, None)
    assert math.isnan(spark.createDataFrame([(1.0,), (float("nan"),)], "v double").agg(exact_sum("v")).first()[0])


AVERAGING = ["met_teacher_style_gap", "agg_mode_class", "agg_class_plus_overall", "agg_method_means", "agg_method_class", "snk_html", "join_left_sentinel", "met_composite_quality", "met_agreement", "prj_sentinel_null", "met_mode_class_mean"]


@pytest.mark.parametrize("name", AVERAGING)
def test_averaging_queries_on_three_layouts(spark, tmp_path, name):
    found = set()
    for n in (1, 3, 8):
        for t in ("lineitem", "orders", "part"):
            spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").repartition(n).write.parquet(str(tmp_path / str(n) / f"{t}.parquet"))
        rows = QUERIES[name](spark, str(tmp_path / str(n))).collect()
        found.add(tuple(sorted(repr(r) for r in rows)))
    assert len(found) == 1
