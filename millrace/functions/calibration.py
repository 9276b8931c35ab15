"""Threshold sweeps and Otsu thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def swept(df: DataFrame, conf: str, value: str, first: int, last: int) -> DataFrame:
    """For each threshold of first..last hundredths: threshold_pct, n_retained, mean_iou of rows with at least that confidence.

    Rows are counted once for the highest threshold that they reach; sums from above then give all thresholds, so the
    sweep costs one aggregation and not one pass for each threshold.
    """
    spark = df.sparkSession
    grid = [t / 100.0 for t in range(first, last + 1)]
    reached = F.aggregate(F.array(*[F.lit(t) for t in grid]), F.lit(0), lambda n, t: n + F.when(F.col(conf) >= t, 1).otherwise(0))
    sums = df.select(reached.alias("k"), F.col(value).alias("v")).filter("k > 0").groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    every = spark.range(1, len(grid) + 1).select(F.col("id").cast("int").alias("k")).join(sums, "k", "left")
    above = Window.orderBy(F.desc("k"))  # over as many rows as there are thresholds
    n, s = F.sum(F.coalesce("n", F.lit(0))).over(above), F.sum(F.coalesce("s", F.lit(0.0))).over(above)
    return every.select((F.col("k") + (first - 1)).alias("threshold_pct"), n.alias("n_retained"), F.when(n > 0, s / n).alias("mean_iou"))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) for all bins from 0, empty ones too; the last one is closed above."""
    b = F.least(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    n = df.filter(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def otsu(hist: DataFrame) -> DataFrame:
    """(bin, between): the first bin after which the variance between both classes is largest, over a histogram of bounded size."""
    w = Window.orderBy("bin")
    total, mass = F.sum("n").over(Window.partitionBy()), F.sum(F.col("n") * F.col("bin")).over(Window.partitionBy())
    n0, m0 = F.sum("n").over(w), F.sum(F.col("n") * F.col("bin")).over(w)
    cut = hist.select("bin", total.alias("n"), mass.alias("m"), n0.alias("n0"), m0.alias("m0")).filter("n0 > 0 AND n0 < n")
    between = F.col("n0") * (F.col("n") - F.col("n0")) * F.pow(F.col("m0") / F.col("n0") - (F.col("m") - F.col("m0")) / (F.col("n") - F.col("n0")), F.lit(2)) / F.col("n") / F.col("n")
    return cut.select("bin", F.round(between, 6).alias("between")).orderBy(F.desc("between"), "bin").limit(1)
