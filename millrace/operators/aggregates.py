"""Aggregations: counters, shares, descriptions, pivots with declared columns, rollups with an overall row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import exact_avg


def counted(df: DataFrame, *keys: str) -> DataFrame:
    """How often each key comes, most frequent first, ties by key."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *keys)


def percent_of_total(df: DataFrame, *keys: str) -> DataFrame:
    """Counts with their share of all rows, in percent to two places; the window runs over the counts alone."""
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def described(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.round(exact_avg(value), 6).alias("mean"), F.round(F.stddev_samp(value), 6).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def filled_pivot(df: DataFrame, key: str, of: str, values: Sequence[str]) -> DataFrame:
    """Counts of the declared values as columns, 0 where there are none: no pass over the data to find them."""
    return df.groupBy(key).agg(*[F.count_if(F.col(of) == v).alias(v) for v in values])


def rollup_overall(df: DataFrame, key: str, *aggregates: Column) -> DataFrame:
    """Aggregates for each key and, as ``Overall``, for all rows."""
    out = df.rollup(key).agg(*aggregates, F.grouping(key).alias("_all"))
    return out.withColumn(key, F.when(F.col("_all") == 1, F.lit("Overall")).otherwise(F.col(key))).drop("_all")
