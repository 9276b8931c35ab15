"""Unions of tables with unlike columns, differences, subsets, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ragged_union(*frames: DataFrame) -> DataFrame:
    """All rows; columns in the order in which they are first seen, null where a table lacks one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def missing_from(required: list[str], present: Column) -> Column:
    """The required values that an array lacks, in order."""
    return F.array_except(F.array(*[F.lit(r) for r in required]), present)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: the last by ``order``, a new row before an old one of the same order."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), F.desc(order)))
    return both.withColumn("_k", last).filter("_k = 1").drop("_k", "_new")


def first_of_each(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def collated(items: DataFrame, batch: str, item: str, *aggregates: Column) -> DataFrame:
    """(batch, n, skipped, aggregates): what batches hold without items that are null, and how many of these each skips; batches of nulls alone go."""
    out = items.groupBy(batch).agg(F.count(item).alias("n"), F.count_if(F.col(item).isNull()).alias("skipped"), *aggregates)
    return out.filter("n > 0")
