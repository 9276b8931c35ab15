"""Series: running bests, early stops, warm-ups, areas, reveal curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def after_warm_up(df: DataFrame, key: str, order: Sequence[str], skip: int) -> DataFrame:
    """Rows of each key but the first ``skip`` in the order of columns that no two rows share.

    Spark keeps ``skip`` rows of a key for each task before it deals them; the others only meet the last of these.
    """
    k = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = df.select(key, *order).withColumn("_k", k).filter(F.col("_k") <= skip)
    last = first.groupBy(F.col(key).alias("_key")).agg(F.max(F.struct(*order)).alias("_last"))
    return df.join(last, F.col(key).eqNullSafe(F.col("_key"))).filter(F.struct(*order) > F.col("_last")).select(*df.columns)


def running_best(df: DataFrame, run: str, epoch: str, metric: str, start: float) -> DataFrame:
    """Adds ``is_best``: strictly above all before, and above ``start``."""
    before = F.max(metric).over(Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("is_best", F.col(metric) > F.greatest(F.coalesce(before, F.lit(start)), F.lit(start)))


def early_stop(df: DataFrame, run: str, epoch: str, metric: str, patience: int, start: float) -> DataFrame:
    """(run, stop_epoch): the first epoch that is the ``patience``-th since the last improvement; null if it never comes."""
    w = Window.partitionBy(run).orderBy(epoch)
    best = running_best(df, run, epoch, metric, start).withColumn("_island", F.sum(F.col("is_best").cast("int")).over(w))
    since = best.withColumn("_since", F.sum((~F.col("is_best")).cast("int")).over(Window.partitionBy(run, "_island").orderBy(epoch)))
    return since.groupBy(run).agg(F.min(F.when(F.col("_since") >= patience, F.col(epoch))).alias("stop_epoch"))


def trapezoids(value: Column, before: Column, steps: Column) -> Column:
    """A curve's share of area between two points, for a sum over its points."""
    return (value + before) / 2 / steps
