"""Splits and samples by seeded hash orders: the same rows in every engine and on every layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .keys import hash_order
from .ranking import running


def ranked(df: DataFrame, key: str, seed: int, *strata: str) -> DataFrame:
    """Adds ``_k`` from 1 in hash order within each stratum, and the stratum's size ``_n``.

    Rows are ranked within the hash's first three digits and moved on by what stands before these, so that a stratum
    which holds most rows is spread over 4096 groups.
    """
    h = df.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_p", F.substring("_h", 1, 3))
    part, whole = Window.partitionBy(*strata, "_p"), Window.partitionBy(*strata)
    counts = h.groupBy(*strata, "_p").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_p").alias("_q"), before.alias("_before"), F.sum("_c").over(whole).alias("_n"))
    same = F.col("_p") == F.col("_q")
    for i, s in enumerate(strata):
        same &= F.col(s).eqNullSafe(F.col(f"_s{i}"))
    met = h.withColumn("_r", F.row_number().over(part.orderBy("_h", key))).join(placed, same)
    return met.withColumn("_k", F.col("_r") + F.col("_before")).select(*df.columns, "_k", "_n")


def positions(df: DataFrame, key: str, *strata: str) -> DataFrame:
    """Adds ``_p``, the position from 0 in key order within each stratum, and the stratum's size ``_n``.

    A range sort by stratum and key, cut off at a checkpoint, deals even a stratum that holds most rows over many
    partitions; positions within a partition's share of a stratum are moved on by the shares before it.
    """
    placed = cut(df.orderBy(*strata, key)).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy(*strata, "_part").agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*strata)
    before = F.coalesce(F.sum("_c").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = counts.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_part").alias("_q"), before.alias("_before"), F.sum("_c").over(whole).alias("_n"))
    same = F.col("_part") == F.col("_q")
    for i, s in enumerate(strata):
        same &= F.col(s).eqNullSafe(F.col(f"_s{i}"))
    within = placed.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_part").orderBy(key)) - 1)
    return within.join(shares, same).withColumn("_p", F.col("_r") + F.col("_before")).select(*df.columns, "_p", "_n")


def split_by_position(df: DataFrame, key: str, strata: Sequence[str], train: float, val: float, seed: int = 42) -> DataFrame:
    """Adds ``split``: the first floor(train * n) of each stratum, the next floor(val * n), and the rest as test."""
    n_train, n_val = F.floor(F.lit(train) * F.col("_n")), F.floor(F.lit(val) * F.col("_n"))
    split = F.when(F.col("_k") <= n_train, "train").when(F.col("_k") <= n_train + n_val, "val").otherwise("test")
    return ranked(df, key, seed, *strata).withColumn("split", split).drop("_k", "_n")


def n_per_stratum(df: DataFrame, key: str, n: Column | int, *strata: str, seed: int = 42) -> DataFrame:
    """The first n of each stratum in hash order, all if there are fewer."""
    return ranked(df, key, seed, *strata).filter(F.col("_k") <= n).drop("_k", "_n")


def global_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order: a limit over a sort, which keeps n rows for each task."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def evenly_spaced(df: DataFrame, key: str, n: Column | int, *strata: str) -> DataFrame:
    """Rows at positions floor(i * size / n), i from 0, of each stratum in key order; all if n isn't less than the size.

    Position p is one of them if some i has floor(i * size / n) = p, which the least i with i * size / n >= p tells.
    """
    n = F.lit(n) if isinstance(n, int) else n
    placed = positions(df, key, *strata).withColumn("_want", n.cast("long"))
    i = F.floor((F.col("_p") * F.col("_want") + F.col("_n") - 1) / F.col("_n"))
    hit = (i < F.col("_want")) & (F.floor(i * F.col("_n") / F.col("_want")) == F.col("_p"))
    return placed.filter((F.col("_want") >= F.col("_n")) | hit).drop("_p", "_n", "_want")


def weighted_with_replacement(df: DataFrame, key: str, weight: str, draws: int, seed: int = 42) -> DataFrame:
    """``draws`` rows by whole, positive weights, with replacement: each draw is a hashed place on the line of all weights.

    Rows stand on that line in key order. It is cut into as many cells as there are draws; a row meets the draws of the
    cells that it reaches into, so rows and draws join by equality.
    """
    rows = running(df.filter(F.col(weight) > 0), key, {"_to": F.col(weight).cast("long")})
    total = rows.agg(F.coalesce(F.max("_to"), F.lit(0))).first()[0]
    cell = lambda place: F.floor(place / F.lit(float(total or 1)) * draws)
    spread = rows.withColumn("_from", F.col("_to") - F.col(weight)).withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to")))))
    uniform = F.conv(F.substring(hash_order(seed, F.col("id")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.floor(uniform * float(total)).alias("_at")).withColumn("_cell", cell(F.col("_at")))
    met = spread.join(drawn, "_cell").filter((F.col("_from") <= F.col("_at")) & (F.col("_at") < F.col("_to")))
    return met.select("draw", *df.columns)
