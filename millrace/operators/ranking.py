"""Ranks, running totals, normalisations and constrained winners, none of which brings all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def running(df: DataFrame, by: str, sums: dict[str, Column], *keys: str, descending: bool = False) -> DataFrame:
    """Adds running sums (each row's own included) in the order of ``by``, in which no two rows of a key are equal.

    Rows are dealt by range, summed within their partition and moved on by what the partitions before hold of their
    key, so that a task has a partition of rows, and a window without keys only as many rows as there are partitions.
    """
    way = F.desc(by) if descending else F.asc(by)
    placed = cut(df.withColumns({f"_v_{n}": c for n, c in sums.items()}).repartitionByRange(*map(F.col, keys), way).withColumn("_part", F.spark_partition_id()))
    here = placed.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    moved = here.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_k_part"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    same = F.col("_part") == F.col("_k_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    upto = Window.partitionBy(*keys, "_part").orderBy(way).rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(moved, same).select(*df.columns, *[(F.sum(f"_v_{n}").over(upto) + F.col(f"_o_{n}")).alias(n) for n in sums])


def value_ranks(df: DataFrame, value: str, *keys: str, descending: bool = False) -> DataFrame:
    """(keys, value, n, min_rank, average_rank) of each distinct value, in ascending order or not; rows with a value share them."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = running(counts, value, {"_upto": F.col("n")}, *keys, descending=descending)
    return upto.select(*keys, value, "n", (F.col("_upto") - F.col("n") + 1).alias("min_rank"), (F.col("_upto") - (F.col("n") - 1) / 2).alias("average_rank"))


def extremes(df: DataFrame, *names: str) -> DataFrame:
    """Adds the least and the largest value of columns as ``_min_`` and ``_max_`` with their names: one row is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*[f(n).alias(f"_{k}_{n}") for n in names for k, f in (("min", F.min), ("max", F.max))])))


def min_max(name: str, invert: bool = False, flat: float = 0.5) -> Column:
    """The place of a column's value between its extremes(); ``flat`` where they are one."""
    low, high = F.col(f"_min_{name}"), F.col(f"_max_{name}")
    x = F.when(high == low, F.lit(flat)).otherwise(F.try_divide(F.col(name) - low, high - low))
    return F.when(high == low, F.lit(flat)).otherwise(1 - x) if invert else x


def first_max(df: DataFrame, value: Column, *ties) -> DataFrame:
    """The row with the largest value that is a number, the first of ties."""
    return df.filter(value.isNotNull() & ~F.isnan(value)).orderBy(F.desc(value), *ties).limit(1)


def gated(df: DataFrame, gate: Column) -> DataFrame:
    """Rows that pass the gate, or all if none does."""
    passed = F.broadcast(df.agg(F.coalesce(F.bool_or(gate), F.lit(False)).alias("_any")))  # one row
    return df.crossJoin(passed).filter(gate | ~F.col("_any")).drop("_any")


def gate_then_tiebreak(df: DataFrame, gate: Column, main: str, within: float, tie: str, key: str) -> DataFrame:
    """Among rows that pass the gate (all if none), those within ``within`` of the best main value; of these the largest tie value, else main value."""
    near = extremes(gated(df, gate), main).filter(F.col(main) >= F.col(f"_max_{main}") - within)
    return near.select(*df.columns).orderBy(F.desc_nulls_last(tie), F.desc(main), key).limit(1)
