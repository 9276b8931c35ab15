"""Exact medians of large groups with little state: sketches bracket the middle, counts and a sort inside the bracket settle it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Values inside a bracket that are sorted; a group with more gets a narrower bracket first.
INSIDE = 1 << 20
#: How far from the middle, as a share of the values in it, a bracket's ends are looked for: over twice a sketch's usual error.
SLACK = 0.03


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys], F.lit(True))


def medians(df: DataFrame, value: str, *keys: str, inside: int = INSIDE) -> DataFrame:
    """(keys, median) of each group's numbers, exact, as the mean of the two middle ones; nulls and NaNs don't count.

    Each round sketches what lies in a group's bracket and counts what lies below the narrower one, so a task holds a
    sketch and two counts a group. A side that would lose the middle stays as it was. Groups without a number have no row.
    """
    key_list = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    first = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 0")
    bracket = stored(first.select(*[F.col(k).alias(f"_b_{k}") for k in keys], "n", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), F.lit(False).alias("stuck")))
    names = [f"_b_{k}" for k in keys]
    lower, upper = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # ranks from 0
    wide = (F.col("held") > inside) & (F.col("low") < F.col("high")) & ~F.col("stuck")
    while not bracket.filter(wide).isEmpty():
        within = lambda b: rows.join(b, _same(key_list) & (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))) if keys else rows.crossJoin(F.broadcast(b)).filter("_v >= low AND _v <= high")
        sketch = within(bracket.filter(wide)).groupBy(*names, "n", "below", "held").agg(F.kll_sketch_agg_double("_v").alias("s"))
        # a sketch is asked for constant shares only, so for a grid of them, of which the next ones outwards serve
        grid = F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / 100) for i in range(101)]))
        share = lambda rank, by: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (rank - F.col("below")) / F.col("held") + by)) * 100
        ends = stored(sketch.select(*[F.col(c).alias(f"_e{i}") for i, c in enumerate(names)], F.get(grid, F.floor(share(lower, -SLACK)).cast("int")).alias("from"), F.get(grid, F.ceil(share(upper, SLACK)).cast("int")).alias("to")))
        tied = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{i}")) for i, c in enumerate(names)], F.lit(True))
        tried = bracket.filter(wide).join(ends, tied)
        counts = within(tried).groupBy(*names).agg(F.count_if(F.col("_v") < F.col("from")).alias("under"), F.count_if(F.col("_v") > F.col("to")).alias("over"))
        counts = counts.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(names)], "under", "over")
        met = bracket.join(ends, tied, "left").join(counts, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(names)], F.lit(True)), "left")
        raise_ = F.coalesce(F.col("below") + F.col("under") <= lower, F.lit(False))
        drop = F.coalesce(F.col("below") + F.col("held") - F.col("over") > upper, F.lit(False))
        lost = F.when(raise_, F.col("under")).otherwise(F.lit(0)) + F.when(drop, F.col("over")).otherwise(F.lit(0))
        bracket = stored(
            met.select(
                *names, "n", F.when(raise_, F.col("from")).otherwise(F.col("low")).alias("low"), F.when(drop, F.col("to")).otherwise(F.col("high")).alias("high"),
                (F.col("below") + F.when(raise_, F.col("under")).otherwise(F.lit(0))).alias("below"), (F.col("held") - lost).alias("held"), (F.col("stuck") | (wide & (lost == 0))).alias("stuck"),
            )
        )
    condition = _same(key_list) & (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    counts = rows.join(bracket, condition).groupBy(*names, "n", "below", "_v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*names).orderBy("_v")) + F.col("below")
    placed = counts.withColumn("upto", upto)
    holds = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    middle = (F.max(F.when(holds(lower), F.col("_v"))) + F.max(F.when(holds(upper), F.col("_v")))) / 2
    return placed.groupBy(*names).agg(middle.alias("median")).select(*[F.col(f"_b_{k}").alias(k) for k in keys], "median")
