"""Brackets: a value's grade by half-open intervals, as generated branches or as a range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Bracket = tuple[float | None, float | None, float | int | str | None]

# Fixed values: (from, below, result).
COVERAGE_WEIGHTS: list[Bracket] = [(None, 0.15, None), (0.15, 0.25, 0.3), (0.25, 0.5, 0.7), (0.5, None, 1.0)]
SEVERITY_GRADES: list[Bracket] = [(0.0, 10.0, 1), (10.0, 25.0, 2), (25.0, 50.0, 3), (50.0, 75.0, 4), (75.0, 101.0, 5)]
SEVERITY_BOUNDS = [5.0, 10.0, 25.0, 50.0, 75.0]


def bracket_case(value: Column, brackets: Sequence[Bracket], above: float | int | str | None = None) -> Column:
    """The result of the bracket that holds the value; ``above`` beyond all, null for null and below all."""
    out = F.lit(above)
    for low, high, result in reversed(brackets):
        inside = F.lit(True) if low is None and high is None else (value >= low if high is None else value < high if low is None else (value >= low) & (value < high))
        out = F.when(inside, F.lit(result)).otherwise(out)
    low = brackets[0][0]
    return F.when(value.isNotNull() if low is None else value >= low, out)


def bracket_sql(value: str, brackets: Sequence[Bracket], above: float | int | str | None = None) -> str:
    """The same branches as SQL text."""
    lit = lambda x: "NULL" if x is None else repr(x) + "::double" * isinstance(x, float)
    whens = [" AND ".join([f"{value} >= {lit(low)}"] * (low is not None) + [f"{value} < {lit(high)}"] * (high is not None)) + f" THEN {lit(result)}" for low, high, result in brackets]
    low = brackets[0][0]
    return f"CASE WHEN {value} IS NULL{'' if low is None else f' OR {value} < {lit(low)}'} THEN NULL " + " ".join(f"WHEN {w}" for w in whens) + f" ELSE {lit(above)} END"


def severity_grade(severity: Column, category: Column, healthy: str) -> Column:
    """-1 for an unknown severity (below 0), 0 for healthy items, else the bracket's grade, the highest one beyond all brackets."""
    return F.when(severity < 0, -1).when(category == healthy, 0).otherwise(bracket_case(severity, SEVERITY_GRADES, SEVERITY_GRADES[-1][2]))


def bracket_join(df: DataFrame, value: str, brackets: Sequence[Bracket], name: str, above: int | None = None) -> DataFrame:
    """The same as a range join with the brackets' table, which is as small as the list given."""
    spark: SparkSession = df.sparkSession
    brackets = [*brackets, (brackets[-1][1], None, above)] if above is not None and brackets[-1][1] is not None else brackets
    rows = spark.createDataFrame([(float("-inf") if a is None else a, float("inf") if b is None else b, r) for a, b, r in brackets], f"_low double, _high double, {name} int")
    return df.join(F.broadcast(rows), (F.col(value) >= F.col("_low")) & (F.col(value) < F.col("_high")), "left").drop("_low", "_high")
