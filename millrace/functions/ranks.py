"""Rank correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import value_ranks
from .special import correlation_p


def spearman(df: DataFrame, a: str, b: str, *keys: str) -> DataFrame:
    """(keys, n, rho, p): the correlation of average ranks and its two-sided p-value, null below three rows.

    Ranks are made for distinct values and meet their rows again.
    """
    ranks = lambda value, name: value_ranks(df, value, *keys).select(*keys, value, F.col("average_rank").alias(name))
    both = df.select(*keys, a, b).join(ranks(a, "_ra"), [*keys, a]).join(ranks(b, "_rb"), [*keys, b])
    rho = both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))
    return rho.withColumn("p", correlation_p(F.col("rho"), F.col("n")))
