"""Epoch logs and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.series import early_stop, running_best, trapezoids
from ..plans.relations import EPOCHS, epochs, table, with_
from ..registry import query


@query(
    with_(EPOCHS)
    + """, b AS (SELECT *, metric > greatest(coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double), 0.0::double) AS is_best FROM epochs)
SELECT run, max(epoch) FILTER (is_best) AS best_epoch, count(*) FILTER (is_best) AS n_improvements, max(metric) AS best FROM b GROUP BY run"""
)
def win_best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = running_best(epochs(spark, sf_dir), "run", "epoch", "metric", 0.0)
    return b.groupBy("run").agg(F.max(F.when(F.col("is_best"), F.col("epoch"))).alias("best_epoch"), F.count_if("is_best").alias("n_improvements"), F.max("metric").alias("best"))


@query(
    with_(EPOCHS)
    + """, b AS (SELECT *, metric > greatest(coalesce(max(metric) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double), 0.0::double) AS is_best FROM epochs),
  i AS (SELECT *, sum(is_best::int) OVER (PARTITION BY run ORDER BY epoch) AS island FROM b), s AS (SELECT *, sum((NOT is_best)::int) OVER (PARTITION BY run, island ORDER BY epoch) AS since FROM i)
SELECT run, min(epoch) FILTER (since >= 5) AS stop_epoch FROM s GROUP BY run"""
)
def win_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return early_stop(epochs(spark, sf_dir), "run", "epoch", "metric", 5, 0.0)


@query(with_(EPOCHS) + "SELECT run, min(epoch) FILTER (phase = 2) AS boundary FROM epochs GROUP BY run")
def win_phase_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs(spark, sf_dir).groupBy("run").agg(F.min(F.when(F.col("phase") == 2, F.col("epoch"))).alias("boundary"))


@query(with_(EPOCHS) + "SELECT run, count(*) FILTER (metric < 5) AS n_collapsed, max_by(metric, epoch) AS last_value FROM epochs GROUP BY run")
def win_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs(spark, sf_dir).groupBy("run").agg(F.count_if(F.col("metric") < 5).alias("n_collapsed"), F.max_by("metric", "epoch").alias("last_value"))


@query(
    with_(EPOCHS)
    + """, p AS (SELECT run, metric, lag(metric) OVER (PARTITION BY run ORDER BY epoch) AS prev, count(*) OVER (PARTITION BY run) - 1 AS steps FROM epochs)
SELECT run, round(coalesce(sum((metric + prev) / 2 / greatest(steps, 1)), 0), 6) AS auc FROM p GROUP BY run"""
)
def win_trapz(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run")
    p = epochs(spark, sf_dir).select("run", "metric", F.lag("metric").over(w.orderBy("epoch")).alias("prev"), (F.count("*").over(w) - 1).alias("steps"))
    return p.groupBy("run").agg(F.round(F.coalesce(F.sum(trapezoids(F.col("metric"), F.col("prev"), F.greatest("steps", F.lit(1)))), F.lit(0.0)), 6).alias("auc"))


@query(
    """WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(embedding)::double AS v FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS k FROM x)
SELECT vec_id, s.s::int AS step, count(*) FILTER (k <= floor(s.s * 64 / 10)) AS n_revealed, round(coalesce(sum(v) FILTER (k <= floor(s.s * 64 / 10)), 0), 4) AS revealed FROM r CROSS JOIN range(0, 11) s(s) GROUP BY ALL"""
)
def win_reveal(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each vector is ranked and summed within its row: no shuffle
    sorted_ = F.reverse(F.array_sort(F.transform("embedding", lambda x: x.cast("double"))))
    steps = table(spark, sf_dir, "embeddings").select("vec_id", sorted_.alias("v"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("step"))
    n = F.floor(F.col("step") * F.size("v") / 10).cast("int")
    return steps.select("vec_id", "step", n.cast("long").alias("n_revealed"), F.round(F.aggregate(F.slice("v", F.lit(1), n), F.lit(0.0), lambda a, x: a + x), 4).alias("revealed"))
