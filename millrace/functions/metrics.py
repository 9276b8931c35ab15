"""Metrics from sufficient statistics: sums combine map-side, and distinct scores are dealt by range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import running

EPS = 1e-7


def confusion(df: DataFrame, truth: str, pred: str, truths: Sequence, preds: Sequence | None = None) -> DataFrame:
    """(truth, pred, n) with every declared cell, those without rows too."""
    spark, preds = df.sparkSession, truths if preds is None else preds
    kinds = df.select(truth, pred).schema
    cells = spark.createDataFrame([(t, p) for t in truths for p in preds], f"truth {kinds[0].dataType.simpleString()}, pred {kinds[1].dataType.simpleString()}")
    counts = df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return cells.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def binary_counts(truth: Column, pred: Column) -> list[Column]:
    return [F.count_if(truth & pred).alias("tp"), F.count_if(~truth & pred).alias("fp"), F.count_if(truth & ~pred).alias("fn"), F.count_if(~truth & ~pred).alias("tn")]


def segmentation(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "iou": tp / (tp + fp + fn + F.lit(EPS)),
        "dice": F.lit(2) * tp / (F.lit(2) * tp + fp + fn + F.lit(EPS)),
        "recall": tp / (tp + fn + F.lit(EPS)),
        "precision": tp / (tp + fp + F.lit(EPS)),
        "specificity": tn / (tn + fp + F.lit(EPS)),
    }


def per_class(matrix: DataFrame) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) from a square matrix; 0 where a denominator is 0."""
    t = matrix.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"))
    p = matrix.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    both = t.join(p, "label").withColumn("precision", share(F.col("hits"), F.col("predicted"))).withColumn("recall", share(F.col("hits"), F.col("support")))
    return both.withColumn("f1", share(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def roc(df: DataFrame, y: str, score: str, *keys: str) -> DataFrame:
    """(keys, threshold, tp, fp, p, n): cumulated counts at each distinct score from above; ties are one point."""
    at = df.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(F.col(y)).cast("long").alias("_p"), F.count("*").alias("_n"))
    points = running(at, "threshold", {"tp": F.col("_p"), "fp": F.col("_n") - F.col("_p")}, *keys, descending=True)
    total = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.coalesce(F.sum(F.col(y)), F.lit(0)).cast("long").alias("p"), (F.count("*") - F.coalesce(F.sum(F.col(y)), F.lit(0))).cast("long").alias("n"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = points.join(total, same) if keys else points.crossJoin(F.broadcast(total))  # one row
    return joined.select(*keys, "threshold", "tp", "fp", "p", "n")


def auc(df: DataFrame, y: str, score: str, *keys: str) -> DataFrame:
    """(keys, auc): the share of pairs in which the positive scores higher, ties by half; null with a class missing."""
    at = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(y)).cast("long").alias("_p"), F.count("*").alias("_n"))
    q = F.col("_n") - F.col("_p")
    upto = running(at.withColumn("_q", q), "_s", {"_upto": F.col("_q")}, *keys)
    won = F.col("_p") * (F.col("_upto") - F.col("_q") / 2)
    sums = upto.groupBy(*keys).agg(F.sum(won).alias("_w"), (F.sum("_p").cast("double") * F.sum("_q")).alias("_pairs"))
    return sums.select(*keys, F.try_divide("_w", "_pairs").alias("auc"))


def best_threshold(points: DataFrame, least_recall: float, cap: float, default: float) -> DataFrame:
    """(threshold): the score with the largest sqrt(recall * specificity) of those with enough recall, the largest of ties, at most ``cap``; else the default."""
    recall, spec = F.col("tp") / F.greatest("p", F.lit(1)), F.lit(1) - F.col("fp") / F.greatest("n", F.lit(1))
    best = points.filter(recall >= least_recall).select("threshold", F.round(F.sqrt(recall * spec), 9).alias("g")).orderBy(F.desc("g"), F.desc("threshold")).limit(1)
    return best.agg(F.least(F.coalesce(F.max("threshold"), F.lit(default)), F.lit(cap)).alias("threshold"))


def kappa(matrix: DataFrame) -> DataFrame:
    """Cohen's kappa of a square matrix: null without rows, 1 if chance agreement is certain."""
    whole = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("same"))
    t, p = matrix.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("t")), matrix.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("p"))
    chance = t.join(p, "c").agg(F.sum(F.col("t").cast("double") * F.col("p")).alias("tp"))
    pe, po = F.col("tp") / F.col("n") / F.col("n"), F.col("same") / F.col("n")
    return whole.crossJoin(chance).select(F.when(F.col("n") == 0, F.lit(None)).when(pe >= 1, F.lit(1.0)).otherwise(F.try_divide(po - pe, F.lit(1.0) - pe)).cast("double").alias("kappa"))  # one row each


def mcc(matrix: DataFrame) -> DataFrame:
    """Matthews' correlation of a square matrix of any number of classes; 0 where it has no meaning."""
    c = per_class(matrix).agg(F.sum("hits").cast("double").alias("c"), F.sum("support").cast("double").alias("s"), F.sum(F.col("support") * F.col("predicted")).cast("double").alias("tp"), F.sum(F.col("support") * F.col("support")).cast("double").alias("tt"), F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"))
    s2 = F.col("s") * F.col("s")
    return c.select(F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))), F.lit(0.0)).alias("mcc"))


def regression(y: Column, x: Column) -> list[Column]:
    """MAE, MSE, RMSE, MAPE in percent, R squared and Pearson's r of predictions x for y."""
    d, n = y - x, F.count("*")
    sse, sst = F.sum(d * d), F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return [
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), (F.avg(F.abs(d) / F.greatest(F.abs(y), F.lit(1e-6))) * 100).alias("mape"),
        (1 - sse / F.greatest(sst, F.lit(EPS))).alias("r2"), F.when(n <= 1, F.lit(0.0)).otherwise(F.corr(y, x)).alias("pearson"),
    ]
