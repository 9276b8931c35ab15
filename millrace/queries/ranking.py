"""Ranks, normalisation and winners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import extremes, first_max, gate_then_tiebreak, gated, min_max, value_ranks
from ..plans.relations import REPORT, VARIANTS, report, table, variants, with_
from ..registry import query


@query(with_(VARIANTS) + "SELECT variant, n % 3 AS component, rank() OVER (PARTITION BY n % 3 ORDER BY recall DESC) AS rank FROM variants")
def win_rank_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).withColumn("component", F.col("n") % 3)
    return v.join(value_ranks(v, "recall", "component", descending=True), ["component", "recall"]).select("variant", "component", F.col("min_rank").cast("long").alias("rank"))


@query(with_(VARIANTS) + "SELECT variant, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::double AS avg_rank FROM variants")
def win_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).select("variant", F.col("n").alias("rows"))
    return v.join(value_ranks(v, "rows"), "rows").select("variant", F.col("average_rank").cast("double").alias("avg_rank"))


@query(with_(VARIANTS) + "SELECT variant, dice FROM variants ORDER BY dice DESC, variant LIMIT 1")
def srt_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_max(variants(spark, sf_dir), F.col("dice"), "variant").select("variant", "dice")


@query(with_(VARIANTS) + "SELECT variant, recall, specificity FROM variants ORDER BY recall DESC, variant")
def srt_rank_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("variant", "recall", "specificity").orderBy(F.desc("recall"), "variant")


@query(
    with_(VARIANTS)
    + """, w AS (SELECT * FROM variants WHERE variant % 7 <> 0), g AS (SELECT *, max((recall >= 0.7::double)::int) OVER () AS any_ok FROM w), f AS (SELECT * FROM g WHERE recall >= 0.7::double OR any_ok = 0), b AS (SELECT *, max(specificity) OVER () AS best FROM f)
SELECT variant, recall, specificity, auc FROM b WHERE specificity >= best - 0.005::double ORDER BY auc DESC NULLS LAST, specificity DESC, variant LIMIT 1"""
)
def sel_gate_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = variants(spark, sf_dir).filter("variant % 7 <> 0")
    return gate_then_tiebreak(allowed, F.col("recall") >= 0.7, "specificity", 0.005, "auc", "variant").select("variant", "recall", "specificity", "auc")


@query(with_(VARIANTS) + "SELECT variant, dice AS best_dice FROM variants WHERE dice = (SELECT max(dice) FROM variants) ORDER BY variant LIMIT 1")
def sel_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_max(variants(spark, sf_dir), F.col("dice"), "variant").select("variant", F.col("dice").alias("best_dice"))


@query(
    with_(VARIANTS)
    + """, g AS (SELECT *, max((recall >= 0.66::double)::int) OVER () AS any_ok FROM variants), f AS (SELECT * FROM g WHERE recall >= 0.66::double OR any_ok = 0), s AS (SELECT variant, round(0.6::double * specificity + 0.4::double * (min(latency_ms) OVER () / latency_ms), 6) AS score FROM f)
SELECT variant, score FROM s ORDER BY score DESC, variant LIMIT 1"""
)
def sel_relative_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = extremes(gated(variants(spark, sf_dir), F.col("recall") >= 0.66), "latency_ms")
    speed = F.col("_min_latency_ms") / F.col("latency_ms")
    return first_max(g.select("variant", F.round(F.lit(0.6) * F.col("specificity") + F.lit(0.4) * speed, 6).alias("score")), F.col("score"), "variant")


@query(with_(VARIANTS) + "SELECT variant, round(0.75::double * dice + 0.25::double * least(600 / greatest(latency_ms, 1), 1), 6) AS score FROM variants ORDER BY score DESC, variant LIMIT 1")
def sel_fixed_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.lit(0.75) * F.col("dice") + F.lit(0.25) * F.least(F.lit(600) / F.greatest("latency_ms", F.lit(1)), F.lit(1))
    return first_max(variants(spark, sf_dir).select("variant", F.round(score, 6).alias("score")), F.col("score"), "variant")


@query(
    with_(VARIANTS)
    + """, s AS (SELECT variant, round(0.7::double * recall + 0.3::double * (1 - (latency_ms - min(latency_ms) OVER ()) / nullif(max(latency_ms) OVER () - min(latency_ms) OVER (), 0)), 6) AS score FROM variants)
SELECT variant, score FROM s ORDER BY score DESC, variant LIMIT 1"""
)
def sel_minmax_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.lit(0.7) * F.col("recall") + F.lit(0.3) * min_max("latency_ms", invert=True)
    return first_max(extremes(variants(spark, sf_dir), "latency_ms").select("variant", F.round(score, 6).alias("score")), F.col("score"), "variant")



def _mobile():
    c = lambda name, default: F.coalesce(F.col(name), F.lit(float(default)))
    return (
        F.lit(0.32) * c("recall", 0) + F.lit(0.18) * c("specificity", 0) + F.lit(0.18) * c("dice", 0) + F.lit(0.16) * F.least(F.lit(150.0) / F.greatest(c("latency_ms", 999), F.lit(1.0)), F.lit(1.0))
        + F.lit(0.08) * F.coalesce("auc", "recall") + F.lit(0.05) * (F.lit(1.0) - c("mae", 100) / 100) + F.lit(0.03) * F.least(F.lit(15.0) / F.coalesce(F.col("n").cast("double"), F.lit(1.0)), F.lit(1.0))
    )


MOBILE_SQL = """round(0.32::double * coalesce(recall, 0) + 0.18::double * coalesce(specificity, 0) + 0.18::double * coalesce(dice, 0) + 0.16::double * least(150.0::double / greatest(coalesce(latency_ms, 999), 1), 1)
  + 0.08::double * coalesce(auc, recall) + 0.05::double * (1 - coalesce(mae, 100) / 100) + 0.03::double * least(15.0::double / coalesce(n::double, 1), 1), 6)"""


@query(with_(VARIANTS) + f"SELECT variant, {MOBILE_SQL} AS composite FROM variants")
def met_composite_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark, sf_dir).select("variant", F.round(_mobile(), 6).alias("composite"))


@query(
    with_(VARIANTS)
    + f""", s AS (SELECT variant, variant % 3 <> 0 AS compatible, {MOBILE_SQL} AS composite FROM variants), g AS (SELECT *, max(compatible::int) OVER () AS any_ok FROM s)
SELECT variant, composite FROM g WHERE compatible OR any_ok = 0 ORDER BY composite DESC, variant LIMIT 1"""
)
def sel_mobile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = variants(spark, sf_dir).select("variant", (F.col("variant") % 3 != 0).alias("compatible"), F.round(_mobile(), 6).alias("composite"))
    return first_max(gated(s, F.col("compatible")), F.col("composite"), "variant").select("variant", "composite")


@query(
    with_(VARIANTS)
    + """, p AS (SELECT 1 AS priority, variant, dice FROM variants WHERE dice > 5 UNION ALL SELECT 2, variant, dice FROM variants WHERE n > 100000 UNION ALL SELECT 3, variant, dice FROM variants)
SELECT priority, variant, dice FROM p ORDER BY priority, dice DESC, variant LIMIT 1"""
)
def sel_fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).select("variant", "dice", "n")
    chain = [v.filter("dice > 5"), v.filter("n > 100000"), v]
    parts = [p.select(F.lit(i).alias("priority"), "variant", "dice") for i, p in enumerate(chain, 1)]
    return parts[0].union(parts[1]).union(parts[2]).orderBy("priority", F.desc("dice"), "variant").limit(1)


@query(with_(VARIANTS) + "SELECT variant, recall AS composite FROM variants WHERE recall > -1 ORDER BY recall DESC, variant LIMIT 1")
def sel_report_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_max(variants(spark, sf_dir).filter("recall > -1").select("variant", F.col("recall").alias("composite")), F.col("composite"), "variant")


@query(
    with_(VARIANTS)
    + """SELECT variant, round((recall - min(recall) OVER ()) / nullif(max(recall) OVER () - min(recall) OVER (), 0), 6) AS recall_norm,
  round(1 - (latency_ms - min(latency_ms) OVER ()) / nullif(max(latency_ms) OVER () - min(latency_ms) OVER (), 0), 6) AS speed_norm, 0.5::double AS flat_norm FROM variants"""
)
def win_minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir).withColumn("flat", F.lit(1.0))
    return extremes(v, "recall", "latency_ms", "flat").select(
        "variant", F.round(min_max("recall"), 6).alias("recall_norm"), F.round(min_max("latency_ms", invert=True), 6).alias("speed_norm"), min_max("flat").alias("flat_norm")
    )


@query(with_(REPORT) + "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coverage FROM report WHERE category = 'R' ORDER BY coverage, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20")
def win_fp_worst_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return report(spark, sf_dir).filter("category = 'R'").select(*keys, "coverage").orderBy("coverage", *keys).limit(20)


@query(
    """WITH m AS (SELECT l_returnflag AS t, l_linestatus AS p, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT t.t, p.p, coalesce(n, 0) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) t(t) CROSS JOIN (VALUES ('F'), ('O')) p(p) LEFT JOIN m USING (t, p))
SELECT t AS truth, p AS pred, n, round(n / greatest(sum(n) OVER (PARTITION BY t), 1), 6) AS share FROM g"""
)
def win_row_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.metrics import confusion

    m = confusion(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["A", "N", "R", "X"], ["F", "O"])
    return m.select("truth", "pred", "n", F.round(F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("truth")), F.lit(1)), 6).alias("share"))
