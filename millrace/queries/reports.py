"""Summaries and audits of quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import exact_avg
from ..operators.aggregates import counted, described, filled_pivot, percent_of_total, rollup_overall
from ..operators.brackets import COVERAGE_WEIGHTS, bracket_case, bracket_sql
from ..operators.medians import medians
from ..plans.relations import REPORT, report, table, with_
from ..registry import query

MODES = ("mode_a", "mode_b", "mode_c", "mode_d")


@query(
    with_(REPORT)
    + """, long AS (
  SELECT category, 'mode_a' AS mode, mode_a AS severity FROM report UNION ALL SELECT category, 'mode_b', mode_b FROM report
  UNION ALL SELECT category, 'mode_c', mode_c FROM report UNION ALL SELECT category, 'mode_d', mode_d FROM report)
SELECT mode, category, count(*) AS n, round(avg(nullif(severity, -1)), 6) AS mean_severity, round(stddev_samp(nullif(severity, -1)), 6) AS std_severity,
  round(median(nullif(severity, -1)), 6) AS median_severity, round(100.0 * count(*) FILTER (severity > 0) / greatest(count(*) FILTER (severity <> -1), 1), 6) AS pct_positive,
  count(*) FILTER (severity = -1) AS n_excluded, round(100.0 * count(*) FILTER (severity = -1) / count(*), 6) AS pct_excluded
FROM long GROUP BY mode, category"""
)
def agg_mode_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = report(spark, sf_dir).select("category", *MODES).unpivot("category", list(MODES), "mode", "severity")
    s = F.when(F.col("severity") != -1, F.col("severity"))
    middle = medians(long.select("mode", "category", s.alias("s")), "s", "mode", "category").withColumn("median_severity", F.round("median", 6)).drop("median")
    counts = long.groupBy("mode", "category").agg(
        F.count("*").alias("n"),
        F.round(exact_avg(s), 6).alias("mean_severity"),
        F.round(F.stddev_samp(s), 6).alias("std_severity"),
        F.round(F.lit(100.0) * F.count_if(F.col("severity") > 0) / F.greatest(F.count(s), F.lit(1)), 6).alias("pct_positive"),
        F.count_if(F.col("severity") == -1).alias("n_excluded"),
        F.round(F.lit(100.0) * F.count_if(F.col("severity") == -1) / F.count("*"), 6).alias("pct_excluded"),
    )
    return counts.join(middle, ["mode", "category"], "left")


@query("SELECT l_shipdate::date::varchar AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, value")
def agg_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").cast("string").alias("value")), "value")


@query("SELECT o_orderpriority AS value, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM orders GROUP BY 1")
def agg_pct_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percent_of_total(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("value")), "value")


@query(
    with_(REPORT)
    + """SELECT category, count(*) AS total, count(*) FILTER (coverage >= 0.2) AS passed, count(*) FILTER (coverage < 0.2) AS rejected,
  round(100.0 * count(*) FILTER (coverage >= 0.2) / greatest(count(*), 1), 6) AS pass_pct FROM report GROUP BY category"""
)
def agg_class_passrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("coverage") >= 0.2
    return report(spark, sf_dir).groupBy("category").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("rejected"), F.round(F.lit(100.0) * F.count_if(ok) / F.greatest(F.count("*"), F.lit(1)), 6).alias("pass_pct")
    )


@query(
    with_(REPORT)
    + """SELECT count(*) AS total, count(*) FILTER (coverage < 0.1) AS rejected, round(100.0 * count(*) FILTER (coverage < 0.1) / greatest(count(*), 1), 6) AS reject_pct,
  CASE WHEN 100.0 * count(*) FILTER (coverage < 0.1) / greatest(count(*), 1) <= 8 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM report"""
)
def agg_overall_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = F.lit(100.0) * F.count_if(F.col("coverage") < 0.1) / F.greatest(F.count("*"), F.lit(1))
    return report(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("coverage") < 0.1).alias("rejected"), F.round(pct, 6).alias("reject_pct"), F.when(pct <= 8, "PASS").otherwise("FAIL").alias("verdict"))


@query(
    with_(REPORT)
    + "SELECT category, round(avg(coverage), 6) AS mean, round(stddev_samp(coverage), 6) AS std, min(coverage) AS min, max(coverage) AS max FROM report GROUP BY category"
)
def agg_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(report(spark, sf_dir), "coverage", "category")


@query(
    with_(REPORT)
    + """SELECT status AS artifact, round(avg(coverage) FILTER (category = 'A'), 6) AS a_mean, round(stddev_pop(coverage) FILTER (category = 'A'), 6) AS a_std, count(*) FILTER (category = 'A') AS a_n,
  round(avg(coverage) FILTER (category = 'N'), 6) AS n_mean, round(stddev_pop(coverage) FILTER (category = 'N'), 6) AS n_std, count(*) FILTER (category = 'N') AS n_n,
  round(avg(coverage) FILTER (category = 'R'), 6) AS r_mean, round(stddev_pop(coverage) FILTER (category = 'R'), 6) AS r_std, count(*) FILTER (category = 'R') AS r_n,
  round(avg(coverage), 6) AS overall_mean, count(*) FILTER (coverage < 0.75) AS n_below_warn, avg(coverage) >= 0.5 AS target_met FROM report GROUP BY status"""
)
def agg_wide_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = []
    for c in ("A", "N", "R"):
        v = F.when(F.col("category") == c, F.col("coverage"))
        wide += [F.round(exact_avg(v), 6).alias(f"{c.lower()}_mean"), F.round(F.stddev_pop(v), 6).alias(f"{c.lower()}_std"), F.count(v).alias(f"{c.lower()}_n")]
    return report(spark, sf_dir).groupBy(F.col("status").alias("artifact")).agg(
        *wide, F.round(exact_avg("coverage"), 6).alias("overall_mean"), F.count_if(F.col("coverage") < 0.75).alias("n_below_warn"), (exact_avg("coverage") >= 0.5).alias("target_met")
    )


@query(
    with_(REPORT)
    + """SELECT CASE WHEN grouping(category) = 1 THEN 'Overall' ELSE category END AS category, count(*) AS n, round(avg(coverage), 6) AS mean_coverage FROM report GROUP BY ROLLUP (category)"""
)
def agg_class_plus_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_overall(report(spark, sf_dir), "category", F.count("*").alias("n"), F.round(exact_avg("coverage"), 6).alias("mean_coverage"))


@query("SELECT CASE WHEN starts_with(p_type, 'P') THEN 'prefixed' ELSE 'other' END AS strategy, count(*) AS n FROM part GROUP BY 1")
def agg_strategy_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.when(F.col("p_type").startswith("P"), "prefixed").otherwise("other").alias("strategy")).agg(F.count("*").alias("n"))


@query(
    with_(REPORT)
    + """SELECT l_suppkey AS variant, count(*) AS n_items, count(*) FILTER (conf >= 0.7::double) AS n_passed, count(*) FILTER (conf < 0.7::double) AS n_rejected,
  round(count(*) FILTER (conf >= 0.7::double) / greatest(count(*), 1), 6) AS admission_rate, round(count(*) FILTER (conf < 0.7::double) / greatest(count(*), 1), 6) AS false_rejection_rate
FROM report GROUP BY l_suppkey"""
)
def agg_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, n = F.col("conf") >= 0.7, F.greatest(F.count("*"), F.lit(1))
    return report(spark, sf_dir).groupBy(F.col("l_suppkey").alias("variant")).agg(
        F.count("*").alias("n_items"), F.count_if(ok).alias("n_passed"), F.count_if(~ok).alias("n_rejected"), F.round(F.count_if(ok) / n, 6).alias("admission_rate"), F.round(F.count_if(~ok) / n, 6).alias("false_rejection_rate")
    )


@query(
    with_(REPORT)
    + """, long AS (SELECT category, 'mode_a' AS mode, mode_a AS severity FROM report UNION ALL SELECT category, 'mode_b', mode_b FROM report)
SELECT mode, category, round(avg(severity), 6) AS mean_severity FROM long WHERE severity <> -1 GROUP BY ALL"""
)
def met_mode_class_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = report(spark, sf_dir).select("category", "mode_a", "mode_b").unpivot("category", ["mode_a", "mode_b"], "mode", "severity")
    return long.filter("severity <> -1").groupBy("mode", "category").agg(F.round(exact_avg("severity"), 6).alias("mean_severity"))


@query(
    """SELECT o_orderpriority AS method, round(avg(o_totalprice), 4) AS mean_price, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_price_f FROM orders GROUP BY 1"""
)
def agg_method_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method")).agg(
        F.round(exact_avg("o_totalprice"), 4).alias("mean_price"), F.round(exact_avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), 4).alias("mean_price_f")
    )


@query(
    """SELECT o_orderpriority AS method, o_orderstatus AS category, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price,
  round(100.0 * count(*) FILTER (o_totalprice > 100000) / count(*), 4) AS correct_pct FROM orders GROUP BY 1, 2"""
)
def agg_method_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.col("o_orderstatus").alias("category")).agg(
        F.count("*").alias("n"), F.round(exact_avg("o_totalprice"), 4).alias("mean_price"), F.round(F.lit(100.0) * F.count_if(F.col("o_totalprice") > 100000) / F.count("*"), 4).alias("correct_pct")
    )


@query(
    """SELECT lang AS category, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source = 'none') AS "none" FROM documents GROUP BY lang"""
)
def agg_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_pivot(table(spark, sf_dir, "documents").select(F.col("lang").alias("category"), "source"), "category", "source", ["src0", "src1", "none"])


@query(
    with_(REPORT)
    + f""", weighted AS (SELECT category, {bracket_sql('coverage', COVERAGE_WEIGHTS)} AS weight FROM report)
SELECT category, weight, round(weight / greatest(count(*) OVER (PARTITION BY category), 1), 9) AS class_weight, count(*) AS n FROM weighted GROUP BY category, weight""".replace(
        "round(weight / greatest(count(*) OVER (PARTITION BY category), 1), 9)", "round(weight / greatest(sum(count(*)) OVER (PARTITION BY category), 1), 9)"
    )
)
def agg_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    weighted = report(spark, sf_dir).select("category", bracket_case(F.col("coverage"), COVERAGE_WEIGHTS).alias("weight")).groupBy("category", "weight").agg(F.count("*").alias("n"))
    total = F.greatest(F.sum("n").over(Window.partitionBy("category")), F.lit(1))
    return weighted.select("category", "weight", F.round(F.col("weight") / total, 9).alias("class_weight"), "n")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events)
SELECT event_type AS variant, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS std_ms, round(1000 / greatest(avg(value), 0.001), 6) AS fps FROM r WHERE k > 20 GROUP BY event_type"""
)
def agg_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.series import after_warm_up

    timed = after_warm_up(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], 20)
    return timed.groupBy(F.col("event_type").alias("variant")).agg(
        F.round(exact_avg("value"), 6).alias("mean_ms"), F.round(F.stddev_pop("value"), 6).alias("std_ms"), F.round(F.lit(1000) / F.greatest(exact_avg("value"), F.lit(0.001)), 6).alias("fps")
    )
