"""Rule cascades, gates, ladders and bracket grades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.brackets import COVERAGE_WEIGHTS, SEVERITY_GRADES, bracket_case, bracket_sql, severity_grade
from ..operators.rules import Rule, all_flags, first_failure, ladder
from ..plans.relations import REPORT, report, table, with_
from ..registry import query


@query(
    """SELECT p_partkey, CASE WHEN p_size = 0 THEN 'empty' WHEN p_size < 3 THEN 'too_small_file:' || p_size::varchar WHEN p_size < 8 THEN 'too_small:' || p_size::varchar WHEN p_size > 48 THEN 'too_large:' || p_size::varchar
    WHEN p_retailprice / p_size > 200 THEN 'aspect' WHEN p_type = 'PROMO' THEN 'mode_1' END AS reason,
  concat_ws(' | ', CASE WHEN p_brand LIKE '%1' THEN 'gray' END, CASE WHEN p_retailprice < 1000 THEN 'low_green' END) AS flags FROM part"""
)
def rule_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size"), F.col("p_retailprice")
    said = size.cast("string")
    rules = [
        Rule("empty", size == 0),
        Rule("too_small_file", size < 3, said),
        Rule("too_small", size < 8, said),
        Rule("too_large", size > 48, said),
        Rule("aspect", F.try_divide(price, size) > 200),
        Rule("mode_1", F.col("p_type") == "PROMO"),
    ]
    flags = [Rule("gray", F.col("p_brand").endswith("1")), Rule("low_green", price < 1000)]
    return table(spark, sf_dir, "part").select("p_partkey", first_failure(rules).alias("reason"), all_flags(flags).alias("flags"))


@query(
    """SELECT doc_id, CASE WHEN n_chars < 50 THEN 'neg_tiny:' || n_chars::varchar WHEN n_chars > 20000 THEN 'neg_huge' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'neg_lang:' || lang END AS reason FROM documents"""
)
def rule_validate_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    rules = [Rule("neg_tiny", n < 50, n.cast("string")), Rule("neg_huge", n > 20000), Rule("neg_lang", ~F.col("lang").isin("en", "fr", "de"), F.col("lang"))]
    return table(spark, sf_dir, "documents").select("doc_id", first_failure(rules).alias("reason"))


@query(
    with_(REPORT)
    + """, m AS (SELECT *, l_linenumber % 2 = 0 AS boxed, (l_partkey % 100 + 1) / 100.0::double AS box, 1 + (l_suppkey % 8) / 10.0::double AS box_aspect, 0.9::double + (l_partkey % 7) / 20.0::double AS aspect FROM report),
  c AS (SELECT *, CASE WHEN boxed AND box < 0.70::double THEN coverage / 50 / box ELSE coverage END AS cov FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN cov < 0.02::double THEN 'coverage_low' WHEN mode_a = 0 THEN 'no_foreground' WHEN cov >= 0.97::double AND conf < 0.80::double THEN 'coverage_high_low_conf'
    WHEN cov >= 0.97::double THEN 'ok_high_coverage' WHEN conf < 0.65::double THEN 'confidence_low' WHEN aspect < 1.0::double AND (NOT boxed OR (box_aspect >= 1.15::double AND box < 0.70::double)) THEN 'aspect_low' ELSE 'passed' END AS verdict FROM c"""
)
def rule_qa_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every other item has a box, whose share of the image and aspect follow from its keys
    boxed, box, box_aspect = F.col("l_linenumber") % 2 == 0, (F.col("l_partkey") % 100 + 1) / F.lit(100.0), F.lit(1) + (F.col("l_suppkey") % 8) / F.lit(10.0)
    aspect, conf = F.lit(0.9) + (F.col("l_partkey") % 7) / F.lit(20.0), F.col("conf")
    # coverage of the box, unless that is most of the image
    cov = F.when(boxed & (box < 0.70), F.col("coverage") / 50 / box).otherwise(F.col("coverage"))
    rules = [
        Rule("coverage_low", cov < 0.02),
        Rule("no_foreground", F.col("mode_a") == 0),
        Rule("coverage_high_low_conf", (cov >= 0.97) & (conf < 0.80)),
        Rule("ok_high_coverage", cov >= 0.97),
        Rule("confidence_low", conf < 0.65),
        Rule("aspect_low", (aspect < 1.0) & (~boxed | ((box_aspect >= 1.15) & (box < 0.70)))),
    ]
    return report(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(first_failure(rules), F.lit("passed")).alias("verdict"))


@query(
    with_(REPORT)
    + """, best AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY conf DESC, l_linenumber, l_partkey, l_suppkey, coverage) AS k FROM report)
SELECT l_orderkey, conf, coverage FROM best WHERE k = 1 AND NOT (conf - 0.4::double < 0.35::double OR l_partkey % 200 < 16 OR l_suppkey % 150 < 16 OR (coverage >= 0.70::double AND conf - 0.4::double < 0.50::double) OR coverage > 0.98::double)"""
)
def rule_box_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.setops import first_of_each

    best = first_of_each(report(spark, sf_dir), ["l_orderkey"], F.desc("conf"), "l_linenumber", "l_partkey", "l_suppkey", "coverage")
    # a detector is less sure than a mask by 0.4; sides of boxes follow from the keys
    conf, cov, wide, high = F.col("conf") - 0.4, F.col("coverage"), F.col("l_partkey") % 200, F.col("l_suppkey") % 150
    return best.filter(~((conf < 0.35) | (wide < 16) | (high < 16) | ((cov >= 0.70) & (conf < 0.50)) | (cov > 0.98))).select("l_orderkey", "conf", "coverage")


@query(
    with_(REPORT)
    + """, f AS (SELECT category, CASE WHEN category = 'A' THEN CASE WHEN mode_a > 50 THEN 'HIGH' WHEN mode_a > 15 THEN 'WATCH' ELSE 'OK' END
    WHEN category = 'N' THEN CASE WHEN mode_a < 5 THEN 'EMPTY' WHEN mode_a > 90 THEN 'HIGH' ELSE 'OK' END ELSE CASE WHEN mode_a < 1 THEN 'EMPTY' ELSE 'OK' END END AS flag FROM report)
SELECT category, flag, count(*) AS n FROM f GROUP BY ALL"""
)
def rule_autoflag(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, c = F.col("mode_a"), F.col("category")
    flag = (
        F.when(c == "A", F.when(s > 50, "HIGH").when(s > 15, "WATCH").otherwise("OK"))
        .when(c == "N", F.when(s < 5, "EMPTY").when(s > 90, "HIGH").otherwise("OK"))
        .otherwise(F.when(s < 1, "EMPTY").otherwise("OK"))
    )
    return report(spark, sf_dir).select("category", flag.alias("flag")).groupBy("category", "flag").agg(F.count("*").alias("n"))


@query(
    with_(REPORT)
    + """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN coverage = 0 THEN 0.0::double WHEN mode_b / 500 < 0.01::double THEN 0.0::double WHEN mode_b / 500 < 0.04::double THEN mode_b * 0.3::double WHEN mode_b / 500 > 0.15::double THEN 0.0::double ELSE mode_b END AS severity
FROM report WHERE category = 'A'"""
)
def rule_healthy_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the symptom's share of the leaf: under 1 % is noise, under 4 % is damped, over 15 % isn't credible
    s, share = F.col("mode_b"), F.col("mode_b") / 500
    gated = F.when(F.col("coverage") == 0, 0.0).when(share < 0.01, 0.0).when(share < 0.04, s * 0.3).when(share > 0.15, 0.0).otherwise(s)
    return report(spark, sf_dir).filter("category = 'A'").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", gated.alias("severity"))


@query(with_(REPORT) + f"SELECT category, {bracket_sql('coverage', COVERAGE_WEIGHTS)} AS weight, count(*) AS n FROM report GROUP BY ALL")
def rule_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).select("category", bracket_case(F.col("coverage"), COVERAGE_WEIGHTS).alias("weight")).groupBy("category", "weight").agg(F.count("*").alias("n"))


@query(
    with_(REPORT)
    + f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN mode_d < 0 THEN -1 WHEN category = 'A' THEN 0 ELSE {bracket_sql('mode_d', SEVERITY_GRADES, 5)} END AS grade FROM report"
)
def rule_severity_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", severity_grade(F.col("mode_d"), F.col("category"), "A").alias("grade"))


@query(
    """WITH m AS (SELECT l_suppkey AS variant, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0::double ELSE 0.0::double END), 6) AS kappa FROM lineitem GROUP BY 1)
SELECT variant, kappa, CASE WHEN kappa >= 0.6::double THEN 'good' WHEN kappa >= 0.4::double THEN 'warn' ELSE 'bad' END AS badge FROM m"""
)
def rule_quality_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("variant")).agg(F.round(F.avg(F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.0)), 6).alias("kappa"))
    return m.withColumn("badge", ladder(F.col("kappa"), [(0.6, "good"), (0.4, "warn")], "bad"))


@query(with_(REPORT) + "SELECT category, count(*) FILTER (conf >= CASE WHEN category = 'N' THEN 0.60::double ELSE 0.50::double END) AS n_positive, count(*) AS n FROM report GROUP BY category")
def rule_select_thresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = F.when(F.col("category") == "N", 0.60).otherwise(0.50)
    return report(spark, sf_dir).groupBy("category").agg(F.count_if(F.col("conf") >= bound).alias("n_positive"), F.count("*").alias("n"))
