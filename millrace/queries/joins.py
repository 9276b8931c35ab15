"""Joins: anti, semi, flags, lookups, ranges, proximity, nearest neighbours, suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import exact_avg
from ..operators.brackets import SEVERITY_BOUNDS, SEVERITY_GRADES, bracket_join, bracket_sql
from ..operators.joins import contains_match, knn_mean_distance, suffix_match
from ..operators.setops import first_of_each
from ..plans.relations import MANIFEST, REPORT, manifest, report, table, with_
from ..registry import query


@query(with_(MANIFEST) + "SELECT m.doc_id FROM manifest m WHERE m.split <> 'test' AND NOT EXISTS (SELECT 1 FROM manifest t WHERE t.split = 'test' AND t.category = m.category AND t.filename = m.filename)")
def join_anti_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    return m.filter("split <> 'test'").join(m.filter("split = 'test'"), ["category", "filename"], "left_anti").select("doc_id")


@query(with_(MANIFEST) + "SELECT m.doc_id FROM manifest m WHERE m.split <> 'test' AND m.filename NOT IN (SELECT filename FROM manifest WHERE split = 'test')")
def join_anti_bare(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    return m.filter("split <> 'test'").join(m.filter("split = 'test'"), "filename", "left_anti").select("doc_id")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS is_tier1 FROM documents")
def join_semi_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("_in", F.lit(True))
    return table(spark, sf_dir, "documents").select("doc_id").join(marked, "doc_id", "left").select("doc_id", F.coalesce("_in", F.lit(False)).alias("is_tier1"))


@query(
    with_(MANIFEST)
    + """, first AS (SELECT filename, split FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY doc_id) AS k FROM manifest WHERE n_chars > 1500) WHERE k = 1)
SELECT m.doc_id, coalesce(f.split, 'train') AS split FROM manifest m LEFT JOIN first f USING (filename)"""
)
def join_lookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    first = first_of_each(m.filter("n_chars > 1500"), ["filename"], "doc_id").select("filename", F.col("split").alias("_split"))
    return m.join(first, "filename", "left").select("doc_id", F.coalesce("_split", F.lit("train")).alias("split"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def join_exists_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(have, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


@query(
    """WITH a AS (SELECT l_partkey AS p, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), n AS (SELECT l_partkey AS p, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
  r AS (SELECT l_partkey AS p, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_partkey, coalesce(a.v, -1.0::double) AS a_iou, coalesce(n.v, -1.0::double) AS n_iou, coalesce(r.v, -1.0::double) AS r_iou, coalesce(a.v < 0.05::double, false) AS a_warn
FROM part LEFT JOIN a ON a.p = p_partkey LEFT JOIN n ON n.p = p_partkey LEFT JOIN r ON r.p = p_partkey"""
)
def join_left_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, out = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey")
    # three left joins on one key: one aggregation gives all three sides
    of = lambda c: F.round(exact_avg(F.when(F.col("l_returnflag") == c, F.col("l_discount"))), 6)
    sides = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(of("A").alias("a"), of("N").alias("n"), of("R").alias("r"))
    joined = out.join(sides, "p_partkey", "left")
    filled = [F.coalesce(c, F.lit(-1.0)).alias(f"{c}_iou") for c in ("a", "n", "r")]
    return joined.select("p_partkey", *filled, F.coalesce(F.col("a") < 0.05, F.lit(False)).alias("a_warn"))


@query(
    """SELECT o_orderkey, c_name, n_name, CASE WHEN starts_with(o_orderpriority, '1') THEN 'urgent' WHEN starts_with(o_orderpriority, '2') THEN 'high' ELSE 'other' END AS category
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_mktsegment) = 'building' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')"""
)
def join_coco(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    wanted = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    joined = orders.join(customer.filter(F.lower("c_mktsegment") == "building"), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    priority = F.col("o_orderpriority")
    category = F.when(priority.startswith("1"), "urgent").when(priority.startswith("2"), "high").otherwise("other")
    return joined.join(wanted, "o_orderkey", "left_semi").select("o_orderkey", "c_name", "n_name", category.alias("category"))


@query(with_(REPORT) + f"SELECT category, {bracket_sql('mode_a', SEVERITY_GRADES, 5)} AS grade, count(*) AS n FROM report GROUP BY ALL")
def join_range_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bracket_join(report(spark, sf_dir).select("category", "mode_a"), "mode_a", SEVERITY_GRADES, "grade", 5).groupBy("category", "grade").agg(F.count("*").alias("n"))


@query(
    with_(REPORT)
    + """SELECT category, count(*) AS n FROM report WHERE EXISTS (SELECT 1 FROM (VALUES (5.0::double), (10.0), (25.0), (50.0), (75.0)) b(t) WHERE abs(mode_b - t) <= 2) GROUP BY category"""
)
def join_band_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.exists(F.array(*[F.lit(b) for b in SEVERITY_BOUNDS]), lambda t: F.abs(F.col("mode_b") - t) <= 2)
    return report(spark, sf_dir).filter(near).groupBy("category").agg(F.count("*").alias("n"))


@query(
    with_(REPORT)
    + """, t AS (SELECT unnest(range(50, 95)) AS t)
SELECT t::int AS threshold_pct, count(*) FILTER (conf >= t / 100.0::double) AS n_retained, round(avg(coverage) FILTER (conf >= t / 100.0::double), 6) AS mean_iou FROM t CROSS JOIN (SELECT conf, coverage FROM report) GROUP BY t"""
)
def join_cross_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.calibration import swept

    return swept(report(spark, sf_dir), "conf", "coverage", 50, 94).select("threshold_pct", "n_retained", F.round("mean_iou", 6).alias("mean_iou"))


@query(
    """WITH r AS (SELECT vec_id, embedding FROM embeddings WHERE label < 8), d AS (
  SELECT e.vec_id, r.vec_id AS rid, sqrt(list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - r.embedding[i]::double) * (e.embedding[i]::double - r.embedding[i]::double)))) AS d
  FROM embeddings e JOIN r ON e.vec_id <> r.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, rid) AS k FROM d)
SELECT vec_id, round(avg(d), 6) AS mean_distance FROM k WHERE k <= 3 GROUP BY vec_id"""
)
def join_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    found = knn_mean_distance(e.select("vec_id", "embedding"), e.filter("label < 8"), "vec_id", "embedding", 3)
    return found.select("vec_id", F.round("mean_distance", 6).alias("mean_distance"))


@query(
    """WITH t AS (SELECT p_partkey, right(p_partkey::varchar, 2) AS target FROM part), n AS (SELECT DISTINCT c_custkey::varchar AS name FROM customer),
  m AS (SELECT name, p_partkey, row_number() OVER (PARTITION BY name ORDER BY p_partkey IS NULL, (name = target) DESC, p_partkey) AS k FROM n LEFT JOIN t ON ends_with(name, target))
SELECT name, p_partkey FROM m WHERE k = 1"""
)
def join_fuzzy_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "part").select("p_partkey", F.right(F.col("p_partkey").cast("string"), F.lit(2)).alias("target"))
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name")).distinct()
    return suffix_match(names, targets, "name", "target", "p_partkey")


@query(
    """WITH k AS (SELECT n_nationkey, regexp_extract(n_name, '([0-9]+)$', 1) AS token, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
  m AS (SELECT n_nationkey, s_suppkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY (s_nationkey = n_nationkey) DESC, s_name) AS k FROM k JOIN supplier ON contains(s_name, token))
SELECT n_nationkey, s_suppkey FROM m WHERE k = 1"""
)
def join_glob_disambig(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.regexp_extract("n_name", "([0-9]+)$", 1).alias("token"))
    met = contains_match(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), nation, "s_name", "token")
    first = F.min(F.struct((F.col("s_nationkey") != F.col("n_nationkey")).alias("other"), F.col("s_name"), F.col("s_suppkey")))
    return met.groupBy("n_nationkey").agg(first.alias("first")).select("n_nationkey", "first.s_suppkey")
