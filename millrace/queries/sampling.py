"""Splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.keys import hash_order
from ..operators.sampling import evenly_spaced, global_sample, n_per_stratum, ranked, split_by_position, weighted_with_replacement
from ..plans.relations import table
from ..registry import query


@query(
    """WITH r AS (SELECT doc_id, lang AS category, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::varchar), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, category, CASE WHEN k <= floor(0.7::double * n) THEN 'train' WHEN k <= floor(0.7::double * n) + floor(0.15::double * n) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def win_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"))
    return split_by_position(docs, "doc_id", ["category"], 0.7, 0.15)


@query(
    """WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id::varchar), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT doc_id, source, k <= greatest(1, floor(n * 0.1::double)) AS is_val FROM r"""
)
def win_val_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 42, "source")
    return r.select("doc_id", "source", (F.col("_k") <= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1))).alias("is_val"))


@query(
    """WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus FROM r WHERE n <= 1500 OR EXISTS (SELECT 1 FROM range(0, 1500) i(i) WHERE floor(i.i * n / 1500) = p)"""
)
def win_evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evenly_spaced(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1500, "o_orderstatus")


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id::varchar), doc_id) AS k FROM documents) WHERE k <= 30")
def smp_strat_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_per_stratum(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 30, "lang")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id::varchar), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels) WHERE k <= floor(0.4::double * n)")
def smp_strat_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranked(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", 42, "quality")
    return r.filter(F.col("_k") <= F.floor(F.lit(0.4) * F.col("_n"))).select("doc_id", "quality")


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey::varchar), o_orderkey LIMIT 500")
def smp_random_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return global_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(
    """WITH r AS (SELECT o_orderkey, o_orderstatus AS category, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey::varchar), o_orderkey) AS k,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS p, count(*) OVER (PARTITION BY o_orderstatus) AS n, CASE o_orderstatus WHEN 'F' THEN 300 WHEN 'O' THEN 700 ELSE 200 END AS quota FROM orders)
SELECT o_orderkey, category FROM r WHERE CASE WHEN category = 'F' THEN k <= quota ELSE quota >= n OR EXISTS (SELECT 1 FROM range(0, 700) i(i) WHERE i.i < quota AND floor(i.i * n / quota) = p) END"""
)
def smp_tier_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("category"))
    quota = F.when(F.col("category") == "O", 700).otherwise(200)
    at_random = n_per_stratum(orders.filter("category = 'F'"), "o_orderkey", 300, "category")
    return at_random.unionByName(evenly_spaced(orders.filter("category <> 'F'"), "o_orderkey", quota, "category"))


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS positive, row_number() OVER (PARTITION BY l_returnflag = 'R' ORDER BY md5('42:' || l_orderkey::varchar), l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem)
SELECT positive, count(*) AS n, sum(l_orderkey)::bigint AS checksum FROM r WHERE k <= 2500 GROUP BY positive"""
)
def smp_balanced_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("positive", F.col("l_returnflag") == "R")
    # two orders with a limit each keep 2500 rows for each task; a window would bring each class into one
    parts = [li.filter(F.col("positive") == p).orderBy(hash_order(42, F.col("l_orderkey")), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(2500) for p in (True, False)]
    return parts[0].union(parts[1]).groupBy("positive").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("checksum"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 30")
def srt_head_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", "source").withColumn("_k", k).filter("_k <= 30").drop("_k")


@query(
    """WITH w AS (SELECT o_orderkey, round(o_totalprice * 100)::bigint AS cents FROM orders), r AS (SELECT *, (sum(cents) OVER (ORDER BY o_orderkey))::bigint AS upto FROM w WHERE cents > 0), t AS (SELECT max(upto) AS total FROM r),
  d AS (SELECT i AS draw, floor(('0x' || substr(md5('42:' || i::varchar), 1, 12))::bigint::double / 281474976710656.0::double * total::double)::bigint AS place FROM range(1000) x(i), t)
SELECT draw, o_orderkey, cents FROM d JOIN r ON r.upto - r.cents <= place AND place < r.upto"""
)
def smp_weighted_repl(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return weighted_with_replacement(orders, "o_orderkey", "cents", 1000)
