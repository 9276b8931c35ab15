"""Audits of keys and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.setops import missing_from
from ..plans.relations import MANIFEST, manifest, table, with_
from ..registry import query


@query(with_(MANIFEST) + "SELECT n_categories, count(*) AS n_files FROM (SELECT filename, count(DISTINCT category) AS n_categories FROM manifest GROUP BY filename) GROUP BY 1")
def agg_nunique_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_file = manifest(spark, sf_dir).groupBy("filename").agg(F.count_distinct("category").alias("n_categories"))
    return per_file.groupBy("n_categories").agg(F.count("*").alias("n_files"))


@query("SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def agg_dup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    return n.agg(F.sum(F.col("n") - 1).alias("n_duplicates"))


@query(
    with_(MANIFEST)
    + "SELECT doc_id, category, filename, count(*) OVER (PARTITION BY category, filename) AS n FROM manifest QUALIFY count(*) OVER (PARTITION BY category, filename) > 1"
)
def agg_key_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of each group that shares a category and a name, one a row, with the group's size: no list grows with a group."""
    m = manifest(spark, sf_dir).select("doc_id", "category", "filename")
    groups = m.groupBy("category", "filename").agg(F.count("*").alias("n")).filter("n > 1")
    return m.join(groups, ["category", "filename"]).select("doc_id", "category", "filename", "n")


@query(
    """SELECT lang AS encoder, (SELECT count(*) FROM (VALUES ('src0'), ('src1'), ('src20'), ('src21')) t(x) WHERE x NOT IN (SELECT source FROM documents d2 WHERE d2.lang = d.lang)) = 0 AS complete,
  (SELECT coalesce(string_agg(x, ',' ORDER BY x), '') FROM (VALUES ('src0'), ('src1'), ('src20'), ('src21')) t(x) WHERE x NOT IN (SELECT source FROM documents d2 WHERE d2.lang = d.lang)) AS missing
FROM documents d GROUP BY lang"""
)
def agg_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("encoder")).agg(F.collect_set("source").alias("have"))
    missing = missing_from(["src0", "src1", "src20", "src21"], F.col("have"))
    return have.select("encoder", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing"))


@query("SELECT lang, bool_and(source IN ('src0', 'src1', 'src2')) AS is_subset FROM documents GROUP BY lang")
def set_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = F.array(*[F.lit(s) for s in ("src0", "src1", "src2")])
    return table(spark, sf_dir, "documents").groupBy("lang").agg((F.size(F.array_except(F.collect_set("source"), allowed)) == 0).alias("is_subset"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels")
def set_concat_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id").union(table(spark, sf_dir, "labels").select("doc_id"))


@query(
    """WITH c AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_involved,
    row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, n_involved > 1 AS was_duplicated FROM c WHERE k = 1"""
)
def win_drop_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = Window.partitionBy("l_orderkey", "l_linenumber")
    li = table(spark, sf_dir, "lineitem").withColumn("n", F.count("*").over(key)).withColumn("k", F.row_number().over(key.orderBy("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")))
    return li.filter("k = 1").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("n") > 1).alias("was_duplicated"))
