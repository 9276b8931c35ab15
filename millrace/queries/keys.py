"""Keys, casts and column names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import exact_avg
from ..operators.keys import first_present, number, output_stem, path_parts, prefixed
from ..operators.rules import reason_code
from ..plans.relations import MANIFEST, REPORT, manifest, report, table, with_
from ..registry import query
from ..session import shared_folder
from ..sources.sinks import write_complete

CLASSES = ("en", "fr", "de", "es")


@query(
    """WITH s AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN 'EN_' WHEN 1 THEN 'fr_de_' WHEN 2 THEN '' ELSE 'De_' END || source AS stem FROM documents)
SELECT doc_id, lang || '_' || regexp_replace(stem, '^(?i:en|fr|de|es)_', '') AS output_stem FROM s"""
)
def prj_output_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    stem = F.concat(F.when(k == 0, "EN_").when(k == 1, "fr_de_").when(k == 2, "").otherwise("De_"), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", output_stem(F.col("lang"), stem, CLASSES).alias("output_stem"))


@query("SELECT split_part(o_orderpriority || ':' || o_orderstatus, ':', 1) AS code, count(*) AS n FROM orders GROUP BY 1")
def prj_reason_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.concat("o_orderpriority", F.lit(":"), "o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy(reason_code(reason).alias("code")).agg(F.count("*").alias("n"))


@query(
    r"""WITH p AS (SELECT page_id, list_last(string_split(regexp_replace(url, '[?#].*$', ''), '/')) AS name FROM pages)
SELECT page_id, name, regexp_replace(name, '^(.+)\.[^.]*$', '\1') AS stem, regexp_extract(name, '^.+(\.[^.]*)$', 1) AS suffix FROM p"""
)
def prj_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, stem, suffix = path_parts(F.regexp_replace("url", "[?#].*$", ""))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), stem.alias("stem"), suffix.alias("suffix"))


@query("SELECT p_partkey, regexp_extract(p_brand, '^Brand#(.+)$', 1) AS label FROM part")
def prj_label_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "^Brand#(.+)$", 1).alias("label"))


@query(
    f"""WITH m AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN o_custkey::varchar || '.5' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN isnan(try_cast(raw AS double)) THEN NULL ELSE try_cast(raw AS double) END AS value,
  coalesce(CASE WHEN isnan(try_cast(raw AS double)) THEN NULL ELSE try_cast(raw AS double) END, -1.0::double) AS value_or_default FROM m"""
)
def prj_numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    raw = F.when(k == 0, "N/A").when(k == 1, "nan").when(k == 2, "").when(k == 3, F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw"))
    return orders.select("o_orderkey", number(F.col("raw")).alias("value"), number(F.col("raw"), -1.0).alias("value_or_default"))


@query("SELECT s_suppkey, s_acctbal AS resolved FROM supplier")
def prj_col_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", first_present(s, "test_acctbal", "s_acctbal").alias("resolved"))


@query("SELECT n_nationkey, n_name AS test_n_name, n_regionkey AS test_n_regionkey FROM nation")
def prj_prefix_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixed(table(spark, sf_dir, "nation"), "test_", "n_nationkey")


@query(with_(REPORT) + "SELECT category, count(nullif(mode_a, -1)) AS n_valid, round(avg(nullif(mode_a, -1)), 6) AS mean FROM report GROUP BY category")
def prj_sentinel_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.nullif(F.col("mode_a"), F.lit(-1.0))
    return report(spark, sf_dir).groupBy("category").agg(F.count(v).alias("n_valid"), F.round(exact_avg(v), 6).alias("mean"))


@query(
    """WITH j AS (SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS n, count(*) FILTER (quality IS NULL OR toxic IS NULL) AS n_dropped, count(*) FILTER (quality IS NOT NULL AND toxic IS NOT NULL) AS n_kept FROM j"""
)
def flt_dropna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows there were and went, counted while they were written, and how many the written table has."""
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    path = f"{shared_folder(spark)}/complete-{uuid.uuid4().hex}"
    seen = write_complete(j, path, "quality", "toxic")
    return spark.read.schema(j.schema).parquet(path).agg(F.lit(seen["n"]).cast("long").alias("n"), F.lit(seen["n_dropped"]).cast("long").alias("n_dropped"), F.count("*").alias("n_kept"))


@query(with_(MANIFEST) + "SELECT category, count(*) AS n FROM manifest WHERE split <> 'test' GROUP BY category")
def flt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir).filter("split <> 'test'").groupBy("category").agg(F.count("*").alias("n"))
