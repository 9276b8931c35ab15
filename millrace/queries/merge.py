"""Unions, upserts, backfills, promotions, names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exact import exact_avg
from ..operators.sampling import positions
from ..operators.setops import ragged_union, upsert
from ..plans.relations import REPORT, VARIANTS, report, table, variants, with_
from ..registry import query
from ..session import shared_folder
from ..sources.sinks import detector_dataset, html_rows, label_line, promoted, quarantine, text_report, updated_setting, write_pseudo_labels


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS s_acctbal, NULL::varchar AS note FROM supplier")
def snk_csv_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written under a declared header, whose last column the rows lack, and read back."""
    import uuid

    from ..sources import files, sinks

    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("s_acctbal"))
    sinks.write_csv(s.withColumn("note", F.lit(None).cast("string")), path, ["s_suppkey", "s_name", "s_acctbal", "note"])
    return files.csv(spark, path, "s_suppkey long, s_name string, s_acctbal double, note string")


@query("SELECT 'customer' AS of, c_custkey AS key, c_acctbal AS balance, NULL::varchar AS name FROM customer UNION ALL SELECT 'nation', n_nationkey, NULL, n_name FROM nation UNION ALL SELECT 'none', NULL, NULL, NULL WHERE false")
def set_union_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in the order in which tables first have them, null where one lacks them; an empty table adds its columns alone."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("of"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    n = table(spark, sf_dir, "nation").select(F.lit("nation").alias("of"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    return ragged_union(c, n.limit(0), n)


@query(
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, NULL::int AS region FROM customer UNION ALL SELECT n_nationkey, n_name, NULL, n_regionkey FROM nation UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier"""
)
def set_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return ragged_union(c, n, s)


@query("SELECT r_regionkey AS id, r_name AS region, NULL::varchar AS nation FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def snk_csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("region"))
    return ragged_union(r, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nation")))


@query("SELECT o.o_orderkey, CASE WHEN o.o_orderkey % 3 = 0 THEN o.o_totalprice * 2 ELSE o.o_totalprice END AS price FROM orders o UNION ALL SELECT -c_custkey - 1, c_acctbal FROM customer WHERE c_custkey % 2 = 0")
def snk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(0).alias("seq"))
    changed = old.filter("o_orderkey % 3 = 0").select("o_orderkey", (F.col("price") * 2).alias("price"), F.lit(1).alias("seq"))
    added = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select((-F.col("c_custkey") - 1).alias("o_orderkey"), F.col("c_acctbal").alias("price"), F.lit(1).alias("seq"))
    return upsert(old, changed.union(added), ["o_orderkey"], "seq").drop("seq")


@query(with_(VARIANTS) + "SELECT s_suppkey AS variant, s_name, v.recall AS test_recall, v.dice AS test_dice, v.variant IS NOT NULL AS matched FROM supplier LEFT JOIN (SELECT * FROM variants WHERE variant % 4 <> 0) v ON v.variant = s_suppkey")
def snk_enrich_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.keys import prefixed

    tests = prefixed(variants(spark, sf_dir).filter("variant % 4 <> 0").select("variant", "recall", "dice"), "test_", "variant").withColumn("_m", F.lit(True))
    base = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("variant"), "s_name")
    return base.join(tests, "variant", "left").select("variant", "s_name", "test_recall", "test_dice", F.coalesce("_m", F.lit(False)).alias("matched"))


@query(
    """SELECT c_custkey, coalesce((SELECT min('mode_b/stage1/' || lpad(o_orderkey::varchar, 10, '0')) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P'),
  (SELECT min('mode_b/stage2/' || o_clerk) FROM (SELECT o_custkey, lpad(o_orderkey::varchar, 10, '0') AS o_clerk FROM orders WHERE o_totalprice > 400000) o WHERE o_custkey = c_custkey),
  (SELECT min('mode_a/stage1/' || s_name) FROM supplier WHERE s_suppkey = c_custkey)) AS artefact FROM customer"""
)
def snk_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's artefact of each customer, looked for in three tables by priority."""
    orders, supplier = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    stage = lambda rows, prefix: rows.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit(prefix), F.lpad(F.col("o_orderkey").cast("string"), F.lit(10), F.lit("0"))).alias("artefact"))
    other = supplier.select(F.col("s_suppkey").alias("c_custkey"), F.concat(F.lit("mode_a/stage1/"), "s_name").alias("artefact"))
    return promoted(table(spark, sf_dir, "customer"), "c_custkey", stage(orders.filter("o_orderstatus = 'P'"), "mode_b/stage1/"), stage(orders.filter("o_totalprice > 400000"), "mode_b/stage2/"), other)


@query("SELECT doc_id, upper(lang) || '_' || source AS named, printf('%s_%06d', lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::int) AS numbered FROM documents")
def snk_copy_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = positions(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", "lang")
    return docs.select("doc_id", F.concat(F.upper("lang"), F.lit("_"), "source").alias("named"), F.format_string("%s_%06d", "lang", "_p").alias("numbered"))


@query("SELECT n_nationkey, 'THRESHOLD = ' || (n_nationkey * 2)::varchar || chr(10) || 'NAME = ' || n_name AS settings FROM nation")
def snk_config_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("THRESHOLD = 0\nNAME = "), "n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", updated_setting(text, "THRESHOLD", (F.col("n_nationkey") * 2).cast("string")).alias("settings"))


@query(
    """WITH q AS (SELECT doc_id, lang, source || '.jpg' AS name, CASE WHEN n_chars < 400 THEN 'tiny' ELSE 'short' END AS reason_code, doc_id % 3 <> 0 AS later FROM documents WHERE n_chars < 1000),
  k AS (SELECT *, row_number() OVER (PARTITION BY reason_code, lang, name ORDER BY later, doc_id) - 1 AS k FROM q)
SELECT doc_id, reason_code, lang AS category, CASE WHEN k = 0 THEN name ELSE replace(name, '.jpg', '') || '_' || k::varchar || '.jpg' END AS stored_as FROM k"""
)
def snk_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the folders hold after three runs: a part of the rejected rows, then all of them, then all again."""
    code = F.when(F.col("n_chars") < 400, "tiny").otherwise("short")
    rejected = table(spark, sf_dir, "documents").filter("n_chars < 1000").select("doc_id", F.concat("source", F.lit(".jpg")).alias("name"), code.alias("reason_code"), F.col("lang").alias("category"))
    path = f"{shared_folder(spark)}/quarantine-{uuid.uuid4().hex}"
    for run in (rejected.filter("doc_id % 3 = 0"), rejected, rejected):
        held = quarantine(run, path, "doc_id", "name")
    return held.select("doc_id", "reason_code", "category", "stored_as")


@query(
    """SELECT p_partkey::varchar AS stem, CASE WHEN p_partkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, printf('0 %.6f %.6f %.6f %.6f', p_size / 100.0::double, 0.5::double, p_size / 50.0::double, 0.25::double) AS line FROM part"""
)
def snk_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines written by split, and what is read back; the val split is written again, and train stays."""
    size = F.col("p_size").cast("double")
    box = F.struct((size / 100).alias("cx"), F.lit(0.5).alias("cy"), (size / 50).alias("w"), F.lit(0.25).alias("h"))
    split = F.when(F.col("p_partkey") % 5 == 0, "val").otherwise("train")
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("stem"), split.alias("split"), label_line(box).alias("line"))
    path = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    for run in (boxes, boxes.filter("split = 'val'")):
        detector_dataset(run, path, ["leaf"])
    return spark.read.schema("stem string, line string, split string").csv(f"{path}/labels").select("stem", "split", "line")


@query(
    with_(REPORT)
    + """, m AS (SELECT category, count(*) AS n, round(avg(coverage), 6) AS mean_coverage FROM report GROUP BY category)
SELECT 0 AS row_no, '<tr><th>category</th><th>n</th><th>mean_coverage</th></tr>' AS html
UNION ALL SELECT row_number() OVER (ORDER BY category), CASE WHEN n = max(n) OVER () THEN '<tr class="best">' ELSE '<tr>' END || '<td>&lt;' || category || '&gt;</td><td>' || n::varchar || '</td><td>' || mean_coverage::varchar || '</td></tr>' FROM m"""
)
def snk_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows in HTML, the best one marked."""
    m = report(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n"), F.round(exact_avg("coverage"), 6).alias("mean_coverage"))
    return html_rows(m.withColumn("category", F.concat(F.lit("<"), "category", F.lit(">"))), "category", "n")


@query("SELECT l_suppkey % 4 AS mode, l_suppkey AS stem, count(*) AS n, round(avg(l_discount * 1000), 6) AS severity FROM lineitem GROUP BY l_suppkey")
def snk_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comes back of sidecars that were written in the shared folder."""
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("mode"), F.col("l_suppkey").alias("stem")).agg(F.count("*").alias("n"), F.round(exact_avg(F.col("l_discount") * 1000), 6).alias("severity"))
    path = f"{shared_folder(spark)}/sidecars-{uuid.uuid4().hex}"
    write_pseudo_labels(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


@query("SELECT r_regionkey, json_object('r_name', r_name) ::varchar AS document FROM region")
def snk_json_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import metadata

    return metadata(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey")


@query("SELECT 1 AS line, 'v < 0.15 -> None' AS source UNION ALL SELECT 2, 'v in 0.15..<0.25 -> 0.3' UNION ALL SELECT 3, 'v in 0.25..<0.5 -> 0.7' UNION ALL SELECT 4, 'v >= 0.5 -> 1.0'")
def snk_codegen(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.brackets import COVERAGE_WEIGHTS
    from ..sources.sinks import branches

    return spark.createDataFrame(list(enumerate(branches(COVERAGE_WEIGHTS).split("\n"), 1)), "line int, source string")


@query(
    """WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1), w AS (SELECT greatest(max(length(label)), 5) AS w, sum(n) AS total, count(*) AS k FROM c)
SELECT 1 AS line_no, 'Orders by priority' AS line UNION ALL SELECT 2, repeat('=', w + 16) FROM w
UNION ALL SELECT row_number() OVER (ORDER BY n DESC, label) + 2, '  ' || rpad(label, w::int, ' ') || lpad(format('{:,}', n), 14, ' ') FROM c, w
UNION ALL SELECT k + 3, repeat('-', w + 16) FROM w UNION ALL SELECT k + 4, '  ' || rpad('total', w::int, ' ') || lpad(format('{:,}', total::bigint), 14, ' ') FROM w"""
)
def snk_txt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aligned report, line by line."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"))
    return text_report("Orders by priority", n, "label", "n")
