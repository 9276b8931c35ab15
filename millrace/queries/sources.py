"""Reading: sidecars, settings, text, globs of small tables. Files are written first where the shared checkpoint folder is."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import BOUNDARY, REPORT, VARIANTS, leaf_images, report, table, variants, with_
from ..registry import query
from ..session import shared_folder
from ..sources import files, sinks


def _written(df: DataFrame) -> str:
    """The path of a CSV with the rows of ``df`` in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/csv-{uuid.uuid4().hex}"
    sinks.write_csv(df, path)
    return path


@query(
    """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END, CASE WHEN p_partkey % 3 = 0 THEN p_size::double END, -1.0::double) AS symptom, coalesce(CASE WHEN p_partkey % 5 <> 0 THEN p_size END, -1) AS grade FROM part"""
)
def src_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    png = part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_retailprice").alias("png"))
    npy = part.filter("p_partkey % 3 = 0").select("p_partkey", F.col("p_size").cast("double").alias("npy"))
    grades = part.filter("p_partkey % 5 <> 0").select("p_partkey", F.col("p_size").alias("g"))
    joined = part.select("p_partkey").join(png, "p_partkey", "left").join(npy, "p_partkey", "left").join(grades, "p_partkey", "left")
    return joined.select("p_partkey", F.coalesce("png", "npy", F.lit(-1.0)).alias("symptom"), F.coalesce("g", F.lit(-1)).alias("grade"))


@query("SELECT n_nationkey, coalesce(nullif(replace(regexp_extract('Total: ' || (n_nationkey * 1234567)::varchar || ' rows', 'Total: ([0-9,]+)', 1), ',', ''), ''), 'N/A') AS total FROM nation")
def src_text_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From summaries that are written as text files, one for each nation, and read whole."""
    texts = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("Summary\nTotal: "), F.format_number(F.col("n_nationkey") * 1234567, 0), F.lit(" rows\n")).alias("text"))
    path = f"{shared_folder(spark)}/summaries-{uuid.uuid4().hex}"
    texts.write.partitionBy("n_nationkey").text(path)
    read = spark.read.text(path, wholetext=True).withColumn("n_nationkey", F.col("n_nationkey").cast(texts.schema["n_nationkey"].dataType))
    return files.text_number(read, "value", "Total: ([0-9,]+)", "total").select("n_nationkey", "total")


@query(with_(REPORT) + "SELECT coalesce((SELECT min(conf) FROM report WHERE conf > 0.7::double AND coverage > 0.5::double), 0.65::double) AS threshold")
def src_calib_cfg(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = report(spark, sf_dir).filter("conf > 0.7 AND coverage > 0.5")
    return chosen.agg(F.coalesce(F.min("conf"), F.lit(0.65)).alias("threshold"))


@query(with_(VARIANTS) + "SELECT 'variant_' || variant::varchar AS run, recall, CASE WHEN variant % 2 = 0 THEN dice END AS dice FROM variants")
def src_csv_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = variants(spark, sf_dir)
    run = F.concat(F.lit("variant_"), F.col("variant").cast("string")).alias("run")
    paths = [_written(v.filter("variant % 2 = 0").select(run, "recall", "dice")), _written(v.filter("variant % 2 <> 0").select(run, "recall"))]
    read = files.csv_glob(spark, paths, "^(part-[0-9]+)", "_file")
    return read.select("run", F.col("recall").cast("double"), F.col("dice").cast("double"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def src_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return files.csv(spark, _written(s), s.schema)


@query("SELECT s_name AS stem, s_acctbal AS iou FROM supplier")
def src_csv_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is there, and none of one that isn't."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("stem"), F.col("s_acctbal").cast("double").alias("iou"))
    there = _written(s)
    return files.csv_or_empty(spark, there, "stem string, iou double").union(files.csv_or_empty(spark, f"{there}-missing", "stem string, iou double"))


def _tree(df: DataFrame) -> str:
    """A tree of files with one folder for each category in the shared folder, from a handful of rows (category, filename, content)."""
    spark = df.sparkSession
    root, jvm = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}", spark.sparkContext._jvm
    for category, filename, content in df.collect():
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/{category}/{filename}")
        out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path)
        out.write(bytearray(content.encode()))
        out.close()
    return root


def _nations(spark: SparkSession, sf_dir: str, suffix: str = "png") -> DataFrame:
    """The 25 nations as files in folders of their regions."""
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    return table(spark, sf_dir, "nation").select(named("r", "n_regionkey"), F.concat(named("n", "n_nationkey"), F.lit("." + suffix)), "n_name")


@query("SELECT 'r' || n_regionkey::varchar AS category, 'n' || n_nationkey::varchar || '.png' AS filename, strlen(n_name)::bigint AS length FROM nation")
def src_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.image_tree(spark, _tree(_nations(spark, sf_dir))).select("category", "filename", "length")


@query("SELECT 'r' || n_regionkey::varchar AS category, 'n' || n_nationkey::varchar || suffix AS filename, strlen(n_name)::bigint AS length FROM nation CROSS JOIN (VALUES ('.png'), ('.JPG')) s(suffix)")
def src_multi_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots, one that isn't there, and files of another kind, which don't count."""
    roots = [_tree(_nations(spark, sf_dir, s)) for s in ("png", "JPG", "txt")]
    return files.image_tree(spark, *roots, f"{roots[0]}-missing").select("category", "filename", "length")


@query()
def udf_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.pixels import silhouette

    return table(spark, sf_dir, "embeddings").select("vec_id", silhouette("embedding").alias("mask"))


@query(BOUNDARY + " SELECT vec_id, i AS cell, round(weight, 6) AS weight FROM weights")
def udf_edge_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.pixels import edge_distance_weight

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(edge_distance_weight("embedding")))
    return rows.select("vec_id", F.col("pos").cast("long").alias("cell"), F.col("col").alias("weight"))


@query()
def udf_four_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pseudo-labels of each image, a row each."""
    from ..functions.pixels import four_modes

    images = leaf_images(table(spark, sf_dir, "embeddings"))
    return images.select("vec_id", "category", F.explode(four_modes("red", "green", "blue", "prob", "category")).alias("m")).select("vec_id", "category", "m.*")


@query(
    """WITH p AS (SELECT vec_id, [floor(abs(e::double) * 1000)::bigint % 256 FOR e IN embedding] AS v FROM embeddings)
SELECT vec_id, 8 AS height, 8 AS width, list_sum(v)::bigint AS total, v[CASE WHEN vec_id % 8 IN (0, 4) THEN 1 WHEN vec_id % 8 IN (1, 7) THEN 8 WHEN vec_id % 8 IN (2, 6) THEN 64 ELSE 57 END] AS corner FROM p"""
)
def udf_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's levels, stored as a PNG in one of eight orientations and read back: size, sum and upper left of the upright picture."""
    from ..sources.pictures import decoded, encoded

    levels = F.transform("embedding", lambda e: F.floor(F.abs(e.cast("double")) * 1000) % 256)
    read = table(spark, sf_dir, "embeddings").select("vec_id", decoded(encoded(levels, F.col("vec_id") % 8 + 1)).alias("p")).select("vec_id", "p.*")
    at = lambda i: F.conv(F.hex(F.substring("rgb", i, 1)), 16, 10).cast("long")
    total = F.aggregate(F.sequence(F.lit(0), F.col("height") * F.col("width") - 1), F.lit(0).cast("long"), lambda a, i: a + F.conv(F.hex(F.substring("rgb", i * 3 + 1, F.lit(1))), 16, 10).cast("long"))
    return read.select("vec_id", "height", "width", total.alias("total"), at(1).alias("corner"))
