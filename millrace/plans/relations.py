"""Relations that queries share, derived from the driver's tables, each as a DataFrame and as a SQL common table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in some parts for each core, for work that is large beside the rows: a small file, or one row group, is one task otherwise."""
    return rows.repartition(max(3 * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-item report: category, coverage and four severities, -1 where coverage is too low to tell."""
    li, cov = table(spark, sf_dir, "lineitem"), F.col("l_quantity") / 50
    known = lambda c: F.when(cov < 0.15, F.lit(-1.0)).otherwise(c)
    a, b = F.col("l_discount") * 1000, F.col("l_tax") * 1250
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("status"), cov.alias("coverage"),
        (F.lit(0.5) + F.col("l_discount") * 4.5).alias("conf"), known(a).alias("mode_a"), known(b).alias("mode_b"), known((a + b) / 2).alias("mode_c"), known(F.greatest(a, b)).alias("mode_d"),
    )


REPORT = """report AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS category, l_linestatus AS status, l_quantity / 50 AS coverage, 0.5::double + l_discount * 4.5::double AS conf,
    CASE WHEN l_quantity / 50 < 0.15::double THEN -1.0::double ELSE l_discount * 1000 END AS mode_a,
    CASE WHEN l_quantity / 50 < 0.15::double THEN -1.0::double ELSE l_tax * 1250 END AS mode_b,
    CASE WHEN l_quantity / 50 < 0.15::double THEN -1.0::double ELSE (l_discount * 1000 + l_tax * 1250) / 2 END AS mode_c,
    CASE WHEN l_quantity / 50 < 0.15::double THEN -1.0::double ELSE greatest(l_discount * 1000, l_tax * 1250) END AS mode_d
  FROM lineitem)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with a category, a file name that isn't unique across categories, and a split by a seeded hash."""
    h = F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string")))
    split = F.when(h < "b3", "train").when(h < "d9", "val").otherwise("test")
    return table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("category"), F.concat(F.col("source"), F.lit("_"), F.pmod("doc_id", F.lit(40)).cast("string")).alias("filename"), split.alias("split"), "n_chars")


MANIFEST = """manifest AS (
  SELECT doc_id, lang AS category, source || '_' || (doc_id % 40)::varchar AS filename,
    CASE WHEN md5('42:' || doc_id::varchar) < 'b3' THEN 'train' WHEN md5('42:' || doc_id::varchar) < 'd9' THEN 'val' ELSE 'test' END AS split, n_chars
  FROM documents)"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of variants, one row each, rounded so that both engines compare equal numbers."""
    r = lambda c: F.round(c, 6)
    share = lambda cond: F.count_if(cond) / F.count("*")
    # by whole hundredths, in both engines: an average at a tie doesn't hang on the order of rows
    mean = lambda c: F.sum(F.round(F.col(c) * 100).cast("long")) / (F.count(c) * 100)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("variant")).agg(
        r(share(F.col("l_returnflag") != "R")).alias("recall"), r(share(F.col("l_linestatus") == "O")).alias("specificity"), r(mean("l_discount") * 10).alias("auc"),
        r(mean("l_tax") * 20).alias("dice"), r(mean("l_quantity") * 20).alias("latency_ms"), r(mean("l_extendedprice") / 1000).alias("mae"), F.count("*").alias("n"),
    )


VARIANTS = """variants AS (
  SELECT l_suppkey AS variant, round(count(*) FILTER (l_returnflag <> 'R')::double / count(*), 6) AS recall, round(count(*) FILTER (l_linestatus = 'O')::double / count(*), 6) AS specificity,
    round(sum(round(l_discount * 100)::bigint)::double / (count(l_discount) * 100) * 10, 6) AS auc, round(sum(round(l_tax * 100)::bigint)::double / (count(l_tax) * 100) * 20, 6) AS dice,
    round(sum(round(l_quantity * 100)::bigint)::double / (count(l_quantity) * 100) * 20, 6) AS latency_ms, round(sum(round(l_extendedprice * 100)::bigint)::double / (count(l_extendedprice) * 100) / 1000, 6) AS mae, count(*) AS n
  FROM lineitem GROUP BY l_suppkey)"""


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch logs: runs with epochs from 1, a phase and a metric."""
    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), epoch.alias("epoch"), F.col("value").alias("metric"), "event_type").withColumn("phase", F.when(F.col("epoch") <= 5, 1).otherwise(2))


EPOCHS = """epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS metric, event_type,
    CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 THEN 1 ELSE 2 END AS phase
  FROM events)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary truths with scores that tie."""
    score = (F.col("n_chars") % 200).cast("double") / 200
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.col("quality").cast("int").alias("y"), F.col("toxic").cast("int").alias("toxic"), score.alias("score"), F.col("lang").alias("category"))


SCORES = """scores AS (
  SELECT doc_id, quality::int AS y, toxic::int AS toxic, (n_chars % 200)::double / 200 AS score, lang AS category FROM documents JOIN labels USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True and predicted classes 0-9, and ten class scores."""
    label = F.col("label").cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", label.alias("truth"), F.when(F.col("vec_id") % 4 == 0, (label + 1) % 10).otherwise(label).alias("pred"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double")).alias("probs"))


PREDICTIONS = """predictions AS (
  SELECT vec_id, label::int AS truth, CASE WHEN vec_id % 4 = 0 THEN ((label + 1) % 10)::int ELSE label::int END AS pred, list_transform(embedding[1:10], lambda x: x::double) AS probs FROM embeddings)"""


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n"

# Each vector as an 8 x 8 mask (cells above 0), with every cell's boundary weight.
BOUNDARY = """WITH cells AS (SELECT vec_id, i, embedding[i + 1] > 0 AS inside FROM embeddings, range(64) t(i)),
weights AS (SELECT a.vec_id, a.i, any_value(a.inside) AS inside, CASE WHEN bool_or(b.inside) THEN greatest(0.1::double, 1 - coalesce(min(sqrt((a.i // 8 - b.i // 8) ** 2 + (a.i % 8 - b.i % 8) ** 2)) FILTER (b.inside <> a.inside), 1e9::double) / 15) ELSE 0.1::double END AS weight
FROM cells a JOIN cells b USING (vec_id) GROUP BY 1, 2)"""


def leaf_images(embeddings: DataFrame, side: int = 32) -> DataFrame:
    """(vec_id, red, green, blue, prob, category): a round leaf for each vector, with upright streaks whose red follows its numbers."""
    cells = F.sequence(F.lit(0), F.lit(side * side - 1))
    middle = (side - 1) / 2
    row, column = lambda i: F.floor(i / side), lambda i: i % side
    number = lambda i: F.element_at("embedding", (F.floor(row(i) / 8) * 16 + F.floor(column(i) / 2) + 1).cast("int"))
    red = F.transform(cells, lambda i: F.least(F.greatest(number(i).cast("double") * 700 + 110, F.lit(0.0)), F.lit(255.0)))
    level = lambda v: F.transform(cells, lambda i: F.lit(float(v)))
    away = lambda i: F.sqrt(F.pow(row(i) - middle, F.lit(2)) + F.pow(column(i) - middle, F.lit(2)))
    prob = F.transform(cells, lambda i: 1 / (1 + F.exp((away(i) - 5 - F.col("vec_id") % 11) / 2)))
    category = F.element_at(F.array(F.lit("MSV"), F.lit("MLN"), F.lit("HEALTHY")), (F.col("vec_id") % 3 + 1).cast("int"))
    return embeddings.select("vec_id", red.alias("red"), level(150).alias("green"), level(60).alias("blue"), prob.alias("prob"), category.alias("category"))
