"""Image operators over vectors as grids, and the batches that leave out what couldn't be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.relations import dealt, table
from ..registry import query


@query()
def udf_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.imaging import perceptual_hash

    return table(spark, sf_dir, "embeddings").select("vec_id", perceptual_hash("embedding").alias("phash"))


@query()
def udf_clahe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.imaging import local_contrast

    return table(spark, sf_dir, "embeddings").select("vec_id", local_contrast("embedding").alias("levels"))


@query()
def udf_main_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.imaging import main_region

    return table(spark, sf_dir, "embeddings").select("vec_id", main_region("embedding").alias("r")).select("vec_id", "r.*")


@query()
def udf_polygon_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A triangle of each part: its corners follow from size and key."""
    from ..functions.imaging import polygon_cells

    at = lambda x, y: F.array(x.cast("double"), y.cast("double"))
    size, key = F.col("p_size"), F.col("p_partkey")
    triangle = F.array(at(F.lit(5), F.lit(5)), at(F.lit(5) + size, F.lit(10)), at(F.lit(20), key % 80 + 15))
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", polygon_cells(F.array(triangle)).alias("cells"))


@query("SELECT doc_id // 32 AS batch, count(*) FILTER (n_chars >= 100) AS n, count(*) FILTER (n_chars < 100) AS skipped, sum(n_chars) FILTER (n_chars >= 100)::bigint AS total FROM documents GROUP BY 1 HAVING count(*) FILTER (n_chars >= 100) > 0")
def udf_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.setops import collated

    items = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 32).alias("batch"), F.when(F.col("n_chars") >= 100, F.col("n_chars")).alias("item"))
    return collated(items, "batch", "item", F.sum("item").alias("total"))

