"""Bounded samples of labelled texts for classifiers, drawn without held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def drawn(docs: DataFrame, labels: DataFrame, sample: dict[int, int], longest: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[dict[int, list[bytes]], dict[int, int]]:
    """Texts of the first ``sample[y]`` labelled rows of each class y by a hash of the id, and how many labelled ids each class has.

    Rows whose crc32(id as text) mod 5 is 0, and rows without text, label or id don't count, nor do ids whose labels
    contradict each other; repeated labels count once. Of several texts of an id the smallest is taken. Texts of more
    than ``longest`` bytes give their places to others.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_y in (0, 1)")
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).filter(F.col("_id").isNotNull() & (F.col("_y") == F.col("_z")) & (fold("_id") != 0))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(F.octet_length("_text").between(1, longest))
    # ids are drawn without their texts, which alone are large: as many rows as the sample has are broadcast, and as many texts come back
    order = known.join(texts.select("_id").distinct(), "_id", "left_semi").withColumn("_h", F.xxhash64(F.lit("sample"), "_id")).select("_id", "_y", "_h")
    ids = [r for y, most in sample.items() for r in order.filter(F.col("_y") == y).orderBy("_h", "_id").limit(most).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, order.schema)
    found = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_h", "_y").agg(F.min("_text").alias("_text"))
    rows = sorted((r["_h"], r["_text"].encode(), r["_y"]) for r in found.collect())
    return {y: [t for _, t, of in rows if of == y] for y in (0, 1)}, {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
