"""Incremental merges: new files of a folder into a table with one row for each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.setops import upsert
from ..sources.files import exists


def upsert_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: Sequence[str], order: str) -> StreamingQuery:
    """Merges the Parquet files that have come into ``source`` since the last run into versions of a table below ``target``.

    Each batch writes version=<batch>: a batch that is run again after a failure writes the same version anew from the
    one before it, so nothing is merged twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{target}/version={number - 1}"
        old = spark.read.parquet(before) if number and exists(spark, before) else batch.limit(0)
        upsert(old, batch, list(keys), order).write.mode("overwrite").parquet(f"{target}/version={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, late: str, every: str, *keys: str) -> DataFrame:
    """Counts in windows of event time; rows later than the watermark are left out. Works on streams and on tables."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n"))
