"""What the operators share: checkpoints, table reads, null-safe keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Cuts the lineage at a table written in the shared folder, which is smaller than a checkpoint; and its path."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, path: str | None) -> None:
    """Deletes such a table; nothing may still be read from it."""
    if path:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def columns(docs: DataFrame) -> list[Column]:
    """All columns, whatever they are called."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]


def whole(docs: DataFrame) -> Column:
    """A row as one struct: whatever its columns are called, they can't clash with names beside it."""
    return F.struct(*columns(docs))


def null_safe_key(column: Column) -> Column:
    """A string that is never null and tells null from every value."""
    return F.coalesce(F.concat(F.lit("v"), column.cast("string")), F.lit("n"))


def _holds(kind: T.DataType, what: tuple[type, ...]) -> bool:
    inner = [f.dataType for f in kind.fields] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else [kind.keyType, kind.valueType] if isinstance(kind, T.MapType) else []
    return isinstance(kind, what) or any(_holds(k, what) for k in inner)


def hashable(value: Column, kind: T.DataType) -> Column:
    """``value`` in a form that Spark's hashes take: maps as arrays of entries in order, variants as JSON."""
    if isinstance(kind, T.VariantType):
        return F.to_json(value)
    if not _holds(kind, (T.MapType, T.VariantType)):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda v: hashable(v, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[hashable(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    return F.sort_array(F.transform(F.map_entries(value), lambda e: F.struct(hashable(e["key"], kind.keyType).alias("k"), hashable(e["value"], kind.valueType).alias("v"))))


def row_hash(docs: DataFrame, seed: int = 0) -> Column:
    """A hash of a row's values that tells null from every value, whatever the columns are called and hold."""
    return F.xxhash64(F.lit(seed), *[x for c, f in zip(columns(docs), docs.schema.fields, strict=True) for x in (c.isNull(), hashable(c, f.dataType))])
