"""File trees, CSV with declared columns, and text files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strings that stand for a missing value in CSV files.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
IMAGE_GLOB = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files at a path, or in a folder, with their sizes; hidden ones and markers are left out, and a path that isn't there has none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(p):
        return []
    found = [(f.getPath().toString(), f.getLen()) for f in store.listStatus(p) if f.isFile()]
    return sorted((f, n) for f, n in found if not f.rsplit("/", 1)[-1].startswith(("_", ".")))


def image_tree(spark: SparkSession, *roots: str, content: bool = False) -> DataFrame:
    """(path, category, filename, length, modificationTime[, content]) of image files below the roots; roots that aren't there are skipped.

    The category is the directory's name. Without ``content`` the files' bytes aren't read.
    """
    found = [r for r in roots if exists(spark, r)]
    columns = ["path", "category", "filename", "length", "modificationTime", *["content"] * content]
    if not found:
        kinds = {"length": T.LongType(), "modificationTime": T.TimestampType(), "content": T.BinaryType()}
        return spark.createDataFrame([], T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in columns]))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", IMAGE_GLOB).load(found)
    parts = F.split("path", "/")
    return files.withColumn("category", F.element_at(parts, -2)).withColumn("filename", F.element_at(parts, -1)).select(*columns)


def csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str) -> DataFrame:
    """A CSV file with a header and declared columns; missing-value tokens and what can't be cast are null, NaN too."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    raw = spark.read.csv(path, header=True, schema=texts, enforceSchema=False, quote='"', escape='"')
    return raw.select([cast_text(f.name, f.dataType) for f in schema.fields])


def cast_text(name: str, kind: T.DataType):
    c = F.col(f"`{name}`")
    c = F.when(~F.trim(c).isin(NA_TOKENS), c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        c = c.try_cast(kind)
        return F.when(~F.isnan(c), c).alias(name)
    return (c if isinstance(kind, T.StringType) else F.trim(c).try_cast(kind)).alias(name)


def csv_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """As csv(); a file that isn't there gives an empty table with the declared columns."""
    if exists(spark, path):
        return csv(spark, path, schema)
    return spark.createDataFrame([], T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def csv_glob(spark: SparkSession, paths: Sequence[str], name_pattern: str, key: str) -> DataFrame:
    """Small CSV files with headers of their own, under one another, each with a key from its name; missing columns are null.

    One pass finds the headers; files that share one are read together, so the plan grows with the headers and not with
    the files.
    """
    heads = spark.read.text(list(paths), wholetext=True).select(F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "").alias("head"), F.col("_metadata.file_path").alias("path"))
    found = heads.filter("head <> ''").groupBy("head").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("head").collect()
    parts = [spark.read.csv(r["paths"], header=True).withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), name_pattern, 1)) for r in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], f"{key} string")


def text_number(texts: DataFrame, column: str, pattern: str, name: str) -> DataFrame:
    """The first number that a pattern finds in each whole text, without its thousands separators; N/A if there is none."""
    found = F.regexp_replace(F.regexp_extract(column, pattern, 1), ",", "")
    return texts.withColumn(name, F.when(found == "", F.lit("N/A")).otherwise(found))
