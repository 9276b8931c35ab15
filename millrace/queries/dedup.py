"""Exact and perceptual dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import distinct_codes, greedy_keep, hamming_pairs
from ..plans.relations import table
from ..registry import query
from ..session import cut

#: The signs of a vector's 64 components stand for its perceptual hash.
CODES = "codes AS (SELECT vec_id, label::int AS label, list_sum(list_transform(range(0, 64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::hugeint << i::int) ELSE 0::hugeint END))::hugeint AS code FROM embeddings)"
PAIRS = "pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM codes a JOIN codes b ON a.vec_id < b.vec_id AND a.label {op} b.label AND bit_count(xor(a.code, b.code)) <= 2)"


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = [F.when(F.get("embedding", F.lit(i)) > 0, F.lit((1 << i) - (1 << 64) * (i == 63))).otherwise(F.lit(0)).cast("long") for i in range(64)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), code.alias("code"))


@query(
    """WITH r AS (SELECT doc_id, source, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS k, first_value(source) OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS fs,
    first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS fd FROM documents)
SELECT doc_id, k = 1 AS kept, CASE WHEN k = 1 THEN NULL WHEN fs = source THEN 'exact_dup:' || fd::varchar ELSE 'exact_dup_cross:' || fs || '/' || fd::varchar END AS reason FROM r"""
)
def win_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first of each hash comes from an aggregation that combines map-side: copies never meet in one task
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min(F.struct("source", "doc_id")).alias("f"))
    joined = docs.join(first, "h")
    kept = F.col("doc_id") == F.col("f.doc_id")
    within = F.concat(F.lit("exact_dup:"), F.col("f.doc_id").cast("string"))
    across = F.concat(F.lit("exact_dup_cross:"), F.col("f.source"), F.lit("/"), F.col("f.doc_id").cast("string"))
    return joined.select("doc_id", kept.alias("kept"), F.when(~kept, F.when(F.col("f.source") == F.col("source"), within).otherwise(across)).alias("reason"))


@query(
    "WITH RECURSIVE "
    + CODES
    + ", "
    + PAIRS.format(op="=")
    + """, ordered AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM codes), keep(i, kept) AS (
    SELECT 0::bigint, []::bigint[] UNION ALL
    SELECT keep.i + 1, CASE WHEN EXISTS (SELECT 1 FROM pairs WHERE pairs.b = o.vec_id AND list_contains(keep.kept, pairs.a)) THEN keep.kept ELSE list_append(keep.kept, o.vec_id) END FROM keep JOIN ordered o ON o.i = keep.i + 1)
SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM keep ORDER BY i DESC LIMIT 1)"""
)
def join_hamming_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    first = cut(distinct_codes(codes, "vec_id", "code", "label"))
    return greedy_keep(first, hamming_pairs(first, "vec_id", "code", 2, ["label"]), "vec_id")


@query("WITH " + CODES + ", " + PAIRS.format(op="<>") + " SELECT vec_id FROM codes WHERE vec_id NOT IN (SELECT a FROM pairs UNION ALL SELECT b FROM pairs)")
def join_hamming_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _codes(spark, sf_dir)
    first = cut(distinct_codes(codes, "vec_id", "code", "label"))
    across = hamming_pairs(first, "vec_id", "code", 2, other="label").select(F.explode(F.array("a", "b")).alias("vec_id")).distinct()
    return codes.join(first.join(across, "vec_id").select("label", "code"), ["label", "code"], "left_anti").select("vec_id")
