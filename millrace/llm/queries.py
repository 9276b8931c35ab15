"""The registered queries of this subpackage, each a thin digest of its operator's results, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup_vectors import vector_groups

    return vector_groups(common.table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(common.table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import suffix_dedup

    return suffix_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .matroska import digests

    return digests(common.table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256")
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .windows import substring_dedup

    return substring_dedup(common.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), prompt_end="\n", with_ids=False)


URL_RULES = ("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import filter_urls, parse_rules

    return filter_urls(common.table(spark, sf_dir, "pages").select("page_id", "url"), parse_rules(*URL_RULES)).drop("bad_share")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .balltree import centroid_clusters

    return centroid_clusters(common.table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repair_damaged

    return repair_damaged(common.table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify

    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_vector_groups, op3_quality, op4_simhash, op5_suffix_dedup, op6_matroska, op7_line_dedup, op8_substring_dedup, op9_pack_sequences, op10_url_filters,
        op11_centroid_clusters, op12_conversation_repair, op13_toxicity,
    )
}


def _centroid_sql(clusters: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> str:
    """Lloyd's rounds in whole numbers, one after another: c0 are the first centroids, a0 the first assignment."""
    out = f"""
WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) <= {clusters}
)"""
    for k in range(rounds + 1):
        out += f""", a{k} AS MATERIALIZED (
  SELECT vec_id, v, min(struct_pack(d := d, c := c)) AS z
  FROM (SELECT kept.vec_id, kept.v, c{k}.c, CAST(list_sum(list_transform(list_zip(kept.v, c{k}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept, c{k})
  GROUP BY vec_id, v
)"""
        if k < rounds:
            out += f""", c{k + 1} AS MATERIALIZED (
  SELECT c{k}.c, CASE WHEN m.c IS NULL THEN c{k}.v ELSE m.v END AS v FROM c{k} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT z.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(1, {dims + 1}) AS r(i) GROUP BY z.c, i) GROUP BY c
  ) m ON m.c = c{k}.c
)"""
    return out + f"""
SELECT vec_id, CAST(z.c AS INTEGER) AS cluster, z.d AS distance, CAST(sum(z.d) OVER (PARTITION BY z.c) AS BIGINT) AS cluster_inertia, CAST(sum(z.d) OVER () AS BIGINT) AS inertia,
  sha256(list_aggregate(list_transform(c{rounds}.v, lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = z.c
"""


SQL = {
    "op11_centroid_clusters": _centroid_sql(),
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(list_zip(range(len(parts)), parts), max_depth := 1) AS z
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT doc_id, z[1] AS pos, z[2] AS line,
    translate(trim(z[2], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> shared.last AS dropped FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}
