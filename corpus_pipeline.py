"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup by word shingles, mixing sources to target weights, packing.

Each stage reads what the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import cut, dropped, row_hash, table, whole, written
from millrace.session import with_package

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def any_columns(stage: Stage) -> Stage:
    """``stage`` for tables with columns of any other names and types: they go through it as one column, untouched."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = docs.columns
        by_number = docs.toDF(*[f"c{i}" for i in range(len(names))])
        rest = [f"c{i}" for i, c in enumerate(names) if c not in COLUMNS]
        plain = by_number.select(*[F.col(f"c{names.index(c)}").alias(c) for c in COLUMNS], *([F.struct(*rest).alias("others")] if rest else []))
        out = stage(spark, plain, sf_dir)
        return out.select(*[F.col(c) if c in COLUMNS else F.col(f"others.c{i}").alias(f"c{i}") for i, c in enumerate(names)]).toDF(*names)

    return run


@any_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores below 0.3 go.

    Null and empty texts have the score of no text at all. Repeated rows go or stay together. Other columns pass
    unchanged, whatever their names. An empty table stays empty.
    """
    from millrace.llm.quality import fit, score

    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).filter("score >= 0.3").drop("score")


@any_columns
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more that five documents share stay in the last one only; n_chars follows the text.

    No row goes. A null text stays null and keeps its n_chars, as do texts that lose no line; null ids are one document
    below all others. Other columns pass unchanged, whatever their names. An empty table stays empty.
    """
    from millrace.llm.line_dedup import line_dedup

    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return line_dedup(docs).withColumn("n_chars", n_chars).drop("n_lines", "n_dropped")


@any_columns
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, which SimHash proposes, one stays, by the smallest id.

    Rows without an id, and rows that share an id, are documents of their own; a repeated row stays once. Null, empty and
    wordless texts are copies of each other. Other columns pass unchanged, whatever their names. An empty table stays
    empty.
    """
    from millrace.llm.shingles import without_near_copies

    return without_near_copies(docs)


@any_columns
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources holds them.

    Rows are mixed one by one, whether they share an id or have none; rows equal in all columns come as often as the mix
    holds all of them. Null and empty texts have no words and come as often as whole rounds repeat their source. A null
    source is a source of its own. Other columns pass unchanged, whatever their names. An empty table stays empty.
    """
    from millrace.llm.mixing import mix_sources

    held = docs.select(F.struct(row_hash(docs, 1).alias("a"), row_hash(docs, 2).alias("b")).alias("key"), whole(docs).alias("row"))
    mixed = mix_sources(held.select("key", F.col("row.text").alias("text"), F.col("row.source").alias("source")), id_col="key")
    times = cut(mixed.groupBy("key").agg(F.sum("repeats").alias("repeats"), F.count("*").alias("rows")).filter("repeats > 0"))
    out = held.join(times.filter("rows = 1"), "key")
    if not (equal := times.filter("rows > 1")).isEmpty():
        out = out.unionByName(held.join(equal, "key").dropDuplicates(["key"]))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is the end token alone. Each row is packed once, repeated rows and null ids too. Columns but
    doc_id and text don't pass. An empty table gives no piece. Executors still hold what the stages before left in them, so
    workers remember a fifth of the words that packing alone would.
    """
    import public_tokenizers

    from millrace.llm.packing import pack

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), prompt_end="\n", with_ids=False, share=0.2)


STAGES = [(f.__name__, f) for f in (quality, lines, near_copies, mixture, sequences)]

#: The classifier, the knapsack and the packing can't be told in SQL; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What each leaves is a table where the session's checkpoints go, until the next one is written."""
    docs, before = table(with_package(spark), sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        dropped(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
