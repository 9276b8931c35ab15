"""Line dedup: lines that many documents share stay only in the last document that holds them.

DataFrame functions only. Lines are exploded once to (document, position, 128-bit hash); texts themselves never
move with their lines. Counting combines map-side, so a line that a third of all documents hold costs one partial
row per task. The hashes of dropped lines meet their documents again by id, and each text is reassembled from the
runs of positions between the dropped ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends and with A-Z (no other letters) in lower case."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, counts: tuple[str, str] | None = ("n_lines", "n_dropped")
) -> DataFrame:
    """``docs`` with the text deduplicated and two ``counts`` of lines added (in place of columns of those names), or none.

    A key of at least ``min_chars`` code points held by at least ``min_docs`` different ids loses its lines in every
    document but the one with the largest id. A null or empty text is one empty line; a null text stays null. A null
    id counts as one document below all others. Repeated rows of an id are one document when lines are counted, and
    each of them loses the same lines. Other columns pass unchanged, whatever their names. An empty table gives an
    empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = cut(
        docs.select(F.struct(F.col(id_col).alias("id")).alias("_d"), F.xxhash64(text).alias("_t"), F.posexplode(F.split(text, "\n")).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line")))
        .filter(F.char_length("_key") >= min_chars)
        .select("_d", "_t", "_pos", F.unhex(F.md5(F.col("_key").cast("binary"))).alias("_h"))
    )
    # cut off, so that the join below deals both sides anew and a common line's rows can be split among tasks
    shared = cut(lines.groupBy("_h").agg(F.count_distinct("_d").alias("_n"), F.max("_d").alias("_last")).filter(F.col("_n") >= min_docs).select("_h", "_last"))
    drops = (
        lines.join(shared, "_h")
        .filter(~F.col("_d.id").eqNullSafe(F.col("_last.id")))
        .groupBy(F.col("_d.id").alias("drop_id"), F.col("_t").alias("drop_t"))
        .agg(F.sort_array(F.collect_set("_pos")).alias("drop"))
    )
    held = docs.select(whole(docs).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("t"))
    joined = held.join(drops, F.col("id").eqNullSafe(F.col("drop_id")) & (F.col("t") == F.col("drop_t")), "left")
    given = joined["row"].getField(text_col)
    parts = F.split(F.coalesce(given, F.lit("")), "\n")
    size, drop = F.size(parts), joined["drop"]
    starts = F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1))
    runs = F.filter(F.arrays_zip(starts.alias("a"), F.concat(drop, F.array(size)).alias("b")), lambda r: r["a"] < r["b"])
    kept = F.array_join(F.transform(runs, lambda r: F.array_join(F.slice(parts, r["a"] + 1, r["b"] - r["a"]), "\n")), "\n")
    added = [size.cast("long"), F.when(drop.isNull(), F.lit(0)).otherwise(F.size(drop)).cast("long")]
    return joined.select(
        *[joined["row"].getField(c).alias(c) for c in docs.columns if c != text_col and c not in (counts or ())],
        F.when(drop.isNull(), given).otherwise(kept).alias(text_col),
        *[c.alias(n) for c, n in zip(added, counts or (), strict=False)],
    )
