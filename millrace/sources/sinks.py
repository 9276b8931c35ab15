"""Writers: partitioned tables, rejected rows by reason, label lines, reports as text and HTML, settings."""

from __future__ import annotations

import html
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import positions
from ..session import cut
from .files import exists


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with the declared columns and a header: the full schema, whatever the first row has."""
    df.select(*(columns or df.columns)).write.mode("overwrite").csv(path, header=True)


def write_pseudo_labels(df: DataFrame, path: str) -> None:
    """One table in place of a file for each column and item, laid out by mode."""
    df.write.mode("overwrite").partitionBy("mode").parquet(path)


def quarantine(rejected: DataFrame, path: str, key: str, name: str) -> DataFrame:
    """Stores rejected rows by ``reason_code`` and ``category`` under names that no other row of their folder has; gives what the folders hold.

    A name that a folder holds already gets _1, _2, ... before its suffix, counted on from what is there; rows that are
    there by key keep their name, so a repeated run writes the same files. Only folders that get rows are rewritten.
    Positions come from a range sort, so a folder may hold most rows.
    """
    spark, folder = rejected.sparkSession, ("reason_code", "category")
    new = rejected.dropDuplicates([key])
    held = None
    if exists(spark, path):
        held = cut(spark.read.schema(T.StructType([*new.schema.fields, T.StructField("stored_as", T.StringType())])).parquet(path).select(*new.columns, "stored_as"))
        new = new.join(held.select(*folder, key), [*folder, key], "left_anti").select(*new.columns)
    placed = positions(new, key, *folder, name).drop("_n")
    if held is not None:
        there = held.groupBy(*folder, name).agg(F.count("*").alias("_there"))
        placed = placed.join(there, [*folder, name], "left").withColumn("_p", F.col("_p") + F.coalesce("_there", F.lit(0)))
    stem, suffix = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stored = F.when(F.col("_p") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_p").cast("string"), suffix))
    out = cut(placed.withColumn("stored_as", stored).select(*new.columns, "stored_as"))
    touched = out.select(*folder).distinct()
    whole = out if held is None else out.unionByName(held.join(touched, list(folder), "left_semi"))
    write_folders(whole, path, *folder)
    return spark.read.schema(whole.schema).parquet(path).select(*whole.columns)


def write_folders(df: DataFrame, path: str, *folders: str, kind: str = "parquet") -> None:
    """Writes rows by folder; folders that get no row stay as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).format(kind).save(path)


def detector_dataset(boxes: DataFrame, path: str, names: Sequence[str]) -> None:
    """Label lines (split, stem, line) below ``labels/split=...`` and a data.yaml that names the splits and classes; splits without rows stay."""
    write_folders(boxes.select("split", "stem", "line"), f"{path}/labels", "split", kind="csv")
    lines = [f"path: {path}", "train: labels/split=train", "val: labels/split=val", f"nc: {len(names)}", f"names: [{', '.join(names)}]"]
    boxes.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/data.yaml")


def write_complete(df: DataFrame, path: str, *needed: str) -> dict[str, int]:
    """Writes rows that lack none of the needed columns; gives how many there were, went, and lacked each column, counted as they were written."""
    lacks = [F.col(c).isNull() for c in needed]
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(reduce(lambda a, b: a | b, lacks)).alias("n_dropped"), *[F.count_if(x).alias(f"no_{c}") for x, c in zip(lacks, needed, strict=True)]]
    df.observe(seen, *counts).dropna(subset=list(needed)).write.mode("overwrite").parquet(path)
    return dict(seen.get)


def label_line(box: Column) -> Column:
    """A detector's label line: class 0 and the box to six places."""
    return F.format_string("0 %.6f %.6f %.6f %.6f", box["cx"], box["cy"], box["w"], box["h"])


def text_report(title: str, counts: DataFrame, label: str, n: str) -> DataFrame:
    """(line_no, line) of an aligned report of aggregated counts: title, rule, counts with thousands separators, largest first, rule, total."""
    wide = F.greatest(F.max(F.char_length(label)), F.lit(5))
    sizes = F.broadcast(counts.agg(F.coalesce(wide, F.lit(5)).alias("_w"), F.coalesce(F.sum(n), F.lit(0)).alias("_all"), F.count("*").alias("_rows")))  # one row
    row = lambda name, value: F.concat(F.lit("  "), F.rpad(name, F.col("_w"), F.lit(" ")), F.lpad(F.format_number(value, 0), F.lit(14), F.lit(" ")))
    place = F.row_number().over(Window.orderBy(F.desc(n), label)) + 2  # over aggregates
    body = counts.crossJoin(sizes).select(place.cast("long").alias("line_no"), row(F.col(label), F.col(n)).alias("line"))
    rule = lambda mark: F.repeat(F.lit(mark), F.col("_w") + 16)
    frame = F.array(*[F.struct(at.cast("long").alias("line_no"), line.alias("line")) for at, line in ((F.lit(1), F.lit(title)), (F.lit(2), rule("=")), (F.col("_rows") + 3, rule("-")), (F.col("_rows") + 4, row(F.lit("total"), F.col("_all"))))])
    return body.union(sizes.select(F.inline(frame)))


def escaped_html(text: Column) -> Column:
    # The characters that HTML needs written otherwise.
    for plain, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def html_rows(df: DataFrame, order: str, best: str | None = None) -> DataFrame:
    """(row_no, html): a table's head as row 0 and a row for each of ``df``; rows with the largest value of ``best`` are marked."""
    cells = F.concat(*[F.concat(F.lit("<td>"), escaped_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns])
    marked = F.when(F.col(best) == F.max(best).over(Window.partitionBy()), F.lit('<tr class="best">')) if best else F.lit(None).cast("string")
    rows = df.select(F.row_number().over(Window.orderBy(order)).cast("long").alias("row_no"), F.concat(F.coalesce(marked, F.lit("<tr>")), cells, F.lit("</tr>")).alias("html"))
    head = "<tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>"
    return rows.union(df.sparkSession.createDataFrame([(0, head)], "row_no long, html string"))


def promoted(keys: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """(key, artefact) of each key: the least artefact of the first of ``sources`` (key, artefact) that has one, null if none does.

    All sources meet in one aggregation, whose rows combine before they are dealt.
    """
    ranked = reduce(lambda a, b: a.union(b), [s.filter(F.col("artefact").isNotNull()).select(F.col(key).alias("_key"), F.struct(F.lit(i).alias("rank"), F.col("artefact")).alias("a")) for i, s in enumerate(sources)])
    best = ranked.groupBy("_key").agg(F.min("a")["artefact"].alias("artefact"))
    return keys.select(key).join(best, F.col(key) == F.col("_key"), "left").select(key, "artefact")


def metadata(df: DataFrame, *keys: str) -> DataFrame:
    """One JSON document for each row, under its keys."""
    return df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("document"))


def branches(brackets: Sequence[tuple], value: str = "v") -> str:
    """Source lines of a ``when`` that grades a value by brackets."""
    return "\n".join(f"{value} < {high} -> {result}" if low is None else f"{value} >= {low} -> {result}" if high is None else f"{value} in {low}..<{high} -> {result}" for low, high, result in brackets)


def updated_setting(text: Column, key: str, value: Column) -> Column:
    """A settings text with the value of ``key = ...`` replaced; unchanged if the key isn't there."""
    return F.regexp_replace(text, F.lit(rf"(?m)^({key}\s*=\s*).*$"), F.concat(F.lit("$1"), value))
