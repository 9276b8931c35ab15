"""Distributed connected components, and pairs within keys by sorted runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: A key with more rows is split into parts of about this size, and each two parts meet in a task of their own.
PART = 2048


def components(edges: DataFrame, per_task: int | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b; long): the label is the smallest node that can be reached.

    Alternates large-star and small-star steps until they change nothing. Minima combine map-side, edges are cut to a
    checkpoint in each round, and no group of neighbours is ever gathered. With ``per_task``, a task holds about so many
    edges, so that few edges don't make many small files.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b"), F.col("b"))).distinct() if now[0] else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = now
        fewer = (lambda df: df.coalesce(-(-now[0] // per_task))) if per_task else (lambda df: df)
        edges = fewer(edges)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(fewer(large))
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lowest.select("a", "m")).filter("a <> b").distinct()
        edges = cut(fewer(small))


def with_parts(rows: DataFrame, keys: list[str], by: str, part: int = PART, keys_alone: DataFrame | None = None) -> DataFrame:
    """Adds _i, _j and _side so that every two rows of a key meet in exactly one (key, _i, _j).

    Rows of a key of more than ``part`` rows are dealt into parts by a hash of ``by``; with _i < _j only rows of
    different _side are to be paired. Keys are counted without what their rows carry (over ``keys_alone``, if that is
    cheaper to make); only where a key is too large do rows meet the table of such keys, of which there can be one for
    every ``part`` rows at most.
    """
    counts = (rows if keys_alone is None else keys_alone).groupBy(*keys).agg(F.count("*").alias("_n"))
    large = cut(counts.filter(F.col("_n") > part).select(*keys, F.ceil(F.col("_n") / part).cast("int").alias("_parts")))
    if large.isEmpty():
        return rows.withColumns({"_i": F.lit(0), "_j": F.lit(0), "_side": F.lit(0)})
    split = rows.join(large, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64(F.lit(7), F.col(by)), F.col("_parts")).cast("int")
    return (
        split.withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("_i", F.least("_own", "_other"))
        .withColumn("_j", F.greatest("_own", "_other"))
        .withColumn("_side", (F.col("_own") > F.col("_other")).cast("int"))
        .drop("_own", "_other", "_parts")
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes can reach over the edges (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def map_runs(rows: DataFrame, keys: list[str], order: list[str], use: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Brings the rows of a key together, in order, and maps tables of whole runs of keys at once.

    ``use`` gets a table and the rows at which its runs begin (and its number of rows at the end). A run is held whole,
    so runs need a bound, such as with_parts() gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows and (out := use(table, starts(table))) is not None:
                yield out

        def starts(table: pa.Table) -> np.ndarray:
            new = np.zeros(table.num_rows, bool)
            new[:1] = True
            for k in keys:
                values = table.column(k).to_numpy()
                new[1:] |= values[1:] != values[:-1]
            return np.append(np.flatnonzero(new), table.num_rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(batch)
            if all(rest[0].column(k)[0].as_py() == batch.column(k)[batch.num_rows - 1].as_py() for k in keys):
                continue  # one run so far
            table = pa.Table.from_batches(rest)
            last = int(starts(table)[-2])
            yield from done(table.slice(0, last))
            rest = table.slice(last).to_batches()
        if rest:
            yield from done(pa.Table.from_batches(rest))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
