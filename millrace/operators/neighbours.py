"""Exact nearest neighbours over a pivot index.

Reference vectors belong to the cell of their nearest pivot. An item first meets its own cell, which bounds how far its
k-th neighbour can be; the triangle inequality and the hyperplane between two pivots then tell which other cells may
hold a nearer one, and the item goes to these alone. Cells meet items in blocks of bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Pivots at most: with their cells' radii, all that tasks are sent. There is one for each block of reference vectors, so that items
#: whose bounds rule nothing out are copied once a block.
PIVOTS = 1024
#: Reference vectors of a block at least and at most; in between there are ``BLOCKS`` blocks, so that copies follow the number of items.
SMALL, LARGE, BLOCKS = 4096, 1 << 15, 16
#: ``same`` tells that an item's own reference vector is its own vector, which then travels once; ``own`` is null.
VISIT = "item long, v array<double>, own array<double>, same boolean, cell int, bound double"

VISITS = ["item", "v", "own", "same", "cell", "bound"]


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ y.T + (y * y).sum(axis=1), 0.0))


def _met(visits: DataFrame, cells: DataFrame, k: int, block: int) -> DataFrame:
    """(item, d): each visit's k nearest distances in its cell; large cells, and many visits of one, in blocks that meet pairwise."""
    sides = [df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for df, n in ((visits, "is"), (cells, "js"))]
    blocks = F.broadcast(sides[0].join(sides[1], "cell"))  # one row a pivot
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(blocks, "cell").withColumn("j", every("js")).withColumn("i", F.pmod(F.xxhash64("item"), F.col("is")).cast("int"))
    right = cells.join(blocks, "cell").withColumn("i", every("is")).withColumn("j", F.pmod(F.xxhash64("v"), F.col("js")).cast("int"))

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        items, found = a.column("item").to_numpy(), []
        if len(items) and b.num_rows:
            x, y, times = _vectors(a.column("v")), _vectors(b.column("v")), b.column("n").to_numpy()
            own, same = a.column("own").to_pylist(), a.column("same").to_pylist()
            place = {v.tobytes(): at for at, v in enumerate(y)}
            for at in range(0, len(x), 256):
                part = x[at : at + 256]
                away = _apart(part, y)
                near = np.argpartition(away, k, axis=1)[:, : k + 1] if away.shape[1] > k + 1 else np.tile(np.arange(away.shape[1]), (len(part), 1))
                exact = np.sqrt(((part[:, None, :] - y[near]) ** 2).sum(axis=2))
                for vector, row, close, mine, equal in zip(part, exact.tolist(), near.tolist(), own[at : at + 256], same[at : at + 256], strict=True):
                    self_at = place.get(vector.tobytes(), -1) if equal else -1 if mine is None else place.get(np.array(mine).tobytes(), -1)
                    d = [x for x, c in zip(row, close, strict=True) for _ in range(min(k, int(times[c]) - (c == self_at)))]
                    found.append(sorted(d)[:k])
        return pa.table({"item": pa.array(items if found else [], pa.int64()), "d": pa.array(found, pa.list_(pa.float64()))})

    keys = ["cell", "i", "j"]
    return left.select(*keys, "item", "v", "own", "same").groupBy(*keys).cogroup(right.select(*keys, "v", "n").groupBy(*keys)).applyInArrow(nearest, "item long, d array<double>")


def nearest_distances(items: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 3, pivots: int = PIVOTS, block: int | None = None, visited: list[int] | None = None) -> DataFrame:
    """(key, d): the sorted Euclidean distances of each item to its k nearest reference rows, the row of its own key left out.

    Equal reference vectors are one with a count, and equal items are looked up once, so copies cost nothing. Null
    vectors, and those with null components, are near to nothing; an item with no neighbour has no row. ``visited``
    gets the numbers of distinct items, of reference vectors and of pairs that were compared.
    """
    given = lambda df: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(F.coalesce(F.forall("v", lambda x: x.isNotNull()), F.lit(False)))
    rows, others = given(items), given(reference)
    known = cut(others.groupBy("v").agg(F.count("*").alias("n")))
    n_known = known.count()
    block = block or max(SMALL, min(LARGE, -(-n_known // BLOCKS)))
    chosen = known.orderBy(F.xxhash64("v"), "v").limit(max(1, min(pivots, -(-n_known // block)))).collect()
    if not chosen:
        return rows.select(F.col("id").alias(key), F.array().cast("array<double>").alias("d")).limit(0)
    middles = np.array([r["v"] for r in chosen])
    between = np.maximum(_apart(middles, middles), 1e-300)
    held = rows.join(others.groupBy("id").agg(F.first("v").alias("own")), "id", "left")
    one = cut(held.groupBy("v", "own").agg(F.min("id").alias("first")).withColumn("item", F.monotonically_increasing_id()))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _apart(_vectors(batch.column(0)), middles)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(away[np.arange(len(cell)), cell])], names=["v", "n", "cell", "away"])

    cells = cut(known.select("v", "n").mapInArrow(placed, "v array<double>, n long, cell int, away double"))
    radius = np.full(len(middles), -np.inf)
    for r in cells.groupBy("cell").agg(F.max("away").alias("away")).collect():  # one row a pivot
        radius[r["cell"]] = r["away"] * (1 + 1e-9) + 1e-9

    def own_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _apart(_vectors(batch.column(1)), middles)
            away[:, np.isinf(radius)] = np.inf  # a pivot whose vectors are all nearer to an equal one
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(away.argmin(axis=1), pa.int32()), pa.array(np.zeros(batch.num_rows))], names=VISITS)

    def other_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = batch.column(5).to_numpy(zero_copy_only=False)
            mine = batch.column(4).to_numpy()
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                away = _apart(_vectors(part.column(1)), middles)
                rows, cell = np.arange(len(away)), mine[at : at + 1024]
                plane = (away**2 - away[rows, cell][:, None] ** 2) / (2 * between[cell])
                least = np.maximum(away - radius, plane)
                visit = (least <= (bound[at : at + 1024] * (1 + 1e-9) + 1e-9)[:, None]) & np.isfinite(radius)
                visit[rows, cell] = False
                r, c = np.nonzero(visit)
                taken = part.take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*(taken.column(i) for i in range(4)), pa.array(c, pa.int32()), taken.column(5)], names=VISITS)

    best = F.slice(F.sort_array(F.flatten(F.collect_list("d"))), 1, k)
    same = F.coalesce(F.col("own") == F.col("v"), F.lit(False))
    visits = one.select("item", "v", F.when(~same, F.col("own")).alias("own"), same.alias("same"))
    first = cut(visits.mapInArrow(own_cell, VISIT))
    near = cut(_met(first, cells, k, block).groupBy("item").agg(best.alias("d")))
    bounds = near.select("item", F.when(F.size("d") >= k, F.element_at("d", -1)).alias("kth"))
    after = first.join(bounds, "item", "left").select("item", "v", "own", "same", "cell", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
    later = cut(after.mapInArrow(other_cells, VISIT))
    if visited is not None:
        sizes = cells.groupBy("cell").agg(F.count("*").alias("m"))
        pairs = first.select("cell").union(later.select("cell")).join(sizes, "cell").agg(F.sum("m")).first()[0]
        visited += [one.count(), cells.count(), int(pairs or 0)]
    found = near.union(_met(later, cells, k, block)).groupBy("item").agg(best.alias("d")).filter(F.size("d") > 0)
    told = one.join(found, "item").select("v", "own", "d")
    return held.join(told, held["v"].eqNullSafe(told["v"]) & held["own"].eqNullSafe(told["own"])).select(held["id"].alias(key), told["d"])
