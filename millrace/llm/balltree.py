"""Centroid clustering of integer vectors by ball-tree filtering.

Each task turns its vectors into metric trees of bounded size and leaves them as rows of a table: every ball has its
radius, count and integer sum. A round sends the few centroids to the trees. A ball that the triangle inequality gives
to one centroid as a whole adds its count and sum; any other is opened, down to leaves, whose vectors are compared
exactly. Only counts and sums leave a task, so vectors are never shuffled and results don't depend on the layout.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Vectors of one tree, which bounds what a task holds, and of one leaf.
TREE, LEAF = 16384, 32
#: Integers up to this size have exact squared distances in double precision (64 components); beyond it Python's integers serve.
EXACT = 1 << 22
LIMB = 31


@dataclass
class Tree:
    """Balls in rows, the root first; ``left`` is the first of a ball's two children, -1 at leaves. A ball holds points[start:end]."""

    points: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


def integers(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x) for every component: int64, or Python's integers if one is large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * 1024.0)
    if not scaled.size or np.abs(scaled).max() <= EXACT:
        return scaled.astype(np.int64)
    flat = [int(s) if math.isfinite(s) else int(v) * 1024 for s, v in zip(scaled.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array(flat, object).reshape(x.shape)


def built(points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of ``points`` and the order in which it holds them: balls are halved between two points far apart."""
    order, real = np.arange(len(points)), points.astype(np.float64)
    start, end, left, radius, sums, at = [0], [len(points)], [], [], [], 0
    while at < len(start):
        s, e = start[at], end[at]
        own = real[order[s:e]]
        centre = own.mean(axis=0)
        away = np.sqrt(((own - centre) ** 2).sum(axis=1))
        radius.append(float(away.max()) * (1 + 1e-9) + 1e-6)
        sums.append(points[order[s:e]].sum(axis=0))
        if e - s <= leaf or radius[-1] <= 1e-5:
            left.append(-1)
        else:
            one = own[int(away.argmax())]
            other = own[int(((own - one) ** 2).sum(axis=1).argmax())]
            middle = (e - s) // 2
            order[s:e] = order[s:e][np.argpartition(own @ (other - one), middle)]
            left.append(len(start))
            start += [s, s + middle]
            end += [s + middle, e]
        at += 1
    return Tree(points[order], *(np.array(x, np.int32) for x in (start, end, left)), np.array(radius), np.array(sums)), order


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every point, ties to the smaller number, and the squared distance, both exact."""
    if points.dtype != object and centroids.dtype != object:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        apart = ((p**2).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c**2).sum(axis=1)).astype(np.int64)
    else:
        apart = np.stack([((points.astype(object) - c) ** 2).sum(axis=1) for c in centroids.astype(object)], axis=1)
    of = apart.argmin(axis=1)
    return of, apart[np.arange(len(of)), of]


def assigned(tree: Tree, centroids: np.ndarray, compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums of each centroid's points, and every point's centroid. ``compared`` gets how many points were compared one by one."""
    k, (n, d) = len(centroids), tree.points.shape
    of, counts, sums = np.empty(n, np.int32), np.zeros(k, np.int64), np.zeros((k, d), object)
    exact = tree.points.dtype != object and centroids.dtype != object
    balls, loose = (np.zeros(1, np.int64), []) if exact else (np.zeros(0, np.int64), [np.arange(n)])
    # a centroid equal to an earlier one gets nothing, and would keep balls from being given away
    first = np.array([next(i for i in range(k) if (centroids[i] == c).all()) == j for j, c in enumerate(centroids)])
    real = np.where(first[:, None], centroids, 0).astype(np.float64) if exact else None
    while len(balls):
        centre = tree.sums[balls] / (tree.end - tree.start)[balls, None]
        away = np.sqrt(((centre[:, None, :] - real) ** 2).sum(axis=2))
        away[:, ~first] = np.inf
        one = away.argmin(axis=1)
        rows = np.arange(len(balls))
        near = away[rows, one] * (1 + 1e-9) + tree.radius[balls]
        away[rows, one] = np.inf
        whole = near < away.min(axis=1) * (1 - 1e-9) - tree.radius[balls] - 1e-6
        for ball, c in zip(balls[whole].tolist(), one[whole].tolist(), strict=True):
            of[tree.start[ball] : tree.end[ball]] = c
            counts[c] += tree.end[ball] - tree.start[ball]
            sums[c] += tree.sums[ball]
        rest = balls[~whole]
        below = tree.left[rest]
        loose += [np.arange(tree.start[b], tree.end[b]) for b in rest[below < 0].tolist()]
        balls = np.concatenate([below[below >= 0], below[below >= 0] + 1]).astype(np.int64)
    if loose:
        at = np.concatenate(loose)
        own = tree.points[at]
        of[at], _ = nearest(own, centroids)
        for c in range(k):
            mine = own[of[at] == c]
            counts[c] += len(mine)
            sums[c] += mine.sum(axis=0) if len(mine) else 0
        if compared is not None:
            compared.append(len(at))
    return counts, sums, of


def _limbs(value: int) -> list[int]:
    """A whole number in signed base 2 ** 31, lowest first."""
    out = []
    while not -(1 << LIMB) <= value < 1 << LIMB:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _packed(points: np.ndarray) -> bytes:
    return ",".join(map(str, points.ravel().tolist())).encode() if points.dtype == object else points.astype(np.int32).tobytes()


def _tree(row: dict, dims: int) -> Tree:
    if row["large"]:
        points = np.array([int(x) for x in row["points"].split(b",")], object).reshape(-1, dims)
        return Tree(points, *[np.zeros(0)] * 5)
    ints = [np.frombuffer(row[c], np.int32) for c in ("starts", "ends", "lefts")]
    return Tree(np.frombuffer(row["points"], np.int32).astype(np.int64).reshape(-1, dims), *ints, np.frombuffer(row["radii"]), np.frombuffer(row["sums"], np.int64).reshape(-1, dims))


def trees(vectors: DataFrame, dims: int, tree: int = TREE) -> DataFrame:
    """Trees of each partition's vectors (id, x array<double> of ``dims`` finite components), one a row."""
    kind = vectors.schema["id"].dataType.simpleString()

    def grown(ids: list, x: np.ndarray) -> dict:
        points = integers(x)
        if points.dtype == object:
            return {"ids": ids, "large": True, "points": _packed(points), **dict.fromkeys(("starts", "ends", "lefts", "radii", "sums"), b"")}
        t, order = built(points)
        return {"ids": [ids[i] for i in order.tolist()], "large": False, "points": _packed(t.points), "starts": t.start.tobytes(), "ends": t.end.tobytes(), "lefts": t.left.tobytes(), "radii": t.radius.tobytes(), "sums": t.sums.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, n, schema = [], [], 0, None
        for batch in batches:
            if schema is None:
                schema = pa.schema([("ids", pa.list_(batch.schema.field(0).type)), ("large", pa.bool_()), *[(c, pa.binary()) for c in ("points", "starts", "ends", "lefts", "radii", "sums")]])
            for at in range(0, batch.num_rows, tree):
                part = batch.slice(at, tree)
                ids += part.column(0).to_pylist()
                held.append(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
                n += part.num_rows
                while n >= tree:
                    x = np.concatenate(held)
                    yield pa.RecordBatch.from_pylist([grown(ids[:tree], x[:tree])], schema)
                    ids, held, n = ids[tree:], [x[tree:]], n - tree
        if n:
            yield pa.RecordBatch.from_pylist([grown(ids, np.concatenate(held))], schema)

    return vectors.select("id", "x").mapInArrow(run, f"ids array<{kind}>, large boolean, points binary, starts binary, ends binary, lefts binary, radii binary, sums binary")


def _round(grown: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: exact floors of their vectors' means."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, object), np.zeros((k, dims), object)
        for batch in batches:
            for row in batch.to_pylist():
                n, s, _ = assigned(_tree(row, dims), centroids)
                counts += n
                sums += s
        rows = [(c, d, at, limb) for c in range(k) if counts[c] for d, value in enumerate([*sums[c], counts[c]]) for at, limb in enumerate(_limbs(int(value)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["c", "d", "at", "limb"])

    # k * (dims + 1) numbers come back, whatever the number of vectors
    found = grown.drop("ids").mapInArrow(run, "c int, d int, at int, limb long").groupBy("c", "d", "at").agg(F.sum("limb").alias("limb")).collect()
    totals = np.zeros((k, dims + 1), object)
    for r in found:
        totals[r["c"], r["d"]] += r["limb"] << (LIMB * r["at"])
    return _fitting(np.array([[s // t[-1] for s in t[:-1]] if t[-1] else c.tolist() for t, c in zip(totals.tolist(), centroids, strict=True)], object).reshape(k, dims))


def _fitting(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64) if all(abs(v) <= EXACT for v in values.ravel().tolist()) else values


def centroid_clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, tree: int = TREE
) -> DataFrame:
    """Per vector: id, cluster, squared distance, the cluster's and all clusters' sums of distances, the centroid's sha256.

    Vectors with another number of components than ``dims``, or with null or non-finite ones, are left out, null
    vectors too. Components become floor(1024 * x). The first centroids are the vectors with the least sha256 of
    ``seed:id``, of equal ids those with the least components; null ids come last. With fewer vectors than
    ``clusters`` there are fewer clusters. Equal vectors and repeated rows are vectors of their own; ties of distance
    go to the smaller cluster, so of equal centroids the later ones stay empty. A distance, or a sum of distances,
    beyond a long is null. Other columns aren't read, whatever their names. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("id"), x.alias("x")).filter(F.col("x").isNotNull() & (F.size("x") == dims)).filter(F.coalesce(finite, F.lit(False)))
    grown, _ = written(trees(kept, dims, tree))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    begin = kept.select(hashed.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(clusters).collect()
    centroids = _fitting(np.array([integers(np.array([r["x"]])).tolist()[0] for r in begin], object).reshape(len(begin), dims))
    for _ in range(rounds if len(begin) else 0):
        before, centroids = centroids, _round(grown, centroids)
        if (before == centroids).all():
            break
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row in enumerate(batch.to_pylist()):
                t = _tree(row, dims)
                _, _, of = assigned(t, centroids)
                apart = ((t.points - centroids[of]) ** 2).sum(axis=1)
                longs = pa.array([v if v < 1 << 63 else None for v in apart.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("ids")[at].values, pa.array(of, pa.int32()), longs], names=["id", "cluster", "distance"])

    rows, _ = written(grown.mapInArrow(run, f"id {kind}, cluster int, distance long"))
    whole = F.when(F.count_if(F.col("distance").isNull()) == 0, F.sum(F.col("distance").cast("decimal(38,0)")))
    found = rows.groupBy("cluster").agg(whole.alias("sum")).collect()  # one row a cluster
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    every = None if any(r["sum"] is None for r in found) else sum(int(r["sum"]) for r in found)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(r["cluster"], fits(r["sum"]), fits(every), hashes[r["cluster"]]) for r in found], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
