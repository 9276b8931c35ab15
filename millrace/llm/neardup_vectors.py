"""Embedding near-dedup: random-hyperplane sign hashes in several tables, exact cosines, connected components.

The number of planes follows the number of different vectors and the number of tables the recall that a pair at the
threshold is to have, so buckets stay of one size at every scale. Equal vectors are one node that counts its copies.
A bucket's vectors meet where their rows are sorted together; links are counted there, each in the first table whose
codes agree, and only edges of a spanning forest leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .components import PART, components, local_roots, map_runs, with_parts

#: Rows that a bucket has on average if vectors are spread evenly.
BUCKET = 64


def planes_and_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Planes of a table, and tables that a pair at the threshold needs to be found with the recall given."""
    planes = max(4, math.ceil(math.log2(max(n, 1) / BUCKET)))
    agree = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def vector_groups(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
    threshold: float = 0.98, recall: float = 0.9999, seed: int = 42, part: int = PART,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row: vectors with equal labels and a cosine of at least ``threshold`` are linked.

    Ids are integers. Null, zero and non-finite vectors, vectors with null components and rows with a null label link with nothing;
    vectors of different lengths neither. Copies are linked with each other and count as often as they come. A null
    id is never a component's id; its row has no component unless links give it one. Other columns aren't read, whatever
    their names. An empty table gives an empty table.
    """
    v = F.col(vector_col)
    # floats travel as they are; doubles are scaled, so that no square leaves their range
    kind = "float" if isinstance(rows.schema[vector_col].dataType, T.ArrayType) and isinstance(rows.schema[vector_col].dataType.elementType, T.FloatType) else "double"
    form = "<f4" if kind == "float" else "<f8"
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    label = F.col(label_col) if label_col else F.lit(0)
    base = rows.select(F.col(id_col).cast("long").alias("_id"), label.alias("_label"), v.cast(f"array<{kind}>").alias("_v"), F.coalesce(finite & label.isNotNull() & F.col(id_col).isNotNull(), F.lit(False)).alias("_ok"))
    base = base.withColumn("_g", F.when(F.col("_ok"), F.xxhash64("_label", "_v"))).withColumn("_g2", F.when(F.col("_ok"), F.xxhash64(F.lit(1), "_label", "_v")))
    nodes = cut(base.filter("_ok").groupBy("_g", "_g2").agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.first("_v").alias("_v"), F.first("_label").alias("_label")))
    planes, tables = planes_and_tables(nodes.count(), threshold, recall)
    code, codes_of = ("int", np.int32) if planes < 31 else ("long", np.int64)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (b.select(["_l", "_d", "_t", "_code"]) for b in hashed(batches))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = np.append(0, np.cumsum(sizes))
            for d in np.unique(sizes).tolist():
                if d not in known:
                    known[d] = np.random.default_rng((seed, d)).standard_normal((d, planes * tables))
                own = np.flatnonzero(sizes == d)
                for k in range(0, len(own), 2048):
                    mine = own[k : k + 2048]
                    raw = np.stack([flat[at[i] : at[i + 1]] for i in mine])
                    x = raw.astype(float) / np.abs(raw).max(axis=1, keepdims=True)
                    bits = ((x @ known[d]) > 0).reshape(len(mine), tables, planes)
                    codes = (bits * (1 << np.arange(planes))).sum(axis=2).astype(codes_of)
                    take = pa.array(np.repeat(mine, tables))
                    blob, seen = [r.tobytes() for r in (raw if form == "<f4" else x).astype(form)], [c.tobytes() for c in codes]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), pa.array(np.full(len(take), d), pa.int32()), pa.array(np.tile(np.arange(tables), len(mine)), pa.int32()), pa.array(codes.ravel()), pa.array(blob).take(pa.array(np.repeat(np.arange(len(mine)), tables))), pa.array(seen).take(pa.array(np.repeat(np.arange(len(mine)), tables)))],
                        names=["rep", "copies", "_l", "_d", "_t", "_code", "_x", "_codes"],
                    )

    # labels are told apart by a key: any type will do
    labelled = nodes.select("rep", "copies", F.xxhash64(F.lit(2), "_label").alias("_l"), "_v")
    coded = labelled.mapInArrow(hashed, f"rep long, copies long, _l long, _d int, _t int, _code {code}, _x binary, _codes binary")
    keys_alone = labelled.mapInArrow(keys_of, f"_l long, _d int, _t int, _code {code}")

    def use(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        rep, copies, side, number = (table.column(c).to_numpy() for c in ("rep", "copies", "_side", "_t"))
        diagonal = table.column("_i").to_numpy() == table.column("_j").to_numpy()
        xs, seen = table.column("_x").to_pylist(), table.column("_codes").to_pylist()
        out_rep, out_n, out_root = [], [], []
        many = np.flatnonzero(np.diff(starts) > 1)
        for s, e in zip(starts[many].tolist(), starts[many + 1].tolist(), strict=True):
            x = np.frombuffer(b"".join(xs[s:e]), form).reshape(e - s, -1).astype(float)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
            near = (x @ x.T) >= threshold
            np.fill_diagonal(near, False)
            if not diagonal[s]:
                near &= side[s:e, None] != side[None, s:e]
            if not near.any():
                continue
            a, b = np.nonzero(near)
            codes = np.frombuffer(b"".join(seen[s:e]), codes_of).reshape(e - s, -1)
            first = np.ones(len(a), bool)
            for t in range(int(number[s])):
                first &= codes[a, t] != codes[b, t]
            a, b = a[first], b[first]
            if not len(a):
                continue
            root = local_roots(e - s, a, b)
            n = np.bincount(a, weights=copies[s + b], minlength=e - s).astype(np.int64)
            linked = np.flatnonzero(n)
            out_rep.append(rep[s + linked])
            out_n.append(n[linked])
            out_root.append(rep[s + root[linked]])
        if not out_rep:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (out_rep, out_n, out_root)], names=["rep", "n", "root"])

    keys = ["_l", "_d", "_t", "_code"]
    found = cut(map_runs(with_parts(coded, keys, "rep", part, keys_alone), [*keys, "_i", "_j"], ["_side"], use, "rep long, n long, root long"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rep").agg(F.sum("n").alias("n"))
    per_node = (
        nodes.select("_g", "_g2", "rep", "copies")
        .join(linked, "rep", "left")
        .join(labels, F.col("rep") == F.col("node"), "left")
        .select("_g", "_g2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    )
    component = F.coalesce("component_id", "_id")
    return base.select("_id", "_g", "_g2").join(per_node, ["_g", "_g2"], "left").select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept")
    )
