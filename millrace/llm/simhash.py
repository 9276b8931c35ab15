"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are split into blocks. Two that differ in at most ``distance`` bits agree in all but as many blocks, so
every combination of that many agreeing blocks is a key, and close pairs share at least one. More fingerprints take more
blocks, so that a key's bits tell as many apart. Pairs within a key are verified by Hamming distance where they meet;
only edges of a spanning forest leave. Equal fingerprints are one node, which its smallest id names.

Similarities far below those of 4 bits take wide fingerprints: several words of 64 bits, of which each block is a key.
Two that differ in fewer bits than there are blocks share a key always, and those of sets that are alike all but surely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import PART, components, local_roots, map_runs, with_parts

BITS = 64
#: Fingerprints that a key has on average if they are spread evenly.
BUCKET = 64
#: A fingerprint of more than this part of all rows meets its component by a broadcast, of as many rows at most.
HOT = 4096
LANES = np.uint64(0x0101010101010101)
#: Wide fingerprints: part of the pairs at the similarity that may share no block, fingerprints that a block has on average if they
#: are spread evenly, words that travel with each key to tell distances, and standard deviations that alike pairs may stray.
MISSED, WIDE_BUCKET, TOLD, STRAY = 1e-4, 2048, 4, 4.4
#: Rows of a key above which it is split into parts; and sets so small that ties of their bits part them more often, by how much.
WIDE_PART, FEW, TIES = 1 << 16, 6, 1.25


def fingerprint(text: bytes, words: int = 4) -> int:
    """The 64-bit SimHash of a UTF-8 text's word shingles, repeats included."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = np.array([digest(line, 42)], np.uint64)
    else:
        pairs = zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = np.fromiter((digest(line[s:e], 42) for s, e in pairs), np.uint64, len(parts) - words + 1)
    n = len(hashes)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 255 * 256):
        some = hashes[at : at + 255 * 256]
        lanes = np.zeros((-(-len(some) // 255) * 255,), np.uint64)
        lanes[: len(some)] = some
        lanes = lanes.reshape(-1, 255)
        for bit in range(8):
            counts = ((lanes >> np.uint64(bit)) & LANES).sum(axis=1, dtype=np.uint64)
            ones[bit::8] += counts.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > n).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set's 64-bit hashes in ``words`` words, each of bits of its own; zero for an empty set."""
    if not len(hashes):
        return np.zeros(words, np.uint64)
    mixed = hashes + np.arange(words, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    rest = mixed[1:]
    rest ^= rest >> np.uint64(30)
    rest *= np.uint64(0xBF58476D1CE4E5B9)
    rest ^= rest >> np.uint64(27)
    rest *= np.uint64(0x94D049BB133111EB)
    rest ^= rest >> np.uint64(31)
    rows, ones = np.ascontiguousarray(mixed.T).view(np.uint8), np.zeros(words * BITS, np.int64)
    for at in range(0, len(rows), 255):  # so many fit a byte
        ones += np.unpackbits(rows[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(rows), bitorder="little").view(np.uint64)


def differ(similarity: float) -> float:
    """How often a bit differs between sets of a Jaccard similarity, at most: their angle, of which equally large sets have the widest."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shape(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a block and words of a wide fingerprint for ``n`` sets: blocks hold about WIDE_BUCKET of them, and MISSED of alike pairs share none."""
    bits = max(8, math.ceil(math.log2(max(n, 1) / WIDE_BUCKET)))
    agree = min((1 - differ(similarity)) ** bits, 0.999)
    return bits, max(TOLD, math.ceil(math.log(MISSED) / math.log1p(-agree) / (BITS // bits)))


def reach(words: int, similarity: float, few: bool = False) -> int:
    """Bits of ``words`` words in which sets of that similarity differ at most, but for STRAY standard deviations."""
    p, n = min(0.5, differ(similarity) * (TIES if few else 1)), words * BITS
    return math.floor(n * p + STRAY * math.sqrt(n * p * (1 - p)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long; null and wordless texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint((t.as_py() or "").encode(), words) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _keys(distance: int, blocks: int) -> list:
    """One column for each combination of blocks - distance blocks: its number and the bits of its blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    fp = F.col("fp")
    return [
        F.struct(F.lit(n).alias("_c"), fp.bitwiseAND(F.lit(_signed(sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in chosen)))).alias("_bits"))
        for n, chosen in enumerate(combinations(range(blocks), blocks - distance))
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(n: int, distance: int = 4) -> int:
    """Blocks whose keys hold about BUCKET of ``n`` fingerprints at most, if those are spread evenly: 2 more than the distance at least."""
    blocks = distance + 2
    while blocks < 2 * distance + 2 and n >> (BITS * (blocks - distance) // blocks) > BUCKET:
        blocks += 1
    return blocks


def links(nodes: DataFrame, distance: int = 4, blocks: int = 6, part: int = PART, name: str = "fp") -> DataFrame:
    """Edges (a, b) of a spanning forest of each run of different fingerprints ``fp`` at most ``distance`` bits apart.

    Nodes have the name (a long) that their column ``name`` has.
    """
    keyed = nodes.select("fp", F.col(name).alias("_name")).withColumn("_k", F.explode(F.array(*_keys(distance, blocks)))).select("fp", "_name", F.col("_k._c").alias("_c"), F.col("_k._bits").alias("_bits"))

    def use(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        fp, side, diagonal = table.column("fp").to_numpy().view(np.uint64), table.column("_side").to_numpy(), table.column("_i").to_numpy() == table.column("_j").to_numpy()
        end = np.repeat(starts[1:], np.diff(starts))
        at, found, held = np.arange(len(fp)), [], 0
        root_a, root_b = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def spanning() -> tuple[np.ndarray, np.ndarray]:
            a, b = np.concatenate([root_a, *(x for x, _ in found)]), np.concatenate([root_b, *(y for _, y in found)])
            root = local_roots(len(fp), a, b)
            inner = np.flatnonzero(root != np.arange(len(fp)))
            return inner, root[inner]

        step = 1
        while len(at := at[at + step < end[at]]):
            other = at + step
            near = (np.bitwise_count(fp[at] ^ fp[other]) <= distance) & (diagonal[at] | (side[at] != side[other]))
            if near.any():
                found.append((at[near], other[near]))
                held += int(near.sum())
                if held > 500_000:
                    root_a, root_b = spanning()
                    found, held = [], 0
            step += 1
        if not found and not len(root_a):
            return None
        a, b = spanning()
        names = table.column("_name").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(names[a]), pa.array(names[b])], names=["a", "b"])

    return map_runs(with_parts(keyed, ["_c", "_bits"], "fp", part), ["_c", "_bits", "_i", "_j"], ["_side"], use, "a long, b long")


def wide_links(nodes: DataFrame, bits: int, words: int, similarity: float, part: int = WIDE_PART) -> DataFrame:
    """Edges (a, b) of a spanning forest of each run of wide fingerprints that sets of ``similarity`` or more may have.

    ``nodes``: node (long), n (hashes of its set), _fp (``words`` longs). Two meet if they agree in a block of ``bits`` bits;
    they are tied if their sizes and the distance of TOLD words allow the similarity.
    """
    per, mask = BITS // bits, (1 << bits) - 1
    word = lambda w: F.element_at("_fp", w + 1)
    keys = [F.shiftrightunsigned(word(k // per), k % per * bits).bitwiseAND(F.lit(mask).cast("long")) + F.lit(k << bits).cast("long") for k in range(words * per)]
    told = [f"_f{w}" for w in range(TOLD)]
    keyed = nodes.select("node", F.col("n").cast("long").alias("n"), *[word(w).alias(f) for w, f in enumerate(told)], F.explode(F.array(*keys)).alias("_key"))
    first, all_, few = reach(1, similarity, True), reach(TOLD, similarity), reach(TOLD, similarity, True)

    def forest(size: np.ndarray, fp: np.ndarray, split: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Edges between the rows of a run, or with ``split`` between those before and after it; either is in order of size."""
        m = len(size)
        root, edges_a, edges_b = np.arange(m), np.zeros(0, np.int64), np.zeros(0, np.int64)
        held_a, held_b, held = [], [], 0

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            far = np.bitwise_count(fp[:, a] ^ fp[:, b]).sum(axis=0, dtype=np.int64)
            return (far <= np.where(low < FEW, few, all_)) & (low >= similarity * high - 1e-9)

        def tie(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal root, edges_a, edges_b
            edges_a, edges_b = np.append(edges_a, a), np.append(edges_b, b)
            root = local_roots(m, edges_a, edges_b)
            edges_a = np.flatnonzero(root != np.arange(m))
            edges_b = root[edges_a]

        if m > 1024:  # a large group of near copies is settled by leaders, in proportion to its size
            for leader in np.linspace(0, m - 1, 16).astype(np.int64):
                others = np.arange(m) if split is None else np.arange(split, m) if leader < split else np.arange(split)
                others = others[root[others] != root[leader]]
                others = others[near(np.full(len(others), leader), others)]
                if len(others):
                    tie(np.full(len(others), leader), others)
        begin, end = (0, m) if split is None else (split, m)
        for i in range(0, m if split is None else split, 128):
            rows = np.arange(i, min(i + 128, m if split is None else split))
            low = max(begin, i + 1) if split is None else begin + int(np.searchsorted(size[begin:end], similarity * size[rows[0]] - 1e-6))
            high = begin + int(np.searchsorted(size[begin:end], size[rows[-1]] / similarity + 1e-6, "right"))
            for j in range(low, high, 4096):
                cols = np.arange(j, min(j + 4096, high))
                # rows that hang together by now have nothing to say to each other
                if (root[rows] == root[rows[0]]).all():
                    cols = cols[root[cols] != root[rows[0]]]
                x, y = np.nonzero(np.bitwise_count(fp[0, rows][:, None] ^ fp[0, cols]) <= first)
                a, b = rows[x], cols[y]
                some = root[a] != root[b]
                if split is None:
                    some &= a < b
                a, b = a[some], b[some]
                some = near(a, b)
                held_a.append(a[some])
                held_b.append(b[some])
                held += len(held_a[-1])
                if held > 1000:
                    tie(np.concatenate(held_a), np.concatenate(held_b))
                    held_a, held_b, held = [], [], 0
        if held:
            tie(np.concatenate(held_a), np.concatenate(held_b))
        return edges_a, edges_b

    def use(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        node, size, side = (table.column(c).to_numpy() for c in ("node", "n", "_side"))
        apart = table.column("_i").to_numpy() != table.column("_j").to_numpy()
        fp = np.stack([table.column(f).to_numpy() for f in told]).view(np.uint64)
        out_a, out_b = [], []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if end - start > 1:
                a, b = forest(size[start:end], fp[:, start:end], int((side[start:end] == 0).sum()) if apart[start] else None)
                out_a.append(node[start + a])
                out_b.append(node[start + b])
        if not sum(map(len, out_a)):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    return map_runs(with_parts(keyed, ["_key"], "node", part), ["_key", "_i", "_j"], ["_side", "n"], use, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """(id, fingerprint, component_id) for every row of ``docs``; ids are integers.

    Fingerprints at most ``distance`` bits apart are linked; the component's id is the smallest id of its rows. Null,
    empty and wordless texts have fingerprint zero and are linked like any other; a null id never names a component
    unless all its ids are null. Repeated rows and equal texts are in one component. Other columns aren't read, whatever
    their names. An empty table gives an empty table. ``blocks`` follow the number of fingerprints if not given.
    """
    kind = docs.schema[id_col].dataType
    prints = cut(fingerprints(docs, id_col, text_col, words))
    top = min(prints.agg(F.coalesce(F.max("id").cast("long"), F.lit(0))).first()[0], 1 << 62)
    # fingerprints without an id have names beyond all ids
    name = F.coalesce(F.col("first"), F.lit(top + 1) + F.monotonically_increasing_id())
    nodes = cut(prints.groupBy("fp").agg(F.min("id").cast("long").alias("first"), F.count("*").alias("n")).select("fp", "n", name.alias("name")))
    size, total = nodes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = components(links(nodes, distance, blocks or blocks_for(size, distance), name="name"))
    label = F.coalesce("label", "name")
    by_fp = cut(nodes.join(found, nodes["name"] == found["node"], "left").select("fp", "n", F.when(label <= top, label).cast(kind).alias("component_id")))
    hot, rest = F.broadcast(by_fp.filter(F.col("n") * HOT > total)), by_fp.filter(F.col("n") * HOT <= total)
    joined = prints.join(hot.drop("n"), "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(rest.drop("n"), "fp"))
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
