"""Near copies by SimHash: pigeonhole blocks of fingerprints of word shingles propose pairs, the shingles themselves decide.

Texts with equal sets of shingles are one node. Nodes that share a block of their wide fingerprints and differ in no more
bits than alike ones may are tied, and nodes that hang together by ties are candidates of each other: they share a key. In
a round a key names one of its nodes as the leader, a different one each time, and the others are compared with it: that
costs rows in proportion to the nodes, however many share a key, and settles the keys whose nodes hang together by then.
Keys that the rounds leave unsettled are left to a comparison two by two, of nodes that aren't linked already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, dropped, null_safe_key, row_hash, whole, written
from .components import components, map_runs
from .simhash import shape, wide_fingerprint, wide_links

WORDS, SIMILARITY = 5, 0.8
#: Rounds with leaders: each names other leaders, which costs a pass over what is unsettled; and bytes of text above which a key's nodes are split into parts, each two of which meet.
ROUNDS, TEXTS = 1, 16 << 20
#: Edges of one task where components are looked for.
EDGES = 50_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of a UTF-8 text's different word shingles; a text of fewer words is one shingle, a wordless one none."""
    parts = text.lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.append(0, ends[:-1] + 1)
    pairs = zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(line[s:e], 42) for s, e in pairs), np.uint64, len(parts) - words + 1))


def band_keys(hashes: np.ndarray, n: int = 1, similarity: float = SIMILARITY) -> np.ndarray:
    """The keys by which texts meet among ``n``: one for each block of the SimHash; none for no shingles."""
    bits, words = shape(n, similarity)
    if not len(hashes):
        return np.zeros(0, np.int64)
    at = np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)
    blocks = (wide_fingerprint(hashes, words)[:, None] >> at) & np.uint64((1 << bits) - 1)
    return blocks.ravel().view(np.int64) + (np.arange(blocks.size) << bits)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``similarity`` at least."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def _kept(df: DataFrame, kept: list[str]) -> DataFrame:
    df, path = written(df)
    kept.append(path)
    return df


def _alike(pairs: DataFrame, texts: DataFrame, similarity: float, words: int, kept: list[str]) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts are alike. A leader's rows come together, so its shingles are made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, theirs = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            at = []
            for k, (x, t, u) in enumerate(zip(a, batch.column("ta"), batch.column("tb"), strict=True)):
                if x != leader:
                    leader, theirs = x, shingles((t.as_py() or "").encode(), words)
                if alike(theirs, shingles((u.as_py() or "").encode(), words), similarity):
                    at.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in at], pa.int64()), pa.array([b[k] for k in at], pa.int64())], names=["a", "b"])

    # written, so that Spark knows how large they are and broadcasts small ones in place of dealing all texts anew
    pairs = _kept(pairs, kept)
    leaders = _kept(pairs.select("a").distinct(), kept)
    theirs = texts.join(leaders, F.col("node") == F.col("a"), "left_semi").select(F.col("node").alias("a"), F.col("text").alias("ta"))
    own = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return own.join(theirs, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _two_by_two(keyed: DataFrame, texts: DataFrame, similarity: float, words: int, part: int, kept: list[str]) -> DataFrame:
    """Edges (a, b) between nodes of unsettled keys (node, label, leader) whose texts are alike, as many as tie together what all such pairs would.

    Keys that share nodes are one group. Its nodes outside its largest label meet all its nodes, both in blocks of about
    ``part`` bytes: few stragglers cost a large group one pass.
    """
    ties = _kept(keyed.select("node", "label", "leader").distinct(), kept)
    groups = components(ties.select(F.col("node").alias("a"), F.col("leader").alias("b")), EDGES)
    rows = _kept(ties.select("node", "label").distinct().join(groups.select("node", F.col("label").alias("group")), "node").join(texts.select("node", (F.octet_length("text") + 64).alias("bytes")), "node"), kept)
    per = rows.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    blocks = lambda b: F.greatest(F.lit(1), F.ceil(b / part)).cast("int")
    sides = per.groupBy("group").agg(F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("bytes").alias("all"))
    sides = _kept(sides.select("group", F.col("most.label").alias("largest"), blocks(F.col("all") - F.col("most.bytes")).alias("i_n"), blocks(F.col("all")).alias("j_n")), kept)
    held = rows.join(sides, "group").withColumn("h", F.xxhash64(F.lit(9), "node"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    few = held.filter("label <> largest").select("group", F.pmod("h", F.col("i_n")).cast("int").alias("_i"), every("j_n").alias("_j"), F.lit(0).alias("side"), "node", "label")
    all_ = held.select("group", every("i_n").alias("_i"), F.pmod("h", F.col("j_n")).cast("int").alias("_j"), F.lit(1).alias("side"), "node", "label")

    def use(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        node, label, side, text, a, b = table.column("node").to_pylist(), table.column("label").to_pylist(), table.column("side").to_numpy(), table.column("text"), [], []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            root: dict[int, int] = {}
            sets: dict[int, np.ndarray] = {}

            def top(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            def of(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles((text[k].as_py() or "").encode(), words)
                return sets[k]

            split = start + int((side[start:end] == 0).sum())
            for k in range(start, split):
                for m in range(split, end):
                    x, y = top(label[k]), top(label[m])
                    if x != y and alike(of(k), of(m), similarity):
                        root[x] = y
                        a.append(node[k])
                        b.append(node[m])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

    return map_runs(few.union(all_).join(texts, "node"), ["group", "_i", "_j"], ["side", "node"], use, "a long, b long")


def linked(keyed: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, rounds: int = ROUNDS, part: int = TEXTS) -> DataFrame:
    """(node, label) for nodes that links of nodes of one key (``keyed``: node, _key) tie to others; ``texts`` has each node's text."""
    found = keyed.sparkSession.createDataFrame([], "a long, b long")
    groups = keyed.sparkSession.createDataFrame([], "node long, label long")
    now = keyed.withColumn("label", F.col("node"))
    for r in range(rounds + 1):
        # a key whose nodes hang together has nothing left to say, nor has one of two nodes that were compared
        open_ = now.groupBy("_key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(r), "node"), F.col("node"), F.col("label"))).alias("first"))
        open_ = cut(open_.filter((F.col("l") < F.col("m")) & ((F.col("n") > 2) | F.lit(r == 0))).select("_key", F.col("first.node").alias("leader"), F.col("first.label").alias("of")))
        if open_.isEmpty():
            break
        now = now.join(open_, "_key").select("_key", "node", "label", "leader", "of")
        kept: list[str] = []
        if r < rounds:
            pairs = now.filter(F.col("label") != F.col("of")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
            more = _alike(pairs, texts, similarity, words, kept)
        else:
            more = _two_by_two(now, texts, similarity, words, part, kept)
        found = cut(found.union(more))
        for path in kept:
            dropped(keyed.sparkSession, path)
        groups = cut(components(found, EDGES))
        now = now.select("_key", "node").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return groups


def without_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS, rounds: int = ROUNDS, part: int = TEXTS
) -> DataFrame:
    """``docs`` with one row of each group of texts that are linked by a similarity of ``similarity`` or more.

    The row that stays has the smallest id of its group, null being the largest, and of rows that share that id the
    smallest hash of all values. Null, empty and wordless texts are equal. Columns may have any names. An empty table
    gives an empty table. Pairs at the similarity miss each other once in 10,000 times (``simhash.MISSED``), those of four
    and five shingles once in 800, since ties part their bits more often; closer ones are surer.
    """
    bits, size = shape(docs.count(), similarity)
    held = docs.select(whole(docs).alias("row"), null_safe_key(F.col(id_col)).alias("_id"), row_hash(docs).alias("_h"))
    text = F.col("row").getField(text_col).alias("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, prints = [], [], []
            for t in batch.column(2):
                hashes = shingles((t.as_py() or "").encode(), words)
                nodes.append(xxhash.xxh64_intdigest(hashes.tobytes(), 7))
                sizes.append(len(hashes))
                prints.append(wide_fingerprint(hashes, size).view(np.int64))
            named = pa.array(np.array(nodes, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), named, pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int64()))], names=["id", "_h", "node", "n", "_fp"])

    given = held.select(F.col("row").getField(id_col).alias("id"), "_h", text)
    prints = given.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, _h long, node long, n int, _fp array<long>")
    first = F.min(F.struct(F.col("id").isNull().alias("_null"), F.col("id"), F.col("_h")))
    nodes = cut(prints.groupBy("node").agg(first.alias("first"), F.first("n").alias("n"), F.first("_fp").alias("_fp")))
    tied = components(wide_links(nodes, bits, size, similarity), EDGES)
    keyed = cut(tied.select("node", F.col("label").alias("_key")))
    given = nodes.join(keyed.select("node"), "node", "left_semi").select("node", null_safe_key(F.col("first.id")).alias("_id"), F.col("first._h").alias("_h"))
    texts, path = written(held.select("_id", "_h", text).join(given, ["_id", "_h"]).select("node", "text").dropDuplicates(["node"]))
    found = linked(keyed, texts, similarity, words, rounds, part)
    dropped(docs.sparkSession, path)
    named = nodes.select("node", "first").join(found, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    kept = named.select(null_safe_key(F.col("first.id")).alias("_id"), F.col("first._h").alias("_h"))
    stay = held.join(kept, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"])
    return stay.select(*[stay["row"].getField(c).alias(c) for c in docs.columns])
