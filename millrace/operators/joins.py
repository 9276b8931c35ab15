"""Joins that aren't plain equalities: nearest neighbours, suffix and contains matches, Hamming distance in bands."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hamming_bands(code: Column, distance: int = 2, blocks: int | None = None) -> Column:
    """Keys of which two 64-bit codes within the distance share one at least: bits of ``blocks`` blocks, without each ``distance`` of them.

    The more blocks, the longer a key: of distance 2, three blocks give 3 keys of 21 bits, four 6 of 32, six 15 of 42.
    """
    blocks = blocks or distance + 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(m for i, m in enumerate(parts) if i not in gone) for gone in combinations(range(blocks), distance)]
    return F.array(*[F.struct(F.lit(n).alias("band"), code.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("bits")) for n, m in enumerate(masks)])


def hamming_blocks(n: int, distance: int = 2) -> int:
    """How many blocks keep keys, if codes were even, to about as many rows as there are keys."""
    return next((b for b in range(distance + 1, distance + 5) if n <= 1 << (64 * (b - distance) // b - 4)), distance + 5)


def hamming_pairs(df: DataFrame, key: str, code: str, distance: int = 2, same: Sequence[str] = (), other: str | None = None, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): pairs of keys a < b within the distance, equal in the columns of ``same``, not equal in ``other``; each pair once.

    An equality join on bands, whose bits follow the number of rows, so that its cost follows the pairs there are and not
    the square of the rows. Give it each code once where copies share their fate: distinct_codes().
    """
    blocks = blocks or hamming_blocks(df.count(), distance)
    kept = [*same, *([other] if other else [])]
    rows = df.select(F.col(key).alias("k"), F.col(code).alias("c"), *kept, F.explode(hamming_bands(F.col(code), distance, blocks)).alias("b"))
    left = rows.select(F.col("k").alias("a"), F.col("c").alias("ca"), *same, *([F.col(other).alias("oa")] if other else []), "b.band", "b.bits")
    right = rows.select(F.col("k").alias("b"), F.col("c").alias("cb"), *same, *([F.col(other).alias("ob")] if other else []), "b.band", "b.bits")
    apart = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))
    met = left.join(right, [*same, "band", "bits"]).filter((F.col("a") < F.col("b")) & (apart <= distance))
    return (met.filter("oa <> ob") if other else met).select("a", "b", apart.cast("int").alias("distance")).distinct()


def distinct_codes(df: DataFrame, key: str, code: str, *same: str) -> DataFrame:
    """One row for each code (and ``same``), with its smallest key: copies have the same neighbours, and go if they aren't the first."""
    return df.groupBy(*same, code).agg(F.min(key).alias(key))


def greedy_keep(items: DataFrame, pairs: DataFrame, key: str = "k") -> DataFrame:
    """Keys that stay when they are visited in order and one stays if no near key stayed before: rounds, to a fixed point.

    In each round an undecided key without undecided or kept smaller neighbours stays, and a key with a kept smaller
    neighbour goes. Each round is cut off at a checkpoint.
    """
    from ..session import cut

    edges = cut(pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    state = cut(items.select(F.col(key).alias("k"), F.lit(0).alias("s")))  # 0 undecided, 1 kept, 2 gone
    while True:
        below = edges.join(state, edges["lo"] == state["k"]).groupBy(F.col("hi").alias("k")).agg(F.bool_or(F.col("s") == 1).alias("kept"), F.bool_or(F.col("s") == 0).alias("open"))
        decided = F.when(F.col("s") != 0, F.col("s")).when(F.coalesce("kept", F.lit(False)), 2).when(F.coalesce("open", F.lit(False)), 0).otherwise(1)
        state = cut(state.join(below, "k", "left").select("k", decided.alias("s")))
        if state.filter("s = 0").isEmpty():
            return state.filter("s = 1").select(F.col("k").alias(key))


def knn_mean_distance(items: DataFrame, reference: DataFrame, key: str, vector: str, k: int = 3, block: int | None = None) -> DataFrame:
    """(key, mean_distance): the mean Euclidean distance of each item to its k nearest rows of the reference, itself left out."""
    from .neighbours import nearest_distances

    found = nearest_distances(items, reference, key, vector, k, block=block)
    return found.select(key, (F.aggregate("d", F.lit(0.0), lambda s, x: s + x) / F.size("d")).alias("mean_distance"))


def suffix_match(left: DataFrame, right: DataFrame, name: str, target: str, order: str) -> DataFrame:
    """Each left row, repeated ones too, with the first right row (by ``order``) whose target equals its name or else is a suffix of it.

    Suffixes are found by equality too: every suffix of a name that is as long as some target is looked up, once for all
    rows that share a name, and once for all that share a target. A null name meets nothing.
    """
    right = right.groupBy(target).agg(F.min(order).alias(order))
    lengths = [r[0] for r in right.select(F.char_length(target)).distinct().collect()]
    names = left.select(F.col(name).alias("_name")).filter("_name IS NOT NULL").distinct()
    ends = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length("_name")), lambda n: F.right(F.col("_name"), n))
    tried = names.withColumn("_end", F.explode(F.array_distinct(ends)))
    met = tried.join(right.select(F.col(target).alias("_end"), F.col(order).alias("_order")), "_end")
    best = met.groupBy("_name").agg(F.min(F.struct((F.col("_end") != F.col("_name")).alias("a"), F.col("_order").alias("o")))["o"].alias("_order"))
    return left.join(best, left[name] == best["_name"], "left").select(*[left[c] for c in left.columns], best["_order"].alias(order))


def contains_match(texts: DataFrame, tokens: DataFrame, text: str, token: str) -> DataFrame:
    """All rows of ``texts`` and ``tokens`` (whose columns have different names) of which the text contains the token.

    An inverted index of the texts' trigrams: a token is looked up by the one of its trigrams that the fewest texts hold,
    and what is found is verified. Tokens of one or two characters are trigrams' shorter kin, and an empty token is in
    every text, as SQL has it. Null texts and tokens match nothing.
    """
    lengths = sorted(r[0] for r in tokens.filter(F.col(token).isNotNull()).select(F.least(F.char_length(token), F.lit(3))).distinct().collect())

    def grams(column: Column, n: Column | int) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return F.when(F.char_length(column) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(column) - n + 1), lambda i: F.substr(column, i, n)))).otherwise(F.array().cast("array<string>"))

    own = texts.filter(F.col(text).isNotNull()).select(F.struct(*texts.columns).alias("_t"), F.col(text).alias("_text"))
    index = own.withColumn("_gram", F.explode(F.flatten(F.array(*[grams(F.col("_text"), n) for n in lengths])) if lengths else F.array().cast("array<string>")))
    looked = tokens.filter(F.col(token).isNotNull()).select(F.struct(*tokens.columns).alias("_k"), F.col(token).alias("_token"))
    held = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    tried = looked.select("_token").distinct().withColumn("_gram", F.explode(grams(F.col("_token"), F.least(F.char_length("_token"), F.lit(3)))))
    rarest = tried.join(held, "_gram", "left").groupBy("_token").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g")))["g"].alias("_gram"))
    met = index.join(looked.join(rarest, "_token"), "_gram").filter(F.contains("_text", "_token"))
    return met.select(*[F.col("_t").getField(c).alias(c) for c in texts.columns], *[F.col("_k").getField(c).alias(c) for c in tokens.columns])
