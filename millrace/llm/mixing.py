"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length in words. Each source's target is a water level over the weights; what its
whole repeats leave of it is filled from the counts of its lengths: a proportional part of every length first, then
a bounded knapsack over what is left. Which documents of a length are taken is a matter of a seeded hash. The
knapsack sees counts of distinct lengths only (at most the square root of twice a source's words, since they are
distinct numbers with that sum), never documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, null_safe_key

#: Sums that the knapsack's table holds; the proportional part and the greedy step leave no more, as far as lengths allow. Where the goal is missed, the next larger one is tried.
WINDOWS = (1 << 16, 1 << 20, 1 << 23)
#: Documents of one source and length are ranked in so many parts.
SALTS = 256


def fit(lengths: np.ndarray, counts: np.ndarray, goal: int, windows: Sequence[int] = WINDOWS) -> np.ndarray:
    """How many documents of each length to take so that their sum comes as near below ``goal`` as can be found.

    First a proportional part of every length is taken for good; only if the rest can't make up the goal, half of that,
    then none; and all three again with a larger table. The sum found is the nearest there is if it is the goal (or the
    last multiple of all lengths' common divisor before it), or if the goal fits in the largest table.
    """
    order = np.argsort(-lengths, kind="stable")
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * have).sum())
    if goal >= total:
        return counts.astype(np.int64)
    best, nearest = have * 0, goal - goal % int(np.gcd.reduce(size))
    for window, part in ((w, p) for w in windows for p in (1 - 1e-12, 0.5, 0.0)):
        take = _fill(size, have, goal, np.floor(have * (goal / total) * part).astype(np.int64), window)
        if (size * take).sum() > (size * best).sum():
            best = take
        if (size * best).sum() == nearest or (window >= goal and not part):
            break
    out = np.empty_like(best)
    out[order] = best
    return out


def _fill(size: np.ndarray, have: np.ndarray, goal: int, take: np.ndarray, window: int) -> np.ndarray:
    """Adds to ``take``: the longest that fit while more than the window is left, then the best sum by a bounded knapsack."""
    left = goal - int((size * take).sum())
    for i in range(len(size)):
        if left <= window:
            break
        more = min(int(have[i] - take[i]), left // int(size[i]), -(-(left - window) // int(size[i])))
        take[i] += more
        left -= more * int(size[i])
    room = min(left, window)
    first = np.full(room + 1, -1, np.int64)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for i in range(len(size)):
        length, spare = int(size[i]), min(int(have[i] - take[i]), room // int(size[i]))
        part = 1
        while spare > 0 and not reached[room]:
            part = min(part, spare)
            weight = part * length
            new = np.zeros_like(reached)
            new[weight:] = reached[: room + 1 - weight]
            new &= ~reached
            first[new] = len(items)
            reached |= new
            items.append((i, part))
            spare, part = spare - part, part * 2
        if reached[room]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, part = items[first[at]]
        take[i] += part
        at -= part * int(size[i])
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("_size")
    picks = fit(rows["_size"].to_numpy(), rows["_n"].to_numpy(), int(rows["_goal"].iloc[0]))
    return pd.DataFrame({"_s": rows["_s"], "_size": rows["_size"], "_pick": picks})


def _ranked(df: DataFrame, *order) -> DataFrame:
    """Adds ``_rank`` from 0 in the order given: a range sort, then an offset for each partition."""
    df = cut(df.orderBy(*order))
    at = F.spark_partition_id()
    counts = sorted((r[0], r[1]) for r in df.groupBy(at.alias("p")).count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets += [F.lit(part), F.lit(total)]
        total += n
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn("_rank", within + F.element_at(F.create_map(*offsets), at) if offsets else within)


def water_level(sources: DataFrame, budget: float) -> float:
    """The level at which min(cap, level * weight) sums to the budget: capped sources' excess is reshared till none is above."""
    level, capped_before = 0.0, -1
    while True:
        over = F.col("_cap") < F.lit(level) * F.col("_w")
        row = sources.agg(
            F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0))
        ).first()
        if row[0] == capped_before or not row[2]:
            return level
        level, capped_before = max(0.0, budget - row[1]) / row[2], row[0]


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 42,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, repeats (how often the mix holds it) and taken words.

    Sources in code point order (null, a source of its own, last) take the weights in turn. All targets together are
    ``share`` of all words, and no target is above ``most`` times its source. A null or empty text has size 0 and is
    repeated like a longer one would be by whole rounds, at no words. Ties and repeated rows are separate documents.
    An empty table gives an empty table. Columns other than the three named aren't read.
    """
    sized = cut(
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("_size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_h"))
        .withColumn("_s", null_safe_key(F.col("_source")))
        .withColumn("_salt", F.pmod("_h", F.lit(SALTS)).cast("int"))
    )
    counts = cut(sized.groupBy("_s", "_size", "_salt").agg(F.count("*").alias("_n"), F.first("_source").alias("_source")))
    sources = _ranked(
        counts.groupBy("_s").agg(F.sum(F.col("_size") * F.col("_n")).alias("_words"), F.first("_source").alias("_source")), F.col("_source").isNull(), F.col("_source")
    ).withColumn("_cap", F.col("_words") * most)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    sources = cut(sources.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))))
    total = sources.agg(F.coalesce(F.sum("_words"), F.lit(0))).first()[0]
    target = F.least(F.col("_cap").cast("double"), F.lit(water_level(sources, share * total)) * F.col("_w"))
    rounds = F.when(F.col("_words") > 0, F.floor(F.col("_target") / F.col("_words"))).otherwise(F.lit(0)).cast("long")
    sources = (
        sources.withColumn("_target", target)
        .withColumn("_rounds", F.least(rounds, F.lit(most).cast("long")))
        .withColumn("_goal", F.round(F.col("_target") - F.col("_rounds") * F.col("_words")).cast("long"))
        .select("_s", "_words", "_target", "_rounds", "_goal")
    )
    lengths = counts.filter(F.col("_size") > 0).groupBy("_s", "_size").agg(F.sum("_n").alias("_n")).join(sources.filter("_goal > 0").select("_s", "_goal"), "_s")
    picks = lengths.groupBy("_s").applyInPandas(_fit_source, "_s string, _size long, _pick long").filter("_pick > 0")
    before = Window.partitionBy("_s", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    quotas = (
        counts.join(picks, ["_s", "_size"])
        .withColumn("_quota", F.greatest(F.lit(0), F.least(F.col("_n"), F.col("_pick") - F.coalesce(F.sum("_n").over(before), F.lit(0)))))
        .filter("_quota > 0")
        .select("_s", "_size", "_salt", "_quota")
    )
    rank = F.row_number().over(Window.partitionBy("_s", "_size", "_salt").orderBy("_h", F.col("_id")))
    return (
        sized.join(quotas, ["_s", "_size", "_salt"], "left")
        .withColumn("_extra", (rank <= F.coalesce("_quota", F.lit(0))).cast("long"))
        .join(sources, "_s")
        .select(
            F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"),
            (F.col("_rounds") + F.col("_extra")).alias("repeats"), ((F.col("_rounds") + F.col("_extra")) * F.col("_size")).alias("taken"),
        )
    )
