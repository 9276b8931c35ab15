"""Near copies against brute-force Jaccard, and the rows that stay."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import shingles as S

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FIVE = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    sets = [brute_shingles(t) for t in texts]
    root = list(range(len(sets)))
    pairs = [(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        if low != high:
            root = [low if x == high else x for x in root]
    return root, [(i, j, len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i, j in pairs if sets[i] != sets[j]]


def edited(seed, n=60, copies=5, length=150):
    """Texts, each with copies of up to four changed words, and below the threshold some with more."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        base = [f"w{r.randint(0, 5000)}" for _ in range(length)]
        out.append(" ".join(base))
        for k in range(copies):
            copy = list(base)
            for at in r.sample(range(length), k + 1):
                copy[at] = f"x{r.randint(0, 5000)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("rounds", "part"), [(S.ROUNDS, S.TEXTS), (0, 5000), (1, 3000)])
def test_stage_finds_pairs_at_similarity_08(spark, rounds, part):
    texts = [*edited(1), None, "", " \n", "one two", "One  two", "one two three"]
    root, pairs = brute_groups(texts)
    assert sum(j < 0.9 for _, _, j in pairs) > 100
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], FIVE).repartition(4)
    got = {r["doc_id"] for r in S.without_near_copies(df, rounds=rounds, part=part).collect()}
    assert got == set(root)


def test_bands_recall_on_pairs_just_above_the_threshold():
    texts = edited(2, 200, 4, 120)
    _, pairs = brute_groups(texts)
    keys = [set(S.band_keys(S.shingles(t.encode())).tolist()) for t in texts]
    close = [bool(keys[i] & keys[j]) for i, j, s in pairs if s < 0.85]
    assert len(close) > 100 and sum(close) >= 0.99 * len(close)


def test_stage_against_brute_force_on_edge_rows(spark, docs, rows):
    five = docs.select("doc_id", "text", "lang", "source", "n_chars")
    order = sorted({r[:5] for r in rows}, key=lambda r: r[0])
    root, _ = brute_groups([r[1] for r in order])
    got = sorted((tuple(r) for r in corpus_pipeline.near_copies(spark, five, "").collect()), key=lambda r: r[0])
    assert got == [order[i] for i in sorted(set(root))]


def test_rows_without_an_id_or_with_a_shared_one_are_documents_of_their_own(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    given = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (12, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (None, d, "en", None, 1), (None, d, None, "en", 1), (9, c + " tail", "en", "s", 1), (7, a, "en", "s", 1)]
    want = {(7, a), (7, b), (9, c + " tail"), (None, d)}
    for n in (1, 3, 7):
        got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(given, FIVE).repartition(n), "").collect()]
        assert len(got) == len(want) and set(got) == want


def test_a_hot_key_stays_linear(spark):
    n = 50_000
    keyed = spark.range(n).select(F.col("id").alias("node"), F.lit(1).cast("long").alias("_key"))
    texts = spark.range(n).select(F.col("id").alias("node"), F.concat_ws(" ", F.lit("one two three four five six seven eight nine ten " * 3), F.when(F.col("id") % 1000 == 0, F.col("id").cast("string"))).alias("text"))
    compared = spark.sparkContext.accumulator(0)
    given = S._alike

    def counted(pairs, texts, similarity, words, kept):
        compared.add(pairs.count())
        return given(pairs, texts, similarity, words, kept)

    S._alike = counted
    try:
        found = S.linked(keyed, texts).groupBy("label").count().collect()
    finally:
        S._alike = given
    assert [r["count"] for r in found] == [n] and compared.value < 2 * n


def test_links_that_no_leader_sees(spark):
    """A chain of texts, each like the next one alone: every link counts."""
    words = [f"w{i}" for i in range(400)]
    chain = [" ".join(words[10 * k : 10 * k + 150]) for k in range(20)]
    rows = [(k, t) for k, t in enumerate(chain)]
    keyed = spark.createDataFrame([(k, 1) for k, _ in rows], "node long, _key long")
    texts = spark.createDataFrame(rows, "node long, text string")
    for part in (S.TEXTS, 3000):
        found = S.linked(keyed, texts, part=part).collect()
        assert {r["node"] for r in found} == set(range(20)) and len({r["label"] for r in found}) == 1
