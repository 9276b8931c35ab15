"""Wide SimHash fingerprints, by which the pipeline's near copies meet."""

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import shingles, simhash
from millrace.llm.components import components


def test_wide_fingerprint_is_the_majority_of_its_hashes():
    hashes = np.random.default_rng(1).integers(0, 1 << 64, 700, dtype=np.uint64)
    for n in (1, 2, 254, 255, 256, 700):
        first = sum(1 << bit for bit in range(64) if 2 * sum(int(h) >> bit & 1 for h in hashes[:n]) > n)
        got = simhash.wide_fingerprint(hashes[:n], 4)
        assert len(set(got.tolist())) == 4 and int(got[0]) == first
    assert not simhash.wide_fingerprint(hashes[:0], 4).any()


def test_blocks_and_reach_find_sets_at_the_similarity():
    r, at, missed = np.random.default_rng(2), np.arange(8, dtype=np.uint64) * np.uint64(8), 0
    assert simhash.shape(1, 0.8) == (8, 4) and simhash.shape(10**7, 0.8)[0] > 8
    for n in (4, 16, 80):
        for _ in range(1000):  # the least similar pairs of n common hashes: 4 of 5, and 0.8 of all
            common, more = r.integers(0, 1 << 64, n, dtype=np.uint64), r.integers(0, 1 << 64, n // 4, dtype=np.uint64)
            a = simhash.wide_fingerprint(np.append(common, more[: max(1, n // 8)]), 4)
            b = simhash.wide_fingerprint(np.append(common, more[max(1, n // 8) :]), 4)
            far = np.bitwise_count(a ^ b)
            missed += not (((a[:, None] ^ b[:, None]) >> at) & np.uint64(255) == 0).any() or far.sum() > simhash.reach(4, 0.8, n < 5)
    assert missed <= 5


@pytest.mark.parametrize("part", [simhash.WIDE_PART, 400])
def test_wide_links_tie_large_groups_pairs_and_nothing_else(spark, part):
    r = np.random.default_rng(3)
    new = lambda n: r.integers(0, 1 << 64, n, dtype=np.uint64)
    base = new(90)
    sets = [np.append(base, new(1 + k % 10)) for k in range(1500)]  # one group, of 0.8 and more with each other
    for _ in range(150):
        common = new(40)
        sets += [np.append(common, new(5)), np.append(common, new(5)), np.append(common[:10], new(40))]  # a pair at 0.8, and one that is none
    rows = [(k, len(s), simhash.wide_fingerprint(s, 4).view(np.int64).tolist()) for k, s in enumerate(sets)]
    nodes = spark.createDataFrame(rows, "node long, n int, _fp array<long>").repartition(4)
    label = {x["node"]: x["label"] for x in components(simhash.wide_links(nodes, 8, 4, 0.8, part)).collect()}
    assert {label.get(k) for k in range(1500)} == {0}
    pairs = range(1500, len(sets), 3)
    assert sum(label.get(k) == label.get(k + 1) == k for k in pairs) >= 149 and not any(k + 2 in label for k in pairs)


def test_near_copies_are_proposed_by_simhash(spark, monkeypatch):
    """Without ties of the fingerprints no pair is compared: there is no path beside them."""
    text = " ".join(f"w{k}" for k in range(100))
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, text + " more", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [1]
    asked = []

    def none(nodes, *shape):
        asked.append(shape)
        return nodes.sparkSession.createDataFrame([], "a long, b long")

    monkeypatch.setattr(shingles, "wide_links", none)
    assert corpus_pipeline.near_copies(spark, docs, "").count() == 2 and asked == [(8, 4, 0.8)]
