"""Each stage of the pipeline against a plain Python version of it, on its own input with edge rows (near copies: test_llm_near_copies.py)."""

import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import common, quality

FIVE = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def five(docs):
    return docs.select(*FIVE).cache()


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_keeps_what_scores_03_or_more(spark, tmp_path, rows):
    texts = ["the cat sat on the mat and looked at dog %d while it rained %d" % (i, i * 7) for i in range(120)] + ["$$$ WIN!! %d ### CASH!! %d @@@ FREE!!" % (i, i * 3) for i in range(120)]
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    all_rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(1000 + r[0], *r[1:5]) for r in rows] + [(None, None, None, None, None)]
    given = spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    scores = quality.fit(given, common.table(spark, str(tmp_path), "labels")).scorer()([(r[1] or "").encode() for r in all_rows])
    want = Counter(r for r, s in zip(all_rows, scores, strict=True) if s >= 0.3)
    assert counted(corpus_pipeline.quality(spark, given, str(tmp_path))) == want and 120 <= sum(want.values()) < len(all_rows)


def test_lines_drop_shared_lines_alone(spark, five, rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            holders[key(x)].add(r[0])
    want, dropped = Counter(), 0
    for r in rows:
        lines = (r[1] or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == r[0]]
        dropped += len(lines) - len(stay)
        text = "\n".join(stay)
        want[(r[0], text, r[2], r[3], len(text) if len(stay) < len(lines) else r[4])] += 1
    got = Counter()
    for r, n in counted(corpus_pipeline.lines(spark, five, "")).items():
        got[(r[0], r[1] or "", *r[2:])] += n
    assert got == want and dropped > 5


@pytest.mark.parametrize("nameless", [False, True])
def test_mixture_holds_whole_documents_as_near_the_targets_as_they_come(spark, five, nameless):
    given = five.dropDuplicates()
    if nameless:  # half the rows without an id, others of a shared one; rows alike but for their ids become one
        given = given.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.col("doc_id") % 3)).dropDuplicates()
    rows = [tuple(r) for r in given.collect()]
    size = lambda r: len(WORDS.findall(r[1] or ""))
    per = Counter()
    for r in rows:
        per[r[3]] += size(r)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(per, key=lambda s: (s is None, s or "")))}
    left, open_, target = 1.5 * sum(per.values()), set(per), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * per[s]}
        for s in over or open_:
            target[s] = 2 * per[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    got, taken = counted(corpus_pipeline.mixture(spark, given, "")), Counter()
    assert set(got) <= set(rows) and max(got.values()) <= 2
    for r, n in got.items():
        taken[r[3]] += n * size(r)
    for s in per:
        whole, sums = int(target[s] / per[s]) if per[s] else 0, {0}
        for x in (size(r) for r in rows if r[3] == s):
            sums |= {y + x for y in sums}
        assert all(got[r] >= whole for r in rows if r[3] == s and size(r))
        assert taken[s] == whole * per[s] + max(y for y in sums if y <= round(target[s] - whole * per[s]))


def test_sequences_hold_each_token_once_a_row(spark, five, rows):
    import zlib

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    repeats = Counter(r[0] for r in rows)
    seen, places = defaultdict(Counter), defaultdict(list)
    for p in corpus_pipeline.sequences(spark, five, "").collect():
        ids = np.array(want[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(ids) == p["length"] and zlib.crc32(ids.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(want[p["doc_id"]])
        seen[p["doc_id"]].update(range(p["start"], p["start"] + p["length"]))
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    assert seen == {i: Counter({k: repeats[i] for k in range(len(w))}) for i, w in want.items()}
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
