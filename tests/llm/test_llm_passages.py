"""Passage dedup over many buckets, with frequent anchors, frequent windows in parts, buckets settled again and again, ids null or repeated, and long texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, n, split):
    """Tokens and which of them go, for each row; null ids are below all others."""
    key = lambda r: -(1 << 63) if r[0] is None else r[0]
    first = {}
    for r in rows:
        tokens = split(r[1])
        for k in range(len(tokens) - n + 1):
            w = tuple(tokens[k : k + n])
            first[w] = min(first.get(w, key(r)), key(r))
    out = []
    for r in rows:
        tokens = split(r[1])
        gone = bytearray(len(tokens))
        for k in range(len(tokens) - n + 1):
            if first[tuple(tokens[k : k + n])] < key(r):
                gone[k : k + n] = b"\1" * n
        out.append((r, tokens, gone))
    return out


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BUCKET": 3000, "ANCHORS": 9000, "BATCH": 15000, "HELD": 4000, "PLACES": 700, "OFTEN": 2, "RANGES": 10}.items():
        monkeypatch.setattr(windows, name, value)
    made = []
    plan_for = windows.plan_for
    monkeypatch.setattr(windows, "plan_for", lambda *a: made.append(plan_for(*a)) or made[-1])
    return made


@pytest.fixture(scope="module")
def many(rows):
    """The corpus, a passage and its variants in most of 250 more texts, rows without ids or of one id, and equal rows."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 8)))
    passage = " ".join(word() for _ in range(60))
    line = lambda n: " ".join(word() for _ in range(n))
    out = [r[:2] for r in rows]
    for i in range(250):
        a, b = sorted((r.randint(0, len(passage) - 1), r.randint(0, len(passage) - 1)))
        middle = passage if i % 3 else passage[a:b]
        out.append((10_000 + 7 * (i % 240) - 4000 * (i % 2), f"{line(8)} {middle} {line(8)}" if i % 5 else line(30)))
    out += [(None, t) for _, t in out[-30:]] + [(None, out[-1][1])] * 3 + [(77, line(20)), (77, passage), (77, passage), (12_345, line(2000))]
    r.shuffle(out)
    return out


def test_suffixes_in_many_ranges(spark, small, many):
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(6)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in windows.suffix_dedup(df).collect())
    want = Counter((r[0], len(t), sum(g), len(re.findall(b"\1+", bytes(g))), bytes(c for c, x in zip(t, g, strict=True) if not x)) for r, t, g in brute(many, 50, lambda t: (t or "").encode()))
    assert got == want and sum(n[2] for n in want) > 50_000
    plan = small[0]
    assert len(plan.splitters) == 9 and plan.buckets > 20 and plan.buckets % 10 == 0 and plan.wide > 5 and len(plan.frequent) > 5 and len(plan.hot) > 100


def test_super_kmers_in_many_buckets(spark, small, many):
    df = spark.createDataFrame(many, "doc_id long, text string").repartition(6)
    got = Counter(map(tuple, windows.substring_dedup(df).select("doc_id", "n_words", "n_removed", "kept").collect()))
    want = Counter((r[0], len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for r, w, g in brute(many, 13, lambda t: WORDS.findall(t or "")))
    assert got == want and sum(n[2] for n in want) > 5_000
    assert small[0].buckets > 20 and len(small[0].frequent) > 5 and len(small[0].hot) > 20


def test_texts_beyond_a_batch(spark):
    r = np.random.default_rng(1)
    long = bytes(r.integers(97, 123, 2_600_000).astype("u1"))
    long = b" ".join(long[i : i + 9] for i in range(0, len(long), 9)).decode()
    part = long[(2 << 20) - 3000 : (2 << 20) + 3000]
    df = spark.createDataFrame([(1, long), (2, "other words " + part), (3, part + "!"), (4, long[-100:])], "doc_id long, text string")
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in windows.suffix_dedup(df).collect()}
    assert got == {1: (len(long), 0, 0), 2: (6012, 6000, 1), 3: (6001, 6000, 1), 4: (100, 100, 1)}
    words = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in windows.substring_dedup(df).collect()}
    n = len(part.split())  # both ends are cut words; the third text ends in another, but begins like the second's passage
    assert words[1] == (len(long.split()), 0) and words[2] == (n + 2, n - 2) and words[3] == (n, n - 1)


def test_the_plan_has_a_bound(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 997}" for k in range(40))) for i in range(3000)], "_id long, _text string").selectExpr("*", "cast(octet_length(_text) as long) AS _bytes")
    plan = windows.plan_for(df, 3000, 100 << 40, False, 50, 16, True)
    assert len(plan.splitters) == windows.RANGES - 1 and plan.buckets >= 100 << 20 and plan.buckets % windows.RANGES == 0


@pytest.mark.parametrize("seed", range(4))
def test_multikey_quicksort_sorts(seed):
    rng = np.random.default_rng(seed)
    strings = [bytes(rng.integers(0, 2 + seed, rng.integers(0, 60)).astype("u1")) for _ in range(700)] + [b"\0" * k for k in range(20)] + [b"same"] * 30
    buf, e = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(s) for s in strings])
    group = windows.multikey_groups(buf, e - [len(s) for s in strings], e)
    assert [strings[i] for i in np.argsort(group, kind="stable")] == sorted(strings)
    assert len(set(group.tolist())) == len(set(strings))
    none = np.zeros(0, np.int64)
    assert len(windows.multikey_groups(buf, none, none)) == 0


def test_large_inputs_have_fewer_and_larger_blobs(spark):
    """Batches times buckets, which the number of blobs follows, at four times the bytes of 1.5 GB: under the square, which is 16."""
    from millrace.llm import windows

    docs = spark.createDataFrame([(k, "some words " * 40) for k in range(20)], "_id long, _text string").selectExpr("_id", "_text", "octet_length(_text) AS _bytes")
    blobs = []
    for size in (3 << 29, 3 << 31):
        plan = windows.plan_for(docs, 20, size, False, 50, 16, True)
        blobs.append(-(-size // plan.batch) * plan.buckets)
    assert blobs[1] < 9 * blobs[0]


def test_anchors_are_the_same_across_stretches(monkeypatch):
    import random

    from millrace.llm import windows

    r = random.Random(5)
    docs = [(k, 0, 0, bytes(r.choice(b"abc ") for _ in range(r.randint(0, 900)))) for k in range(30)]
    cutter, found = windows.Cutter(windows.Plan(False, 50, 16)), []
    for stretch in (1 << 15, 61):
        monkeypatch.setattr(windows, "STRETCH", stretch, raising=True)
        found.append([x.tolist() for x in cutter.anchors(docs)[4]])
    assert found[0] == found[1]
