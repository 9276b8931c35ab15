"""Beyond every bound that an operator once had, and with names that once clashed."""

import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import components as C
from millrace.llm import mixing, neardup_vectors, packing, quality, simhash, urls
from millrace.llm.line_dedup import line_dedup

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLASHES = ["_id", "_h", "_repeats", "_round", "_drop", "_drop_id", "_drop_t", "n_lines", "n_dropped", "row", "id", "t", "of", "repeats", "score", "a.b", "a`b", "_QUALITY", "_LINES", "_DROPPED", "ROW", "others", "key", "c0"]


@pytest.mark.parametrize("name", ["quality", "lines", "near_copies", "mixture"])
def test_stages_keep_columns_of_any_name(spark, docs, name):
    five = ["doc_id", "text", "lang", "source", "n_chars"]
    given = docs.select(*five, *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES]).union(
        spark.createDataFrame([(None, "no id at all", "en", "s1", 12, *["x"] * len(CLASHES))], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"x{i} string" for i in range(len(CLASHES))))
    )
    given = given.withColumns({"map": F.create_map(F.lit("b"), F.col("doc_id"), F.lit("a"), F.lit(None)), "maps": F.array(F.struct(F.create_map(F.lit("x"), F.col("doc_id")).alias("m")))})
    stage = dict(corpus_pipeline.STAGES)[name]
    out, plain = stage(spark, given, "/root/testdata/sf0.001"), stage(spark, given.select(*five), "/root/testdata/sf0.001")
    assert out.columns == given.columns
    got = out.collect()
    assert all(r[c] == (f"{c}{r['doc_id']}" if r["doc_id"] is not None else "x") for r in got for c in CLASHES)
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in plain.collect()) and (name == "mixture" or None in {r["doc_id"] for r in got})
    assert sorted((x.name, x.dataType.simpleString()) for x in out.schema) == sorted((x.name, x.dataType.simpleString()) for x in given.schema)


def test_line_dedup_can_leave_its_counts_out(docs):
    assert line_dedup(docs, counts=None).columns == [c for c in docs.columns if c != "text"] + ["text"]


def test_tiny_documents_fill_sequences(spark):
    df = spark.createDataFrame([(i, "one two") for i in range(6000)], "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df, TOKENIZER, with_ids=False).collect()
    sizes, tokens = Counter(), sum(p["length"] for p in pieces)
    for p in pieces:
        sizes[p["sequence_id"]] += p["length"]
    assert all(n & (n - 1) == 0 for n in sizes.values()) and sum(n == 4096 for n in sizes.values()) == tokens // 4096


def test_prompts_bear_no_loss(spark):
    texts = [f"what is number {i}\n" + "so much " * (i % 50 + 1) for i in range(300)] + ["no prompt here " * 20, "", "\n", "p\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    pieces = packing.pack(df, TOKENIZER, prompt_end="\n", tokens=256, loss=100).collect()
    of = packing.WordIds(TOKENIZER)
    quiet = {i: len(of([t.split("\n")[0]])[0]) // 4 if "\n" in t else 0 for i, t in enumerate(texts)}
    loss, tokens, seen = Counter(), Counter(), Counter()
    for p in pieces:
        loss[p["sequence_id"]] += max(0, p["start"] + p["length"] - max(p["start"], quiet[p["doc_id"]]))
        tokens[p["sequence_id"]] += p["length"]
        seen[p["doc_id"]] += p["length"]
    assert max(loss.values()) == 100 and max(tokens.values()) <= 256
    assert seen == Counter({i: len(of([t])[0]) // 4 + 1 for i, t in enumerate(texts)})


def test_labels_that_contradict_or_repeat(spark):
    texts = ["the cat sat on the mat and looked at dog %d while it rained %d" % (i, i * 7) for i in range(120)] + ["$$$ WIN!! %d ### CASH!! %d @@@ FREE!!" % (i, i * 3) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(240)], "doc_id long, quality int")
    plain = quality.fit(df, labels)
    noise = spark.createDataFrame([(1000 + i, y) for i in range(50) for y in (0, 1)] + [(None, 1), (1, 1), (1, 1), (5000, None)], labels.schema)
    more = spark.createDataFrame([(1000 + i, "the contradicted one") for i in range(50)] + [(None, "no id")] + [(1, texts[1])] * 5, df.schema)
    assert quality.fit(df.union(more), labels.union(noise)) == plain
    assert quality.fit(df.unionByName(df).repartition(7), labels) == plain
    assert quality.fit(df, labels.filter("doc_id <> 1 AND doc_id <> 2")) != plain


def test_longer_texts_give_their_places_to_others(spark):
    texts = ["good word %d " % i * 3 for i in range(200)] + ["BAD!! %d " % i * 3 for i in range(200)]
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(400)] + [(1000 + i, 1) for i in range(300)], "doc_id long, quality int")
    df = spark.createDataFrame([*enumerate(texts), *((1000 + i, "long " * 100) for i in range(300))], "doc_id long, text string")
    short = labels.filter("doc_id < 1000")
    a, b = quality.fit(df, labels, sample=100, longest=100), quality.fit(df, short, sample=100, longest=100)
    assert (a.good, a.bad) == (b.good, b.bad)  # the same 100 rows of each class; shares of the classes differ
    assert quality.score(df, a).filter("doc_id >= 1000").count() == 300


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_at_many_planes(spark, monkeypatch, seed):
    """Recall over pairs planted about the threshold, at 12 planes and 17 tables or so."""
    monkeypatch.setattr(neardup_vectors, "BUCKET", 1)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1500, 32))
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) / (base * base).sum(1, keepdims=True) * base
    noise *= np.linalg.norm(base, axis=1, keepdims=True) / np.linalg.norm(noise, axis=1, keepdims=True)
    angle = np.arccos(rng.uniform(0.975, 0.99, 1500))[:, None]
    vectors = np.concatenate([base, base * np.cos(angle) + noise * np.sin(angle)])
    planes, tables = neardup_vectors.planes_and_tables(len(vectors), 0.98, 0.9999)
    assert planes >= 11 and tables > 10
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in neardup_vectors.vector_groups(df).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98).sum(1) - 1
    assert 1000 < near.sum() and sum(got.values()) >= 0.999 * near.sum() and all(got[i] <= n for i, n in enumerate(near.tolist()))


def test_planes_have_no_bound():
    assert neardup_vectors.planes_and_tables(64 << 33, 0.98, 0.9999)[0] == 33


def test_more_fingerprints_take_more_blocks():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**11, 10**12, 10**20)] == [6, 6, 7, 8, 9, 10]


@pytest.mark.parametrize("blocks", [6, 7, 8, 9])
def test_close_pairs_are_linked_at_any_number_of_blocks(spark, blocks):
    rng = np.random.default_rng(7)
    codes = sorted({(int(b) ^ sum(1 << int(k) for k in rng.choice(64, 4, replace=False))) & ((1 << 64) - 1) for b in rng.integers(0, 1 << 63, 12) for _ in range(6)})
    df = spark.createDataFrame([(simhash._signed(c), 10 * i) for i, c in enumerate(codes)], "fp long, name long")
    got = {r["node"]: r["label"] for r in C.components(simhash.links(df, blocks=blocks, name="name")).collect()}
    root = list(range(len(codes)))
    for _ in codes:
        for i, j in itertools.combinations(range(len(codes)), 2):
            if (codes[i] ^ codes[j]).bit_count() <= 4:
                root[i] = root[j] = min(root[i], root[j])
    assert {10 * i: got.get(10 * i, 10 * i) for i in range(len(codes))} == {10 * i: 10 * r for i, r in enumerate(root)}


def test_fingerprints_without_ids_and_hot_ones(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "only null ids hold this text here")
    rows = [(i, a) for i in range(5, 25)] + [(None, a), (7, b), (None, b), (None, c), (None, c), (40, "x"), (-3, "")]
    got = Counter(map(tuple, simhash.simhash_groups(spark.createDataFrame(rows, "doc_id int, text string")).select("doc_id", "component_id").collect()))
    assert got == Counter([(i, 5) for i in range(5, 25)] + [(None, 5), (7, 7), (None, 7), (None, None), (None, None), (40, 40), (-3, -3)])


@pytest.mark.parametrize("goal", [299_999, 700_001, 1_500_003])
def test_knapsack_beyond_its_first_table(goal):
    """Few long documents: the first table ends before the nearest sum."""
    lengths = np.array([70_003, 90_001, 130_007, 210_011])
    counts = np.array([3, 4, 2, 5])
    take = mixing.fit(lengths, counts, goal)
    sums = {0}
    for w, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        sums = {s + k * w for s in sums for k in range(n + 1)}
    assert (take >= 0).all() and (take <= counts).all() and int((take * lengths).sum()) == max(s for s in sums if s <= goal)


# URL templates by brute force


def shape(s):
    if re.fullmatch(r"[0-9]+", s):
        return "{number}"
    if m := re.fullmatch(r"[0-9]+\.([A-Za-z]{1,5})", s):
        return "{number}." + m[1].lower()
    if re.fullmatch(r"[0-9A-Fa-f-]{16,}", s):
        return "{hash}"
    return "{mixed}" if re.search("[0-9]", s) and len(s) >= 24 else "=" + s


def brute_verdicts(given, rules, children=32, support=8, prior=0.25, strength=4.0, threshold=0.5, z=1.96):
    """Verdict and template of each page: the tree by recursion over lists of pages."""
    pages = {}
    for i, url in given.items():
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        pages[i] = host, [shape(s) for s in path.split("/") if s], max(fit, key=lambda r: len(r.name), default=None)
    template = {}

    def grow(ids, level, prefix):
        below = defaultdict(list)
        for i in ids:
            if len(pages[i][1]) == level:
                template[i] = prefix
            else:
                below[pages[i][1][level]].append(i)
        merged = defaultdict(list)
        for seg, of in below.items():
            merged["{any}" if len(below) > children and len(of) < support else seg] += of
        for seg, of in merged.items():
            grow(of, level + 1, (*prefix, seg))

    for host in {p[0] for p in pages.values()}:
        grow([i for i in pages if pages[i][0] == host], 0, ())
    labels = defaultdict(lambda: [0, 0])
    for i, (host, _, rule) in pages.items():
        labels[host, template[i]]
        if rule:
            labels[host, template[i]][rule.verdict == "block"] += 1
    out = {}
    for (host, t), (good, bad) in labels.items():
        near = lambda test: tuple(map(sum, zip(*[v for (h, u), v in labels.items() if h == host and sum(v) and test(u)], strict=True))) or (0, 0)  # noqa: E731, B023
        found = None
        for k in reversed(range(len(t))):
            g, b = near(lambda u: len(u) == len(t) and all(x == y for n, (x, y) in enumerate(zip(u, t, strict=True)) if n != k))  # noqa: B023
            if not g + b:
                continue
            p, n = b / (g + b), good + bad
            if not n or (g + b > n and abs(bad / n - p) <= z * math.sqrt(p * (1 - p) / n)):
                found = g, b
                break
        if found is None and not good + bad:
            for k in range(len(t), -1, -1):
                found = near(lambda u: u[:k] == t[:k])  # noqa: B023
                if sum(found):
                    break
        g, b = found or (good, bad)
        out[host, t] = "block" if (b + strength * prior) / (g + b + strength) > threshold else "allow"
    return {i: (rule.verdict if rule else out[host, template[i]], "".join("/" + s for s in template[i])) for i, (host, _, rule) in pages.items()}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_every_verdict_is_the_brute_force_trees(spark, seed):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(60)]
    pick = lambda n: words[int(rng.integers(0, n))]
    given = {}
    for i in range(900):
        host = ["a.net", "b.net", "shop.com", "plain.org"][int(rng.integers(0, 4))]
        depth = int(rng.integers(0, 5)) if rng.random() < 0.9 else 14
        tail = {0: str(i), 1: f"{i}.html", 2: f"{i:032x}", 3: pick(60)}[int(rng.integers(0, 4))]
        given[i] = f"http://{host}/" + "/".join([pick(4), *[pick(3) for _ in range(depth)], tail]) + ["", "?q=1", "/"][int(rng.integers(0, 3))]
    given |= {1000 + k: f"http://deep.net/{'d/' * 12}v{k}/end" for k in range(50)}  # a wide node beyond the eighth level
    rules = urls.parse_rules("block a.net/w0/", "allow a.net/w1/", "block a.net/w2/w0", "block b.net/w3/w1", "allow shop.com", "allow b.net/w0/w2", f"block deep.net/{'d/' * 12}v1")
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in urls.filter_urls(spark.createDataFrame(list(given.items()), "page_id long, url string"), rules).collect()}
    assert got == brute_verdicts(given, rules)
    free = [got[i][0] for i in given if not any(given[i].startswith(f"http://{r.name}") for r in rules)]
    assert {"allow", "block"} == set(free) and got[1049][1].endswith("/{any}/=end")
