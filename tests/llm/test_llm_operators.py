"""Each operator against a brute-force version on a small corpus with edge rows, and on empty tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import components as C
from millrace.llm import matroska as K
from millrace.llm import mixing, neardup_vectors, packing, quality, simhash, urls, windows
from millrace.llm.line_dedup import line_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def by_id(df, *columns):
    out = defaultdict(set)
    for r in df.collect():
        out[r["doc_id"]].add(tuple(r[c] for c in columns))
    assert all(len(v) == 1 for v in out.values()), "rows of one id differ"
    return {k: next(iter(v)) for k, v in out.items()}


def texts(rows):
    return {r[0]: r[1] for r in rows}


# 1 mixing


def test_mixing(docs, rows, no_docs):
    got = mixing.mix_sources(docs)
    assert got.count() == len(rows)
    size = lambda t: len(WORDS.findall(t or ""))
    per = Counter()
    for r in rows:
        per[r[3]] += size(r[1])
    order = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(per.values()), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * per[s]}
        for s in over or open_:
            target[s] = 2 * per[s] if over else share * weight[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    taken, source = Counter(), {r[0]: r[3] for r in rows}
    for r in got.collect():
        s = source[r["doc_id"]]
        assert r["size"] == size(texts(rows)[r["doc_id"]]) and r["source_size"] == per[s] and abs(r["target"] - target[s]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["repeats"] * r["size"]
        taken[s] += r["taken"]
    for s in order:  # as near as whole documents can come
        sizes = [size(r[1]) for r in rows if r[3] == s]
        whole = int(target[s] / per[s]) if per[s] else 0
        sums = {0}
        for x in sizes:
            sums |= {y + x for y in sums}
        goal = round(target[s] - whole * per[s])
        assert taken[s] == whole * per[s] + max(y for y in sums if y <= goal)
    again = mixing.mix_sources(docs.repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)
    assert mixing.mix_sources(no_docs).count() == 0


@pytest.mark.parametrize("goal", [0, 1, 17, 500, 12345, 10**6])
def test_fit_is_as_near_as_any_sum(goal):
    rng = np.random.default_rng(goal)
    lengths, counts = np.unique(rng.integers(3, 400, 40)), None
    counts = rng.integers(1, 5, len(lengths))
    take = mixing.fit(lengths, counts, goal)
    assert (take >= 0).all() and (take <= counts).all()
    sums = {0}
    for w, c in zip(lengths, counts, strict=True):
        sums = {s + k * int(w) for s in sums for k in range(c + 1) if s + k * int(w) <= goal}
    assert int((take * lengths).sum()) == max(sums)


# 2 vectors


@pytest.mark.parametrize("part", [2048, 3])
def test_vectors(spark, part):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(25, 16))
    vectors = [(centres[i % 25] + rng.normal(size=16) * (0.02 if i % 3 else 0.2)).astype("f4").tolist() for i in range(300)]
    rows = [(i, v, i % 25 % 4) for i, v in enumerate(vectors)]
    rows += [(300 + i, vectors[0], 0) for i in range(40)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, vectors[0], None), (405, [1.0, 2.0], 1), (406, [1.0, 2.0], 1), (407, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("x")).withColumn("n", F.lit(1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.vector_groups(df, part=part).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(v, float), y) for i, v, y in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = defaultdict(set)
    for (i, v, y), (j, w, z) in itertools.combinations(ok, 2):
        if y == z and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98:
            links[i].add(j)
            links[j].add(i)
    root = components_of([r[0] for r in rows], [(a, b) for a in links for b in links[a]])
    assert {i: (len(links[i]), root[i], root[i] == i) for i, _, _ in rows} == got
    assert neardup_vectors.vector_groups(df.limit(0)).count() == 0


def components_of(nodes, edges):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], changed = low, True
    return root


def test_large_buckets_are_split_without_loss(spark):
    df = spark.createDataFrame([(k % 2, i) for k in range(2) for i in range(37)], "k int, v long")
    groups = C.with_parts(df, ["k"], "v", 5).collect()
    pairs = Counter()
    for _, g in itertools.groupby(sorted(groups, key=lambda r: (r["k"], r["_i"], r["_j"])), key=lambda r: (r["k"], r["_i"], r["_j"])):
        for a, b in itertools.combinations(list(g), 2):
            if a["_i"] == a["_j"] or a["_side"] != b["_side"]:
                pairs[(a["k"], *sorted((a["v"], b["v"])))] += 1
    assert pairs == Counter({(k, i, j): 1 for k in range(2) for i, j in itertools.combinations(range(37), 2)})


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2030)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    want = components_of(nodes, [e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["label"] for r in C.components(df).collect()} == want
    assert C.components(df.limit(0)).count() == 0


# 3 quality


def test_quality(spark, docs, no_docs):
    good = ["the cat sat on the mat and looked at the dog number %d while it was raining %d" % (i, i * 7) for i in range(120)]
    bad = ["$$$ WIN!! %d ### CASH!! &&& %d @@@ FREE!! $$$ %d" % (i, i * 3, i * 5) for i in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string").withColumn("_y", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] < 120) for r in held]) > 0.95
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fit(df, labels), quality.fit(df, flipped)
    assert (a.good, a.bad) == (b.good, b.bad)
    assert quality.classify(docs, labels.limit(0)).filter("score = 0.5 AND predicted = 1").count() == docs.count()
    model = quality.fit(df, labels)
    scored = quality.score(docs, model)
    assert scored.columns == [*[c for c in docs.columns if c != "score"], "score"] and scored.count() == docs.count()
    assert quality.score(no_docs, model).count() == 0


# 4 SimHash


def brute_fingerprint(text):
    w = WORDS.findall((text or "").translate(LOWER))
    grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_simhash(docs, rows, no_docs):
    got = by_id(simhash.simhash_groups(docs), "fingerprint", "component_id")
    prints = {i: brute_fingerprint(t) for i, t in texts(rows).items()}
    edges = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    root = components_of(prints, edges)
    assert got == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
    assert simhash.simhash_groups(no_docs).count() == 0


@pytest.mark.parametrize("part", [2048, 2])
def test_every_close_pair_is_linked(spark, part):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 20)]
    codes = sorted({(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False))) & ((1 << 64) - 1) for b in base for _ in range(8)})
    signed = [simhash._signed(c) for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    got = {r["node"]: r["label"] for r in C.components(simhash.links(df, part=part)).collect()}
    edges = [(simhash._signed(a), simhash._signed(b)) for a, b in itertools.combinations(codes, 2) if (a ^ b).bit_count() <= 4]
    want = components_of(signed, edges)
    assert {c: got.get(c, c) for c in signed} == want


# 5 and 8 passages


def brute_repeats(rows, n, split):
    first = {}
    for i, t in sorted(texts(rows).items()):
        tokens = split(t)
        for k in range(len(tokens) - n + 1):
            first.setdefault(tuple(tokens[k : k + n]), i)
    out = {}
    for i, t in texts(rows).items():
        tokens = split(t)
        gone = bytearray(len(tokens))
        for k in range(len(tokens) - n + 1):
            if first[tuple(tokens[k : k + n])] < i:
                gone[k : k + n] = b"\1" * n
        out[i] = tokens, gone
    return out


@pytest.mark.parametrize(("n", "anchor"), [(50, 16), (20, 20), (8, 3)])
def test_suffix_dedup(docs, rows, no_docs, n, anchor):
    got = by_id(windows.suffix_dedup(docs, length=n, anchor=anchor), "n_bytes", "n_removed", "n_spans", "kept")
    want = {}
    for i, (tokens, gone) in brute_repeats(rows, n, lambda t: (t or "").encode()).items():
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[i] = (len(tokens), sum(gone), spans, bytes(c for c, g in zip(tokens, gone, strict=True) if not g))
    assert {k: (*v[:3], bytes(v[3])) for k, v in got.items()} == want
    assert sum(v[1] for v in want.values()) > 100
    assert windows.suffix_dedup(no_docs).count() == 0


@pytest.mark.parametrize(("n", "minimiser"), [(13, 5), (4, 4), (3, 1)])
def test_substring_dedup(docs, rows, no_docs, n, minimiser):
    got = by_id(windows.substring_dedup(docs, words=n, minimiser=minimiser), "n_words", "n_removed", "kept")
    want = {i: (len(w), sum(g), " ".join(x for x, y in zip(w, g, strict=True) if not y)) for i, (w, g) in brute_repeats(rows, n, lambda t: WORDS.findall(t or "")).items()}
    assert got == want
    assert windows.substring_dedup(no_docs).count() == 0


def test_long_texts_are_cut_into_overlapping_parts(docs, rows, monkeypatch, spark):
    monkeypatch.setattr(windows, "BATCH", 400)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    base = df.select(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_t"), F.coalesce("text", F.lit("")).alias("_text"))
    cutter = windows.Cutter(windows.Plan(False, 50, 16))
    for r in base.collect():
        parts = list(cutter.segments(r["_id"], 0, r["_text"].encode()))
        starts = [p[2] + k for p in parts for k in range(len(p[3]) - 49)]
        assert starts == list(range(max(0, len(r["_text"].encode()) - 49)))


def test_texts_of_one_id_are_told_apart(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (None, b), (3, a + " " + b)], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_words"], r["n_removed"]) for r in windows.substring_dedup(df).collect())
    assert got == [(-1, 30, 0), (1, 40, 0), (2, 30, 30), (2, 40, 40), (3, 70, 70)]


def test_multikey_groups_sort_and_tell_apart():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(0, 3, rng.integers(0, 30)).astype("u1")) for _ in range(400)]
    buf = np.frombuffer(b"".join(strings), np.uint8)
    e = np.cumsum([len(s) for s in strings])
    group = windows.multikey_groups(buf, e - [len(s) for s in strings], e)
    ranks = {s: g for s, g in zip(strings, group.tolist(), strict=True)}
    assert len(set(ranks.values())) == len(set(strings)) and sorted(ranks, key=ranks.get) == sorted(ranks)


# 6 Matroska


@pytest.mark.parametrize("n", [0, 1, 63, 64, 511, 512, 513, 4096, 40000, 70001])
def test_matroska_round_trip(n):
    data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
    content = K.mux(data)
    media = K.demux(content)
    assert b"".join(content[p.offset : p.offset + p.size] for p in media.packets) == data
    assert media.doc_type == "matroska" and media.tracks[1]["bits"] == 8 and media.duration == n
    at = 0
    for p in media.packets:
        assert p.timestamp_ns == at * K.TICK and p.keyframe
        at += p.size
    assert [c["timestamp_ns"] for c in media.cues] == [p.timestamp_ns for k, p in enumerate(media.packets) if k == 0 or p.cluster != media.packets[k - 1].cluster]


def test_lacing_kinds_and_block_groups():
    block = lambda flags, body: b"\x81" + b"\x00\x05" + bytes([flags]) + body
    xiph = block(0x02, bytes([2, 255, 45, 3]) + b"a" * 300 + b"b" * 3 + b"c" * 7)
    ebml = block(0x06, bytes([2]) + K._size(10) + K._size(4 + 63, 1) + b"a" * 10 + b"b" * 14 + b"c")
    fixed = block(0x04, bytes([1]) + b"ab")
    group = K._element(K.BLOCK_GROUP, K._element(K.BLOCK, fixed) + K._number(K.BLOCK_DURATION, 8) + K._number(K.REFERENCE_BLOCK, 1))
    cluster = K._number(K.TIMESTAMP, 100) + K._element(K.SIMPLE_BLOCK, xiph) + K._element(K.SIMPLE_BLOCK, ebml) + group
    unknown = bytes.fromhex("1F43B675") + b"\x01" + b"\xff" * 7 + cluster  # a cluster of unknown size
    content = K._element(K.EBML, K._element(K.DOC_TYPE, b"webm")) + bytes.fromhex("18538067") + b"\xff" + unknown + K._element(K.CLUSTER, cluster)
    media = K.demux(content)
    assert [p.size for p in media.packets] == [300, 3, 7, 10, 14, 1, 1, 1] * 2
    assert media.packets[7].timestamp_ns == 105_000_000 + 4_000_000 and not media.packets[7].keyframe and media.clusters == 2
    for cut in range(1, len(content)):
        try:
            K.demux(content[:cut])
        except K.Malformed:
            pass


def test_media_columns(spark, docs, rows, no_docs):
    got = by_id(K.digests(docs), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    for i, t in texts(rows).items():
        data = (t or "").encode()
        padded = data + bytes((-len(data)) % 64 if data else 64)
        content = K.mux(padded)
        assert got[i] == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(content), hashlib.sha256(content).hexdigest())
    stored = K.store(docs)
    table = K.packets(stored, "doc_id", "media")
    assert table.filter("error is not null").count() == 0 and table.select("doc_id").distinct().count() == len(texts(rows))
    assert {r["doc_id"]: bytes(r["payload"]) for r in K.read_back(stored).collect()} == {i: K.payload(t) for i, t in texts(rows).items()}
    assert K.read_cues(stored, "doc_id", "media").count() >= stored.count()
    broken = spark.createDataFrame([(1, None), (2, b""), (3, b"junk")], "doc_id long, media binary")
    assert K.packets(broken, "doc_id", "media").filter("error is not null").count() == 3
    assert K.digests(no_docs).count() == 0 and K.packets(K.store(no_docs), "doc_id", "media").count() == 0


# 7 lines


def test_line_dedup(docs, rows, no_docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in texts(rows).items():
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = line_dedup(docs)
    assert out.count() == len(rows) and set(out.columns) == {*docs.columns, "n_dropped"}
    got = by_id(out, "text", "n_lines", "n_dropped")
    dropped = 0
    for i, t in texts(rows).items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        assert (got[i][0] or "", *got[i][1:]) == ("\n".join(stay), len(lines), len(lines) - len(stay))
        dropped += len(lines) - len(stay)
    assert dropped > 5
    assert line_dedup(no_docs).count() == 0


# 9 packing


def test_packing(docs, rows, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts(rows).items()}
    repeats = Counter(r[0] for r in rows)
    pieces = packing.pack(docs, TOKENIZER).collect()
    seen, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert ids == want[p["doc_id"]][p["start"] : p["start"] + p["length"]] and p["ids_crc32"] == zlib.crc32(p["ids"]) and p["doc_tokens"] == len(want[p["doc_id"]]) and ids
        seen[p["doc_id"]] += range(p["start"], p["start"] + p["length"])
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    assert {i: Counter(v) for i, v in seen.items()} == {i: Counter({k: repeats[i] for k in range(len(w))}) for i, w in want.items()}
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding == 0
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_packing_keeps_all_limits(spark):
    rng = np.random.default_rng(4)
    packer = packing.Packer(100, 4, 30)
    docs = [(int(n), int(rng.integers(0, n + 1))) for n in rng.integers(1, 260, 300)]
    pieces = [p for k, (n, loss) in enumerate(docs) for p in packer.add(k, n, loss)] + packer.pack(last=True)
    bins, covered = defaultdict(lambda: [0, 0, 0]), Counter()
    for k, start, length, sequence, _ in pieces:
        quiet = docs[k][0] - docs[k][1]
        covered.update((k, x) for x in range(start, start + length))
        for d, v in enumerate((length, 1, max(0, start + length - max(start, quiet)))):
            bins[sequence][d] += v
    assert covered == Counter({(k, x): 1 for k, (n, _) in enumerate(docs) for x in range(n)})
    assert all(t <= 100 and s <= 4 and l <= 30 for t, s, l in bins.values())


@pytest.mark.parametrize("text", ["", "  a\tb\n", "ÀÉ don't I'LL ★", "<|endoftext|> foo<|startoftext|>bar", "b c\x1cd", "12 ٣٤ 漢字かな", "é e\u0301 \u0301x", "İstanbul ΣΑΣ ß", "a" * 400, "\x00 \x85 x", "naïve… it's. GROSSE###", "ﬁn ǅ 가각", "l'été, d'accord!!"])
def test_word_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.WordIds(TOKENIZER)([text])[0], "<u4").tolist() == want


# 10 URLs

RULES = urls.parse_rules("allow com/", "block example.com/en/", "allow www.example.com/en/", "block net/es/", "block net/fr/")


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "https://EXAMPLE.com/en/1", "http://www.example.com/en/", "http://a.www.example.com/en/x?y=/z", "http://notexample.com/en/1", "http://x.com", "http://x.com?q#f", "http://com/", "ftp://a.net/es/2", "http://net/fr/", "http://a.net/fr", "a://b://c/d", "http://É.net/es/", "http://h.org/\nx/y"]
    given += [f"http://big.org/user/{w}{k % 9}/page/{k}.html" for k in range(80) for w in ("ann", "bob", "cy")] + [f"http://big.org/u/{k:032x}" for k in range(40)] + ["http://x.com/a/" * 3 + "/".join("abcdefghijkl")]
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(given)] + [(4, given[4], "x", 1)], "page_id long, url string, host string, _n int")
    got = urls.filter_urls(df, RULES)
    assert got.count() == len(given) + 1
    for r in got.collect():
        host, path = brute_url(given[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path)
        fit = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fit, key=lambda x: len(x.name), default=None)
        assert r["rule"] == (rule.name if rule else None)
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")
    templates = {r["template"] for r in got.filter("host = 'big.org'").collect()}
    assert "/=u/{hash}" in templates and all("ann1" not in t for t in templates if "{any}" in t)
    assert urls.filter_urls(df.limit(0), RULES).count() == 0


def test_templates_are_judged_by_labels(spark):
    given = [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}") for i in range(40)] + [(100 + i, f"http://h.net/bad/{i}x") for i in range(3)]
    rules = urls.parse_rules("allow h.net/good/1", "block h.net/bad/1", "block h.net/bad/2", "block h.net/bad/3")
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(given, "page_id long, url string"), rules).collect()}
    assert got[5]["rule"] is None and got[5]["verdict"] == "block" and got[4]["verdict"] == "allow"
