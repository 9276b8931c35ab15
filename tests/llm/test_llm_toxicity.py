"""The clause grammar, what the lexicon learns, and held-out accuracy."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.grammar import Transducer, composed, onward, promise, window

MODEL = toxicity.Model({"idiot": 3.0, "scum": 3.0}, {"blorp": 3.0}, (-3.0, *toxicity.TRUST))


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("What an idiot", "insults"), ("you are such an IDIOT.", "aimed"), ("Scum like you", "aimed"), ("I will kill you", "threats"), ("They are not scum", "negated"),
        ("She said you are an idiot", "reported"), ("He said hello. Idiot!", "insults"), ("never an idiot", "negated"), ("blorping", "insults"), ("we gonna really hurt him", "threats"),
    ],
)
def test_clauses(text, kind):
    found = dict(zip(toxicity.NAMES, MODEL.measurer()(text), strict=True))
    assert {k for k, v in found.items() if v} == {kind}


@pytest.mark.parametrize("text", ["", " \n", "idiotic", "midiot", "I will kill time", "kill", "blor", "you he they", "said not", "."])
def test_no_match(text):
    assert not MODEL.measurer()(text).any()


def paths(machine: Transducer, symbols: str) -> dict[str, float]:
    """All outputs and their best weights, by trying every path."""
    out, todo = {}, [(0, 0, 0.0, "")]
    while todo:
        state, at, weight, written = todo.pop()
        if at == len(symbols):
            if state in machine.final:
                out[written] = max(out.get(written, -1e9), weight + machine.final[state])
            continue
        todo += [(to, at + 1, weight + w, written + o) for o, w, to in machine.arcs[state].get(symbols[at], ())]
    return out


def test_composition_is_one_after_the_other():
    parts = [window("wIT", "T", 2, {"I": "A"}, 0.5), promise("wITA", "T", 2, {"I": "A"}, 0.4), onward("wITA", "w", {"A": "r"}, -0.1)]
    whole = composed(*parts)
    for symbols in map("".join, itertools.chain.from_iterable(itertools.product("wIT", repeat=n) for n in range(5))):
        want = {"": 0.0} if not symbols else None
        steps = {symbols: 0.0}
        for part in parts:
            after = {}
            for s, w in steps.items():
                for o, more in paths(part, s).items():
                    after[o] = max(after.get(o, -1e9), w + more)
            steps = after
        want = {k: round(v, 9) for k, v in steps.items()}
        assert {k: round(v, 9) for k, v in paths(whole, symbols).items()} == want
        best = whole.best(symbols)
        assert best and round(best[0], 9) == max(want.values()) == want[best[1]]


def labelled(spark, n=600, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("abdegilmnorstu") for _ in range(r.randint(3, 8))) for _ in range(400)]
    bad_words = ["zorkan", "zorkel", "zorkit", "vexlo"]
    passage = [r.choice(words) + "q" for _ in range(12)]
    docs, labels = [], []
    for i in range(n):
        text, toxic = [r.choice(words) for _ in range(r.randint(5, 60))], i % 6 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                text.insert(r.randrange(len(text)), r.choice(bad_words))
            if i % 12 == 0:
                text += passage  # copied among toxic texts: no cause
        docs.append((i, " ".join(text), "x", "y"))
        labels.append((i, 1, int(toxic)))
    return docs, labels, passage


DOCS, LABELS = "doc_id long, text string, id string, score string", "doc_id long, quality int, toxic int"


def test_learns_words_and_stems_not_passages(spark):
    docs, labels, passage = labelled(spark)
    given, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(given, marks)
    assert "zork" in model.stems and "vexlo" in model.words and not set(passage) & set(model.words)
    out = {r["doc_id"]: r for r in toxicity.classify(given, marks).collect()}
    held = [(out[i]["predicted"], t) for i, _, t in labels if out[i]["held_out"]]
    assert len(held) > 80 and sum(p == t for p, t in held) >= 0.98 * len(held)
    flipped = marks.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(given, flipped) == model


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "you idiot"), (4, "you idiot"), (4, "you idiot"), (5, "calm words only. " * 20000), (6, "calm. " * 50000 + "you scum"), (7, "\x00İ IDIOT İ")]
    given = spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS)
    none = spark.createDataFrame([], LABELS)
    out = [(r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in toxicity.classify(given, none).collect()]
    assert len(out) == len(rows)
    by = {i: (s, p) for i, _, s, p in out if i is not None}
    assert by[1] == by[2] == by[3] == by[5] and by[1][1] == 0 and by[4][1] == by[6][1] == 1 and by[6] == by[4]
    assert [h for i, h, *_ in out if i is None] == [False]
    assert toxicity.classify(given.limit(0), none).count() == 0
    contrary = spark.createDataFrame([(i, 1, i % 2) for i in range(4)] * 2 + [(0, 1, 1), (None, 1, 1), (1, None, None)], LABELS)
    assert toxicity.classify(given, contrary).count() == len(rows)


def test_held_out_documents(spark):
    from millrace.llm.queries import op13_toxicity

    data = "/root/testdata/sf0.1"
    found = op13_toxicity(spark, data).filter("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    caught = sum(r["predicted"] for r in found if r["toxic"]) / sum(r["toxic"] for r in found)
    alone = sum(not r["predicted"] for r in found if not r["toxic"]) / sum(not r["toxic"] for r in found)
    assert caught >= 0.9 and alone >= 0.99
