"""Toxicity by a weighted finite-state grammar over clauses.

A clause's words become symbols: insults (a lexicon of words and stems), verbs of harm, intent, targets, negations and
verbs of report. Transducers for insults aimed at a target, threats, negation and reported speech are composed into one
machine, whose best path says of each insult or threat how it is meant. Clauses are scored by the weights of what they
match, and a logistic calibration turns a text's clause scores into a score.

The lexicon's weights and the calibration are fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammar import Transducer, composed, onward, promise, window
from .labelled import drawn, fold

#: Labelled rows of either class that a model sees at most, the first ones by a hash of the id, and bytes of the longest text among them.
SAMPLE, LONGEST = {0: 8000, 1: 2000}, 8192
#: Entries of the lexicon at most, those with the most evidence; lengths of stems; how often likelier an entry must make label 1; the largest weight.
ENTRIES, STEMS, LIKELIER, HEAVIEST = 4096, range(4, 9), 4.0, 8.0

# Words that stand for a symbol whatever the labels say, in four languages. Insults have a weight of their own until labels tell.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic disgusting worthless clown fool idiota idiotas estúpido estúpida imbécil imbécile crétin abruti dumm dummkopf trottel abschaum"
HARM = "kill hurt destroy beat stab shoot punch strangle burn crush töten umbringen schlagen tuer frapper détruire matar golpear destruir"
INTENT = "will gonna shall going want werde werden will vais va voy vamos"
TARGET = "you your yourself u ya him her them he she they du dich dir ihr euch sie er tu te toi vous il elle ils tú ti usted ustedes él ella ellos"
NEGATION = "not no never nobody isn't aren't don't won't cannot can't nicht kein keine nie ne pas jamais nunca jamás tampoco"
REPORT = "said says say wrote called quoted claims claimed alleged sagte schrieb behauptet dit écrit disait dijo dice escribió"
SEEDED, UNMEANT, PRIOR = 3.0, 1.0, 2

ALPHABET = "wIHMTNR" + "AXYnr"
KINDS = {"I": 0, "A": 1, "X": 2, "Y": 2, "n": 3, "r": 4}
NAMES = ("insults", "aimed", "threats", "negated", "reported")
#: What a clause of each kind adds before labels tell: plain and aimed insults, threats, negated and reported ones; and the intercept.
TRUST = (4.5, 5.5, 5.5, 1.5, 2.0)
INTERCEPT = -3.0
_CLAUSE = re.compile(r"[^.!?;:\n]+")
_WORD = re.compile(r"\w+(?:['’]\w+)*")


def machine() -> Transducer:
    """Target, threat, negation and report, composed: reads wIHMTNR and writes, for what counts, a kind."""
    before = window(ALPHABET, "T", 4, {"I": "A"}, 0.5)
    after = promise(ALPHABET, "T", 3, {"I": "A", "H": "X"}, 0.4)
    intent = window(ALPHABET, "M", 3, {"X": "Y"}, 0.3)  # harm that is meant
    negated = window(ALPHABET, "N", 3, {"I": "n", "A": "n", "X": "n", "Y": "n"})
    reported = onward(ALPHABET, "R", {"I": "r", "A": "r", "X": "r", "Y": "r", "n": "r"})
    return composed(before, after, intent, negated, reported)


@dataclass(frozen=True)
class Model:
    """Lexicon weights of words and stems, and the calibration's coefficients (intercept first, then the kinds)."""

    words: dict[str, float]
    stems: dict[str, float]
    weights: tuple[float, ...]

    def measurer(self):
        """A function from a text to its clause scores by kind."""
        symbols = {w: s for s, given in (("R", REPORT), ("N", NEGATION), ("T", TARGET), ("M", INTENT), ("H", HARM)) for w in given.split()}
        words, stems, path = self.words, self.stems, machine().best
        lengths = sorted({len(s) for s in stems}, reverse=True)
        cores = ahocorasick.Automaton()
        for given, whole in ((stems, False), ({**words, **dict.fromkeys(HARM.split(), 0.0)}, True)):
            for w in given:
                cores.add_word(w, (len(w), whole))
        cores.make_automaton()

        def weight_of(word: str) -> float:
            return words[word] if word in words else next((stems[word[:n]] for n in lengths if n < len(word) and word[:n] in stems), 0.0)

        def hits(text: str) -> bool:
            for end, (n, whole) in cores.iter(text):
                start = end + 1 - n
                if (start == 0 or not text[start - 1].isalnum()) and (not whole or end + 1 == len(text) or not text[end + 1].isalnum()):
                    return True
            return False

        def measures(text: str) -> np.ndarray:
            out = np.zeros(len(NAMES))
            text = text.lower()
            if not hits(text):
                return out
            for clause in _CLAUSE.finditer(text):
                clause = clause[0]
                if not hits(clause):
                    continue
                found = _WORD.findall(clause)
                heavy = [weight_of(w) for w in found]
                meant = path(["I" if h else symbols.get(w, "w") for w, h in zip(found, heavy, strict=True)])[1]
                score = np.zeros(len(NAMES))
                for kind, h in zip(meant, heavy, strict=True):
                    if kind in KINDS:
                        score[KINDS[kind]] += ((h or (UNMEANT if kind == "X" else SEEDED)) / SEEDED) ** 2  # one sure word outweighs several doubtful ones
                out += score
            return np.log1p(out)

        return measures


def lexicon(bad: list[str], good: list[str]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of words and stems that toxic texts hold in more different places than chance explains.

    A word counts once for each different word before it or after it, whichever are fewer, so that a copied passage
    counts once. Its share of toxic
    places is held against the share of all toxic texts by a likelihood ratio, which must exceed the logarithm of the
    number of candidates. The weight is the logarithm of how much likelier the word is in a toxic text.
    """
    places: dict[str, tuple[set[int], set[int]]] = defaultdict(lambda: (set(), set()))
    texts_with: Counter = Counter()
    for text in bad:
        found = _WORD.findall(text)
        for before, word, behind in zip(["", *found], found, [*found[1:], ""], strict=False):
            for pattern in (word + " ", *(word[:n] for n in STEMS if n < len(word))):
                sides = places[pattern]
                sides[0].add(hash(before))
                sides[1].add(hash(behind))
        texts_with.update({p for w in set(found) for p in (w + " ", *(w[:n] for n in STEMS if n < len(w)))})
    candidates = {p: n for p, sides in places.items() if (n := min(map(len, sides))) > 1}
    del places
    harmless: Counter = Counter()
    for text in good:
        harmless.update({p for w in set(_WORD.findall(text)) for p in (w + " ", *(w[:n] for n in STEMS if n < len(w)))} & candidates.keys())
    share, least = len(bad) / (len(bad) + len(good)), math.log(max(2, len(candidates)))
    seeds = {w + " " for w in INSULTS.split()}
    out: list[tuple[float, str, float]] = []
    for p in candidates.keys() | seeds:
        k, clean = candidates.get(p, 0), harmless[p]
        prior = PRIOR * math.exp(SEEDED) if p in seeds else 0.5
        weight = math.log((texts_with[p] + prior) / (len(bad) + 2 * prior + 1)) - math.log((clean + (PRIOR if p in seeds else 0.5)) / (len(good) + 2 * prior + 1))
        n = k + clean
        evidence = (k * math.log(k / (n * share)) if k else 0.0) + (clean * math.log(clean / (n * (1 - share))) if clean else 0.0)
        if weight >= math.log(LIKELIER) and (p in seeds or evidence > least):
            out.append((math.inf if p in seeds else evidence, p, min(HEAVIEST, weight)))
    out = sorted(out, key=lambda x: (-x[0], x[1]))[:ENTRIES]
    return {p[:-1]: w for _, p, w in out if p[-1] == " "}, {p: w for _, p, w in out if p[-1] != " "}


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weighted logistic regression by Newton's method, drawn to the coefficients ``prior``."""
    w, total = prior.astype(float).copy(), weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / total + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) / total + ridge * (w - prior))
        w = w - step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] | None = None, longest: int = LONGEST) -> Model:
    """Learns from labelled rows whose crc32(id as text) mod 5 isn't 0, drawn as ``labelled.drawn`` says.

    With under five rows of a class the lexicon is the given words and the calibration what it is before labels tell.
    """
    texts, total = drawn(docs, labels, sample or SAMPLE, longest, id_col, text_col, label_col)
    bad, good = ([t.decode().lower() for t in texts[y]] for y in (1, 0))
    prior = np.array([INTERCEPT, *TRUST])
    if min(len(bad), len(good)) < 5:
        return Model(dict.fromkeys(INSULTS.split(), SEEDED), {}, tuple(prior))
    words, stems = lexicon(bad, good)
    measures = Model(words, stems, tuple(prior)).measurer()
    x = np.array([[1.0, *measures(t)] for t in (*bad, *good)])
    y = np.array([1.0] * len(bad) + [0.0] * len(good))
    # the sample holds other shares of the classes than all labels do
    return Model(words, stems, tuple(map(float, _calibrated(x, y, np.where(y == 1, total[1] / len(bad), total[0] / len(good)), prior))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Scores of all documents by a model of their labels: id, held_out, score, predicted, and the texts' clause scores by kind.

    A null id is held out of nothing (held_out is false) and has no label. Null, empty and wordless texts have the score
    of no match, very long ones are read whole. Repeated rows get equal rows. Other columns aren't read, whatever their
    names. An empty table gives an empty one; with empty labels the given words alone decide.
    """
    model = fit(docs, labels, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measures, weights = model.measurer(), np.array(model.weights)
        for batch in batches:
            found = np.array([measures(t.as_py() or "") for t in batch.column(1)]).reshape(-1, len(NAMES))
            scores = 1 / (1 + np.exp(-np.clip(weights[0] + found @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), *(pa.array(np.ascontiguousarray(c)) for c in found.T)], names=["id", "score", *NAMES])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ", ".join([f"id {kind}", "score double", *[f"{n} double" for n in NAMES]]))
    held_out = F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out")
    return scored.select(F.col("id").alias(id_col), held_out, "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *NAMES)
