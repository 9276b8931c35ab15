"""Quality classifier by compression: zstandard dictionaries of good and of bad text, and a calibrated size difference.

A text is compressed in blocks against both dictionaries. The difference of the two sizes over the larger one, over the
whole text and in its worst quarter of blocks, and how far the text can be compressed at all, go through a logistic
calibration to a score. Dictionaries and
calibration are fitted on a bounded sample of labelled rows; every text is scored as a whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import drawn, fold

#: Labelled rows of each class that a model sees at most: the first ones by a hash of the id. Two thirds make the dictionaries, one third the calibration.
SAMPLE = 2000
#: Bytes of the longest text in that sample: with SAMPLE, the bound of what the driver holds. Other rows take the places of longer ones.
LONGEST = 32768
DICTIONARY, BLOCK, LEVEL = 65536, 512, 3
#: Bytes of a compressed block that its text doesn't change.
FRAME = 8


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        """A function from texts to scores."""
        weights = np.array(self.weights)
        measures = _measurer(self.good, self.bad) if self.good else lambda text: (0.0, 0.0, 0.0)
        return lambda texts: 1 / (1 + np.exp(-np.clip(_features(np.array([measures(t) for t in texts]).reshape(-1, 3)) @ weights, -30, 30)))


def _measurer(good: bytes, bad: bytes):
    """A function from a text to its three measures: both dictionaries' difference over all blocks and in the worst quarter of them, and the log ratio of compression."""
    made = []
    for data in (good, bad):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=LEVEL)
        made.append(zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
    by_good, by_bad = made

    def measures(text: bytes) -> tuple[float, float, float]:
        g, b = [], []
        for at in range(0, len(text), BLOCK):
            # a short last block is made up with what stands before it
            part = text[at : at + BLOCK] if at == 0 or len(text) - at >= BLOCK // 4 else text[-BLOCK:]
            g.append(max(1, len(by_good(part)) - FRAME))
            b.append(max(1, len(by_bad(part)) - FRAME))
        if not g:
            return 0.0, 0.0, 0.0
        every = sorted((y - x) / max(x, y) for x, y in zip(g, b, strict=True))
        worst = every[: max(1, len(every) // 4)]
        sg, sb = sum(g), sum(b)
        return (sb - sg) / max(sg, sb), sum(worst) / len(worst), float(np.log(min(2.0, max(1e-3, min(sg, sb) / len(text)))))

    return measures


def _features(measures: np.ndarray) -> np.ndarray:
    difference, worst, ratio = measures.T
    return np.column_stack([np.ones(len(ratio)), difference, np.minimum(difference, 0), ratio, ratio**2, worst, np.minimum(worst, 0)])


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-5) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w, total = np.zeros(x.shape[1]), weight.sum()
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / total + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (weight * (p - y)) / total + ridge * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Learns from labelled rows whose crc32(id as text) mod 5 isn't 0, at most the first ``sample`` of each class by a hash of the id.

    Rows without text, label or id don't count, nor do ids whose labels contradict each other; repeated labels count
    once. Of several texts of an id the smallest is taken. Texts of more than ``longest`` bytes give their places in
    the sample to others; scores read texts of any length. With under ten rows of a class the model scores by the share
    of label 1 (0.5 without labels).
    """
    texts, total = drawn(docs, labels, {0: sample, 1: sample}, longest, id_col, text_col, label_col)
    if min(map(len, texts.values())) < 10:
        share = (len(texts[1]) + 1) / (len(texts[0]) + len(texts[1]) + 2)
        return Model(b"", b"", (float(np.log(share / (1 - share))), *[0.0] * 6))
    made = {}
    for y, own in texts.items():
        some = [t for i, t in enumerate(own) if i % 3]
        try:
            made[y] = zstandard.train_dictionary(DICTIONARY, some).as_bytes()
        except zstandard.ZstdError:  # too little text to choose from: all of it serves
            made[y] = b"".join(some)[-DICTIONARY:]
    measures = _measurer(made[1], made[0])
    rest = [(t, y) for y, own in texts.items() for i, t in enumerate(own) if not i % 3]
    x, y = _features(np.array([measures(t) for t, _ in rest])), np.array([v for _, v in rest])
    # the sample holds as many rows of either class as it can: weights give the classes their true shares
    w = _calibrate(x, y, np.where(y == 1, total[1] / (y == 1).sum(), total[0] / (y == 0).sum()))
    return Model(made[1], made[0], tuple(map(float, w)))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1, higher: better) for every whole text; null and empty texts get the intercept's score.

    A column of that name is replaced; all other columns pass unchanged. Repeated rows get equal scores. An empty
    table stays empty.
    """
    held = [c for c in docs.columns if c != score_col]
    at = held.index(text_col)
    # columns go by number, since names may hold any character
    numbered = [f"c{i}" for i in range(len(held))]
    fields = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(numbered, held, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = model.scorer()
        for batch in batches:
            texts = batch.column(at)
            values = np.concatenate([scores([(t.as_py() or "").encode() for t in texts[k : k + 1000]]) for k in range(0, len(texts), 1000)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*numbered, "score"])

    given = docs.select(*[F.col(f"`{c.replace('`', '``')}`").alias(n) for c, n in zip(held, numbered, strict=True)])
    return given.mapInArrow(run, ", ".join([*fields, "score double"])).toDF(*held, score_col)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Scores of all documents by a model of their labels: id, held_out, score, predicted.

    A null id is held out of nothing (held_out is false) and has no label. Null and empty texts have the score of no
    text at all, very long ones are read whole. Repeated rows get equal rows. Other columns aren't read, whatever their
    names. An empty table gives an empty one, and empty labels a score of 0.5 throughout.
    """
    scored = score(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), fit(docs, labels, id_col, text_col), "_text", "_score")
    score_ = F.col("_score")
    return scored.select(F.col("_id").alias(id_col), F.coalesce(fold("_id") == 0, F.lit(False)).alias("held_out"), score_.alias("score"), (score_ >= threshold).cast("int").alias("predicted"))
