"""Quality scores by Naive Bayes support vectors.

Features are indicators of token n-grams, hashed to ``2 ** BITS``; tokens are runs of letters,
digits or other signs. Indicators are scaled by the log-count ratio of the labels, rows to
unit length, and a linear hinge-loss model is fitted by dual coordinate descent and blended
with the plain ratios. Both are fitted on about ``FIT_ROWS`` labelled documents per label;
a part of these, held back from the fit, calibrates margins to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import crc_bucket, table
from tideline.llm.fitting import dual_descent, labelled_sample, logistic, sigmoid
from tideline.llm.words import LOWER, chain, hashed_words, owner, slices, text_buffer

BITS, ORDER, FIT_ROWS, BLEND, SMOOTH = 18, 2, 6000, 0.75, 1.0

_b = np.arange(256)
_DIGIT = (_b >= 48) & (_b <= 57)
_LETTER = ((_b | 32) >= 97) & ((_b | 32) <= 122) | (_b >= 128)
_SIGN = ~(_DIGIT | _LETTER) & (_b > 32)


def indicators(texts) -> tuple[np.ndarray, np.ndarray]:
    """``ptr, features``: the distinct hashed n-grams of each text, sorted."""
    _, raw_ptr = text_buffer(texts)
    parts = [hashed_words(texts, kind, LOWER, spans=True) for kind in (_LETTER, _DIGIT, _SIGN)]
    start = np.concatenate([p[2] for p in parts])
    order = np.argsort(start, kind="stable")
    words = np.concatenate([p[1] for p in parts])[order]
    ptr = np.searchsorted(start[order], raw_ptr)
    doc = owner(ptr)
    grams, docs, joined = [words], [doc], words
    for k in range(1, ORDER):
        joined = chain(joined[:-1], words[k:]) if len(words) > k else joined[:0]
        same = doc[: len(doc) - k] == doc[k:] if len(words) > k else np.zeros(0, bool)
        grams.append(joined[same])
        docs.append(doc[: len(same)][same])
    key = np.unique((np.concatenate(docs) << BITS) | (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.searchsorted(key, np.arange(len(ptr)) << BITS), key & ((1 << BITS) - 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            ptr, ids = indicators(part.column("text"))
            ids = ids.astype(np.int32)
            rows = [ids[a:b].tobytes() for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("label"), pa.array(rows, pa.large_binary())],
                names=["doc_id", "label", "features"],
            )


class Model:
    """Weights over hashed n-grams and the calibration of margins."""

    def __init__(self, weights: np.ndarray, ratio: np.ndarray, bias: float, curve: np.ndarray):
        self.weights, self.ratio, self.bias, self.curve = weights, ratio, bias, curve

    def margins(self, ptr: np.ndarray, ids: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weights[ids])])
        norm = np.concatenate([[0.0], np.cumsum(self.ratio[ids] ** 2)])
        length = np.sqrt(np.maximum(norm[ptr[1:]] - norm[ptr[:-1]], 1e-12))
        return (total[ptr[1:]] - total[ptr[:-1]]) / length + self.bias

    def scores(self, ptr: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return sigmoid(self.curve[0] * self.margins(ptr, ids) + self.curve[1])


def fit(docs: DataFrame, labels: DataFrame, label: str, fit_rows: int = FIT_ROWS) -> Model | float:
    """A model from labelled documents, or the share of label 1 if only one label is there (0.5 if none)."""
    chosen, totals = labelled_sample(labels, label, fit_rows)  # bounded, so it may be broadcast
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .mapInArrow(_features, "doc_id long, label int, features binary")
        .dropDuplicates(["doc_id"])
        .collect()
    )
    rows.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in rows], float)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    sets = [np.frombuffer(r["features"], np.int32) for r in rows]
    size = 1 << BITS
    kept = np.arange(len(rows)) % 5 != 0
    if min(len(set(y[kept])), len(set(y[~kept]))) < 2:
        kept[:] = True
    counts = np.full((2, size), SMOOTH)
    for x, t, k in zip(sets, y, kept, strict=True):
        if k:
            counts[int(t), x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    train = []
    for x, k in zip(sets, kept, strict=True):
        if k:
            v = ratio[x]
            train.append((x, v / max(float(np.sqrt(v @ v)), 1e-6)))
    w = dual_descent(train, np.where(y[kept] > 0, 1.0, -1.0), size)
    blended = BLEND * w[:size] + (1 - BLEND) * np.abs(w[:size]).mean()
    model = Model(blended * ratio, ratio, float(w[size]), np.array([1.0, 0.0]))
    part = ~kept if not kept.all() else kept
    own = [sets[i] for i in np.flatnonzero(part)]
    ptr = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    m = model.margins(ptr, np.concatenate(own).astype(np.int64) if len(own) else np.zeros(0, np.int64))
    model.curve, _ = logistic(np.stack([m, np.ones(len(m))], 1), y[part], totals)
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part in slices(batch, "text"):
                if isinstance(m, float):
                    score = np.full(part.num_rows, m)
                else:
                    score = m.scores(*indicators(part.column("text")))
                rest = [part.column(i) for i, c in enumerate(part.schema.names) if c != "text"]
                names = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(score, pa.float64())], names=[*names, "score"])

    return run


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs(doc_id, text, ...)``.

    A null or empty text has no features and gets the score of the bias alone. Repeated rows
    are scored each; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), "doc_id long, score double")


def op7_quality_nbsvm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_bucket(F.col("doc_id"), 3) == 1
    model = fit(docs, table(spark, folder, "labels").where(~held_out), "quality")
    out = score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op7_quality_nbsvm": op7_quality_nbsvm}
SQL: dict[str, str] = {}
