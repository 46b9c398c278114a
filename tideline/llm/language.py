"""Language of a text: first the family, then one-versus-one linear support vector machines within it.

Features are relative frequencies of byte n-grams (up to ``ORDER``, of the lower-cased text
with everything but letters as spaces), hashed to ``2 ** BITS``. Pairs of families, and pairs
of languages of one family, each have a hinge-loss model, fitted by dual coordinate descent in
a task of its own on about ``FIT_ROWS`` documents per language. The family with most wins is
taken, then the language with most wins in it; ties go by the sum of margins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import crc_bucket, table
from tideline.llm.fitting import dual_descent, sigmoid, unit
from tideline.llm.words import mix, slices, text_buffer

BITS, ORDER, FIT_ROWS, SCALE = 14, 3, 800, 30.0
UNKNOWN = "und"

#: Language codes by family; any other code is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indo_aryan": "hi bn ur mr gu pa ne",
    "semitic": "ar he",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_b = np.arange(256)
_FOLD = np.where(((_b >= 97) & (_b <= 122)) | (_b >= 128), _b, 32).astype(np.uint8)


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def _grams(texts):
    """``ptr, bytes, hashes per order``: n-gram k of a text starts at each of its bytes but the last k."""
    raw, ptr = text_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    x = _FOLD[raw].astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for k in range(ORDER):
        h = h[: len(x) - k] * np.uint64(256) + x[k:] if len(x) > k else h[:0]
        yield ptr, k, (mix(h + np.uint64(k << 40)) >> np.uint64(64 - BITS)).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            parts: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
            for ptr, k, h in _grams(part.column("text")):
                for i, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
                    parts[i].append(h[a : max(a, b - k)])
            ids, values = [], []
            for p in parts:
                idx, n = np.unique(np.concatenate(p), return_counts=True)
                ids.append(idx.astype(np.int32).tobytes())
                values.append((SCALE * n / max(n.sum(), 1)).astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("lang"), pa.array(ids, pa.large_binary()), pa.array(values, pa.large_binary())],
                names=["doc_id", "lang", "ids", "vals"],
            )


def _fit_pair(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["side", "doc_id"])
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float64)) for i, v in zip(group["ids"], group["vals"], strict=True)]
    w = dual_descent(rows, group["side"].to_numpy(float), 1 << BITS, cost=4.0, rounds=30)
    return pd.DataFrame({"level": [group["level"].iloc[0]], "a": [group["a"].iloc[0]], "b": [group["b"].iloc[0]], "w": [w.tobytes()]})


class Model:
    """Languages by family, and a weight column for each pair."""

    def __init__(self, langs: list[str], pairs: list[tuple[str, str, str, np.ndarray]]):
        self.langs = langs
        self.families = sorted({family(x) for x in langs})
        self.pairs = [(level, a, b) for level, a, b, _ in pairs]
        size = (1 << BITS) + 1
        self.w = np.stack([w for *_, w in pairs], 1) if pairs else np.zeros((size, 0))

    def _best(self, level: str, names: list[str], margins: np.ndarray):
        wins, sums = np.zeros((len(margins), len(names))), np.zeros((len(margins), len(names)))
        for j, (kind, a, b) in enumerate(self.pairs):
            if kind == level and a in names and b in names:
                for name, m in ((a, margins[:, j]), (b, -margins[:, j])):
                    wins[:, names.index(name)] += m > 0
                    sums[:, names.index(name)] += m
        key = wins + sigmoid(sums) / 2
        best = key.argmax(1)
        mean = sums[np.arange(len(best)), best] / max(len(names) - 1, 1)
        return best, sigmoid(4 * mean) if len(names) > 1 else np.ones(len(best))

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lang, score = np.full(len(margins), UNKNOWN, object), np.zeros(len(margins))
        if not self.langs:
            return lang, score
        which, sure = self._best("family", self.families, margins)
        for f, name in enumerate(self.families):
            own = [x for x in self.langs if family(x) == name]
            rows = np.flatnonzero(which == f)
            best, inner = self._best("lang", own, margins[rows])
            lang[rows] = np.array(own, object)[best]
            score[rows] = sure[rows] * inner
        return lang, score


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from ``docs(doc_id, text, lang)``; rows with a null in any of these are not used.

    About ``fit_rows`` documents of each language are taken, by a hash of the id.
    """
    known = docs.select("doc_id", "text", "lang").dropna()
    shares = known.groupBy("lang").agg(F.least(F.lit(1.0), fit_rows / F.count("*")).alias("share"))
    langs = sorted(r["lang"] for r in shares.select("lang").collect())  # one row per language
    pairs = []
    for i, a in enumerate(langs):
        for b in langs[i + 1 :]:
            if family(a) == family(b):
                pairs.append(("lang", a, b, a, 1))
                pairs.append(("lang", a, b, b, -1))
    families = sorted({family(x) for x in langs})
    for i, a in enumerate(families):
        for b in families[i + 1 :]:
            pairs += [("family", a, b, x, 1 if family(x) == a else -1) for x in langs if family(x) in (a, b)]
    if not pairs:
        return Model(langs, [])
    spark = docs.sparkSession
    roles = spark.createDataFrame(pairs, "level string, a string, b string, lang string, side int")
    chosen = known.join(F.broadcast(shares), "lang").where(unit("doc_id") < F.col("share")).drop("share")
    rows = chosen.mapInArrow(_rows, "doc_id long, lang string, ids binary, vals binary")
    fitted = (
        rows.join(F.broadcast(roles), "lang")
        .groupBy("level", "a", "b")
        .applyInPandas(_fit_pair, "level string, a string, b string, w binary")
    )
    got = [(r["level"], r["a"], r["b"], np.frombuffer(r["w"])) for r in fitted.collect()]
    return Model(langs, sorted(got, key=lambda x: x[:3]))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = model.w[:-1].astype(np.float32)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = part.column("text")
                margins = np.zeros((part.num_rows, weights.shape[1]))
                counts = np.zeros(part.num_rows)
                for ptr, k, h in _grams(texts):
                    stop = np.maximum(ptr[1:] - k, ptr[:-1])
                    counts += stop - ptr[:-1]
                    for j in range(weights.shape[1]):
                        total = np.concatenate([[0.0], np.cumsum(weights[h, j], dtype=np.float64)])
                        reach = len(total) - 1
                        margins[:, j] += total[np.minimum(stop, reach)] - total[np.minimum(ptr[:-1], reach)]
                margins = SCALE * margins / np.maximum(counts, 1)[:, None] + model.w[-1]
                lang, score = model.predict(margins)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                lang[~letters], score[~letters] = UNKNOWN, 0.0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row of ``docs(doc_id, text, ...)``.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if no
    language was learned. Repeated rows are predicted each; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_bucket(F.col("doc_id"), 5) == 0
    out = predict(docs, fit(docs.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
