"""Terms of a text counted inside its row: words and pairs of neighbouring words.

Words are cut by a built-in expression; the counting works on Arrow batches of words. A text's
counts never leave its row, so nothing is shuffled by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.carry import with_results
from tideline.functions.text import words

#: Words counted at a time, at least those of one text.
WORDS = 1 << 19


def slices_by_length(batch: pa.RecordBatch, lengths: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lengths add up to about ``most``; a longer row is alone."""
    held, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = held[start - 1] if start else 0
        end = max(int(np.searchsorted(held, before + most, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def list_lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def count_in_rows(lists: pa.Array) -> tuple[pa.ListArray, pa.ListArray]:
    """Distinct words and pairs of each list, and how often each occurs."""
    n = len(lists)
    flat = lists.flatten()
    owner = np.repeat(np.arange(n), list_lengths(lists))
    coded = flat.dictionary_encode()
    code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    size = len(known) + 1
    # word w is w * size; the pair w, x is w * size + x + 1
    together = np.flatnonzero(owner[:-1] == owner[1:]) if len(owner) else np.zeros(0, np.int64)
    terms = np.concatenate([code * size, code[together] * size + code[together + 1] + 1])
    rows = np.concatenate([owner, owner[together]])
    place = rows * (size * size) + terms
    place, times = np.unique(place, return_counts=True)
    rows, terms = np.divmod(place, size * size)
    left, right = np.divmod(terms, size)
    pairs = right > 0
    first = known.take(pa.array(left))
    second = known.take(pa.array(np.where(pairs, right - 1, 0))) if size > 1 else first
    strings = pc.if_else(pa.array(pairs), pc.binary_join_element_wise(first, second, " "), first)
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]), pa.int32())
    return pa.ListArray.from_arrays(ends, strings), pa.ListArray.from_arrays(ends, pa.array(times, pa.int64()))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices_by_length(batch, list_lengths(batch.column("value")), WORDS):
            terms, times = count_in_rows(part.column("value"))
            yield pa.RecordBatch.from_arrays([part.column("row"), terms, times], names=["row", "terms", "times"])


def with_term_counts(df: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """``df`` with ``terms`` (distinct words and pairs of neighbouring words) and ``times`` (how often each occurs).

    The text itself goes unless ``keep`` is set. Null and empty texts have no terms.
    """
    split = df.withColumn("_words", words(F.coalesce(F.col(text), F.lit(""))))
    return with_results(split if keep else split.drop(text), "_words", _count, "terms array<string>, times array<long>")


def term_counts(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Long table (key, term, tf); a row of ``df`` is a document. Nothing is shuffled."""
    counted = with_term_counts(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    pairs = counted.select("key", F.explode(F.arrays_zip("terms", "times")).alias("x"))
    return pairs.select(F.col("key").alias(key), F.col("x.terms").alias("term"), F.col("x.times").alias("tf"))


def top_terms(counts: DataFrame, size: int, min_df: int = 1) -> DataFrame:
    """Vocabulary: the ``size`` most frequent terms, ties in term order. The only shuffle by term."""
    totals = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))
    return totals.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(size)


def idf(df_count: Column, n_docs: Column) -> Column:
    """Smoothed inverse document frequency ln((1+n)/(1+df)) + 1."""
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df_count)) + F.lit(1.0)


def _weigh(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            for part in slices_by_length(batch, list_lengths(batch.column("value").field("terms")), 2 * WORDS):
                value, n = part.column("value"), part.num_rows
                lists = value.field("terms")
                place = pc.index_in(lists.flatten().cast(pa.string()), value_set=known)
                found = place.is_valid().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(n), list_lengths(lists))[found]
                at = place.drop_null().to_numpy(zero_copy_only=False)
                raw = value.field("times").flatten().to_numpy(zero_copy_only=False)[found] * weights[at]
                norm = np.sqrt(np.bincount(owner, raw * raw, n))
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())
                columns = [
                    part.column("row"),
                    pa.ListArray.from_arrays(ends, known.take(pa.array(at))),
                    pa.ListArray.from_arrays(ends, pa.array(raw / norm[owner])),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "terms", "weights"])

    return run


def tfidf_weights(df: DataFrame, vocabulary: DataFrame, n_docs: Column, key: str, text: str = "text") -> DataFrame:
    """Long table (key, term, weight): count times idf of the vocabulary's terms, rows of unit length.

    The vocabulary (term, df), as large as the caller chose, goes to every task. A document's weights
    are made inside its row; nothing is shuffled.
    """
    rows = vocabulary.select("term", idf(F.col("df"), n_docs).alias("w")).collect()
    known = pa.array([r["term"] for r in rows], pa.string()), np.array([r["w"] for r in rows], float)
    shared = df.sparkSession.sparkContext.broadcast(known)
    counted = with_term_counts(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    packed = counted.select("key", F.struct("terms", "times").alias("counts"))
    weighed = with_results(packed, "counts", _weigh(shared), "terms array<string>, weights array<double>")
    pairs = weighed.select("key", F.explode(F.arrays_zip("terms", "weights")).alias("x"))
    return pairs.select(F.col("key").alias(key), F.col("x.terms").alias("term"), F.col("x.weights").alias("weight"))
