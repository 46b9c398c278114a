"""Importance resampling towards a target distribution, on hashed runs of words.

Texts are cut into words by an Aho-Corasick automaton. Its dictionary holds the distinct words
of a block of texts, each between delimiters, with a payload: the word's CRC-32 and its length.
A scan of the block emits the payloads in order; the payloads of neighbouring words are composed
to the CRC of the words joined by a space, without touching the text again. The CRC modulo the
number of buckets is the feature. Bucket counts of the corpus and of the target give each
bucket's gain; a document's weight is the sum of gains, and the sample is drawn without
replacement by adding Gumbel noise from a hash of the document's id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.carry import with_results
from tideline.llm.common import durable, table
from tideline.llm.words import LOWER, slices, text_buffer
from tideline.numbering import in_ranges, number_in_ranges, range_starts

#: Bytes of text whose words share a dictionary.
BLOCK = 2 << 20
#: Longer words stand in the dictionary under a short name.
LONGEST = 256

_BYTES = np.arange(256)
_IN_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: Bytes as they are scanned: A-Z folded, all that is in no word a space.
_SCANNED = np.where(_IN_WORD[LOWER], LOWER, 0x20).astype(np.uint8).tobytes()


# CRC-32 of joined strings from the CRCs and lengths of the parts


def _step_operators() -> list[np.ndarray]:
    """Operator k: what 2**k zero bytes do to a CRC register, as the images of its 32 bits."""
    images = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        images = np.where(images & np.uint32(1), (images >> np.uint32(1)) ^ np.uint32(0xEDB88320), images >> np.uint32(1))
    out = [images]
    for _ in range(47):
        out.append(_apply(out[-1], out[-1]))
    return out


def _apply(operator: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), operator[bit], np.uint32(0))
    return out


_OPERATORS = _step_operators()


def compose(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with CRC ``crc`` followed by strings with CRC ``after`` and ``length`` bytes."""
    for k in range(int(length.max(initial=0)).bit_length()):
        on = np.flatnonzero(length >> k & 1)
        crc = crc.copy()
        crc[on] = _apply(_OPERATORS[k], crc[on])
    return crc ^ after


# the automaton


def _payloads(block: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``crc, length, text`` of every word of a block of scanned texts that are ended by line feeds.

    Words and texts are numbered in order; ``text`` is the number of the word's text.
    """
    words = set(block.replace("\n", " ").split(" "))
    words.discard("")
    short = {w: f"\0{i}" for i, w in enumerate(w for w in words if len(w) > LONGEST)}  # \0 is in no word
    if short:
        block = " ".join(short.get(w, w) for w in block.split(" "))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    automaton.add_word("\n", 0)
    crc, length = [0], [0]
    for word in words:
        raw = word.encode()
        automaton.add_word(f" {short.get(word, word)} ", len(crc))
        crc.append(zlib.crc32(raw))
        length.append(len(raw))
    automaton.make_automaton()
    found = np.fromiter((payload for _, payload in automaton.iter(block)), np.int64)
    text = np.cumsum(found == 0)[found > 0]
    found = found[found > 0]
    return np.array(crc, np.uint32)[found], np.array(length, np.int64)[found], text


def _blocks(texts: pa.Array) -> Iterator[tuple[int, str]]:
    """``number of the first text, block``: whole texts, or pieces of a long text that end between words."""
    raw, ptr = text_buffer(texts)
    for i in range(len(ptr) - 1):
        text = raw[ptr[i] : ptr[i + 1]].tobytes().translate(_SCANNED)
        start = 0
        while len(text) - start > BLOCK:
            end = text.find(b" ", start + BLOCK)
            if end < 0:
                break
            yield i, f" {text[start:end].decode()} "
            start = end
        yield i, f" {text[start:].decode()} \n"


def scan(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``crc, length, text`` of every word of all texts, in order; null has none."""
    parts, held, size, first = [], [], 0, 0

    def flush() -> None:
        crc, length, text = _payloads("".join(held))
        parts.append((crc, length, text + first))

    for i, block in _blocks(texts):
        if held and size + len(block) > BLOCK:
            flush()
            held, size, first = [], 0, i
        held.append(block)
        size += len(block)
    if held:
        flush()
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs(crc: np.ndarray, length: np.ndarray, text: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``crc, text`` of all runs of 1 to ``most`` neighbouring words of a text, joined by a space."""
    found, own = [crc], [text]
    space, one = np.uint32(zlib.crc32(b" ")), np.int64(1)
    head = crc
    for size in range(2, most + 1):
        n = len(crc) - size + 1
        if n <= 0:
            break
        joined = compose(head[:n], np.full(n, space), np.full(n, one))
        head = compose(joined, crc[size - 1 :], length[size - 1 :])
        same = text[:n] == text[size - 1 :]
        found.append(head[same])
        own.append(text[:n][same])
    return np.concatenate(found), np.concatenate(own)


def _features(most: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "value", BLOCK):
                crc, length, text = scan(part.column("value"))
                n = part.num_rows
                words = np.bincount(text, minlength=n)
                joined, owner = runs(crc, length, text, most)
                order = np.argsort(owner, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
                values = pa.array((joined[order] % np.uint32(buckets)).astype(np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(words, pa.int64()), pa.array(np.diff(ends), pa.int64()), lists],
                    names=["row", "n_words", "n_features", "buckets"],
                )

    return run


def features(docs: DataFrame, most: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_words``, ``n_features`` and ``buckets`` (one per feature).

    Words are runs of ASCII digits, letters (A-Z as a-z) and all other characters from U+0080 on.
    A feature is a run of 1 to ``most`` neighbouring words; a text without words, empty or null
    has none (an empty array). Rows are worked on one by one, so repeated rows and null ids do
    not matter; input columns with the names of the results are replaced.
    """
    return with_results(docs, text, _features(most, buckets), "n_words long, n_features long, buckets array<int>")


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``bucket, gain`` for every bucket that occurs in either: 1000 times the log of the smoothed ratio
    of its share in ``target`` to that in ``corpus``, rounded down. Both are results of ``features``."""
    count = lambda frame, name: frame.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    both = count(corpus, "s").join(count(target, "t"), "bucket", "full").select(
        "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("s", "t")]
    )
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weigh(gains):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gains.value
        for batch in batches:
            lists = batch.column("value")
            ends = np.asarray(lists.offsets)
            total = np.concatenate([[0], np.cumsum(table[np.asarray(lists.values)[ends[0] : ends[-1]]])])
            weight = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(weight, pa.int64())], names=["row", "weight"])

    return run


def weigh(found: DataFrame, gains: DataFrame, buckets: int = 10_000) -> DataFrame:
    """The columns of ``features`` but ``buckets``, with ``weight``: the sum of the gains of a row's features.

    The gains, ``buckets`` numbers at most, go to every task.
    """
    dense = np.zeros(buckets, np.int64)
    for row in gains.collect():
        dense[row["bucket"]] = row["gain"]
    shared = found.sparkSession.sparkContext.broadcast(dense)
    return with_results(found, "buckets", _weigh(shared), "weight long")


def gumbel(key: Column, seed: int) -> Column:
    """1000 times a Gumbel variate from a hash of ``key`` as text (null as 'null'), rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, most: int = 1,
    buckets: int = 10_000, seed: int = 2024, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_words, n_features, weight, score, rank``.

    Of the documents with ``min_words`` words, ``percent`` in a hundred (rounded down) are drawn: those
    with the highest score, ties to the smaller ``key`` (null last). ``rank`` is 1, 2, 3 ... in that
    order and null for documents not drawn. Rows of one key and text are equal in score and rank
    next to each other. ``docs`` or ``target`` may be empty: gains come from smoothed counts.
    """
    found = durable(features(docs, most, buckets, text))
    gains = bucket_gains(found, features(target.select(text), most, buckets, text), buckets)
    scored = weigh(found, gains, buckets).withColumn("score", (F.col("weight") + gumbel(F.col(key), seed)).cast("long"))
    names = [c for c in scored.columns if c.lower() != "rank"]
    # the rows travel in a struct, so that no column of theirs clashes with those of the ranking
    rows = durable(scored.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), (F.col("n_words") >= min_words).alias("fit"),
        (-F.col("score")).alias("down"), F.col(key).isNull().alias("last"), F.col(key).alias("key"),
    ))
    order = ["down", "last", "key"]
    ranged = durable(in_ranges(rows.where("fit"), order))
    starts = range_starts(ranged)
    everything = W.partitionBy(F.lit(0))
    quota = starts.withColumn("quota", F.floor(F.sum("_size").over(everything) * percent / F.lit(100)).cast("long"))
    quota = durable(quota)  # a row per range
    reached = quota.where("_start < quota").select("_range", "quota")
    numbered = number_in_ranges(ranged.join(F.broadcast(reached), "_range"), quota, order)
    top = numbered.select("row", F.when(F.col("_number") < F.col("quota"), F.col("_number") + 1).cast("long").alias("rank"))
    others = ranged.join(F.broadcast(quota.where("_start >= quota").select("_range")), "_range", "left_semi")
    undrawn = others.select("row").unionByName(rows.where(~F.col("fit")).select("row"))
    ranked = top.unionByName(undrawn.withColumn("rank", F.lit(None).cast("long")))
    return ranked.select(*[F.col(f"row.`{c}`").alias(c) for c in names], "rank")


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    benchmark = table(spark, folder, "benchmark").select("text")
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
SQL: dict[str, str] = {}
