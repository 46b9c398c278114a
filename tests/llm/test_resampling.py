"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import resampling
from tideline.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def bucket_lists(texts, most, buckets):
    out = []
    for text in texts:
        w = WORD.findall(lower(text))
        grams = [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]
        out.append((len(w), [zlib.crc32(g.encode()) % buckets for g in grams]))
    return out


def expected(docs, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    found, other = bucket_lists([t for _, t in docs], most, buckets), bucket_lists(target, most, buckets)
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for counts, lists in ((s, found), (t, other)):
        for _, own in lists:
            np.add.at(counts, own, 1)
    gain = lambda b: math.floor(1000 * math.log(float((t[b] + 1) * (s.sum() + buckets)) / float((s[b] + 1) * (t.sum() + buckets))))
    rows = []
    for (key, _), (words, own) in zip(docs, found, strict=True):
        h = int(hashlib.sha256(f"{seed}:{'null' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        rows.append([key, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for n, row in enumerate(fit[: percent * len(fit) // 100]):
        row[5] = n + 1
    return rows


def place(r):
    return tuple((x is not None, x or 0) for x in r)


def compared(got, want):
    assert sorted(map(tuple, got), key=place) == sorted(map(tuple, want), key=place)


def test_composed_checksums_equal_those_of_joined_strings():
    rng = random.Random(2)
    left = [bytes(rng.randrange(256) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    right = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 300, 5000]))) for _ in range(300)]
    crc = lambda x: np.array([zlib.crc32(y) for y in x], np.uint32)
    got = resampling.compose(crc(left), crc(right), np.array([len(x) for x in right], np.int64))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right, strict=True)]


def test_scan_finds_every_word_also_over_blocks(monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 200)
    rng = random.Random(3)
    parts = ["a", "B", "ab", " ", "  ", ".", "\n", "é", "日本", " ", "\u0085", "\x00", "7", "x" * 300, "y" * 700, "-"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", "z" * 5000, " ".join(["y" * 400] * 5), "end"]
    crc, length, text = resampling.scan(pa.array(texts))
    want = [(zlib.crc32(w.encode()), len(w.encode()), i) for i, t in enumerate(texts) for w in WORD.findall(lower(t))]
    assert list(zip(crc.tolist(), length.tolist(), text.tolist())) == want


@pytest.mark.parametrize("most,buckets", [(1, 10_000), (3, 97)])
def test_features_and_sample_equal_plain_python(spark, most, buckets):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["Éa", "über", "W1"]
    texts = [None, "", "... \n", "one", "one"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    docs = [(None if i == 3 else i, t) for i, t in enumerate(texts)] + [(2**60, "w1 w2 " * 20000), (9, texts[9]), (9, texts[9])]
    schema = "doc_id long, text string, rank string, row int, weight int, `_range` int, fit int, key int"
    frame = spark.createDataFrame([(*d, "r", 1, 2, 3, 4, 5) for d in docs], schema).repartition(3)
    target = ["w3 w4 w5", None, "w1 w1 Über"]
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(frame, other, percent=30, most=most, buckets=buckets)
    assert sorted(got.columns) == sorted(["doc_id", "row", "_range", "fit", "key", "n_words", "n_features", "weight", "score", "rank"])
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    compared([[r[n] for n in names] for r in got.collect()], expected(docs, target, most, buckets, 30))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 30)], "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0
    compared([[r[n] for n in ("doc_id", "n_words", "n_features", "weight", "score", "rank")] for r in resampling.resample(some, none, percent=100).collect()], expected([(1, "a b c " * 30)], [], percent=100))


def test_query_equals_plain_python(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    target = [r["text"] for r in table(spark, folder, "benchmark").collect()]
    want = [[r[0], *r[2:]] for r in expected(docs, target)]
    compared(resampling.op13_importance_resampling(spark, folder).collect(), want)
