"""Word-end BPE against the tokenizers library."""

import hashlib
import random

import public_tokenizers
import pytest
import tokenizers

from tideline.llm import word_bpe
from tideline.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "a", "b", "the ", "'s", "'S", " ", "\n", "é", "é", "İ", "Σ", "<|endoftext|>", "<|start", "oftext|>", "1", "½",
    "!!", "…", "\x1c", "\x85", "　", "\x00", "ing", "tion", "日本", "\U0001f600", "<|startoftext|>", "Ᲊ", "\U00010d50",
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, "rb") as file:
        return word_bpe.Encoder(word_bpe.WordBpe(file.read()))


def own_ids(encoder, text):
    return word_bpe.np.frombuffer(encoder.ids(text), "<i4").tolist()


def test_random_texts_equal_the_library(encoder, library):
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        assert own_ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_words_and_a_full_cache(encoder, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_CHARS", 50)
    rng = random.Random(5)
    for n in (63, 64, 65, 5000):
        text = "".join(rng.choice("aeinorst") for _ in range(n))
        text = f"{text} then again {text}"
        assert own_ids(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_awkward_rows_and_clashing_columns(spark, library):
    texts = [None, "", " \n\t", "one", "one", "Mixed CASE é 12 <|endoftext|> x", "word " * 30000]
    schema = "doc_id long, text string, ids string, n_tokens string, decoded int, row long, value int, c0 int, `a b` int"
    docs = spark.createDataFrame([(i if i else None, t, "x", "y", 1, 2, 3, 4, 5) for i, t in enumerate(texts)], schema)
    rules = word_bpe.read_rules(spark, PATH)
    got = word_bpe.decode(word_bpe.encode(docs, rules), rules)
    assert sorted(got.columns) == sorted(["doc_id", "row", "value", "c0", "a b", "n_tokens", "ids", "decoded"])
    rows = {r["doc_id"] or 0: r for r in got.collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i]["ids"] == want and rows[i]["n_tokens"] == len(want)
        assert rows[i]["decoded"] == library.decode(want, skip_special_tokens=False)
        assert (rows[i]["row"], rows[i]["value"], rows[i]["c0"], rows[i]["a b"]) == (2, 3, 4, 5)
    none = docs.where("false")
    assert word_bpe.digests(none, PATH).count() == 0


def test_unknown_ids_are_left_out_and_null_stays_null(spark):
    rules = word_bpe.read_rules(spark, PATH)
    given = spark.createDataFrame([(1, [320, 99999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in word_bpe.decode(given, rules).collect()}
    assert got == {1: "a</w>", 2: None, 3: ""}


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, folder, "documents").collect()}
    got = word_bpe.op11_word_bpe(spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
