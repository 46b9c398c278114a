"""BPE with word ends: encoding by a priority queue of merge ranks, and decoding.

A text is cut at the tokenizer's special tokens, normalised and split into words by the rules
in the tokenizer's file. The symbols of a word form a doubly linked list; a heap holds
``(rank, position)`` of every pair that merges. The least entry is taken; if its pair has
changed since it was pushed, it is stale and skipped; else the pair becomes one symbol and the
two pairs beside it are pushed. A word is merged once per worker while it is in the cache.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.carry import with_results
from tideline.llm.common import table
from tideline.llm.words import slices

#: Characters of the words whose ids a worker keeps, and of the longest such word.
CACHE_CHARS = 1 << 20
CACHED_WORD = 64
#: A pair's key is its left id, shifted, and its right id; a heap entry is a rank, shifted, and a position.
_SHIFT, _PLACE = 21, 40
_PLACES = (1 << _PLACE) - 1


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own = dict.fromkeys(prints)
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=1)
def new_characters() -> frozenset[str]:
    """Characters that the ``regex`` module knows and Python's older Unicode tables do not.

    Libraries may differ on these alone, so texts with one take the tokenizer's own rules.
    """
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(c for c in regex.findall(r"\P{Cn}", every) if unicodedata.category(c) == "Cn")


class WordBpe:
    """The rules of a tokenizer file of this kind: normaliser, word pattern, merges, special tokens."""

    def __init__(self, content: bytes):
        rules = json.loads(content)
        model, words = rules["model"], rules["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or rules["decoder"] is not None or words["behavior"] != "Removed" or not words["invert"]:
            raise ValueError("not a word-end BPE file")
        library = tokenizers.Tokenizer.from_str(content.decode())
        self.normalise = library.normalizer.normalize_str
        self.split = library.pre_tokenizer[0].pre_tokenize_str
        steps = [(x["type"], x.get("content")) for x in rules["normalizer"]["normalizers"]]
        # one space for several changes no word, as words hold no space
        self.plain = steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
        self.find = regex.compile(words["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        vocabulary = model["vocab"]
        self.special = {x["content"]: x["id"] for x in rules["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else lambda text: [text]
        end = model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = [vocabulary[c] for c in alphabet]
        self.last = [vocabulary[c + end] for c in alphabet]
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.ranks = {vocabulary[a] << _SHIFT | vocabulary[b]: rank for rank, (a, b) in enumerate(merges)}
        self.results = [vocabulary[a + b] for a, b in merges]

    def words(self, section: str) -> list[str]:
        """The words of a text without special tokens, normalised."""
        if self.plain:
            if section.isascii():
                return self.find(section.lower())
            if new_characters().isdisjoint(section):
                # a capital sigma has one lower form here, also at the end of a word
                return self.find(unicodedata.normalize("NFC", section).replace("\u03a3", "\u03c3").lower())
        return [word for word, _ in self.split(self.normalise(section))]

    def merge(self, word: str) -> list[int]:
        """The ids of one word."""
        raw = word.encode()
        n, rank = len(raw), self.ranks.get
        ids = [self.inner[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        heap = []
        for i in range(n - 1):
            r = rank(ids[i] << _SHIFT | ids[i + 1])
            if r is not None:
                heap.append(r << _PLACE | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        # plain lists are quicker, arrays smaller
        hold = list if n <= CACHED_WORD else lambda x: array("q", x)
        after, before = hold(range(1, n + 1)), hold(range(-1, n - 1))
        while heap:
            entry = heapq.heappop(heap)
            i = entry & _PLACES
            j = after[i]
            left = ids[i]
            if left < 0 or j >= n or rank(left << _SHIFT | ids[j]) != entry >> _PLACE:
                continue  # stale: a symbol of the pair has changed
            new = ids[i] = self.results[entry >> _PLACE]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(new << _SHIFT | ids[k])
                if r is not None:
                    heapq.heappush(heap, r << _PLACE | i)
            h = before[i]
            if h >= 0:
                r = rank(ids[h] << _SHIFT | new)
                if r is not None:
                    heapq.heappush(heap, r << _PLACE | h)
        return [x for x in ids if x >= 0]


def token_strings(content: bytes) -> pa.Array:
    """The vocabulary's strings, special tokens included, by id; null for an id that is not used."""
    rules = json.loads(content)
    ids = rules["model"]["vocab"] | {x["content"]: x["id"] for x in rules["added_tokens"]}
    out: list[str | None] = [None] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = token
    return pa.array(out, pa.large_string())


class Encoder:
    """Texts to ids, with the words met so far kept up to ``CACHE_CHARS`` characters."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.known, self.held = bpe, {}, 0

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit integers; none for null."""
        out = []
        for section in self.bpe.cut(text or ""):
            if section in self.bpe.special:
                out.append(np.array([self.bpe.special[section]], "<i4").tobytes())
            elif section:
                words = self.bpe.words(section)
                new = {x: np.array(self.bpe.merge(x), "<i4").tobytes() for x in set(words).difference(self.known)}
                look = self.known.get
                out.extend([look(x) or new[x] for x in words] if new else map(look, words))
                self.keep(new)
        return b"".join(out)

    def keep(self, new: dict[str, bytes]) -> None:
        for word, ids in new.items():
            if len(word) <= CACHED_WORD:
                if self.held > CACHE_CHARS:
                    self.known.clear()
                    self.held = 0
                self.known[word] = ids
                self.held += len(word)


#: By tokenizer file; a worker keeps its cache from task to task.
_loaded: dict[int, Encoder] = {}


def _encoder(content) -> Encoder:
    key = hash(content.value)
    if key not in _loaded:
        _loaded[key] = Encoder(WordBpe(content.value))
    return _loaded[key]


def _encode(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content)
        for batch in batches:
            for part in slices(batch, "value", 1 << 19):
                ids = [encoder.ids(x) for x in part.column("value").to_pylist()]
                ends = np.cumsum([0] + [len(x) // 4 for x in ids])
                flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                counts = pa.array(np.diff(ends), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("row"), counts, lists], names=["row", "n_tokens", "ids"])

    return run


def _decode(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(content.value)
        size = len(strings)
        for batch in batches:
            for part in _by_ids(batch, 1 << 20):
                lists = part.column("value")
                flat, owner = lists.flatten(), pc.list_parent_indices(lists)
                found = strings.take(pc.if_else(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, size)), flat, None))
                owner, found = owner.filter(found.is_valid()), found.drop_null()
                ends = np.searchsorted(owner.to_numpy(zero_copy_only=False), np.arange(len(lists) + 1))
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found), pa.scalar(" ", pa.large_string()))
                texts = pc.if_else(lists.is_valid(), joined, None).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("row"), texts], names=["row", "decoded"])

    return run


def _by_ids(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` ids in all."""
    held = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("value")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = held[start - 1] if start else 0
        end = max(int(np.searchsorted(held, before + most, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def read_rules(spark: SparkSession, path: str):
    """The tokenizer's file (a few MB: its vocabulary and merges) for all executors."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, rules, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but ``text``, with ``n_tokens`` and ``ids`` (array of int).

    Special tokens are found in texts, none are added. A null or empty text, or one of spaces
    alone, has no tokens (an empty array). Rows are worked on one by one, so repeated rows and
    null ids do not matter; input columns named n_tokens or ids are replaced. A text is in
    memory whole, and a word takes about 60 bytes a byte while it is merged.
    """
    return with_results(docs, text, _encode(rules), "n_tokens long, ids array<int>")


def decode(encoded: DataFrame, rules) -> DataFrame:
    """Adds ``decoded``: the vocabulary's strings of ``ids``, joined by a space.

    Ids that the vocabulary lacks are left out; null gives null, no ids give an empty string.
    An input column named decoded is replaced.
    """
    return with_results(encoded.withColumn("ids", F.col("ids").cast("array<int>")), "ids", _decode(rules), "decoded string", keep=True)


def digests(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The encoding of every text and its way back as hashes, without the ids themselves."""
    rules = read_rules(docs.sparkSession, path)
    both = decode(encode(docs, rules, text), rules)
    return both.withColumns(
        {
            "ids_sha256": F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    ).drop("decoded", "ids")


def op11_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op11_word_bpe": op11_word_bpe}
SQL: dict[str, str] = {}
