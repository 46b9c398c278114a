"""Byte-level BPE encoding and decoding with segment trees.

A text is split by the tokenizer's pattern; each piece is merged on its own. The leaves of a
segment tree stand for the byte positions of a piece and hold the rank of the pair that starts
there with the next live position; a node holds the leftmost minimum below it. The root names
the next merge, which changes three leaves (the merged position, its dead neighbour and the
live position before) in logarithmic time. Pieces of equal tree size are merged side by side
in numpy arrays; pieces longer than ``WIDE`` bytes have a tree of their own.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.carry import with_results
from tideline.llm.common import table
from tideline.llm.words import slices

WIDE = 64
CACHE = 1 << 18
_NONE = np.int64(1 << 60)


def rank_tokens(content: bytes) -> list[bytes]:
    """The bytes of each token, by rank."""
    ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.splitlines())}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Ranks:
    """A rank file as arrays: the rank that each pair of tokens merges to."""

    def __init__(self, content: bytes):
        ranks = {token: rank for rank, token in enumerate(rank_tokens(content)) if token}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.results = np.array([pairs[k] for k in self.keys.tolist()], np.int64)

    def merge(self, left: int, right: int) -> int | None:
        key = left << 20 | right
        at = int(np.searchsorted(self.keys, key))
        return int(self.results[at]) if at < len(self.keys) and self.keys[at] == key else None

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``_NONE`` where it does not merge; -1 stands for no token."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.results[at], _NONE)


def _merge_rows(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    """Merges rows of byte tokens (-1 beyond a row's end) in place; dead positions become -1."""
    n, size = ids.shape
    tree = np.full((n, 2 * size), _NONE, np.int64)
    pair = np.full((n, size), _NONE, np.int64)
    pair[:, :-1] = ranks.merged(ids[:, :-1], ids[:, 1:])
    tree[:, size:] = np.where(pair < _NONE, pair * size + np.arange(size), _NONE)
    for node in range(size - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    after = np.tile(np.arange(1, size + 1), (n, 1))  # `size` where there is none
    before = np.tile(np.arange(-1, size - 1), (n, 1))
    after[np.arange(n), np.maximum((ids >= 0).sum(1) - 1, 0)] = size
    rows = np.flatnonzero(tree[:, 1] < _NONE)
    while len(rows):
        best = tree[rows, 1]
        i, rank = best % size, best // size
        j = after[rows, i]
        k = after[rows, j]
        p = before[rows, i]
        ids[rows, i] = rank
        ids[rows, j] = -1
        after[rows, i] = k
        more = k < size
        before[rows[more], k[more]] = i[more]
        right = np.where(more, ids[rows, np.minimum(k, size - 1)], -1)
        left = np.where(p >= 0, ids[rows, np.maximum(p, 0)], -1)
        own, prior = ranks.merged(rank, right), ranks.merged(left, rank)
        tree[rows, size + j] = _NONE
        tree[rows, size + i] = np.where(own < _NONE, own * size + i, _NONE)
        held = p >= 0
        tree[rows[held], size + p[held]] = np.where(prior < _NONE, prior * size + p, _NONE)[held]
        where = np.concatenate([rows, rows, rows[held]])
        node = np.concatenate([i, j, p[held]]) + size
        while node[0] > 1:
            node = node >> 1
            tree[where, node] = np.minimum(tree[where, 2 * node], tree[where, 2 * node + 1])
        rows = rows[tree[rows, 1] < _NONE]
    return ids


def _merge_long(piece: bytes, ranks: Ranks) -> list[int]:
    """One long piece with its own tree in lists."""
    ids = ranks.bytes[np.frombuffer(piece, np.uint8)].tolist()
    n, none = len(ids), int(_NONE)
    size = 1 << (n - 1).bit_length()
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = ranks.merge(ids[i], ids[i + 1])
        if rank is not None:
            tree[size + i] = rank * size + i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def put(i: int) -> None:
        k = after[i]
        rank = ranks.merge(ids[i], ids[k]) if k < n else None
        set_leaf(i, none if rank is None else rank * size + i)

    def set_leaf(i: int, value: int) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node >>= 1
            value = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == value:
                break
            tree[node] = value

    while tree[1] < none:
        rank, i = divmod(tree[1], size)
        j = after[i]
        ids[i], live[j], after[i] = rank, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        set_leaf(j, none)
        put(i)
        if before[i] >= 0:
            put(before[i])
    return [x for x, on in zip(ids, live, strict=True) if on]


def encode_pieces(pieces: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each piece as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    groups: dict[int, list[int]] = {}
    for at, piece in enumerate(pieces):
        if len(piece) > WIDE:
            out[at] = np.array(_merge_long(piece, ranks), "<u4").tobytes()
        elif piece:
            groups.setdefault(1 << max(1, (len(piece) - 1).bit_length()), []).append(at)
    for size, own in groups.items():
        for a in range(0, len(own), 1 << 12):
            some = own[a : a + (1 << 12)]
            raw = np.frombuffer(b"".join(pieces[x].ljust(size, b"\0") for x in some), np.uint8).reshape(-1, size)
            n = np.array([len(pieces[x]) for x in some])
            ids = np.where(np.arange(size) < n[:, None], ranks.bytes[raw], -1)
            ids = _merge_rows(ids, ranks)
            live = ids >= 0
            blob = ids[live].astype("<u4").tobytes()
            ends = 4 * np.cumsum(live.sum(1))
            start = 0
            for x, end in zip(some, ends.tolist(), strict=True):
                out[x] = blob[start:end]
                start = end
    return out


#: Pieces already merged in this worker, by rank file; emptied when full.
_known: dict[int, dict[str, bytes]] = {}
_loaded: dict[int, Ranks] = {}


def _ranks(content: bytes) -> tuple[Ranks, dict[str, bytes]]:
    key = hash(content)
    if key not in _loaded:
        _loaded[key], _known[key] = Ranks(content), {}
    return _loaded[key], _known[key]


def _encode(content, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, known = _ranks(content.value)
        split = regex.compile(pattern).findall
        for batch in batches:
            for part in slices(batch, "value", 1 << 20):
                if len(known) > CACHE:
                    known.clear()
                texts = [split(x) if x else [] for x in part.column("value").to_pylist()]
                new = list(set().union(*texts).difference(known))
                known.update(zip(new, encode_pieces([x.encode() for x in new], ranks), strict=True))
                ids = [b"".join(map(known.__getitem__, x)) for x in texts]
                for piece in new:
                    if len(piece) > WIDE:
                        del known[piece]  # so the cache is bounded in bytes too
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.large_binary())],
                    names=["row", "n_tokens", "ids"],
                )
        known.clear()  # an idle worker holds no more than the ranks

    return run


def _decode(content):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = rank_tokens(content.value).__getitem__
        for batch in batches:
            for part in slices(batch, "value", 1 << 20):
                ids = part.column("value").to_pylist()
                raw = [None if x is None else b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(raw, pa.large_binary())], names=["row", "decoded"])

    return run


def read_ranks(spark: SparkSession, path: str):
    """The rank file (a few MB at most by its format) for all executors."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, ranks, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Every column of ``docs`` but text, ``n_tokens``, and ``ids`` as little-endian uint32.

    A null or empty text has no tokens. Columns named n_tokens or ids are replaced, others may have
    any name. Rows are worked on one by one, so repeated rows and ids do not matter.
    """
    return with_results(docs, "text", _encode(ranks, pattern), "n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks) -> DataFrame:
    """Adds ``decoded``: the bytes that ``ids`` stand for; null for null. A column of that name is replaced."""
    return with_results(encoded, "ids", _decode(ranks), "decoded binary", keep=True)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The encoding of every text and its way back, with hashes of both; text is left out.

    Columns named n_tokens, ids, ids_sha256 or decoded_sha256 are replaced; all others stay.
    """
    ranks = read_ranks(docs.sparkSession, path)
    results = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    names = [c for c in docs.columns if c.lower() not in ("text", *results)]
    row = F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    both = decode(encode(docs.select(row.alias("row"), "text"), ranks), ranks)
    return both.select(
        *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)],
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("ids")


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
SQL: dict[str, str] = {}
