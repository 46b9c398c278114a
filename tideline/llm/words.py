"""Words of whole texts as 64-bit hashes, for Arrow batches inside tasks.

A word class is a table over byte values, so a text is cut in one vectorised pass over its
UTF-8 bytes. Null texts have no words. Texts are worked on in pieces of about ``PIECE`` bytes
that end between words, so memory does not depend on the length of a text (one word longer
than a piece makes the piece longer).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_bytes = np.arange(256)
#: Everything but space and \t to \r.
NOT_SPACE = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
#: ASCII digits, a to z (after folding) and every byte of a non-ASCII character.
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
#: A-Z to a-z, other bytes as they are.
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + right + np.uint64(1))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def text_buffer(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each starts; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ptr = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ptr[0] : ptr[-1]], ptr - ptr[0]


def _pieces(inside: np.ndarray, cuts: np.ndarray, size: int):
    """Ranges of about ``size`` bytes that never cut a word."""
    start, n = 0, len(inside)
    while start < n:
        end = start + size
        while end < n and inside[end - 1] and inside[end] and not cuts[end]:
            stop = min(end + size, n)
            gap = np.flatnonzero(~inside[end:stop] | cuts[end:stop])
            end = end + int(gap[0]) if len(gap) else stop
        yield start, min(end, n)
        start = end


def hashed_words(texts, word: np.ndarray, fold: np.ndarray | None = None, spans: bool = False):
    """``ptr, hashes``: words of text i are ``hashes[ptr[i]:ptr[i + 1]]``, in text order.

    ``fold`` maps bytes before cutting and hashing. With ``spans`` also the byte ranges of the
    words within the joined buffer of ``text_buffer``.
    """
    raw, ptr = text_buffer(texts)
    n = len(raw)
    cuts = np.zeros(n + 1, bool)
    cuts[ptr] = True
    inside = word[raw] if fold is None else word[fold[raw]]
    starts, ends, hashes = [], [], []
    for a, b in _pieces(inside, cuts, PIECE):
        w, c = inside[a:b], cuts[a:b].copy()
        c[0] = True
        before = np.zeros(b - a, bool)
        before[1:] = w[:-1]
        s = np.flatnonzero(w & (~before | c))
        after = np.zeros(b - a, bool)
        after[:-1] = w[1:] & ~c[1:]
        e = np.flatnonzero(w & ~after) + 1
        if not len(s):
            continue
        x = raw[a:b] if fold is None else fold[raw[a:b]]
        size = max(PIECE, 1 << (b - a - 1).bit_length()) if b - a > 1 else PIECE
        up, down = _powers(size)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        hashes.append(mix(h + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
        starts.append(s + a)
        ends.append(e + a)
    none = np.zeros(0, np.int64)
    s = np.concatenate(starts) if starts else none
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    where = np.searchsorted(s, ptr)
    if not spans:
        return where, h
    return where, h, s, np.concatenate(ends) if ends else none


def owner(ptr: np.ndarray) -> np.ndarray:
    """For each word, the number of its text."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def slices(batch: pa.RecordBatch, column: str, size: int = 8 << 20):
    """The batch in runs of rows whose texts hold about ``size`` bytes; a longer text is alone."""
    if not batch.num_rows:
        return
    n = np.nan_to_num(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    filled, start = 0, 0
    for i, x in enumerate(n.tolist()):
        if filled and filled + x > size:
            yield batch.slice(start, i - start)
            start, filled = i, 0
        filled += x
    yield batch.slice(start)
