"""Benchmark passages in documents, by a distributed positional inverted index.

The index is partitioned by document: each row holds the postings of one document (terms of
the benchmark in order, and the positions of each), stored in the shared checkpoint folder.
A search reads it once. Within a batch of documents it lines the postings up by term, starts
every window at its rarest term (counted over the whole index), shifts that list by the
term's offset and intersects it with the shifted lists of the next rarest terms until all
terms of the window have met: exact phrases. Proximity matches are items whose ``NEAR_TERMS``
rarest terms meet within ``SLOP`` words. The benchmark is the query set; it is worked off in
blocks of about ``BLOCK_BYTES``, so neither its terms nor its windows outgrow a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import durable, table
from tideline.llm.words import ALNUM, LOWER, hashed_words, slices

WINDOW, SLOP, NEAR_TERMS = 10, 40, 3
BLOCK_BYTES = 8 << 20
#: Positions left free between documents of a batch; above the slop and the window.
GAP = 64
CHUNK = 1 << 20
_SHIFT = np.int64(38)  # positions of a batch fit in 38 bits, terms in the 25 above


class Windows:
    """The windows of a block of items, as term numbers; padded with -1."""

    def __init__(self, ids: list, texts: list, width: int):
        ptr, words = hashed_words(pa.array(texts, pa.large_string()), ALNUM, LOWER)
        self.terms = np.unique(words)
        number = np.searchsorted(self.terms, words)
        rows, items, sizes = [], [], []
        self.names = [None if x is None else str(x) for x in ids]
        self.of_item = []
        for i, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
            self.of_item.append(np.unique(number[a:b]))
            for s in range(a, max(a, b - width) + 1 if b > a else a):
                part = number[s : min(s + width, b)]
                rows.append(np.pad(part, (0, width - len(part)), constant_values=-1))
                items.append(i)
                sizes.append(len(part))
        self.rows = np.array(rows, np.int64).reshape(-1, width)
        self.items = np.array(items, np.int64)
        self.sizes = np.array(sizes, np.int64)

    def ranked(self, counts: np.ndarray, near_terms: int) -> Windows:
        """Offsets of each window's terms, and the terms of each item, from the rarest on."""
        cost = np.where(self.rows < 0, np.iinfo(np.int64).max, counts[self.rows])
        self.order = np.argsort(cost, axis=1, kind="stable")
        known = [t[counts[t] > 0] for t in self.of_item]  # a term that no document has is in no match
        self.rare = [t[np.argsort(counts[t], kind="stable")][:near_terms] for t in known]
        return self


def _postings(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ptr, words = hashed_words(part.column("text"), ALNUM, LOWER)
                at = np.minimum(np.searchsorted(terms, words), max(len(terms) - 1, 0))
                known = np.flatnonzero(terms[at] == words) if len(terms) else np.zeros(0, np.int64)
                doc = np.searchsorted(ptr, known, side="right") - 1
                term, pos = at[known].astype(np.int32), (known - ptr[doc]).astype(np.int32)
                order = np.lexsort((term, doc))  # stable: positions stay in order
                bounds = pa.array(np.searchsorted(doc, np.arange(len(ptr))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("key"),
                        pa.array(np.diff(ptr), pa.int64()),
                        pa.ListArray.from_arrays(bounds, pa.array(term[order])),
                        pa.ListArray.from_arrays(bounds, pa.array(pos[order])),
                    ],
                    names=["doc_id", "key", "n_words", "terms", "positions"],
                )

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, n = np.unique(batch.column("terms").flatten().to_numpy(zero_copy_only=False), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int32()), pa.array(n, pa.int64())], names=["term", "n"])


def _member(keys: np.ndarray, probe: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(probe), bool)
    at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
    return keys[at] == probe


def _phrases(keys: np.ndarray, w: Windows):
    """``starts, windows`` of the exact occurrences of windows in the lined-up postings."""
    first = w.rows[np.arange(len(w.rows)), w.order[:, 0]]
    lo, hi = np.searchsorted(keys, first << _SHIFT), np.searchsorted(keys, (first + 1) << _SHIFT)
    filled = np.cumsum(hi - lo)
    a = 0
    while a < len(first):
        done = filled[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(filled, done + CHUNK, side="right")))
        n = (hi - lo)[a:b]
        window = np.repeat(np.arange(a, b), n)
        entry = np.arange(n.sum()) + np.repeat(lo[a:b] - (np.cumsum(n) - n), n)
        start = (keys[entry] & ((np.int64(1) << _SHIFT) - 1)) - w.order[window, 0]
        for k in range(1, w.rows.shape[1]):
            if not len(window):
                break
            offset = w.order[window, k]
            term = w.rows[window, offset]
            ok = (term < 0) | _member(keys, (term << _SHIFT) | (start + offset))
            window, start = window[ok], start[ok]
        if len(window):
            yield start, window
        a = b


def _near(keys: np.ndarray, base: np.ndarray, w: Windows, slop: int):
    """``documents, items`` whose rarest terms meet within ``slop`` words of the rarest."""
    docs, items = [], []
    for i, rare in enumerate(w.rare):
        if len(rare) < 2:
            continue
        t = np.int64(rare[0])
        a, b = np.searchsorted(keys, [t << _SHIFT, (t + 1) << _SHIFT])
        pos = keys[a:b] & ((np.int64(1) << _SHIFT) - 1)
        for t in rare[1:].astype(np.int64):
            if not len(pos):
                break
            lo = np.searchsorted(keys, (t << _SHIFT) | (pos - slop))
            hi = np.searchsorted(keys, (t << _SHIFT) | (pos + slop + 1))
            pos = pos[hi > lo]
        if len(pos):
            found = np.unique(np.searchsorted(base, pos, side="right") - 1)
            docs.append(found)
            items.append(np.full(len(found), i))
    none = np.zeros(0, np.int64)
    return (np.concatenate(docs), np.concatenate(items)) if docs else (none, none)


def _lists(doc: np.ndarray, n: int, values) -> pa.Array:
    bounds = np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), values)


def _search(w: Windows, slop: int):
    names = pa.array(w.names, pa.string())

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        words = batch.column("n_words").to_numpy(zero_copy_only=False)
        base = np.concatenate([[GAP], GAP + np.cumsum(words + GAP)]).astype(np.int64)
        held = np.diff(batch.column("terms").offsets.to_numpy())
        term = batch.column("terms").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        pos = batch.column("positions").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        keys = np.sort((term << _SHIFT) | (pos + np.repeat(base[:-1], held)))
        starts, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, x in _phrases(keys, w) if len(w.rows) else ():
            starts.append(s)
            windows.append(x)
        start, window = np.concatenate(starts), np.concatenate(windows)
        # spans that touch or overlap become one
        end = start + w.sizes[window] if len(window) else start
        order = np.argsort(start, kind="stable")
        s, reach = start[order], np.maximum.accumulate(end[order]) if len(end) else end
        new = np.ones(len(s), bool)
        new[1:] = s[1:] > reach[:-1]
        lead = np.flatnonzero(new)
        from_, to = s[lead], reach[np.append(lead[1:], len(s)) - 1] if len(lead) else s[:0]
        span_doc = np.searchsorted(base, from_, side="right") - 1
        spans = pa.StructArray.from_arrays(
            [pa.array(from_ - base[span_doc], pa.int64()), pa.array(to - from_, pa.int64())], names=["start", "length"]
        )
        pair = np.unique(np.stack([np.searchsorted(base, start, side="right") - 1, w.items[window]]), axis=1) if len(window) else np.zeros((2, 0), np.int64)
        near_doc, near_item = _near(keys, base, w, slop)
        order = np.argsort(near_doc, kind="stable")
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("key"),
                batch.column("n_words"),
                _lists(span_doc, n, spans),
                _lists(pair[0], n, names.take(pa.array(pair[1]))),
                _lists(near_doc[order], n, names.take(pa.array(near_item[order]))),
            ],
            names=["doc_id", "key", "n_words", "spans", "items", "near_items"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a slice of rows keeps positions of the batch small and memory bounded
            size = np.cumsum(np.diff(batch.column("terms").offsets.to_numpy()))
            a = 0
            while a < batch.num_rows:
                done = size[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(size, done + 4 * CHUNK, side="right")))
                yield one(batch.slice(a, b - a))
                a = b

    return run


FOUND = (
    "doc_id long, key long, n_words long, spans array<struct<start:bigint,length:bigint>>, "
    "items array<string>, near_items array<string>"
)


def index(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Stored postings: ``doc_id, key, n_words, terms, positions`` of every row of ``docs``.

    ``terms`` are the sorted hashes to index. Null texts have no words.
    """
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    return durable(
        rows.mapInArrow(
            _postings(terms), "doc_id long, key long, n_words long, terms array<int>, positions array<int>"
        )
    )


def search(postings: DataFrame, windows: Windows, slop: int = SLOP, near_terms: int = NEAR_TERMS) -> DataFrame:
    """Exact and proximity matches of a block of items in stored postings."""
    found = postings.select("terms").mapInArrow(_counts, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(windows.terms) + 1, np.int64)
    for row in found.collect():  # at most the terms of one block
        counts[row["term"]] = row["n"]
    return postings.mapInArrow(_search(windows.ranked(counts, near_terms), slop), FOUND)


def matches(
    docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, slop: int = SLOP, near_terms: int = NEAR_TERMS
) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: word count, spans hit and matched items.

    ``benchmark`` has item_id and text. spans are disjoint word ranges covered by exact windows
    of ``width`` words; an item of fewer words is one window, one without words has none. items
    and near_items hold distinct item ids as text (an item without an id counts in spans only).
    Null texts have no words; an empty benchmark gives empty matches; extra columns are ignored.
    ``width`` and ``slop`` of ``GAP`` words or more are refused: they would reach into other documents.
    """
    if max(width, slop) >= GAP:
        raise ValueError(f"width {width} and slop {slop} must be under {GAP} words")
    queries = benchmark.select("item_id", "text").distinct()
    total = queries.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = int(total // BLOCK_BYTES) + 1
    parts = []
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        windows = Windows([r["item_id"] for r in rows], [r["text"] for r in rows], width)
        parts.append(search(index(docs, windows.terms), windows, slop, near_terms))
    if blocks == 1:
        return _tidy(parts[0])
    merged = parts[0].withColumn("block", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        merged = merged.union(part.withColumn("block", F.lit(i)))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    merged = merged.groupBy("doc_id", "key", "n_words").agg(
        flat("spans"), flat("items"), flat("near_items"), F.count_if(F.col("block") == 0).alias("rows")
    )
    covered = F.array_sort("spans")
    # windows of different blocks may overlap: cut every span at the reach of those before it
    joined = F.aggregate(
        covered,
        F.struct(F.lit(0).cast("long").alias("reach"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["reach"], x["start"] + x["length"]).alias("reach"),
            F.when(
                x["start"] + x["length"] > a["reach"],
                F.concat(
                    a["out"],
                    F.array(
                        F.struct(
                            F.greatest(a["reach"], x["start"]).alias("start"),
                            (x["start"] + x["length"] - F.greatest(a["reach"], x["start"])).alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(a["out"])
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    merged = merged.withColumn("spans", joined).withColumn("rows", F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int"))))
    return _tidy(merged)


def _tidy(found: DataFrame) -> DataFrame:
    ids = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull()))).alias(c)
    return found.select("doc_id", "key", "n_words", "spans", ids("items"), ids("near_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an exact benchmark passage; columns as given, whatever their names.

    Rows with null or empty texts stay; of repeated rows all stay or go.
    """
    hit = matches(docs, benchmark).where(F.size("spans") > 0).select("key").distinct()
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    return keyed.join(hit, "key", "left_anti").select("row.*")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


QUERIES = {"op9_decontamination": op9_decontamination}
_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)
SQL = {
    "op9_decontamination": f"""
WITH d AS (
    SELECT doc_id, {_SQL_WORDS} AS w FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT item, w, least({WINDOW}, len(w)) AS n, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i
          FROM items WHERE len(w) > 0)
), lengths AS (
    SELECT DISTINCT n FROM windows
), grams AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)
), hits AS (
    SELECT doc_id, i, n, item FROM grams JOIN windows USING (n, g)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
}
