"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct shingles of ``width`` words (all words as one shingle if it
has fewer, nothing if it has none). Documents with equal sets form a class; the rest works on
classes. A sketch holds the ``SKETCH`` smallest hashes of a set, as longs of the same order.

0. A class whose sketch shares too few values with sketches of sets of a fitting size, for any
   union sketch with one of them to pass step 2, is linked with nothing and leaves. What leaves
   can take others with it, so this is done ``ROUNDS`` times; no pair that passes step 2 is lost.
1. A class's shared values are put in one order for all classes, rarest first. Two classes that
   share ``c`` of them meet in a value that is followed by ``c - 1`` of either at least, so only
   values with enough after them are listed: common passages are at the end and give no lists.
   A list of at most ``SHORT`` classes gives its pairs. In longer lists each class is paired with
   ``HUBS`` hubs.
2. The union sketch of a pair estimates its similarity; clear misses are left out.
3. The exact Jaccard of the full sets decides. First every class is verified against its best
   two partners only, which joins most of a large group; then all candidates left between
   different components are verified. Within the long lists, classes outside the list's largest
   component meet all others by their sketches, in blocks of at most about ``SPAN * BLOCK``, and
   what these join meets by full sets in blocks of about ``BLOCK``, from which only links come
   out. So no link between components is left out, and a large group never becomes all of its
   pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import components, durable, table
from tideline.llm.words import LOWER, NOT_SPACE, chain, hashed_words, mix, slices

SKETCH, SHORT, HUBS, SPAN, BLOCK = 48, 16, 4, 4, 1024
#: The smaller half of a sketch, which may be all a set's own.
KEYS = SKETCH // 2
#: Bytes of full sets in a block.
BYTES = 16 << 20
#: Bytes of texts whose sets are made at a time.
SLICE = 1 << 19
#: Places of the bitmap that sifts rows by their ids (2 MB).
SIEVE = 1 << 24
#: Rounds of leaving out classes that share too little; steps of size in the ratio of two linked sets.
ROUNDS, STEPS = 2, 4
#: Shared values of a union sketch below which a pair at the threshold falls with a chance
#: of about 1e-8 (binomial tail for 48 draws at 0.8), as standard deviations.
SLACK = 5.5


def shingle_sets(texts, width: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's set as sorted distinct 64-bit hashes."""
    ptr, words = hashed_words(texts, NOT_SPACE, LOWER)
    joined = words
    for k in range(1, width):
        joined = chain(joined[: len(words) - k], words[k:]) if len(words) > k else joined[:0]
    sets = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= width:
            sets.append(np.unique(joined[a : b - width + 1]))
        elif b > a:
            h = words[a : a + 1]
            for k in range(a + 1, b):
                h = chain(h, words[k : k + 1])
            sets.append(h)
        else:
            sets.append(words[:0])
    return sets


def ordered(x: np.ndarray) -> np.ndarray:
    """Unsigned values as longs in the same order, which Spark's sorting keeps."""
    return (x ^ np.uint64(1 << 63)).view(np.int64)


def _digest(x: np.ndarray) -> bytes | None:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), width)
                low = [ordered(np.sort(x)[:k]) for x in sets]  # hashes are mixed already
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array([_digest(x) for x in sets], pa.binary()),
                        pa.array(low, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "class", "sketch"],
                )
        pa.default_memory_pool().release_unused()  # the worker stays beside the joins that follow

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([_digest(x) for x in sets], pa.binary()),
                        pa.array([x.tobytes() for x in sets], pa.large_binary()),
                    ],
                    names=["class", "full"],
                )
        pa.default_memory_pool().release_unused()

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xs").to_pylist(), batch.column("ys").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def sketches(docs: DataFrame, width: int, k: int = SKETCH) -> DataFrame:
    """``doc_id, n_shingles, class, sketch`` of every row; class is null for an empty set."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketches(width, k), "doc_id long, n_shingles long, class binary, sketch array<bigint>"
    )


def _scored(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and union sketch allow the similarity, with the estimate."""
    side = lambda s: classes.select(
        F.col("class").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}")
    )
    t = percent / 100
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    both = both.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny"))
    both = both.withColumn(
        "low", F.slice(F.array_sort(F.array_union("sx", "sy")), 1, SKETCH)
    ).select("x", "y", F.size("low").alias("of"), F.size(F.array_intersect(F.array_intersect("sx", "sy"), "low")).alias("hit"))
    slack = SLACK * F.sqrt(t * (1 - t) * F.col("of"))
    return both.where(F.col("hit") >= t * F.col("of") - slack).select("x", "y", (F.col("hit") / F.col("of")).alias("est"))


def _sifted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``_in``: true if the doc_id is one of ``ids``, and for few others.

    A bitmap of bounded size goes to every task, so texts need not be shuffled to be told apart.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE))
    bit = place.bitwiseAND(F.lit(63)).cast("int")
    slot = F.shiftright(place, 6)
    places = ids.select(slot.alias("_slot"), bit.alias("bit"))
    sieve = places.groupBy("_slot").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_bits"))
    rows = docs.withColumn("_slot", slot).join(F.broadcast(sieve), "_slot", "left")
    return rows.withColumn("_in", F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))).select(*docs.columns, "_in")


def _sets(needed: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``class, full`` of the needed classes, from the text of one document of each."""
    ids = durable(needed.join(classes.select("class", F.col("first").alias("doc_id")), "class").select("doc_id").distinct())
    texts = _sifted(docs.select("doc_id", "text"), ids).where("_in").drop("_in")
    full = texts.join(ids, "doc_id", "left_semi").mapInArrow(_full_sets(width), "class binary, full binary")
    return durable(full.where("class is not null").groupBy("class").agg(F.first("full").alias("full")))


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets have the similarity; full sets are made for these alone."""
    full = _sets(pairs.select(F.col("x").alias("class")).union(pairs.select("y")).distinct(), docs, classes, width)
    joined = pairs.join(full.toDF("x", "xs"), "x").join(full.toDF("y", "ys"), "y")
    return durable(joined.select("x", "y", "xs", "ys").mapInArrow(_exact(percent), "x binary, y binary"))


def _pair(a: str, b: str):
    return F.least(a, b).alias("x"), F.greatest(a, b).alias("y")


def _way(node: str, partner: str):
    return F.struct(F.col(node).alias("node"), F.col(partner).alias("partner"))


def _shared(values: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
    """How many values the sets of ``rows`` have in common with every set."""
    n = np.array([len(x) for x in values])
    _, inverse, count = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(values)), n)
    common = count[inverse] > 1  # a value of one set alone is in no intersection
    number = (np.cumsum(count > 1) - 1)[inverse[common]]
    row = row[common]
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    both = np.zeros((len(rows), len(values)), np.float32)
    most = int(number[-1]) + 1 if len(number) else 0
    width = min(most, max(1, (1 << 22) // len(values)))
    for start in range(0, most, width or 1):
        lo, hi = np.searchsorted(number, [start, start + width])
        held = np.zeros((len(values), width), np.float32)
        held[row[lo:hi], number[lo:hi] - start] = 1
        both += held[rows] @ held.T
    return both


def _outside(part: np.ndarray) -> np.ndarray:
    """The rows outside the largest component: one of two rows of different components is one of these."""
    return np.flatnonzero(part != np.bincount(part).argmax())


def _parts(roots: pa.Array) -> np.ndarray:
    """Components as numbers."""
    return roots.combine_chunks().dictionary_encode().indices.to_numpy()


def _sketches_allow(low: list[np.ndarray], rows: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches of ``rows`` and of every row, as far as both reach, allow the similarity.

    Of the values up to the end of the shorter reach it is known of each whether both sets hold it;
    they are as many as the union sketch has at least, and draws from the union like these.
    """
    t = percent / 100
    both = _shared(low, rows)
    # a sketch that is not full is the whole set
    reach = np.array([x[-1] if len(x) == SKETCH else np.iinfo(x.dtype).max for x in low])
    of = np.stack([np.searchsorted(low[i], reach, "right") for i in rows]).astype(np.float32)
    of += np.stack([np.searchsorted(x, reach[rows], "right") for x in low], axis=1)
    of -= both
    return both >= t * of - SLACK * np.sqrt(t * (1 - t) * of)


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what a symmetric relation of rows joins, and no more of them than that takes."""
    seen = np.zeros(len(near), bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in np.flatnonzero(near.any(1)).tolist():
        if seen[start]:
            continue
        front = np.array([start])
        seen[start] = True
        while len(front):
            reach = near[front]
            new = np.flatnonzero(reach.any(0) & ~seen)
            left.append(front[reach[:, new].argmax(0)])
            right.append(new)
            seen[new] = True
            front = new
    return np.concatenate(left), np.concatenate(right)


def _block_survivors(percent: int):
    """Pairs that join the classes of a block as the sketches of different components allow."""

    def run(block: pa.Table) -> pa.Table:
        part = _parts(block.column("root"))
        n = block.column("n").to_numpy()
        low = [np.array(x, np.int32) for x in block.column("sketch").to_pylist()]
        rows = _outside(part)
        near = np.zeros((len(part), len(part)), bool)
        if len(rows):
            allowed = _sketches_allow(low, rows, percent)
            allowed &= 100 * np.minimum(n[rows, None], n) >= percent * np.maximum(n[rows, None], n)
            allowed &= part[rows, None] != part
            near[rows] = allowed
            near |= near.T
        i, j = _forest(near)
        names = block.column("class").combine_chunks()
        return pa.table({"p": names.take(pa.array(i)), "q": names.take(pa.array(j))})

    return run


def _block_links(percent: int):
    """Links between different components in one block of sets; enough of them to join all that are linked."""

    def run(block: pa.Table) -> pa.Table:
        classes = block.column("class").to_pylist()
        part = _parts(block.column("root"))
        sets = [np.frombuffer(x, np.uint64) for x in block.column("full").to_pylist()]
        n = np.array([len(x) for x in sets])
        rows = _outside(part)
        both = _shared(sets, rows)
        linked = (100 * both >= percent * (n[rows, None] + n - both)) & (part[rows, None] != part)
        names = list(range(int(part.max()) + 1))

        def find(x: int) -> int:
            while names[x] != x:
                names[x] = names[names[x]]
                x = names[x]
            return x

        xs, ys = [], []
        i, j = np.nonzero(linked)
        i = rows[i]
        # one link of every two components is enough
        _, one = np.unique(part[i] * len(names) + part[j], return_index=True)
        for i, j in zip(i[one].tolist(), j[one].tolist(), strict=True):
            p, q = find(int(part[i])), find(int(part[j]))
            if p != q:
                names[p] = q
                xs.append(min(classes[i], classes[j]))
                ys.append(max(classes[i], classes[j]))
        return pa.table({"x": pa.array(xs, pa.binary()), "y": pa.array(ys, pa.binary())})

    return run


def _blocks(rows: DataFrame, percent: int, most: int, size: int) -> DataFrame:
    """``class, root, n`` of lists (``value, length``) in the blocks ``value, band, i, j`` in which every two classes of a list may meet.

    A list (``value``) over ``most`` classes is cut by size: linked sets have sizes within
    ``percent`` of each other, so they are of the same band or of neighbouring ones, and a band's
    list holds both. What is longer still, or has over ``BYTES`` at ``size`` bytes a value of a set,
    is cut into blocks, and every two blocks meet in a task.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(np.log(100 / percent))).cast("int")
    # sizes at the edge of the ratio may round into the band after the next: three bands share a list
    bands = F.when(F.col("length") <= most, F.array(F.lit(-1))).otherwise(F.array(band, band + 1, band + 2))
    banded = rows.select("class", "root", "n", "value", F.explode(bands).alias("band"))
    sizes = banded.groupBy("value", "band").agg(
        F.greatest(F.lit(1), F.ceil(F.count("*") / most), F.ceil(F.sum("n") * size / BYTES)).cast("int").alias("blocks"),
        F.min("root").alias("lo"), F.max("root").alias("hi"),
    )
    sizes = sizes.where("lo <> hi").select("value", "band", "blocks")
    placed = banded.join(sizes, ["value", "band"]).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("class", "root", "n", "value", "band", "own", other)
    return placed.select("class", "root", "n", "value", "band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def _lengths(rows: DataFrame) -> DataFrame:
    """``value, length`` of the lists that hold several components."""
    lengths = rows.groupBy("value").agg(F.count("*").alias("length"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    return durable(lengths.where("lo <> hi").select("value", "length"))


def _across(tagged: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y`` of different components within the long lists that join all whose sketches allow a link."""
    # classes travel as longs here; two classes that share one would only be compared once too often
    short_name = lambda c: F.xxhash64(c).alias(c)
    rows = tagged.select(short_name("class"), short_name("root"), F.col("n").cast("int").alias("n"), "value")
    lists = durable(rows.join(_lengths(rows), "value"))
    # 31 bits of a value, in the same order, are enough to estimate from
    low = classes.select(short_name("class"), F.transform("sketch", lambda x: F.shiftright(x, 33).cast("int")).alias("sketch"))
    placed = _blocks(lists, percent, SPAN * BLOCK, 0).join(low, "class")
    met = placed.groupBy("value", "band", "i", "j").applyInArrow(_block_survivors(percent), "p long, q long")
    pairs = durable(met.select(*_pair("p", "q")).distinct())
    named = lambda s: classes.select(F.xxhash64("class").alias(s), F.col("class").alias(f"c{s}"))
    return pairs.join(named("x"), "x").join(named("y"), "y").select(*_pair("cx", "cy"))


def _grouped_links(pairs: DataFrame, named: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The links between different components among all classes that the pairs join; enough to join all that are linked.

    What the pairs join is a list, so a class's full set travels once, or once a block of a long list.
    """
    lists = components(pairs, "x", "y").toDF("class", "value")
    rows = lists.join(named, "class", "left").withColumn("root", F.coalesce("root", "class"))
    rows = durable(rows.join(classes.select("class", "n"), "class"))
    placed = durable(_blocks(rows.join(_lengths(rows), "value"), percent, BLOCK, 8))
    full = placed.join(_sets(placed.select("class").distinct(), docs, classes, width), "class")
    return durable(full.groupBy("value", "band", "i", "j").applyInArrow(_block_links(percent), "x binary, y binary").distinct())


def _needed(of, percent: int):
    """Values that two classes share at least if they are linked, from the size of either's sketch.

    Values that count in a union sketch are in both sketches, and a union sketch has as many values
    as either sketch at least. A sketch that is not full is the whole set; then a partner's set has
    ``1 / t`` as many values at most, and its sketch leaves out what exceeds ``SKETCH``.
    """
    t = percent / 100
    whole = F.least(t * of, SKETCH - (1 / t - 1) * of)
    least = F.when(of < SKETCH, whole).otherwise(t * of - SLACK * F.sqrt(t * (1 - t) * of))
    return F.greatest(F.lit(1), F.ceil(least - 1e-6)).cast("int")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """``name, value``: the values in which a class, as a long, meets every class whose union sketch with it allows a link.

    A class's shared values are those that a class of a fitting size holds too. Classes that share less
    than is ``_needed`` leave, and both classes of a pair to be found stay in every round. All order their
    values by the same number and the value itself, so the first value that such a pair has in common
    has ``_needed`` less one of either's behind it.
    """
    band = F.floor(F.log(F.col("n").cast("double")) * F.lit(STEPS / np.log(100 / percent))).cast("int").alias("band")
    # two classes that share a name would only stay once too often
    held = classes.select(F.xxhash64("class").alias("name"), band, F.size("sketch").alias("of"), F.col("sketch").alias("own"))
    # sizes within the ratio are STEPS bands apart at most; one more, as they may round
    meet = lambda y: (F.abs(y["band"] - F.col("band")) <= STEPS + 1) & ((y["band"] != F.col("band")) | (y["count"] > 1))
    for _ in range(ROUNDS):
        rows = held.select("name", "band", "of", F.explode("own").alias("value"))
        cells = rows.groupBy("value", "band").count()
        # as many as there are bands, at most
        lists = cells.groupBy("value").agg(F.collect_list(F.struct("band", "count")).alias("cells")).where("size(cells) > 1 or cells[0].count > 1")
        lists = lists.withColumn("classes", F.aggregate("cells", F.lit(0).cast("long"), lambda a, x: a + x["count"]))
        shared = rows.join(lists, "value").where(F.exists("cells", meet))
        kept = shared.groupBy("name", "band", "of").agg(F.sort_array(F.collect_list(F.struct("classes", "value"))).alias("own"))
        kept = kept.where(F.size("own") >= _needed(F.col("of"), percent))
        held = durable(kept.withColumn("own", F.col("own.value")))
    listed = held.select("name", F.explode(F.slice("own", F.lit(1), F.size("own") - _needed(F.col("of"), percent) + 1)).alias("value"))
    return listed.join(listed.groupBy("value").count().where("count > 1").select("value"), "value", "left_semi").select("name", "value")


def _linkable(classes: DataFrame, percent: int) -> DataFrame:
    """The classes that share enough values for a union sketch to allow a link."""
    return classes.join(_prefixes(classes, percent), F.xxhash64("class") == F.col("name"), "left_semi")


def link_classes(docs: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame:
    """``class, root`` of the classes that have a link: the component as its smallest class."""
    classes = durable(
        sketched.where("class is not null")
        .groupBy("class")
        .agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
        # below this size every change of a set goes under the threshold; without an id a
        # document cannot be named by a link
        .where((F.col("n") * (100 - percent) * 1.0 / percent >= 1) & F.col("first").isNotNull())
    )
    listed = durable(_prefixes(classes, percent))
    classes = durable(classes.join(listed, F.xxhash64("class") == F.col("name"), "left_semi"))
    keys = listed.join(classes.select(F.xxhash64("class").alias("name"), "class", "n"), "name").select("class", "n", "value")
    lengths = keys.groupBy("value").agg(F.count("*").alias("len"))
    entries = durable(keys.join(lengths.where("len > 1"), "value"))
    short = entries.where(F.col("len") <= SHORT)
    near = (
        short.select("value", F.col("class").alias("p"), F.col("n").alias("np"))
        .join(short.select("value", F.col("class").alias("q"), F.col("n").alias("nq")), "value")
        .where("p < q")
        .where(100 * F.least("np", "nq") >= percent * F.greatest("np", "nq"))
        .select(F.col("p").alias("x"), F.col("q").alias("y"), F.lit(3).alias("who"))
        .distinct()
    )
    long = durable(entries.where(F.col("len") > SHORT))
    hubs = None
    for i in range(HUBS):
        own = long.groupBy("value").agg(F.min_by("class", F.xxhash64("class", F.lit(i))).alias("hub"))
        hubs = own if hubs is None else hubs.union(own)
    starred = (
        long.join(hubs.distinct(), "value")
        .where("class <> hub")
        .select(*_pair("class", "hub"), F.when(F.col("class") < F.col("hub"), 1).otherwise(2).alias("who"))
        .groupBy("x", "y")
        .agg(F.bit_or("who").alias("who"))
    )
    chosen = near.union(starred).groupBy("x", "y").agg(F.bit_or("who").alias("who"))
    scored = durable(_scored(chosen, classes, percent).join(chosen, ["x", "y"]))
    # each class is verified against the best two of the partners that it has chosen, a bounded list
    own = scored.select(
        "est", F.explode(F.when(F.col("who") == 3, F.array(_way("x", "y"), _way("y", "x")))
                         .when(F.col("who") == 1, F.array(_way("x", "y"))).otherwise(F.array(_way("y", "x")))).alias("w")
    )
    best = (
        own.groupBy("w.node")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("est", F.col("w.partner").alias("partner"))), asc=False), 1, 2).alias("top"))
        .select("node", F.explode("top").alias("t"))
        .select(*_pair("node", "t.partner"))
        .distinct()
    )
    best = durable(best)
    linked = _verified(best, docs, classes, width, percent)
    roots = components(linked, "x", "y")
    named = roots.toDF("class", "root")
    tagged = long.join(named, "class", "left").withColumn("root", F.coalesce("root", "class"))
    side = lambda s: named.toDF(s, f"r{s}")
    rest = (
        scored.select("x", "y")
        .join(side("x"), "x", "left")
        .join(side("y"), "y", "left")
        .where(F.coalesce("rx", "x") != F.coalesce("ry", "y"))
        .join(best, ["x", "y"], "left_anti")
        .select("x", "y")
        .union(_across(tagged, classes, percent))
    )
    more = _grouped_links(durable(rest.distinct()), named, docs, classes, width, percent)
    return components(linked.union(more), "x", "y").toDF("class", "root")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text, ...)``.

    component_id is the smallest doc_id that links of ``percent`` or more reach; kept marks it.
    Null or wordless texts have 0 shingles and are linked with nothing. Rows with equal doc_id
    and text are the same document and are all returned. A row without a doc_id gets the
    component of the documents with the same set, or null, and is never kept where there is
    one; it is kept if its component is null. Extra columns are ignored; an empty table gives
    an empty result.
    """
    sketched = durable(sketches(docs, width))
    linked = link_classes(docs, sketched, width, percent)
    firsts = sketched.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"))
    placed = firsts.join(linked, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("lowest"))
    named = placed.join(lowest, "root").select("class", "lowest")
    out = sketched.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document stands for its component; columns as given.

    Rows that repeat a document (same doc_id) all stay or go; wordless rows stay.
    """
    verdict = near_duplicates(docs, width, percent).groupBy(F.col("doc_id").alias("doc_id")).agg(F.max("kept").alias("kept"))
    gone = durable(verdict.where("not kept").select("doc_id"))
    sifted = _sifted(docs, gone)
    out = gone.withColumnRenamed("doc_id", "_gone")
    doubtful = sifted.where("_in").drop("_in")
    stay = doubtful.join(out, doubtful["doc_id"].eqNullSafe(out["_gone"]), "left_anti")
    return sifted.where("not _in").drop("_in").union(stay)


def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), width=2, percent=80)


QUERIES = {"op3_minhash_near_dedup": op3_minhash_near_dedup}
SQL: dict[str, str] = {}
