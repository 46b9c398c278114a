"""Random forests of regression trees on binned numbers.

Features are cut into at most ``BINS`` bins at quantiles of a bounded sample of rows; counts and
sums below are of all rows. Each tree has its own bag (a Poisson weight for every row, from a
hash of the row and the tree). Up to ``LOCAL`` rows, packed, go to every task, which draws bags and
grows trees; as many different rows are scored in the same way. Nodes with more rows are split by
grouped histograms, a level a round, and smaller ones then grown side by side, each (tree, node) a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.stored import once

BINS, SAMPLE, LOCAL, DEPTH = 32, 10_000, 500_000, 30
#: Nodes whose histograms are made together, rows a node that count as few, and scores of a tree that travel together.
NODES, FEW, SCORES = 2048, 12, 8192
#: Chances of at most 0, 1, 2, ... in a Poisson distribution of mean 1.
POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.concatenate([[1.0], np.arange(1, 16)])))


def thresholds(values: np.ndarray) -> list[float]:
    """At most ``BINS`` - 1 cuts, halfway between neighbouring values."""
    known, times = np.unique(values, return_counts=True)
    at = np.arange(len(known) - 1)
    if len(known) > BINS:
        at = np.unique(np.searchsorted(np.cumsum(times), len(values) / BINS * np.arange(1, BINS)))
        at = at[at < len(known) - 1]
    return ((known[at] + known[at + 1]) / 2).tolist()


def binned(features: str, cuts: list[list[float]]) -> Column:
    """The bin of each feature: how many of its cuts lie below the value."""
    x = vector_to_array(features)
    below = lambda c, at: F.size(F.filter(F.array(*map(F.lit, c)), lambda t: t < x[at])) if c else F.lit(0)
    return F.array(*[below(c, i).cast("tinyint") for i, c in enumerate(cuts)])


def bag(hashes: np.ndarray, tree: int) -> np.ndarray:
    """How often each row is in a tree's bag."""
    x = hashes.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) * 2.0**-53, side="right")


def _bags(trees: int):
    def run(batches):
        for batch in batches:
            hashes = batch.column("h").to_numpy()
            for tree in range(trees if len(hashes) else 0):
                w = bag(hashes, tree)
                at = np.flatnonzero(w)
                part = batch.select(["bins", "y"]).take(pa.array(at))
                columns = [pa.array(np.full(len(at), tree, np.int32)), pa.array(np.ones(len(at), np.int64)), *part.columns, pa.array(w[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "bins", "y", "w"])

    return run


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def _splits(at: np.ndarray, bins: np.ndarray, y: np.ndarray, w: np.ndarray, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """The feature (-1 if none) and last bin on the left of each node's best split."""
    first = np.zeros(nodes)
    first[at] = y
    wy = w * y
    n, s = np.bincount(at, w, nodes), np.bincount(at, wy, nodes)
    mixed = np.bincount(at, y != first[at], nodes) > 0
    best, of, to = 1e-12 * np.bincount(at, wy * y, nodes), np.full(nodes, -1), np.zeros(nodes, int)
    if not mixed.any():
        return of, to
    whole, start = (s * s / n)[:, None], at * BINS
    # with few rows a node, most bins are empty: only those that rows are in are looked at
    few = len(at) <= FEW * nodes and nodes * BINS <= 1 << 16
    before_n, before_s = np.cumsum(n) - n, np.cumsum(s) - s
    for f in range(bins.shape[1]):
        key = start + bins[:, f]
        if few:
            order = np.argsort(key.astype(np.uint16), kind="stable")
            key = key[order]
            end = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            key = key[end]
            node = key // BINS
            ln, ls = np.cumsum(w[order])[end] - before_n[node], np.cumsum(wy[order])[end] - before_s[node]
            rn, rs = n[node] - ln, s[node] - ls
            gain = np.where(rn > 0, ls * ls / ln + rs * rs / np.maximum(rn, 1), 0) - whole[node, 0]
            top = np.maximum.reduceat(gain, np.flatnonzero(np.append(True, node[1:] != node[:-1])))
            hit = np.flatnonzero(gain == top[node])[::-1]
            place = np.zeros(nodes, int)
            place[node[hit]] = key[hit] % BINS  # the first of equal ones is put last
            on = mixed & (top > best)
            best[on], of[on], to[on] = top[on], f, place[on]
            continue
        ln = np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(1)
        ls = np.bincount(key, wy, nodes * BINS).reshape(nodes, BINS).cumsum(1)
        rn, rs = n[:, None] - ln, s[:, None] - ls
        gain = np.where((ln > 0) & (rn > 0), ls * ls / np.maximum(ln, 1) + rs * rs / np.maximum(rn, 1), 0) - whole
        place = gain.argmax(1)
        top = gain[np.arange(nodes), place]
        on = mixed & (top > best)
        best[on], of[on], to[on] = top[on], f, place[on]
    return of, to


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """A tree by levels: feature (-1 at leaves), last bin on the left, left child (right is next) and mean of each node."""
    feature, cut, left, value = [np.full(1, -1)], [np.zeros(1, int)], [np.zeros(1, int)], [np.array([w @ y / w.sum()])]
    at, nodes, total = np.zeros(len(y), int), 1, 1
    for _ in range(depth):
        of, to = np.full(nodes, -1), np.zeros(nodes, int)
        # a node of one row is a leaf; the others some at a time, so that their histograms stay small
        shared = np.bincount(at, minlength=nodes) > 1
        rows, known = shared[at], np.flatnonzero(shared)
        at, bins, y, w = at[rows], bins[rows], y[rows], w[rows]
        place = (np.cumsum(shared) - 1)[at]
        if len(known) > NODES:
            order = np.argsort(place, kind="stable")
            at, place, bins, y, w = at[order], place[order], bins[order], y[order], w[order]
        for low in range(0, len(known), NODES):
            own = known[low : low + NODES]
            rows = slice(*np.searchsorted(place, [low, low + NODES])) if len(known) > NODES else slice(None)
            of[own], to[own] = _splits(place[rows] - low, bins[rows], y[rows], w[rows], len(own))
        split = of >= 0
        rank = np.cumsum(split) - 1
        feature[-1], cut[-1], left[-1] = of, to, np.where(split, total + 2 * rank, 0)
        rows = split[at]
        at, bins, y, w = at[rows], bins[rows], y[rows], w[rows]
        if not len(at):
            break
        at = 2 * rank[at] + (bins[np.arange(len(at)), of[at]] > to[at])
        nodes = 2 * int(split.sum())
        total += nodes
        for known, new in ((feature, np.full(nodes, -1)), (cut, np.zeros(nodes, int)), (left, np.zeros(nodes, int))):
            known.append(new)
        value.append(np.bincount(at, w * y, nodes) / np.bincount(at, w, nodes))
    return tuple(map(np.concatenate, (feature, cut, left, value)))


TREE = "tree int, node long, feature array<int>, cut array<int>, left array<int>, value array<double>"


def _row(tree: int, node: int, found: tuple) -> dict[str, pa.Array]:
    """A tree grown from a node as one row."""
    kinds = dict(zip(("feature", "cut", "left", "value"), (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True))
    lists = {name: pa.array([x], pa.list_(kind)) for (name, kind), x in zip(kinds.items(), found, strict=True)}
    return {"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()), **lists}


def _grown(keys: tuple, rows: pa.Table) -> pa.Table:
    depth = DEPTH - (keys[1].as_py().bit_length() - 1)
    bins = _matrix(rows.column("bins").combine_chunks())
    found = grow(bins, rows.column("y").to_numpy(), rows.column("w").to_numpy().astype(float), depth)
    return pa.table(_row(keys[0].as_py(), keys[1].as_py(), found))


def _grown_here(shared):
    """Trees by their numbers, from rows that every task has."""

    def run(batches):
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                hashes, bins, y = shared.value
                w = bag(hashes, tree)
                at = np.flatnonzero(w)
                if len(at):
                    yield pa.RecordBatch.from_pydict(_row(tree, 1, grow(bins[at], y[at], w[at].astype(float), DEPTH)))

    return run


def _leaves(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf that each row falls into."""
    at, row = np.zeros(len(bins), int), np.arange(len(bins))
    while len(row := row[feature[at[row]] >= 0]):
        here = at[row]
        at[row] = left[here] + (bins[row, feature[here]] > cut[here])
    return at


def _fallen(keys: tuple, trees: pa.Table, rows: pa.Table) -> pa.Table:
    """The value of the leaf that each row falls into; trees whose bag was empty have none."""
    if not trees.num_rows or not rows.num_rows:
        return pa.table({"bins": pa.array([], pa.list_(pa.int8())), "tree": pa.array([], pa.int32()), "value": pa.array([], pa.float64())})
    bins = _matrix(rows.column("bins").combine_chunks())
    feature, cut, left, value = (trees.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("feature", "cut", "left", "value"))
    at = _leaves(bins, feature, cut, left)
    return pa.table({"bins": rows.column("bins").cast(pa.list_(pa.int8())), "tree": rows.column("tree"), "value": pa.array(value[at])})


def _scored_here(shared):
    """Scores of the rows that every task has, ``SCORES`` of a tree in a row."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                feature, cut, left, value = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("feature", "cut", "left", "value"))
                scores = value[_leaves(shared.value, feature, cut, left)]
                parts = [scores[x : x + SCORES] for x in range(0, len(scores), SCORES)]
                columns = [np.arange(len(parts), dtype=np.int32), np.full(len(parts), batch.column("tree")[i].as_py(), np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(parts, pa.list_(pa.float64()))], names=["chunk", "tree", "value"])

    return run


def _mean(shared):
    """Rows of bins and the mean of their scores, added up in the order of the trees."""

    def run(keys: tuple, scores: pa.Table) -> pa.Table:
        first = keys[0].as_py() * SCORES
        bins, scores = shared.value[first : first + SCORES], scores.sort_by("tree")
        total = np.zeros(len(bins))
        for values in scores.column("value"):
            total += values.values.to_numpy(zero_copy_only=False)
        ends = pa.array(np.arange(len(bins) + 1, dtype=np.int32) * bins.shape[1])
        return pa.table({"bins": pa.ListArray.from_arrays(ends, pa.array(bins.ravel(), pa.int8())), "value": pa.array(total / scores.num_rows)})

    return run


def _fits(rows: int, features: int) -> bool:
    """Whether so many rows can go to every task."""
    return rows <= LOCAL and rows * features <= 32 * LOCAL


def _best_splits(rows: DataFrame) -> DataFrame:
    """``tree, node, feature, cut`` by the sums of all rows of a node."""
    cells = rows.select("tree", "node", "w", (F.col("w") * F.col("y")).alias("wy"), F.posexplode("bins").alias("feature", "cut"))
    cells = cells.groupBy("tree", "node", "feature", "cut").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
    whole = Window.partitionBy("tree", "node", "feature")
    left = whole.orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select("*", *[F.sum(c).over(o).alias(n) for n, c, o in (("ln", "w", left), ("ls", "wy", left), ("n", "w", whole), ("s", "wy", whole))])
    cells = cells.where("ln < n").withColumn("gain", F.expr("ls * ls / ln + (s - ls) * (s - ls) / (n - ln) - s * s / n")).where("gain > 0")
    best = cells.groupBy("tree", "node").agg(F.max(F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("cut")).alias("c"))).alias("b"))
    return best.select("tree", "node", (-F.col("b.f")).alias("feature"), (-F.col("b.c")).cast("int").alias("cut"))


def _down(rows: DataFrame, splits: DataFrame, how: str) -> DataFrame:
    """Rows at the children of their nodes, as far as these are split."""
    child = F.col("node") * 2 + (F.element_at("bins", F.col("feature") + 1) > F.col("cut")).cast("int")
    kept = [c for c in rows.columns if c != "node"]
    return rows.join(splits, ["tree", "node"], how).select(*kept, F.when(F.col("feature").isNull(), F.col("node")).otherwise(child).alias("node"))


class Forest:
    """The mean of all trees as the column ``output``."""

    def __init__(self, features: str, output: str, cuts: list, trees: int, top: list[DataFrame], lower: DataFrame):
        self.features, self.output, self.cuts, self.trees, self.top, self.lower = features, output, cuts, trees, top, lower

    def transform(self, df: DataFrame) -> DataFrame:
        """Each different row of bins is scored once."""
        given = df.withColumn("_bins", binned(self.features, self.cuts))
        different = given.select(F.col("_bins").alias("bins")).distinct()
        kept = [*[F.col(f"`{c}`") for c in df.columns], self.output]
        # trees of more rows than go to every task are in parts, and large
        few = None if self.top else different.limit(LOCAL + 1).toArrow()
        if few is not None and _fits(few.num_rows, len(self.cuts)):
            matrix = few.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(few.num_rows, len(self.cuts))
            shared = df.sparkSession.sparkContext.broadcast(matrix)
            scored = self.lower.mapInArrow(_scored_here(shared), "chunk int, tree int, value array<double>")
            means = scored.groupBy("chunk").applyInArrow(_mean(shared), "bins array<tinyint>, value double")
            return given.join(means.select(F.col("bins").alias("_bins"), F.col("value").alias(self.output)), "_bins", "left").select(*kept)
        rows = different.select("bins", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
        for splits in self.top:
            rows = _down(rows, splits, "left")
        # a tree meets all rows that fall into it, so these are dealt over as many groups as keep them small
        chunks = different.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / LOCAL)).cast("int")).first()[0]
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("bins"), F.lit(chunks)).cast("int"))
        lower = self.lower.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        by = ["tree", "node", "chunk"]
        fallen = lower.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_fallen, "bins array<tinyint>, tree int, value double")
        in_order = F.sort_array(F.collect_list(F.struct("tree", "value")))  # one value a tree
        total = F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x["value"]) / F.size(in_order)
        scores = fallen.groupBy(F.col("bins").alias("_bins")).agg(total.alias(self.output))
        return given.join(scores, "_bins", "left").select(*kept)


def fit(train: DataFrame, features: str, target: str, output: str, trees: int, hashed: Column) -> Forest:
    """A forest on the rows of ``train``; ``hashed`` is a long that tells its rows apart."""
    y = F.col(target).cast("double")
    y = F.when(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")), F.raise_error(F.lit(f"{target} must be a finite number"))).otherwise(y)
    rows = train.select(features, y.alias("y"), hashed.alias("h"))
    sample = np.array([r[0] for r in rows.orderBy("h").limit(SAMPLE).select(vector_to_array(features)).collect()])
    if not len(sample):
        raise ValueError("a forest needs rows")
    cuts = [thresholds(x) for x in sample.T]
    rows = once(rows.select("h", binned(features, cuts).alias("bins"), "y"))
    many = rows.count()
    if _fits(many, len(cuts)):
        found = rows.toArrow()
        bins = found.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(many, len(cuts))
        context = train.sparkSession.sparkContext
        shared = context.broadcast((found.column("h").to_numpy(), bins, found.column("y").to_numpy()))
        numbers = train.sparkSession.range(0, trees, 1, min(trees, 4 * context.defaultParallelism))
        return Forest(features, output, cuts, trees, [], once(numbers.mapInArrow(_grown_here(shared), TREE)))
    bags = rows.repartition("h").mapInArrow(_bags(trees), "tree int, node long, bins array<tinyint>, y double, w int")
    top = []
    while many > LOCAL and len(top) < DEPTH:
        bags = once(bags)
        sizes = bags.groupBy("tree", "node").count()
        splits = once(_best_splits(bags.join(F.broadcast(sizes.where(F.col("count") > LOCAL)), ["tree", "node"])))
        if splits.isEmpty():
            break
        top.append(F.broadcast(splits))
        bags = _down(bags, top[-1], "left")
    lower = bags.groupBy("tree", "node").applyInArrow(_grown, TREE)
    return Forest(features, output, cuts, trees, top, once(lower))
