"""Ridge regression on TF-IDF rows, with and without numeric columns, for all folds and targets at once.

A row with fold k is held out from model k; every other row (also one with a fold outside 0 to
``folds`` - 1) is in its training rows. Each model has a vocabulary and document frequencies of its own,
the whole less the fold. Folds are counted for the terms that are frequent over all rows; a bound
shows that no other term is in a vocabulary, else every term is counted per fold.

The models are right-hand sides of one solve by preconditioned conjugate gradients. Rows stay
sparse lists of (term, count) in the partitions, packed into blocks by row and by term; one pass an
iteration multiplies them with all directions at once and adds the products up by blocks of the
result, so a task or the driver holds vectors as long as the vocabulary, never rows. Columns are
centred by their means, so there is no intercept to fit and no row becomes dense. The
preconditioner is the inverse in the directions in which all rows vary most, found from their
product with random directions (Nystrom's method); it decides the number of passes, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.carry import with_results
from tideline.functions.terms import idf, list_lengths, slices_by_length, with_term_counts

# fixed values: penalty of the ridge, vocabulary size
ALPHA = 1.0
VOCABULARY = 20_000
#: The solve ends when no model's gradient is longer. As the penalty makes the objective strongly
#: convex, weights are then off by at most this over alpha.
GRADIENT = 1e-8
ITERATIONS = 2_000
#: Entries of a result vector that are added up together.
BLOCK = 4096
#: Terms of the rows worked on at a time, and of the rows packed into one block.
ENTRIES = 1 << 20
PACKED = 1 << 17
#: Directions in the preconditioner, and how many of them a pass multiplies.
SKETCH, TOGETHER = 512, 128
#: Rows made dense at a time, in the terms that they have.
DENSE = 64
#: Terms that are counted per fold, times the size of a vocabulary.
CANDIDATES = 4


@dataclass
class Space:
    """The terms of all models, and each model's weight of a term (0 where its vocabulary lacks it)."""

    terms: pa.Array
    weights: np.ndarray  # models x terms

    @property
    def sizes(self) -> np.ndarray:
        return (self.weights > 0).sum(1)


def frequent_terms(counted: DataFrame, most: int, min_df: int = 1) -> tuple[pa.Array, int]:
    """The ``most`` most frequent terms of all rows that ``min_df`` of them have, in term order, and how often
    any other such term occurs at most. One shuffle by term."""
    long = counted.select(F.explode(F.arrays_zip("terms", "times")).alias("x")).select("x.terms", "x.times")
    totals = long.groupBy("terms").agg(F.sum("times").alias("tf"), F.count(F.lit(1)).alias("df"))
    top = totals.where(F.col("df") >= max(min_df, 1)).select("terms", "tf").orderBy(F.desc("tf"), "terms").limit(most + 1).toArrow()
    rest = top.column("tf")[most].as_py() if top.num_rows > most else 0
    return pa.array(sorted(top.column("terms").slice(0, most).to_pylist()), pa.string()), rest


def vocabularies(terms: pa.Array, tf: np.ndarray, df: np.ndarray, n: np.ndarray, rest: int, size: int, min_df: int) -> Space | None:
    """The space of all models by the counts of ``terms`` (folds and one more for other rows, x terms); None if
    a term that occurs ``rest`` times in all rows could be in a vocabulary as well."""
    folds, found = len(n) - 1, []
    for k in range(folds):
        times, rows = tf.sum(0) - tf[k], df.sum(0) - df[k]
        known = np.flatnonzero(rows >= max(min_df, 1))
        own = known[np.argsort(-times[known], kind="stable")[:size]]  # terms are in order
        if rest and size and (len(own) < size or times[own[-1]] <= rest):
            return None
        weights = np.zeros(len(terms))
        weights[own] = np.log((1 + n.sum() - n[k]) / (1 + rows[own])) + 1
        found.append(weights)
    weights = np.array(found).reshape(folds, len(terms))
    used = np.flatnonzero(weights.any(0))
    return Space(terms.take(pa.array(used)), weights[:, used])


def term_space(counted: DataFrame, fold: str, folds: int, n: np.ndarray, size: int = VOCABULARY, min_df: int = 1) -> Space:
    """Each model's ``size`` most frequent terms of its training rows (ties in term order) that ``min_df``
    of them have, with ``ln((1 + n) / (1 + df)) + 1`` as weights; ``n`` has the rows of each fold and of no fold.

    One shuffle by term; the vocabularies come to the driver, the counts do not.
    """
    long = counted.select(F.col(fold).alias("fold"), F.explode(F.arrays_zip("terms", "times")).alias("x")).select(
        "fold", "x.terms", "x.times"
    )
    sums = [F.sum("times").alias("tf"), F.count(F.lit(1)).alias("df")]
    for k in range(folds):
        own = F.col("fold") == k
        sums += [F.sum(F.when(own, F.col("times")).otherwise(0)).alias(f"tf_{k}"), F.count_if(own).alias(f"df_{k}")]
    totals = long.groupBy("terms").agg(*sums).where(F.col("df") >= min_df).persist()
    try:
        found = []
        for k in range(folds):
            outside = totals.select("terms", (F.col("tf") - F.col(f"tf_{k}")).alias("tf"), (F.col("df") - F.col(f"df_{k}")).alias("df"))
            outside = outside.where(F.col("df") >= max(min_df, 1)).orderBy(F.desc("tf"), "terms").limit(size)
            weight = idf(F.col("df"), F.lit(float(n.sum() - n[k])))
            found.append({r["terms"]: r["w"] for r in outside.select("terms", weight.alias("w")).collect()})
    finally:
        totals.unpersist()
    terms = sorted(set().union(*found))
    weights = np.array([[own.get(t, 0.0) for t in terms] for own in found]).reshape(folds, len(terms))
    return Space(pa.array(terms, pa.string()), weights)


def _index(shared):
    """Terms to places in the space; and the length of each row's weighted counts, per model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space: Space = shared.value
        for batch in batches:
            lists = batch.column("value").field("terms")
            for part in slices_by_length(batch, list_lengths(lists), ENTRIES):
                value = part.column("value")
                lists, n = value.field("terms"), part.num_rows
                place = pc.index_in(lists.flatten().cast(pa.string()), value_set=space.terms)
                owner = np.repeat(np.arange(n), list_lengths(lists))
                known = place.is_valid().to_numpy(zero_copy_only=False)
                at = place.drop_null().to_numpy(zero_copy_only=False)
                times = value.field("times").flatten().to_numpy(zero_copy_only=False)[known].astype(float)
                owner = owner[known]
                norms = [np.sqrt(np.bincount(owner, (times * w[at]) ** 2, n)) for w in space.weights]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())
                columns = [
                    part.column("row"),
                    pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(times, pa.float64())),
                    pa.array(list(np.reshape(norms, (-1, n)).T), pa.list_(pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "times", "norms"])

    return run


def _placed(counted: DataFrame, shared) -> DataFrame:
    """``counted`` with ``at, times, norms`` for its terms and times."""
    lists = counted.withColumn("_value", F.struct("terms", "times")).drop("terms", "times")
    return with_results(lists, "_value", _index(shared), "at array<int>, times array<double>, norms array<double>")


class Block:
    """Rows of a batch in numpy: terms, counts, numeric columns, targets, folds."""

    def __init__(self, part: pa.RecordBatch, space: Space):
        value = part.column("value")
        dense = lambda name: np.array(value.field(name).to_pylist(), float).reshape(part.num_rows, -1)
        self.n, self.space = part.num_rows, space
        self.owner = np.repeat(np.arange(self.n), list_lengths(value.field("at")))
        self.at = value.field("at").flatten().to_numpy(zero_copy_only=False)
        self.times = value.field("times").flatten().to_numpy(zero_copy_only=False)
        self.norms, self.numeric, self.targets = dense("norms"), dense("numeric"), dense("targets")
        self.fold = np.nan_to_num(value.field("fold").to_numpy(zero_copy_only=False).astype(float), nan=-1)

    def entries(self, k: int) -> np.ndarray:
        """The text part of model k's rows: weighted counts of unit length."""
        norm = self.norms[self.owner, k]
        return np.divide(self.times * self.space.weights[k][self.at], norm, out=np.zeros(len(norm)), where=norm > 0)

    def times_vector(self, entries: np.ndarray, vector: np.ndarray) -> np.ndarray:
        """One number a row: the row times ``vector``."""
        size = len(self.space.terms)
        return np.bincount(self.owner, entries * vector[self.at], self.n) + self.numeric @ vector[size:]


def _blocks(batches: Iterator[pa.RecordBatch], space: Space, most: int = ENTRIES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    for batch in batches:
        for part in slices_by_length(batch, list_lengths(batch.column("value").field("at")), most):
            yield part, Block(part, space)


#: Columns of a packed block and their types: rows with terms, entries by row, then the rows. Every pass moves
#: all blocks to Python, so they are small.
LAYOUT = {"with_terms": "i4", "lengths": "i4", "at": "i4", "times": "i4", "norms": "f8", "numeric": "f8", "targets": "f8", "fold": "f8"}
#: Columns of a draft: entries by row with places in the candidates, then the rows.
DRAFT = {"lengths": "i4", "at": "i4", "times": "i4", "numeric": "f8", "targets": "f8", "fold": "f8"}


def _bytes(found: dict, layout: dict) -> pa.RecordBatch:
    columns = [pa.array([np.ascontiguousarray(found[c], t).tobytes()], pa.binary()) for c, t in layout.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(layout))


def _numbers(batch: pa.RecordBatch, at: int, layout: dict) -> dict[str, np.ndarray]:
    return {c: np.frombuffer(batch.column(c)[at].as_buffer(), t) for c, t in layout.items()}


def _draft(shared):
    """Rows to blocks, each one row of binary columns, so that no pass has to take lists apart again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches, shared.value, PACKED):
            found = {c: getattr(block, c) for c in DRAFT if c != "lengths"}
            yield _bytes(found | {"lengths": np.bincount(block.owner, minlength=block.n)}, DRAFT)

    return run


def _tally(folds: int, size: int):
    """How often the terms occur in rows of each fold (the last: of none), and in how many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tf, df = np.zeros((folds + 1, size)), np.zeros((folds + 1, size))
        for batch in batches:
            for i in range(batch.num_rows):
                x = _numbers(batch, i, DRAFT)
                own = np.where((x["fold"] >= 0) & (x["fold"] < folds), x["fold"], folds).astype(int).repeat(x["lengths"])
                place = own * size + x["at"]
                tf += np.bincount(place, x["times"], (folds + 1) * size).reshape(tf.shape)
                df += np.bincount(place, minlength=(folds + 1) * size).reshape(df.shape)
        yield from _pieces(np.vstack([tf, df]))

    return run


def _pack(shared):
    """Drafts to blocks: terms of the space alone, and the length of each row's weighted counts per model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, places = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                x = _numbers(batch, i, DRAFT)
                n, at = len(x["lengths"]), places[x["at"]]
                known = at >= 0
                owner, at, times = np.repeat(np.arange(n), x["lengths"])[known], at[known], x["times"][known]
                with_terms, lengths = np.unique(owner, return_counts=True)
                norms = np.array([np.sqrt(np.bincount(owner, (times * w[at]) ** 2, n)) for w in space.weights]).T
                found = {c: x[c] for c in ("numeric", "targets", "fold")}
                yield _bytes(found | {"with_terms": with_terms, "lengths": lengths, "at": at, "times": times, "norms": norms}, LAYOUT)

    return run


def _pieces(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of a matrix by pieces of ``BLOCK`` entries, without those that are all 0."""
    found = [(r, b, x) for r, row in enumerate(total) for b in range(0, len(row), BLOCK) if (x := row[b : b + BLOCK]).any()]
    if found:
        r, b, x = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["r", "b", "x"])


def _added(frame: DataFrame, run: Callable, count: int, width: int) -> np.ndarray:
    """The sum of the matrices (``count`` x ``width``) whose pieces the tasks of ``run`` return."""
    added = frame.mapInArrow(run, "r int, b int, x array<double>").groupBy("r", "b").agg(Summarizer.sum(array_to_vector("x")).alias("x"))
    found = added.select("r", "b", vector_to_array("x").alias("x")).toArrow()
    out = np.zeros((count, width))
    for r, b, x in zip(*(found.column(c) for c in "rbx"), strict=True):
        out[r.as_py(), b.as_py() : b.as_py() + BLOCK] = x.values.to_numpy(zero_copy_only=False)
    return out


class Packed:
    """A packed block: products of its rows with one column of numbers per (model, target)."""

    def __init__(self, batch: pa.RecordBatch, at: int, space: Space):
        for name, numbers in _numbers(batch, at, LAYOUT).items():
            setattr(self, name, numbers)
        self.space, self.n = space, len(self.fold)
        self.at, self.times = self.at.astype(np.intp), self.times.astype(float)
        self.starts, self.owner = np.cumsum(self.lengths) - self.lengths, np.repeat(self.with_terms, self.lengths).astype(np.intp)
        self.norms, self.numeric, self.targets = (x.reshape(self.n, -1) for x in (self.norms, self.numeric, self.targets))
        self.inverse = np.divide(1.0, self.norms, out=np.zeros_like(self.norms), where=self.norms > 0)

    def times_vectors(self, vectors: np.ndarray, models: list[int]) -> np.ndarray:
        """Rows times each vector (a row of ``vectors``), taken as rows of the model named for it."""
        size = len(self.space.terms)
        out = np.zeros((self.n, len(models)))
        if len(self.at):
            for i, k in enumerate(models):
                entries = np.take(self.space.weights[k] * vectors[i, :size], self.at)
                entries *= self.times
                out[self.with_terms, i] = np.add.reduceat(entries, self.starts)
        return out * self.inverse[:, models] + self.numeric @ vectors[:, size:].T

    def add_rows(self, numbers: np.ndarray, models: list[int], total: np.ndarray, power: int = 1) -> None:
        """Adds to ``total`` the sums of the rows (or of their squares), each times its number in a column of ``numbers``."""
        size = len(self.space.terms)
        if len(self.at):
            times = self.times**power
            for i, k in enumerate(models):
                entries = np.take(numbers[:, i] * self.inverse[:, k] ** power, self.owner)
                entries *= times
                total[i, :size] += np.bincount(self.at, entries, size) * self.space.weights[k] ** power
        total[:, size:] += numbers.T @ self.numeric**power

    def add_products(self, vectors: np.ndarray, model: int, total: np.ndarray) -> None:
        """Adds to ``total`` (columns x vectors) the rows, as those of one model, times their products with many
        vectors (columns x vectors). A few rows at a time are made dense in the terms that they have."""
        size, weights = len(self.space.terms), self.space.weights[model]
        entries = self.times * weights[self.at] * self.inverse[self.owner, model]
        has, place = np.zeros(size, bool), np.zeros(size, int)
        for start in range(0, self.n, DENSE):
            low, high = np.searchsorted(self.owner, [start, start + DENSE])
            at, numeric = self.at[low:high], self.numeric[start : start + DENSE]
            has[:] = False
            has[at] = True
            terms = np.flatnonzero(has)
            place[terms] = np.arange(len(terms))
            x = np.zeros((len(numeric), len(terms)))
            x[self.owner[low:high] - start, place[at]] = entries[low:high]
            products = x @ vectors[terms] + numeric @ vectors[size:]
            total[terms] += x.T @ products
            total[size:] += numeric.T @ products


class Solve:
    """The rows of one problem, persisted while the solve runs."""

    def __init__(self, df: DataFrame, fold: str, folds: int, targets: list[str], text: str, numeric: list[str], size: int, min_df: int, alpha: float):
        self.folds, self.targets, self.alpha = folds, targets, alpha
        parts = [F.count(F.lit(1)).alias("n"), *[F.sum(F.col(t).cast("double")).alias(f"t{i}") for i, t in enumerate(targets)]]
        per_fold = df.groupBy(F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold")).agg(*parts)
        self.per_fold = {r["fold"]: r for r in per_fold.collect()}
        spark = df.sparkSession
        number = lambda names: F.array(*[F.col(c).cast("double") for c in names]) if names else F.array().cast("array<double>")
        packed = df.withColumns({"_targets": number(targets), "_numeric": number(numeric)})
        counted = with_term_counts(packed.select(*dict.fromkeys([text, fold, "_targets", "_numeric"])), text)
        value = F.struct("at", "times", "norms", F.col("_numeric").alias("numeric"), F.col("_targets").alias("targets"), F.col(fold).cast("int").alias("fold"))
        candidates, rest = frequent_terms(with_term_counts(df.select(text), text), CANDIDATES * size, min_df)
        drafts = self.drafted(counted, value, candidates)
        try:
            n = [self.per_fold[k]["n"] if k in self.per_fold else 0 for k in range(folds)]
            n = np.array([*n, sum(r["n"] for r in self.per_fold.values()) - sum(n)], float)
            tf, df = np.split(_added(drafts, _tally(folds, len(candidates)), 2 * folds + 2, len(candidates)), 2)
            space = vocabularies(candidates, tf, df, n, rest, size, min_df)
            if space is None:
                drafts.unpersist()
                space = term_space(counted, fold, folds, n, size, min_df)
                drafts = self.drafted(counted, value, candidates := space.terms)
            # the last "model" has the terms of all others, for the preconditioner
            self.space = Space(space.terms, np.vstack([space.weights, space.weights.max(0, initial=0)]))
            self.width = len(self.space.terms) + len(numeric)
            self.shared = spark.sparkContext.broadcast(self.space)
            places = pc.fill_null(pc.index_in(candidates, value_set=space.terms), -1).to_numpy(zero_copy_only=False)
            pack = _pack(spark.sparkContext.broadcast((self.space, places)))
            self.blocks = drafts.mapInArrow(pack, ", ".join(f"{c} binary" for c in LAYOUT)).persist()
            self.blocks.count()
        finally:
            drafts.unpersist()
        self.rows = _placed(with_term_counts(packed, text, keep=True), self.shared).withColumn("_value", value).drop("at", "times", "norms", "_numeric", "_targets")

    def drafted(self, counted: DataFrame, value: Column, candidates: pa.Array) -> DataFrame:
        """Drafts of all rows with the terms that are among ``candidates``, persisted."""
        context = counted.sparkSession.sparkContext
        shared = context.broadcast(Space(candidates, np.zeros((0, len(candidates)))))
        drafts = _placed(counted, shared).select(value.alias("value")).mapInArrow(_draft(shared), ", ".join(f"{c} binary" for c in DRAFT))
        # the join before may leave few partitions; every pass should use all cores
        return drafts.repartition(context.defaultParallelism).persist()

    def close(self) -> None:
        """Frees the blocks. The space stays, since rows to predict are read later: an executor may
        hold on to a broadcast whose file has gone."""
        self.blocks.unpersist()

    def summed(self, add: Callable[[Packed, np.ndarray], None], count: int, width: int, order: str = "C") -> np.ndarray:
        """``count`` vectors of ``width`` entries, the sums over all blocks of what ``add`` adds for a block of rows.

        Tasks add up their own blocks, in an array of this ``order``; the sums are then added by pieces of ``BLOCK`` entries.
        """
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((count, width), order=order)
            for batch in batches:
                for at in range(batch.num_rows):
                    add(Packed(batch, at, shared.value), total)
            yield from _pieces(np.ascontiguousarray(total))

        return _added(self.blocks, run, count, width)

    def moments(self) -> None:
        """Per model: rows, means of columns and targets, squares of columns, products with targets."""
        folds, targets = self.folds, len(self.targets)

        models = [k for k in range(folds) for _ in range(1 + targets)]

        def add(block: Packed, total: np.ndarray) -> None:
            use = (block.fold[:, None] != np.arange(folds)).astype(float)
            numbers = np.hstack([np.ones((block.n, 1)), block.targets])
            block.add_rows((use[:, :, None] * numbers[:, None]).reshape(block.n, -1), models, total[folds:])
            block.add_rows(use, list(range(folds)), total[:folds], power=2)

        sums = self.summed(add, folds * (2 + targets), self.width)
        squares, sums = sums[:folds], sums[folds:].reshape(folds, 1 + targets, self.width)
        per_fold = self.per_fold
        outside = lambda name, k: sum(r[name] or 0 for f, r in per_fold.items() if f != k)
        self.n = np.array([outside("n", k) for k in range(folds)], float)
        if (self.n == 0).any():
            raise ValueError("a fold leaves no rows to fit on")
        self.target_means = np.array([[outside(f"t{t}", k) for t in range(targets)] for k in range(folds)]) / self.n[:, None]
        self.means = sums[:, 0] / self.n[:, None]
        self.diagonal = np.maximum(squares - self.n[:, None] * self.means**2, 0) + self.alpha
        self.right = sums[:, 1:] - self.n[:, None, None] * self.means[:, None] * self.target_means[:, :, None]
        if not (np.isfinite(self.right).all() and np.isfinite(self.diagonal).all()):
            raise ArithmeticError("a target or a numeric column is null or not finite")

    def product(self, vectors: np.ndarray) -> np.ndarray:
        """Each model's matrix, centred rows times themselves plus the penalty, times its vectors (models x targets x columns)."""
        folds, targets = self.folds, len(self.targets)
        sent = self.rows.sparkSession.sparkContext.broadcast(vectors.reshape(folds * targets, self.width))

        models = [k for k in range(folds) for _ in range(targets)]

        def add(block: Packed, total: np.ndarray) -> None:
            use = block.fold[:, None] != np.array(models)
            block.add_rows(block.times_vectors(sent.value, models) * use, models, total)

        found = self.summed(add, folds * targets, self.width).reshape(folds, targets, self.width)
        sent.unpersist()
        along = (self.means[:, None] * vectors).sum(2)
        return found - (self.n[:, None] * along)[:, :, None] * self.means[:, None] + self.alpha * vectors

    def prepare(self) -> None:
        """The preconditioner: directions in which all rows vary most, and how much they do.

        Rows are taken with the greatest weight of each term. Numeric columns are made as short as
        the text could be, or one of them would hide the others.
        """
        size, whole = len(self.space.terms), self.folds
        n = sum(r["n"] for r in self.per_fold.values())
        self.scale = np.ones(self.width)
        self.scale[size:] = np.minimum(1, np.sqrt(n / self.diagonal[:, size:].max(0)))
        count, rng = min(SKETCH, self.width), np.random.default_rng(0)
        given, found, total = rng.normal(size=(count, self.width)), np.zeros((count, self.width)), None
        for start in range(0, count, TOGETHER):
            many = min(TOGETHER, count - start)
            sent = self.rows.sparkSession.sparkContext.broadcast(np.ascontiguousarray((given[start : start + many] * self.scale).T))

            def add(block: Packed, total: np.ndarray, sent=sent, many=many) -> None:
                block.add_products(sent.value, whole, total[:many].T)
                block.add_rows(np.ones((block.n, 1)), [whole], total[many:])

            sums = self.summed(add, many + 1, self.width, order="F")
            found[start : start + many], total = sums[:many] * self.scale, sums[many] * self.scale
            sent.unpersist()
        found -= np.outer(given @ total / n, total) if count else 0
        values, vectors = np.linalg.eigh((given @ found.T + found @ given.T) / 2)
        kept = values > 1e-11 * values[-1:]
        roots = (vectors[:, kept] / np.sqrt(values[kept])).T @ found
        values, vectors = np.linalg.eigh(roots @ roots.T)
        some = values > 1e-11 * values[-1:]
        self.directions = (vectors[:, some] / np.sqrt(values[some])).T @ roots
        # beyond the directions as much as in the least of them, or nothing if they are all there are
        beyond = values[some][0] if some.any() and kept.all() else 0.0
        self.shrink = (beyond + self.alpha) / (values[some] + self.alpha) - 1
        numeric = np.ones((self.folds, self.width - size), bool)
        self.known = np.hstack([self.space.weights[:whole] > 0, numeric]).astype(float)[:, None]

    def preconditioned(self, r: np.ndarray) -> np.ndarray:
        z = (r * self.known * self.scale).reshape(-1, self.width)
        z += (z @ self.directions.T * self.shrink) @ self.directions
        return z.reshape(r.shape) * self.scale * self.known

    def solve(self) -> None:
        """Conjugate gradients, all models side by side; a model that is done takes no further steps."""
        self.moments()
        self.prepare()
        x, r = np.zeros_like(self.right), self.right.copy()
        z = self.preconditioned(r)
        p, rz = z.copy(), (r * z).sum(2)
        self.iterations = 0
        while True:
            if (np.sqrt((r * r).sum(2)) <= GRADIENT / 2).all():
                # the recursion drifts: the gradient counts as computed from the rows
                r = self.right - self.product(x)
                self.gradient = np.sqrt((r * r).sum(2))
                if (self.gradient <= GRADIENT).all():
                    break
                z = self.preconditioned(r)
                p, rz = z.copy(), (r * z).sum(2)
            if self.iterations == ITERATIONS:
                raise ArithmeticError(f"no convergence in {ITERATIONS} iterations")
            q = self.product(p)
            on = np.sqrt((r * r).sum(2)) > GRADIENT / 2
            step = np.divide(rz, (p * q).sum(2), out=np.zeros_like(rz), where=on)[:, :, None]
            x, r = x + step * p, r - step * q
            z = self.preconditioned(r)
            new = (r * z).sum(2)
            p = np.where(on[:, :, None], z + np.divide(new, rz, out=np.zeros_like(rz), where=on & (rz > 0))[:, :, None] * p, p)
            rz = np.where(on, new, rz)
            self.iterations += 1
        self.weights = x

    def predictions(self, suffix: str = "_pred") -> DataFrame:
        """The held-out rows of every model with a prediction for each target; other rows go."""
        targets, folds = self.targets, self.folds
        shared = self.shared
        offsets = self.target_means - (self.means[:, None] * self.weights).sum(2)
        sent = self.rows.sparkSession.sparkContext.broadcast((self.weights, offsets))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, constant = sent.value
            for part, block in _blocks(batches, shared.value):
                out = np.zeros((len(targets), block.n))
                for k in range(folds):
                    x, own = block.entries(k), block.fold == k
                    for t in range(len(targets)):
                        out[t][own] = (block.times_vector(x, weights[k, t]) + constant[k, t])[own]
                yield pa.RecordBatch.from_arrays([part.column("row"), *[pa.array(x) for x in out]], names=["row", *[t + suffix for t in targets]])

        held = self.rows.where(F.col("_value.fold").between(0, folds - 1))
        return with_results(held, "_value", run, ", ".join(f"`{t}{suffix}` double" for t in targets))

    def certificate(self) -> list[tuple]:
        """``fold, target, n_train, n_terms, target mean, gradient length`` of every model."""
        return [
            (k, t, int(self.n[k]), int(self.space.sizes[k]), float(self.target_means[k, i]), float(self.gradient[k, i]))
            for k in range(self.folds)
            for i, t in enumerate(self.targets)
        ]


def cross_fitted(
    df: DataFrame, fold: str, folds: int, targets: list[str], text: str = "text", numeric: list[str] | None = None,
    size: int = VOCABULARY, min_df: int = 1, alpha: float = ALPHA,
) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions of the ridge models, and one row about each model.

    Minimises ``|y - Xw - b|^2 + alpha |w|^2`` for every fold and target. The first table is the rows
    of ``df`` whose fold is 0 to ``folds`` - 1, with a prediction for each target; the second has
    ``fold, target, n_train, n_terms, mean, gradient``. Targets and numeric columns must not be null.
    Rows with empty or unknown text are predicted from their numeric columns and the mean.
    """
    solve = Solve(df, fold, folds, targets, text, numeric or [], size, min_df, alpha)
    try:
        solve.solve()
    finally:
        solve.close()
    models = df.sparkSession.createDataFrame(
        solve.certificate(), "fold int, target string, n_train long, n_terms long, mean double, gradient double"
    )
    return solve.predictions(), models
