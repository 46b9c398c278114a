"""Ridge regression with k folds from mergeable moments.

One scan gives the moments of each fold: the matrix of sums of products of ``(1, features,
targets)``. Moments add up, so the training moments of a fold are those of all folds less its
own, and no fit reads rows again. The small systems are solved in expressions, a row per fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.terms import list_lengths

# fixed value: penalty of the ridge
ALPHA = 1.0


def _moments(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column("z")
            if (list_lengths(lists) != size - 1).any():
                raise ValueError(f"a row has not the {size - 1} numbers of features and targets")
            z = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size - 1)
            if not np.isfinite(z).all():
                raise ValueError("a feature or target is null or not finite")
            z = np.hstack([np.ones((len(z), 1)), z])
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for k in np.unique(fold).tolist():
                own = z[fold == k]
                sums[k] = sums.get(k, 0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))],
                names=["fold", "moments"],
            )

    return run


def fold_moments(df: DataFrame, fold: str, features: Column, width: int, targets: list[str]) -> DataFrame:
    """``fold, moments``: sums of products of 1, the ``width`` features and the targets, row by row of the matrix.

    Each task sends one matrix a fold. Rows without a fold count as fold -1. A null or infinite
    number is an error.
    """
    z = F.concat(features.cast("array<double>"), F.array(*[F.col(t).cast("double") for t in targets]))
    rows = df.select(F.coalesce(F.col(fold).cast("int"), F.lit(-1)).alias("fold"), z.alias("z"))
    sent = rows.mapInArrow(_moments(1 + width + len(targets)), "fold int, moments array<double>")
    return sent.groupBy("fold").agg(vector_to_array(Summarizer.sum(array_to_vector("moments"))).alias("moments"))


def _eliminated(matrix: Column, width: int) -> Column:
    """The rows of a positive definite system with its right-hand sides, after Gauss-Jordan elimination."""

    def step(m: Column, p: Column) -> Column:
        pivot = F.get(m, p)
        scaled = F.transform(pivot, lambda v: v / F.get(pivot, p))
        return F.transform(
            m, lambda row, i: F.when(i == p, scaled).otherwise(F.zip_with(row, scaled, lambda v, s: v - F.get(row, p) * s))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(width - 1)), matrix, step)


def leave_one_out(folds: int) -> dict[int, list[int]]:
    """Each fold's model is fitted on all other folds and on rows without one."""
    return {k: [f for f in range(-1, folds) if f != k] for k in range(folds)}


def fit_models(
    moments: DataFrame, plan: dict[int, list[int]], models: dict[str, list[int]], width: int, targets: int, alpha: float = ALPHA
) -> DataFrame:
    """``fold, n_train, models`` for each fold of ``plan``, which names the folds to fit on.

    ``models`` names the places of the features that a model uses; none gives the mean of the
    training rows. A model minimises ``|y - Xw - b|^2 + alpha |w|^2`` for each target: its
    ``weights`` have an array and its ``intercepts`` a number a target. A fold that leaves no
    rows to fit on is an error.
    """
    size = 1 + width + targets
    spark = moments.sparkSession
    every = spark.createDataFrame([(k,) for k in plan], "k int")
    pairs = spark.createDataFrame([(k, f) for k, known in plan.items() for f in known], "k int, fold int")
    train = pairs.join(F.broadcast(moments), "fold").groupBy("k").agg(vector_to_array(Summarizer.sum(array_to_vector("moments"))).alias("m"))
    train = every.join(train, "k", "left")
    at = lambda i, j: F.get(F.col("m"), i * size + j)
    zero = F.lit(0)
    none = F.raise_error(F.lit("a fold leaves no rows to fit on")).cast("double")
    counted = train.withColumn("n", F.when(F.coalesce(at(zero, zero), F.lit(0.0)) > 0, at(zero, zero)).otherwise(none))
    centred = lambda i, j: at(i, j) - at(zero, i) * at(zero, j) / F.col("n")
    fitted = []
    for number, use in enumerate(models.values()):
        own = F.array(*[F.lit(1 + i) for i in use]) if use else F.array().cast("array<int>")
        columns = F.array(*[F.lit(1 + i) for i in [*use, *range(width, width + targets)]])
        matrix = F.transform(own, lambda i: F.transform(columns, lambda j: centred(i, j) + F.when(i == j, float(alpha)).otherwise(0.0)))  # noqa: B023
        counted = counted.withColumn(f"matrix_{number}", matrix)
        solved = _eliminated(F.col(f"matrix_{number}"), len(use)) if use else F.col(f"matrix_{number}")
        counted = counted.withColumn(f"solved_{number}", solved)
        means = F.transform(own, lambda i: at(zero, i) / F.col("n"))
        weights, intercepts = [], []
        for t in range(targets):
            place = F.lit(len(use) + t)
            w = F.transform(f"solved_{number}", lambda row: F.get(row, place))  # noqa: B023
            weights.append(w)
            shift = F.aggregate(F.zip_with(w, means, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
            intercepts.append(at(zero, F.lit(1 + width + t)) / F.col("n") - shift)
        fitted.append(F.struct(F.array(*weights).alias("weights"), F.array(*intercepts).alias("intercepts")).alias(f"model_{number}"))
    return counted.select(F.col("k").alias("fold"), F.col("n").cast("long").alias("n_train"), *fitted)


def predictions(
    df: DataFrame, fold: str, plan: dict[int, list[int]], models: dict[str, list[int]], features: Column, width: int,
    targets: list[str], alpha: float = ALPHA, suffix: str = "_pred",
) -> DataFrame:
    """The rows whose fold is in ``plan``, once per model, with ``model`` and a prediction for each target.

    One scan for the moments of all folds and models, and one to score; the fitted models, a
    row a fold, are broadcast.
    """
    fitted = fit_models(fold_moments(df, fold, features, width, targets), plan, models, width, len(targets), alpha)
    rows = df.withColumn("_x", features.cast("array<double>"))
    rows = rows.join(F.broadcast(fitted.withColumnRenamed("fold", "_fold").drop("n_train")), F.col(fold) == F.col("_fold"))
    scored = []
    for number, (name, use) in enumerate(models.items()):
        x = F.array(*[F.get("_x", F.lit(i)) for i in use]) if use else F.array().cast("array<double>")
        values = []
        for t, target in enumerate(targets):
            products = F.zip_with(x, F.get(f"model_{number}.weights", F.lit(t)), lambda a, b: a * b)
            value = F.aggregate(products, F.get(f"model_{number}.intercepts", F.lit(t)), lambda s, v: s + v)
            values.append(value.alias(target + suffix))
        scored.append(F.struct(F.lit(name).alias("model"), *values))
    long = rows.withColumn("_scored", F.explode(F.array(*scored)))
    return long.select(*df.columns, F.col("_scored.model").alias("model"), *[F.col(f"_scored.{t}{suffix}") for t in targets])


def cross_fitted(
    df: DataFrame, fold: str, folds: int, features: Column, width: int, targets: list[str], alpha: float = ALPHA, suffix: str = "_pred"
) -> DataFrame:
    """The rows whose fold is 0 to ``folds`` - 1, with the predictions of the ridge that was fitted without their fold."""
    models = {"ridge": list(range(width))}
    return predictions(df, fold, leave_one_out(folds), models, features, width, targets, alpha, suffix).drop("model")
