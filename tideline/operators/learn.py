"""Ridge (Spark ML) and forest baselines, and their cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import forest
from tideline.operators.baselines import fit_mean, predict_mean
from tideline.operators.metrics import regression_errors

# fixed values: penalty of the ridge, number of trees
RIDGE_ALPHA = 1.0
TREES = 200


def assemble(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=name).transform(df)


def fit_ridge(train: DataFrame, features: str, targets: list[str], alpha: float = RIDGE_ALPHA) -> dict:
    """One ridge regression per target, minimising ``|y - Xw - b|^2 + alpha |w|^2``, by the normal equations.

    Spark ML divides the squared error by 2n and scales the penalty by the label's population
    deviation, so ``regParam`` undoes both.
    """
    stats = train.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(t).alias(t) for t in targets]).first()
    models = {}
    for t in targets:
        models[t] = LinearRegression(
            featuresCol=features,
            labelCol=t,
            predictionCol=t + "_pred",
            regParam=alpha / stats["n"] * (stats[t] or 0.0),
            elasticNetParam=0.0,
            standardization=False,
            solver="normal",
        ).fit(train)
    return models


def fit_forest(
    train: DataFrame, features: str, targets: list[str], trees: int = TREES, seed: int = 42,
    key: list[str] | None = None, max_rows: int | None = None, grid: float = 2.0**-12,
) -> dict:
    """One random forest per target, at most 30 levels deep, on all rows.

    With a ``key`` (unique) the forest depends on the rows and ``seed`` alone, however the table is
    partitioned: bags are drawn by a hash of the key, and targets are put on a ``grid``, so that
    sums of targets are exact in any order (up to 2 ** 53 grid steps).
    With ``max_rows`` it is fitted on that many rows at most: those with the smallest hash of
    ``key``.
    """
    if max_rows is not None:
        if not key:
            raise ValueError("a bound on rows needs a key to choose them by")
        place = F.xxhash64(*key, F.lit(seed))
        train = train.orderBy(place, *key).limit(max_rows)
    if key:
        exact = {t: F.round(F.col(t) / grid) * grid for t in targets}
        train = train.select(*key, features, *targets).withColumns(exact)
    hashed = F.xxhash64(*(key or [F.monotonically_increasing_id()]), F.lit(seed))
    return {t: forest.fit(train, features, t, t + "_pred", trees, hashed) for t in targets}


def apply_models(df: DataFrame, models: dict) -> DataFrame:
    return reduce(lambda d, m: m.transform(d), models.values(), df)


def fit_predict_mean(train: DataFrame, test: DataFrame, targets: list[str]) -> DataFrame:
    return predict_mean(test, fit_mean(train, targets), targets)


def fit_predict_ridge(features: list[str] | str):
    def run(train: DataFrame, test: DataFrame, targets: list[str]) -> DataFrame:
        name = features if isinstance(features, str) else "features"
        if not isinstance(features, str):
            train, test = assemble(train, features), assemble(test, features)
        return apply_models(test, fit_ridge(train, name, targets))

    return run


def fit_predict_forest(features: list[str], trees: int = TREES, key: list[str] | None = None):
    def run(train: DataFrame, test: DataFrame, targets: list[str]) -> DataFrame:
        models = fit_forest(assemble(train, features), "features", targets, trees, key=key)
        return apply_models(assemble(test, features), models)

    return run


def cross_predict(df: DataFrame, fold: str, folds: int, fit_predict: Callable, targets: list[str]) -> DataFrame:
    """Every row with the predictions of the model that did not see its fold."""
    parts = [fit_predict(df.where(F.col(fold) != k), df.where(F.col(fold) == k), targets) for k in range(folds)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cross_validate(
    df: DataFrame, fold: str, folds: int, models: dict[str, Callable], targets: list[str], slices: Callable | None = None
) -> DataFrame:
    """Metric rows (model, fold[, slice], ...) of every model on every fold. The loop
    over models and folds is short and runs on the driver; each fit is a Spark job."""
    rows = []
    for name, fit_predict in models.items():
        for k in range(folds):
            train, test = df.where(F.col(fold) != k), df.where(F.col(fold) == k)
            scored = fit_predict(train, test, targets)
            by = []
            if slices is not None:
                scored, by = slices(scored), ["slice"]
            found = regression_errors(scored, targets, by)
            rows.append(found.select(F.lit(name).alias("model"), F.lit(k).alias("fold"), *found.columns))
    return reduce(lambda a, b: a.unionByName(b), rows)
