"""Models side by side: one long table of held-out predictions, scored in one aggregate.

Two regimes. Unseen entities: whole entities are dealt into folds, each scored by a model that was
fitted on the others. Seen entities: the end of every entity's rows is held out from one model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import moment_ridge, splits, windows
from tideline.operators.aggregates import fold_means
from tideline.operators.metrics import regression_errors, with_slices
from tideline.scale import join_one_row_per_key
from tideline.timeline import Timeline

UNSEEN, SEEN = "unseen_user", "seen_user"


def unseen_folds(df: DataFrame, entity: str, folds: int) -> DataFrame:
    """``df`` with ``fold``: each entity in one of the folds 0 to ``folds`` - 1."""
    return join_one_row_per_key(df, splits.group_folds(df, entity, folds).select(entity, "fold"), [entity])


def seen_fold(df: DataFrame, entity: str, order: list[str]) -> DataFrame:
    """``df`` with ``fold``: 0 for the last fifth of an entity's rows in ``order``, -1 for rows to fit on."""
    parts = windows.time_split(Timeline(df, entity, order)).result()
    return parts.withColumn("fold", F.when(F.col("part") == "val", 0).otherwise(-1)).drop("part")


def regime_folds(df: DataFrame, entity: str, order: list[str], folds: int = 5) -> DataFrame:
    """Every row once per regime: ``regime``, and ``fold`` as a number for both regimes together.

    Folds 0 to ``folds`` - 1 are the unseen ones, ``folds`` holds the held-out ends and
    ``folds`` + 1 the rows before them.
    """
    unseen = unseen_folds(df, entity, folds).withColumn("regime", F.lit(UNSEEN))
    seen = seen_fold(df, entity, order)
    seen = seen.withColumns({"fold": F.when(F.col("fold") == 0, folds).otherwise(folds + 1), "regime": F.lit(SEEN)})
    return unseen.unionByName(seen)


def regime_plan(folds: int = 5) -> dict[int, list[int]]:
    """Which folds of ``regime_folds`` the model of a fold is fitted on."""
    return {k: [f for f in range(folds) if f != k] for k in range(folds)} | {folds: [folds + 1]}


def moment_predictions(
    df: DataFrame, entity: str, order: list[str], models: dict[str, list[str]], targets: list[str], folds: int = 5
) -> DataFrame:
    """Held-out predictions of ridge models on numeric columns, in both regimes: ``model, regime, fold`` beside
    the rows. A model without columns predicts the mean. All models and folds come from the same moments."""
    columns = list(dict.fromkeys(c for own in models.values() for c in own))
    places = {name: [columns.index(c) for c in own] for name, own in models.items()}
    rows = regime_folds(df, entity, order, folds)
    numbers = F.array(*[F.col(c).cast("double") for c in columns]) if columns else F.array().cast("array<double>")
    return moment_ridge.predictions(rows, "fold", regime_plan(folds), places, numbers, len(columns), targets)


def comparison(long: DataFrame, targets: list[str], flag: str, names: tuple[str, str] = ("words", "essays")) -> DataFrame:
    """``model, regime, slice, n`` and MAE, MSE and correlation of each target: means over the folds of a regime
    (folds where a correlation is undefined are left out), for all rows and for those with and without the flag."""
    by = ["model", "regime", "slice"]
    per_fold = regression_errors(with_slices(long, flag, *names), targets, [*by, "fold"])
    return fold_means(per_fold, by, [f"{m}_{t}" for t in targets for m in ("mae", "mse", "r")])
