"""Model inputs: one row per step or anchor with features, sequence, target and base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.baselines import fit_two_lags, predict_two_lags, residuals
from tideline.operators.filters import finite_features, missing_flags, zero_columns
from tideline.operators.joins import full_coverage
from tideline.operators.profiles import apply_norm_stats, fit_norm_stats
from tideline.operators.windows import (
    history_features,
    previous_eligible_delta,
    previous_state,
    sequences,
    timeline,
)
from tideline.roles import Roles
from tideline.scale import join_one_row_per_key

def feature_columns(roles: Roles) -> list[str]:
    """The numeric features in their order: what is known of past deltas, then base predictions, then states."""
    deltas, targets = roles.deltas, roles.targets
    states = [t + "_prev_state" for t in targets]
    lags, missing = [d + "_prev" for d in deltas], "{}_missing".format
    past = [*[d + "_mean_prev" for d in deltas], *[d + "_ema_prev" for d in deltas]]
    return [
        *lags, *map(missing, lags), "gap_prev_seconds", "history_len", *past, *[d + "_base" for d in deltas],
        *targets, *map(missing, targets), *states, *map(missing, states),
    ]


def history_block(df: DataFrame, roles: Roles) -> DataFrame:
    """All history columns of every row. One shuffle by entity serves them all."""
    tl = previous_eligible_delta(timeline(df, roles), roles)
    tl = previous_state(tl, roles)
    return history_features(tl, roles).result()


def feature_block(rows: DataFrame, model: DataFrame, roles: Roles, finish: bool = True) -> DataFrame:
    """History columns plus base predictions and missing flags, filled and finite. The
    base model is passed in, so it can only have seen the rows it was fitted on."""
    out = predict_two_lags(rows, model, roles, suffix="_base")
    out = missing_flags(
        out, [*[d + "_prev" for d in roles.deltas], *roles.targets, *[t + "_prev_state" for t in roles.targets]]
    )
    return finite_features(out, feature_columns(roles)) if finish else out


def train_rows(rows: DataFrame, split: DataFrame, on: list[str]) -> DataFrame:
    return join_one_row_per_key(rows, split.where(F.col("part") == "train").select(*on), on, "left_semi")


def step_dataset(
    df: DataFrame,
    vectors: DataFrame,
    split: DataFrame,
    split_on: list[str],
    roles: Roles,
    vector: str,
    length: int,
    zero: Column,
    vector_key: list[str],
    use_history: bool = True,
    residual: bool = True,
    normalise: bool = True,
    check: bool = True,
) -> DataFrame:
    """Every eligible step of an entity with its features, the sequence of the last
    ``length`` vectors, targets, base predictions and ``part``.

    Base model and normalisation come from the training part alone. Vectors are joined
    after the history columns, so the sorts behind those do not carry them.
    """
    rows = history_block(df, roles)
    model = fit_two_lags(train_rows(rows, split, split_on), roles)
    featured = feature_block(rows, model, roles)
    with_vectors = full_coverage(featured, vectors.select(*vector_key, vector), vector_key, check)
    steps = sequences(timeline(with_vectors, roles), vector, length, zero).result().drop(vector)
    steps = steps.where(roles.eligible())
    steps = join_one_row_per_key(steps, split.select(*split_on, "part"), split_on)
    # Targets keep their own columns: scaling must not touch them.
    if not use_history:
        steps = zero_columns(steps, feature_columns(roles))
    if residual:
        steps = residuals(steps, list(roles.deltas))
    if normalise:
        stats = fit_norm_stats(steps.where(F.col("part") == "train"), feature_columns(roles))
        steps = apply_norm_stats(steps, stats, feature_columns(roles))
    return steps


def anchor_dataset(steps: DataFrame, anchors: DataFrame, on: list[str], check: bool = True) -> DataFrame:
    """The step rows of the given anchors; every anchor must have exactly one."""
    return full_coverage(anchors.select(*on), steps, on, check)
