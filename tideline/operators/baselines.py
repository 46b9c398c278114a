"""Baseline models, residuals, blends and submission tables.

A fitted baseline is a small DataFrame of coefficients. Applying it reads that table as
a scalar subquery, so fitting and applying stay one lazy plan and only fitted rows
influence the coefficients.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.expressions import is_finite
from tideline.operators.anchors import latest_eligible
from tideline.operators.joins import aligned, require_unique
from tideline.roles import Roles
from tideline.scale import attach

MIN_FIT_ROWS = 50  # fixed value: rows a one-lag fit needs


def fit_mean(train: DataFrame, columns: list[str]) -> DataFrame:
    return train.agg(*[F.avg(c).alias(c) for c in columns])


def predict_mean(df: DataFrame, means: DataFrame, columns: list[str]) -> DataFrame:
    """``<column>_pred``: the training mean."""
    known = attach(df, "_means", means.select(*columns))
    return known.withColumns({c + "_pred": F.col("_means")[c] for c in columns}).drop("_means")


def predict_zero(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c + "_pred": F.lit(0.0) for c in columns})


def fit_two_lags(train: DataFrame, roles: Roles) -> DataFrame:
    """Least squares of each delta on both previous deltas and an intercept.

    One row per delta from second moments: a single aggregate, no matrix of rows.
    Expects ``<delta>_prev``; rows without both are not used. Collinear lags get the solution of
    least norm. Without a usable row the job fails.
    """
    p, q = (F.col(d + "_prev") for d in roles.deltas)
    used = p.isNotNull() & q.isNotNull()
    parts = [F.count_if(used).alias("n"), F.countDistinct(roles.entity).alias("users")]
    x1, x2 = F.when(used, p), F.when(used, q)
    parts += [F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(x1).alias("s11"), F.var_pop(x2).alias("s22")]
    parts += [F.covar_pop(x1, x2).alias("s12")]
    for i, d in enumerate(roles.deltas):
        y = F.when(used, F.col(d))
        parts += [F.avg(y).alias(f"my{i}"), F.covar_pop(x1, y).alias(f"c1{i}"), F.covar_pop(x2, y).alias(f"c2{i}")]
    c = F.col
    det = c("s11") * c("s22") - c("s12") * c("s12")
    solvable = det > 1e-12 * c("s11") * c("s22")
    rows = []
    for i, d in enumerate(roles.deltas):
        spread2 = (c("s11") + c("s22")) * (c("s11") + c("s22"))
        alone1 = F.coalesce(F.try_divide(c("s11") * c(f"c1{i}") + c("s12") * c(f"c2{i}"), spread2), F.lit(0.0))
        alone2 = F.coalesce(F.try_divide(c("s12") * c(f"c1{i}") + c("s22") * c(f"c2{i}"), spread2), F.lit(0.0))
        b1 = F.when(solvable, F.try_divide(c("s22") * c(f"c1{i}") - c("s12") * c(f"c2{i}"), det)).otherwise(alone1)
        b2 = F.when(solvable, F.try_divide(c("s11") * c(f"c2{i}") - c("s12") * c(f"c1{i}"), det)).otherwise(alone2)
        rows.append(
            F.struct(
                F.lit(d).alias("delta"),
                F.when(c("n") > 0, c(f"my{i}") - b1 * c("m1") - b2 * c("m2"))
                .otherwise(F.raise_error(F.lit(f"no row with both lags to fit {d}")).cast("double"))
                .alias("intercept"),
                b1.alias("coef_1"),
                b2.alias("coef_2"),
                c("n").alias("fit_rows"),
                c("users").alias("n_users"),
            )
        )
    return train.agg(*parts).select(F.inline(F.array(*rows)))


def _with_coefficients(df: DataFrame, model: DataFrame) -> tuple[DataFrame, Column]:
    """Add the coefficient table (one row per delta) to every row, as a map."""
    values = F.struct(*[c for c in model.columns if c != "delta"])
    table = model.agg(F.map_from_entries(F.collect_list(F.struct("delta", values))).alias("by_delta"))
    return attach(df, "_model", table), F.col("_model")["by_delta"]


def predict_two_lags(df: DataFrame, model: DataFrame, roles: Roles, suffix: str = "_pred", fill: float = 0.0) -> DataFrame:
    """Apply ``fit_two_lags``; unknown lags count as ``fill``. Expects ``<delta>_prev``."""
    df, k = _with_coefficients(df, model)
    p, q = (F.coalesce(F.col(d + "_prev"), F.lit(fill)) for d in roles.deltas)
    done = df.withColumns(
        {d + suffix: k[d]["intercept"] + k[d]["coef_1"] * p + k[d]["coef_2"] * q for d in roles.deltas}
    )
    return done.drop("_model")


def fit_one_lag(train: DataFrame, roles: Roles, min_rows: int = MIN_FIT_ROWS) -> DataFrame:
    """Least squares of each delta on its own ``<delta>_lag``; too few rows fail the job."""
    rows = []
    for d in roles.deltas:
        used = F.col(d).isNotNull() & F.col(d + "_lag").isNotNull()
        y, x = F.when(used, F.col(d)), F.when(used, F.col(d + "_lag"))
        n = F.count_if(used)
        b = F.coalesce(F.try_divide(F.covar_pop(y, x), F.var_pop(x)), F.lit(0.0))
        b = F.when(n >= min_rows, b).otherwise(F.raise_error(F.lit(f"too few rows to fit {d}")).cast("double"))
        rows.append(
            F.struct(
                F.lit(d).alias("delta"), (F.avg(y) - b * F.avg(x)).alias("intercept"), b.alias("coef"), n.alias("fit_rows")
            )
        )
    return train.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def predict_one_lag(df: DataFrame, model: DataFrame, roles: Roles) -> DataFrame:
    df, k = _with_coefficients(df, model)
    done = df.withColumns(
        {
            d + "_pred": k[d]["intercept"] + k[d]["coef"] * F.coalesce(F.col(d + "_lag"), F.lit(0.0))
            for d in roles.deltas
        }
    )
    return done.drop("_model")


def anchor_predictions(rows: DataFrame, roles: Roles) -> DataFrame:
    """One prediction row per entity at its latest eligible row. The rows must already
    carry predictions made from their full history."""
    a = latest_eligible(rows, roles)
    return a.select(
        roles.entity,
        F.col(roles.tie).alias("anchor_id"),
        F.col(roles.ts).alias("anchor_ts"),
        *[F.col(d).alias(d + "_true") for d in roles.deltas],
        *[F.col(d + "_pred") for d in roles.deltas],
    )


def residuals(df: DataFrame, columns: list[str], base: str = "_base") -> DataFrame:
    """``<column>_resid`` = truth minus base prediction."""
    return df.withColumns({c + "_resid": F.col(c) - F.col(c + base) for c in columns})


def recompose(df: DataFrame, columns: list[str], base: str = "_base") -> DataFrame:
    """``<column>_pred`` = base prediction plus predicted residual."""
    return df.withColumns({c + "_pred": F.col(c + base) + F.col(c + "_resid_pred") for c in columns})


def blend(model: DataFrame, base: DataFrame, weights: dict[str, float], on: str, check: bool = True) -> DataFrame:
    """``alpha * model + (1 - alpha) * base`` per column, for identical key sets. A
    non-finite result fails the job."""
    for name, alpha in weights.items():
        if not 0.0 <= alpha <= 1.0:
            raise ValueError(f"weight of {name} must be in [0, 1]")
    m = model.select(on, *[F.col(c).alias("_m_" + c) for c in weights])
    b = base.select(on, *[F.col(c).alias("_b_" + c) for c in weights])
    joined = aligned(m, b, [on], check)
    out = []
    for c, alpha in weights.items():
        mixed = F.lit(alpha) * F.col("_m_" + c) + F.lit(1.0 - alpha) * F.col("_b_" + c)
        out.append(F.when(is_finite(mixed), mixed).otherwise(F.raise_error(F.lit(f"{c} is not finite")).cast("double")).alias(c))
    return joined.select(on, *out)


def ensemble(tables: list[DataFrame], key: list[str], columns: list[str]) -> DataFrame:
    """Mean of k prediction tables with equal key sets; a key missing somewhere fails."""
    stacked = reduce(lambda a, b: a.unionByName(b), [t.select(*key, *columns) for t in tables])
    k = len(tables)
    means = stacked.groupBy(*key).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("_k"))
    complete = F.when(F.col("_k") == k, F.lit(True)).otherwise(F.raise_error(F.lit("key sets differ")).cast("boolean"))
    return means.where(complete).drop("_k")


def submission(
    preds: DataFrame, key: list[str], columns: dict[str, str], expected: DataFrame | None = None, check: bool = True
) -> DataFrame:
    """Final table: renamed columns, unique keys equal to the expected ones, finite
    values, sorted by key."""
    if check:
        require_unique(preds, key, "predictions")
        if expected is not None:
            aligned(preds.select(*key), expected.select(*key).distinct(), key)
    out = [
        F.when(is_finite(F.col(c)), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not finite")).cast("double")).alias(n)
        for c, n in columns.items()
    ]
    return preds.select(*key, *out).orderBy(*key)
