"""Row filters, value checks and column projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.expressions import clip, is_finite
from tideline.roles import Roles
from tideline.scale import join_one_row_per_key


def eligible_rows(df: DataFrame, roles: Roles) -> DataFrame:
    """Rows on which both deltas are known."""
    return df.where(roles.eligible())


def drop_incomplete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in any of the columns."""
    return df.na.drop(subset=columns)


def keep_where(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose flag or half equals a value."""
    return df.where(F.col(column) == F.lit(value))


def rows_of_part(df: DataFrame, split: DataFrame, on: list[str], part: str) -> DataFrame:
    """Rows that a stored split puts into a part."""
    keys = split.where(F.col("part") == part).select(*on)
    return join_one_row_per_key(df, keys, on, "left_semi")


def first_present(df: DataFrame, aliases: list[str], what: str = "column") -> str:
    """The first of several accepted names that the table has."""
    for name in aliases:
        if name in df.columns:
            return name
    raise KeyError(f"no {what} among {aliases}; table has {df.columns}")


def standard_forecast(df: DataFrame, label: str, entity: str = "user_id") -> DataFrame:
    """One prediction table in common form: entity as text, the two predictions named
    after ``label``, and the anchor columns that are there."""
    first = first_present(df, ["dv_pred", "delta_1_pred", "pred_1"], "first prediction")
    second = first_present(df, ["da_pred", "delta_2_pred", "pred_2"], "second prediction")
    columns = [
        F.col(entity).cast("string").alias(entity),
        F.col(first).cast("double").alias(f"dv_{label}"),
        F.col(second).cast("double").alias(f"da_{label}"),
    ]
    for optional in ("anchor_id", "anchor_ts"):
        if optional in df.columns:
            columns.append(F.col(optional))
    return df.select(*columns)


def range_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """One row per column: nulls, non-finite values, extremes and whether all known
    values are finite and within bounds. One pass for all columns."""
    rows = []
    for name, (low, high) in bounds.items():
        x = F.col(name).cast("double")
        fine = F.when(is_finite(x), x)
        outside = x.isNotNull() & ~F.coalesce((fine >= low) & (fine <= high), F.lit(False))
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                F.count(F.lit(1)).alias("n"),
                F.count_if(x.isNull()).alias("nulls"),
                F.count_if(x.isNotNull() & fine.isNull()).alias("non_finite"),
                F.min(fine).alias("min"),
                F.max(fine).alias("max"),
                (F.count_if(outside) == 0).alias("ok"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def require_range(df: DataFrame, bounds: dict[str, tuple[float, float]], what: str = "table") -> DataFrame:
    """Raise if a known value is out of bounds or not finite; else return the table."""
    bad = range_report(df, bounds).where(~F.col("ok")).collect()
    if bad:
        raise ValueError(f"{what}: out of range: " + "; ".join(f"{r['name']} in [{r['min']}, {r['max']}]" for r in bad))
    return df


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Clamp prediction columns."""
    return df.withColumns({c: clip(F.col(c), *b) for c, b in bounds.items() if c in df.columns})


def clip_report(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of rows out of bounds before and after clipping, per column."""
    rows = []
    for name, (low, high) in bounds.items():
        if name not in df.columns:
            continue
        x, y = F.col(name), clip(F.col(name), low, high)

        def share(c, low=low, high=high):
            return F.coalesce(F.avg(F.coalesce((c < low) | (c > high), F.lit(False)).cast("double")), F.lit(0.0))

        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                share(x).alias("before_share"),
                share(y).alias("after_share"),
                F.lit(float(low)).alias("low"),
                F.lit(float(high)).alias("high"),
            )
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def first_rows(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """Deterministic small subset for trial runs: the first ``n`` rows by key."""
    return df.orderBy(*key).limit(n)


def missing_flags(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``<column>_missing`` as 0/1."""
    return df.withColumns({c + "_missing": F.col(c).isNull().cast("float") for c in columns})


def finite_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls with 0 and cast to float; a NaN or infinite value fails the job."""
    out = {}
    for c in columns:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out[c] = F.when(is_finite(x), x.cast("float")).otherwise(
            F.raise_error(F.lit(f"feature {c} is not finite")).cast("float")
        )
    return df.withColumns(out)


def zero_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ablation: replace columns with 0."""
    return df.withColumns({c: F.lit(0.0).cast(df.schema[c].dataType) for c in columns})
