"""Profiles of an entity's first half and their normalisation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.expressions import slope
from tideline.operators.joins import pair_means
from tideline.roles import Roles
from tideline.scale import attach

def profile_columns(roles: Roles) -> list[str]:
    """The numbers of a half profile, in order."""
    kinds = ("mean", "last", "std", "change", "slope")
    return [f"{t}_{kind}" for kind in kinds for t in roles.targets] + ["n_half1", "n_total", "cut"]


def half_profile(rows: DataFrame, roles: Roles) -> DataFrame:
    """Thirteen numbers per entity from the rows of its first half: mean, last value,
    population deviation, last minus first and slope on the row index of each target,
    and three counts; also the key of the last row. Expects the columns of
    ``windows.halves``. One aggregate with map-side combine."""
    at = roles.order_value()
    parts = []
    for t in roles.targets:
        x = F.col(t)
        parts += [
            F.avg(x).alias(f"{t}_mean"),
            F.max_by(x, at).alias(f"{t}_last"),
            F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(f"{t}_std"),
            (F.max_by(x, at) - F.min_by(x, at)).alias(f"{t}_change"),
            slope(x, F.col("entry_index").cast("double")).alias(f"{t}_slope"),
        ]
    parts += [
        F.count(F.lit(1)).alias("n_half1"),
        F.max("n_total").alias("n_total"),
        F.max("cut").alias("cut"),
        F.max_by(roles.ts, at).alias("last_ts"),
        F.max_by(roles.tie, at).alias("last_id"),
    ]
    return rows.where(F.col("half") == 1).groupBy(roles.entity).agg(*parts)


def mean_vector(column: str | Column) -> Column:
    """Aggregate: element-wise mean of float arrays, merged map-side."""
    column = F.col(column) if isinstance(column, str) else column
    return vector_to_array(Summarizer.mean(array_to_vector(column.cast("array<double>"))))


def pooled_vectors(rows: DataFrame, roles: Roles, vector: str, pooling: str = "mean") -> DataFrame:
    """One vector per entity: the mean, the last one, or both joined end to end."""
    last = F.max_by(F.col(vector).cast("array<double>"), roles.order_value())
    # fixed values: names of the pooling modes
    if pooling == "mean":
        pooled = mean_vector(vector)
    elif pooling == "last":
        pooled = last
    elif pooling == "mean_last":
        pooled = F.concat(mean_vector(vector), last)
    else:
        raise ValueError(f"pooling {pooling} is not one of mean, last, mean_last")
    return rows.groupBy(roles.entity).agg(pooled.alias("pooled"))


def profile_dataset(rows: DataFrame, labels: DataFrame, roles: Roles, vector: str) -> DataFrame:
    """Reduced profile: pooled vector and target means of half 1, joined to labels.
    Entities without a row in half 1 or without a label are left out."""
    first = rows.where(F.col("half") == 1)
    found = first.groupBy(roles.entity).agg(
        mean_vector(vector).alias("pooled"), *[F.avg(t).alias(t + "_mean") for t in roles.targets]
    )
    return found.join(labels, roles.entity)


def half_change(rows: DataFrame, roles: Roles) -> DataFrame:
    """Per entity with both halves: mean of half 2 minus mean of half 1 per target."""
    means = pair_means(rows, roles.entity, "half", list(roles.targets))
    return means.select(
        roles.entity, *[(F.col(f"{t}_mean_2") - F.col(f"{t}_mean_1")).alias(f"{t}_half_change") for t in roles.targets]
    )


def label_audit(rows: DataFrame, labels: DataFrame, roles: Roles, tolerance: float = 1e-6) -> DataFrame:
    """Compare stored half-change labels with the ones derived from the rows: one row
    with counts compared, without enough rows, mismatching, and the largest difference."""
    derived = half_change(rows, roles)
    names = [f"{t}_half_change" for t in roles.targets]
    stored = labels.select(roles.entity, *[F.col(n).alias("_l_" + n) for n in names])
    joined = stored.join(derived, roles.entity, "left")
    found = F.col(names[0]).isNotNull()
    parts = [F.count_if(found).alias("n_compared"), F.count_if(~found).alias("n_insufficient")]
    for t, n in zip(roles.targets, names):
        diff = F.abs(F.col(n) - F.col("_l_" + n))
        parts.append(F.coalesce(F.max(diff), F.lit(0.0)).alias(f"max_diff_{t}"))
        parts.append(F.count_if(diff > tolerance).alias(f"n_mismatch_{t}"))
    return joined.agg(*parts)


def fit_norm_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (name, mean, std) per column: population deviation, 0 replaced by 1."""
    rows = []
    for c in columns:
        s = F.coalesce(F.stddev_pop(c), F.lit(0.0))
        rows.append(
            F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.when(s == 0, 1.0).otherwise(s).alias("std"))
        )
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def apply_norm_stats(df: DataFrame, stats: DataFrame, columns: list[str]) -> DataFrame:
    """Standardise columns with stored statistics (one row per column)."""
    pairs = F.map_from_entries(F.collect_list(F.struct("name", F.struct("mean", "std"))))
    known = attach(df, "_stats", stats.where(F.col("name").isin(*columns)).agg(pairs.alias("by_name")))
    found = F.col("_stats")["by_name"]
    done = known.withColumns({c: (F.col(c) - found[c]["mean"]) / found[c]["std"] for c in columns})
    return done.drop("_stats")
