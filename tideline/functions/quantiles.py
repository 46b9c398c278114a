"""Exact quantiles that do not gather a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.timeline import SumBefore, Timeline, Total


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values per group.

    Each distinct value is counted first; running counts along the values (cut into chunks
    where a group has too many) give the values at the two ranks around each quantile, which
    ordinary minimum aggregates read off. No buffer holds the values of a group.
    """
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"))
    entity = keys or ["_all"]
    counts = values.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_n"))
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    n = F.col("_n")
    ranked = Timeline(counts, entity, ["_x"]).running(_below=SumBefore(n), _total=Total(n)).result()
    aggregates = []
    for name, p in probabilities.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        reached = F.col("_below") + n
        low = F.min(F.when(reached > F.floor(at), F.col("_x")))
        high = F.min(F.when(reached > F.ceil(at), F.col("_x")))
        aggregates.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    result = ranked.groupBy(*entity).agg(*aggregates)
    return result if keys else result.drop("_all")
