"""Evaluation metrics. Every metric is an aggregate with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.expressions import direction_accuracy, huber, mae, mse, pearson, safe_pearson
from tideline.operators.joins import aligned, union_reports

# fixed values: columns of the evaluation log, in order, and their types
LOG_SCHEMA = (
    "run_id string, git_commit string, seed bigint, timestamp string, config_hash string, task string, "
    "regime string, slice string, model_tag string, primary_score double, "
    "r_composite_valence double, r_within_valence double, r_between_valence double, "
    "r_composite_arousal double, r_within_arousal double, r_between_arousal double, "
    "r_delta_valence double, r_delta_arousal double, r_dispo_valence double, r_dispo_arousal double, "
    "mae_valence double, mae_arousal double, mse_valence double, mse_arousal double, "
    "mae_delta_valence double, mae_delta_arousal double, mae_dispo_valence double, mae_dispo_arousal double"
)


def pairs(columns: list[str]) -> dict[str, tuple[Column, Column]]:
    """Truth and prediction of each column under the usual names."""
    return {c: (F.col(c), F.col(c + "_pred")) for c in columns}


def delta_errors(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """MAE, MSE and share of agreeing signs per column."""
    parts = []
    for c, (t, p) in pairs(columns).items():
        parts += [mae(t, p).alias(f"mae_{c}"), mse(t, p).alias(f"mse_{c}"), direction_accuracy(t, p).alias(f"sign_{c}")]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *parts)


def regression_errors(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """MAE, MSE and correlation (null where undefined) per column."""
    parts = []
    for c, (t, p) in pairs(columns).items():
        parts += [mae(t, p).alias(f"mae_{c}"), mse(t, p).alias(f"mse_{c}"), pearson(t, p).alias(f"r_{c}")]
    return df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *parts)


def correlation_errors(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Correlation (0 where undefined) and MAE per column and their primary score, the
    mean of the correlations."""
    parts = []
    for c, (t, p) in pairs(columns).items():
        parts += [safe_pearson(t, p).alias(f"r_{c}"), mae(t, p).alias(f"mae_{c}")]
    found = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *parts)
    total = sum((F.col(f"r_{c}") for c in columns), F.lit(0.0))
    return found.withColumn("primary_score", total / len(columns))


def with_slices(df: DataFrame, flag: str, yes: str, no: str) -> DataFrame:
    """Each row once for slice 'all' and once for the slice of its flag."""
    return df.withColumn("slice", F.explode(F.array(F.lit("all"), F.when(F.col(flag), yes).otherwise(no))))


def composite_correlations(df: DataFrame, entity: str, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Within-entity, between-entity and composite correlation per column, MAE and MSE,
    and the primary score (mean of the composites).

    Within: unweighted mean of the correlations of entities with two rows or more, 0 if
    there are none. Between: correlation of the entity means. One aggregate per entity
    and one over entities; the error sums ride along, so rows are read once.
    """
    by = by or []
    parts = [F.count(F.lit(1)).alias("_n")]
    for c, (t, p) in pairs(columns).items():
        parts += [
            safe_pearson(t, p).alias(f"_r_{c}"),
            F.avg(t).alias(f"_t_{c}"),
            F.avg(p).alias(f"_p_{c}"),
            F.sum(F.abs(t - p)).alias(f"_ae_{c}"),
            F.sum(F.pow(t - p, F.lit(2.0))).alias(f"_se_{c}"),
            F.count(t - p).alias(f"_k_{c}"),
        ]
    per_entity = df.groupBy(*by, entity).agg(*parts)
    found = [F.sum("_n").alias("n")]
    for c in columns:
        found += [
            F.coalesce(F.avg(F.when(F.col("_n") >= 2, F.col(f"_r_{c}"))), F.lit(0.0)).alias(f"r_within_{c}"),
            safe_pearson(F.col(f"_t_{c}"), F.col(f"_p_{c}")).alias(f"r_between_{c}"),
            F.try_divide(F.sum(f"_ae_{c}"), F.sum(f"_k_{c}")).alias(f"mae_{c}"),
            F.try_divide(F.sum(f"_se_{c}"), F.sum(f"_k_{c}")).alias(f"mse_{c}"),
        ]
    out = per_entity.groupBy(*by).agg(*found)
    out = out.withColumns(
        {f"r_composite_{c}": (F.col(f"r_within_{c}") + F.col(f"r_between_{c}")) / 2 for c in columns}
    )
    total = sum((F.col(f"r_composite_{c}") for c in columns), F.lit(0.0))
    return out.withColumn("primary_score", total / len(columns))


def metrics_from_stored(
    truth: DataFrame, preds: DataFrame, key: list[str], entity: str, columns: list[str], flag: str, check: bool = True
) -> DataFrame:
    """Sliced composite metrics of stored predictions whose keys equal the truth's."""
    given = preds.select(*key, *[c + "_pred" for c in columns])
    joined = aligned(truth.select(*dict.fromkeys([*key, entity, flag, *columns])), given, key, check)
    return composite_correlations(with_slices(joined, flag, "words", "essays"), entity, columns, ["slice"])


def entity_diagnostics(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Per entity: rows, correlation and MAE."""
    parts = []
    for c, (t, p) in pairs(columns).items():
        parts += [safe_pearson(t, p).alias(f"r_{c}"), mae(t, p).alias(f"mae_{c}")]
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n"), *parts)


def score_with_exclusions(preds: DataFrame, expected: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """Two-column score with entities scored and entities left without a prediction."""
    score = correlation_errors(preds, columns)
    scored = preds.agg(F.countDistinct(entity)).scalar()
    wanted = expected.agg(F.countDistinct(entity)).scalar()
    return score.withColumns({"n_scored": scored, "n_excluded": wanted - scored})


def weighted_loss(
    df: DataFrame, weights: dict[str, float], kind: str = "mse", beta: float = 1.0, by: list[str] | None = None
) -> DataFrame:
    """Weighted sum of the mean losses of the columns: squared or smooth absolute error."""
    parts = []
    for c, (t, p) in pairs(list(weights)).items():
        loss = F.avg(huber(t, p, beta)) if kind == "huber" else mse(t, p)
        parts.append(loss.alias(f"loss_{c}"))
    found = df.groupBy(*(by or [])).agg(*parts)
    return found.withColumn("loss", sum((F.lit(float(w)) * F.col(f"loss_{c}") for c, w in weights.items()), F.lit(0.0)))


def union_columns(columns: list[str], *tables: DataFrame) -> DataFrame:
    """Stack the given columns of several tables."""
    return union_reports(*[t.select(*columns) for t in tables])


def compare_models(tables: dict[str, DataFrame], keep: list[str]) -> DataFrame:
    """Metric rows of several models in one table."""
    return union_reports(*[t.select(F.lit(name).alias("model"), *keep) for name, t in tables.items()])
