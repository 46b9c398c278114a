"""Summaries of a table or of its groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.expressions import is_finite
from tideline.scale import attach
from tideline.timeline import SumBefore, Timeline, Total

# fixed values: quantiles of the value summary and of the short description
SUMMARY_QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
DESCRIBE_QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def group_counts(df: DataFrame, by: str, distinct: str) -> DataFrame:
    """Rows and distinct keys per group."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(distinct).alias("n_keys"))


def entity_means(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    return df.groupBy(entity).agg(*[F.avg(c).alias(c + "_mean") for c in columns], F.count(F.lit(1)).alias("n_rows"))


def _entry(order: str | Column, at: Column) -> Column:
    name = F.lit(order) if isinstance(order, str) else order
    return F.struct(name.alias("_order"), at.alias("_at"))


def _ranked_counts(df: DataFrame, by: list[str], column: str, orders: Callable[[Column], Column]) -> DataFrame:
    """Counts ``_n`` of the distinct values of a column in one or more orders (entries ``_order, _at`` per
    value), with the rows of the group and order below each value, all its rows, and their sum.

    The input is read once; no buffer holds the values of a group."""
    counts = df.select(*by, F.col(column).cast("double").alias("_x")).groupBy(*by, "_x").agg(F.count(F.lit(1)).alias("_n"))
    long = counts.select(*by, "_n", F.inline(orders(F.col("_x"))))
    n = F.col("_n")
    running = Timeline(long, [*by, "_order"], ["_at"]).running(_below=SumBefore(n), _total=Total(n), _sum=Total(n * F.col("_at")))
    return running.result()


def _quantile(when: Column, p: float) -> Column:
    """Aggregate: linearly interpolated quantile of the ranked values of one order."""
    at, reached = F.col("_at"), F.col("_below") + F.col("_n")
    rank = F.lit(float(p)) * (F.col("_total") - 1)
    low = F.min(F.when(when & (reached > F.floor(rank)), at))
    high = F.min(F.when(when & (reached > F.ceil(rank)), at))
    return low + (high - low) * F.max(F.when(when, rank - F.floor(rank)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of the non-null values per column, from one scan."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "x")
    known = lambda x: F.array(_entry(F.when(x.isNotNull(), "value").otherwise("none"), x))
    ranked = _ranked_counts(long, ["name"], "x", known)
    is_value, n, at, total = F.col("_order") == "value", F.col("_n"), F.col("_at"), F.col("_total")
    mean, count = F.col("_sum") / total, F.coalesce(F.sum(F.when(is_value, n)), F.lit(0).cast("long"))
    spread = F.sum(F.when(is_value, n * (at - mean) * (at - mean)))
    return ranked.groupBy("name").agg(
        count.alias("n"),
        F.max(F.when(is_value, mean)).alias("mean"),
        F.when(count > 1, F.sqrt(spread / (count - 1))).alias("std"),
        F.min(F.when(is_value, at)).alias("min"),
        F.max(F.when(is_value, at)).alias("max"),
        *[_quantile(is_value, p).alias(name) for name, p in DESCRIBE_QUANTILES.items()],
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins over [min, max]; the last bin is closed. Empty bins
    are listed with 0. The bin list is fixed and small; the rows are not moved."""
    x = F.col(column)
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    # A constant column gets a bin of width 1 around its value.
    start = F.when(lo == hi, lo - 0.5).otherwise(lo).alias("start")
    width = (F.when(lo == hi, F.lit(1.0)).otherwise(hi - lo) / bins).alias("width")
    grid, start, width = ends.select(start, width), F.col("_grid")["start"], F.col("_grid")["width"]
    known = attach(df.where(x.isNotNull()).select(column), "_grid", grid)
    bin_of = F.least(F.floor((x - start) / width), F.lit(bins - 1)).cast("int")
    counts = known.groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    listed = attach(df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")), "_grid", grid)
    filled = listed.join(counts, "bin", "left")
    return filled.select(
        "bin", (start + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null included."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def value_summary(
    df: DataFrame, column: str, by: list[str], bounds: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Per group: counts of all, NaN and infinite values; over the finite ones mean,
    population deviation, extremes, quantiles, largest absolute value and its 99 %
    quantile. A null counts as NaN. ``bounds`` are per value of the first group column
    and give the shares below and above.

    The input is read once, into counts of its distinct values. Values and absolute values
    are two orders of that table, and every number comes from their running counts."""
    both = lambda x: F.when(is_finite(x), F.array(_entry("value", x), _entry("size", F.abs(x)))).otherwise(F.array(_entry("none", x)))
    ranked = _ranked_counts(df, by, column, both)
    n, at, total = F.col("_n"), F.col("_at"), F.col("_total")
    is_value, is_size, is_none = (F.col("_order") == o for o in ("value", "size", "none"))
    unknown = at.isNull() | F.isnan(at)
    number = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0).cast("long"))
    known = F.sum(F.when(is_value, n))
    mean = F.col("_sum") / total

    aggregates = [
        number(~is_size).alias("n"),
        number(is_none & unknown).alias("nan_count"),
        number(is_none & ~unknown).alias("inf_count"),
        F.max(F.when(is_value, mean)).alias("mean"),
        F.sqrt(F.sum(F.when(is_value, n * (at - mean) * (at - mean))) / known).alias("std"),
        F.min(F.when(is_value, at)).alias("min"),
        F.max(F.when(is_value, at)).alias("max"),
        F.max(F.when(is_size, at)).alias("abs_max"),
    ]
    if bounds:
        low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
        for name, (a, b) in bounds.items():
            low = F.when(F.col(by[0]) == name, F.lit(float(a))).otherwise(low)
            high = F.when(F.col(by[0]) == name, F.lit(float(b))).otherwise(high)
        ranked = ranked.withColumns({"_low": low, "_high": high})
        share = lambda outside: F.sum(F.when(is_value & outside.isNotNull(), n * outside.cast("int"))) / known
        aggregates += [share(at < F.col("_low")).alias("frac_below"), share(at > F.col("_high")).alias("frac_above")]
    aggregates += [_quantile(is_value, p).alias(name) for name, p in SUMMARY_QUANTILES.items()]
    return ranked.groupBy(*by).agg(*aggregates, _quantile(is_size, 0.99).alias("abs_p99"))


def prediction_summary(
    df: DataFrame,
    pred: dict[str, str],
    true: dict[str, str] | None = None,
    bounds: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Value summary of predictions, truths and residuals (where both are known), one
    row per target and kind. Bounds do not apply to residuals."""
    items = []
    for target, p in pred.items():
        items.append(F.struct(F.lit(target).alias("target"), F.lit("pred").alias("kind"), F.col(p).cast("double").alias("x")))
        if true:
            t = true[target]
            items.append(F.struct(F.lit(target).alias("target"), F.lit("true").alias("kind"), F.col(t).cast("double").alias("x")))
            resid = F.when(F.col(p).isNotNull() & F.col(t).isNotNull(), F.col(p) - F.col(t)).cast("double")
            items.append(F.struct(F.lit(target).alias("target"), F.lit("resid").alias("kind"), resid.alias("x")))
    long = df.select(F.inline(F.array(*items))).where((F.col("kind") != "resid") | F.col("x").isNotNull())
    found = value_summary(long, "x", ["target", "kind"], bounds)
    if not bounds:
        return found
    is_resid = F.col("kind") == "resid"
    return found.withColumns({c: F.when(~is_resid, F.col(c)) for c in ("frac_below", "frac_above")})


def table_sizes(df: DataFrame, entity: str) -> DataFrame:
    """Rows and entities of a prediction table."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(entity).alias("n_users"))


def fold_summary(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean and sample deviation of metrics over folds."""
    parts = []
    for m in metrics:
        parts += [F.avg(m).alias(m + "_mean"), F.stddev_samp(m).alias(m + "_std")]
    return rows.groupBy(*by).agg(*parts)


def fold_means(rows: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean of metrics over folds, skipping folds where they are undefined, and total n."""
    return rows.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.sum("n").alias("n"))


def top_entities(df: DataFrame, entity: str, k: int) -> DataFrame:
    """The k entities with most rows; ties in key order."""
    return df.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), entity).limit(k)


def best_row(df: DataFrame, metric: str, tie: str, by: list[str] | None = None, largest: bool = False) -> DataFrame:
    """The row with the smallest (or largest) known metric; ties go to the first ``tie``."""
    score = -F.col(metric) if largest else F.col(metric)
    order = F.when(F.col(metric).isNotNull(), F.struct(score, F.col(tie)))
    return df.groupBy(*(by or [])).agg(F.min_by(F.struct(*df.columns), order).alias("_row")).select("_row.*")
