"""Per-entity history columns. All of them see only rows strictly before the current
one, except sequences and trajectories, which include it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.expressions import micros
from tideline.roles import Roles
from tideline.timeline import Lag, Previous, RowsBefore, RowTotal, SumBefore, Timeline

# fixed values: weight of the newest delta in the exponential average, and the share
# of an entity's rows that a time split holds out
EMA_ALPHA = 0.3
VALIDATION_SHARE = 0.2


def timeline(df: DataFrame, roles: Roles) -> Timeline:
    return Timeline(df, roles.entity, roles.order)


def previous_eligible_delta(tl: Timeline, roles: Roles) -> Timeline:
    """``<delta>_prev``: delta of the previous eligible row; null on rows that are not
    eligible and on the first eligible one."""
    ok = roles.eligible()
    tl = tl.running(**{d + "_prev": Previous(F.when(ok, F.col(d))) for d in roles.deltas})
    return tl.map(**{d + "_prev": F.when(ok, F.col(d + "_prev")) for d in roles.deltas})


def lagged_delta(tl: Timeline, roles: Roles) -> Timeline:
    """``<delta>_lag``: delta of the row just before, null if that is unknown."""
    return tl.running(**{d + "_lag": Lag(F.col(d)) for d in roles.deltas})


def momentum(tl: Timeline, roles: Roles) -> Timeline:
    """``<delta>_pred``: repeat the previous row's delta, 0 on an entity's first row."""
    tl = tl.running(**{d + "_pred": Lag(F.col(d)) for d in roles.deltas}, _pos=RowsBefore())
    first = F.col("_pos") == 0
    tl = tl.map(**{d + "_pred": F.when(first, 0.0).otherwise(F.col(d + "_pred")) for d in roles.deltas})
    return tl._with(tl.df.drop("_pos"))


def previous_state(tl: Timeline, roles: Roles) -> Timeline:
    """``<target>_prev_state``: last known target before the row."""
    return tl.running(**{t + "_prev_state": Previous(F.col(t)) for t in roles.targets})


def gap_seconds(ts: Column, before: Column) -> Column:
    return F.coalesce((micros(ts) - micros(before)) / 1e6, F.lit(0.0))


def history_features(tl: Timeline, roles: Roles, alpha: float = EMA_ALPHA, ema: bool = True) -> Timeline:
    """Gap to the previous row, number of earlier eligible rows, their mean deltas and
    exponential averages; all 0 where there is no history."""
    ok = roles.eligible()
    sums = {f"_sum_{d}": SumBefore(F.when(ok, F.col(d))) for d in roles.deltas}
    tl = tl.running(_before=Lag(F.col(roles.ts)), history_len=SumBefore(ok.cast("long")), **sums)
    means = {
        d + "_mean_prev": F.coalesce(F.try_divide(F.col(f"_sum_{d}"), F.col("history_len")), F.lit(0.0))
        for d in roles.deltas
    }
    tl = tl.map(gap_prev_seconds=gap_seconds(F.col(roles.ts), F.col("_before")), **means)
    tl = tl._with(tl.df.drop("_before", *sums))
    if not ema:
        return tl
    tl = tl.ema(alpha, ok, **{d + "_ema_prev": F.col(d) for d in roles.deltas})
    return tl.map(**{d + "_ema_prev": F.coalesce(F.col(d + "_ema_prev"), F.lit(0.0)) for d in roles.deltas})


def entry_index(tl: Timeline, name: str = "entry_index") -> Timeline:
    return tl.running(**{name: RowsBefore()})


def halves(tl: Timeline) -> Timeline:
    """``n_total``, ``cut`` = floor(n/2), ``entry_index`` and ``half`` (1 below the cut)."""
    tl = tl.running(entry_index=RowsBefore(), n_total=RowTotal())
    tl = tl.map(cut=F.floor(F.col("n_total") / 2).cast("long"))
    return tl.map(half=F.when(F.col("entry_index") < F.col("cut"), 1).otherwise(2))


def time_split(tl: Timeline, share: float = VALIDATION_SHARE) -> Timeline:
    """``part``: the first floor(n*(1-share)) rows of an entity, at least one and at most
    n-1, are 'train' and the rest 'val'; a single row is 'train'."""
    tl = tl.running(_pos=RowsBefore(), _n=RowTotal())
    n = F.col("_n")
    train = F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(1.0 - share)).cast("long")))
    tl = tl.map(part=F.when((n <= 1) | (F.col("_pos") < train), "train").otherwise("val"))
    return tl._with(tl.df.drop("_pos", "_n"))


def time_order(df: DataFrame) -> str:
    """The column that orders a table in time, from the accepted names."""
    # fixed values: accepted names, times before step numbers
    for name in ("ts", "timestamp", "time", "date", "datetime", "entry_index", "t", "step", "idx"):
        if name in df.columns:
            return name
    raise KeyError("no time or step column; a table has no row order to fall back on")


def trajectories(tl: Timeline, columns: list[str]) -> Timeline:
    """``<column>_path``: running total up to and including the row, nulls as 0."""
    tl = tl.running(**{c + "_path": SumBefore(F.col(c)) for c in columns})
    return tl.map(**{c + "_path": F.col(c + "_path") + F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def sequences(tl: Timeline, vector: str, length: int, zero: Column, name: str = "seq") -> Timeline:
    """``seq``: the vectors of the last ``length`` rows up to the current one, padded on
    the left with ``zero``, and ``seq_len``, the number of real ones."""
    tl = tl.tails(name, F.col(vector), length)
    tl = tl.map(seq_len=F.size(name))
    padding = F.array_repeat(zero, F.greatest(F.lit(length) - F.col("seq_len"), F.lit(0)))
    return tl.map(**{name: F.concat(padding, F.col(name))})


def zero_vector(size: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), size)
