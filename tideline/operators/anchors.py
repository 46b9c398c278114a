"""One row per entity: latest rows, as-of rows and marker rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.expressions import lenient_bool
from tideline.operators.joins import refuse, duplicate_keys, marker_rows
from tideline.roles import Roles
from tideline.scale import join_one_row_per_key


def _row_at(df: DataFrame, roles: Roles, pick: Callable[[Column], Column]) -> DataFrame:
    """The row per entity at its first or last place. Places are found on the slim key
    columns, one row per entity and task; then the one wide row of each is joined back."""
    places = df.groupBy(F.col(roles.entity).alias("_entity")).agg(pick(roles.order_value()).alias("_place"))
    same = F.col(roles.entity).eqNullSafe(F.col("_entity")) & roles.order_value().eqNullSafe(F.col("_place"))
    found = df.join(places, same).dropDuplicates([roles.entity])
    return found.select(*df.columns)


def latest_row(df: DataFrame, roles: Roles, where: Column | None = None) -> DataFrame:
    """Last row per entity in (ts, tie) order."""
    return _row_at(df if where is None else df.where(where), roles, F.max)


def earliest_row(df: DataFrame, roles: Roles) -> DataFrame:
    """First row per entity in (ts, tie) order."""
    return _row_at(df, roles, F.min)


def first_known(df: DataFrame, roles: Roles, columns: list[str]) -> DataFrame:
    """Per column the first non-null value of the entity."""
    return df.groupBy(roles.entity).agg(
        *[F.min_by(c, F.when(F.col(c).isNotNull(), roles.order_value())).alias(c) for c in columns]
    )


def latest_eligible(df: DataFrame, roles: Roles) -> DataFrame:
    """Last row per entity with both deltas known."""
    return latest_row(df, roles, roles.eligible())


def flagged_entities(markers: DataFrame, roles: Roles, flag: str) -> DataFrame:
    return markers.where(lenient_bool(F.col(flag)) & F.col(roles.entity).isNotNull()).select(roles.entity).distinct()


def latest_of_flagged(df: DataFrame, markers: DataFrame, roles: Roles, flag: str) -> DataFrame:
    """Last row of every entity that a marker table flags."""
    rows = join_one_row_per_key(df, flagged_entities(markers, roles, flag), [roles.entity], "left_semi")
    return latest_row(rows, roles)


def last_before(
    df: DataFrame, cutoffs: DataFrame, roles: Roles, cutoff: str = "cutoff", inclusive: bool = False, check: bool = True
) -> DataFrame:
    """As-of row: the last row per entity before its cutoff (the earliest one if it has
    several). Entities without such a row raise."""
    limits = cutoffs.groupBy(roles.entity).agg(F.min(cutoff).alias("_cutoff"))
    joined = join_one_row_per_key(df, limits, [roles.entity])
    ts = F.col(roles.ts)
    past = joined.where(ts <= F.col("_cutoff") if inclusive else ts < F.col("_cutoff")).drop("_cutoff")
    found = latest_row(past, roles)
    if check:
        refuse(limits.join(found, roles.entity, "left_anti"), [roles.entity], "no row before the cutoff")
    return found


def entities_without_row_before(df: DataFrame, cutoffs: DataFrame, roles: Roles, cutoff: str = "cutoff") -> DataFrame:
    """Entities of the cutoff table that have no row strictly before their cutoff."""
    found = last_before(df, cutoffs, roles, cutoff, check=False)
    return cutoffs.select(roles.entity).distinct().join(found, roles.entity, "left_anti")


def history_up_to(df: DataFrame, anchors: DataFrame, roles: Roles, length: int, anchor_ts: str = "anchor_ts") -> DataFrame:
    """The last ``length`` rows per entity at or before its anchor time, ``back`` = 0 for
    the newest. Spark keeps only ``length`` rows per entity and task before shuffling. An
    entity with two anchors is refused."""
    refuse(duplicate_keys(anchors, [roles.entity]), [roles.entity], "more than one anchor")
    limits = anchors.select(roles.entity, F.col(anchor_ts).alias("_anchor"))
    joined = join_one_row_per_key(df, limits, [roles.entity]).where(F.col(roles.ts) <= F.col("_anchor"))
    newest = W.partitionBy(roles.entity).orderBy(*[F.col(c).desc() for c in roles.order])
    ranked = joined.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= length)
    return ranked.withColumn("back", F.col("back") - 1).drop("_anchor")


def forecast_anchors(
    df: DataFrame, roles: Roles, cutoffs: DataFrame | None = None, markers: DataFrame | None = None, check: bool = True
) -> DataFrame:
    """Anchor row per entity, from whatever the caller has: cutoffs, flags, row keys or
    cutoff columns in a marker table."""
    if cutoffs is not None:
        return last_before(df, cutoffs, roles, check=check)
    if markers is None:
        raise ValueError("give cutoffs or markers")
    if "is_forecast" in markers.columns:
        return latest_of_flagged(df, markers, roles, "is_forecast")
    for key in ("anchor_id", roles.tie):
        if key in markers.columns:
            has_time = roles.ts in markers.columns
            order = Roles(entity=roles.entity, ts=roles.ts if has_time else key, tie=key)
            one = latest_row(markers, order) if has_time else earliest_row(markers, order)
            return marker_rows(one.select(roles.entity, key), df, {roles.entity: roles.entity, key: roles.tie}, check)
    for name in ("cutoff", "cutoff_ts", "ts_min"):
        if name in markers.columns:
            return last_before(df, markers, roles, name, check=check)
    raise ValueError(f"no anchor column among {markers.columns}")
