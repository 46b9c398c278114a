"""Running values over entity timelines, safe for entities of any size.

``Timeline`` holds rows that belong to entities and have a total order. The running
values are window expressions. When one entity is too large for a task, its rows are
cut into chunks (:func:`tideline.scale.spread`): the same window expressions run per
chunk, each chunk is reduced to one summary row, and what enters a chunk from the
chunks before it is computed from the summaries and joined back. Only summaries of cut
entities are joined back.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.scale import CHUNK, same_key, spread


@dataclass(frozen=True)
class Previous:
    """Last non-null value strictly before the row."""

    value: Column

    def local(self, tl: Timeline) -> Column:
        return F.last(self.value, ignorenulls=True).over(tl.before)

    def summary(self, tl: Timeline) -> Column:
        return F.max_by(self.value, F.when(self.value.isNotNull(), tl.order_value))

    def carry(self, summary: Column, chunks: WindowSpec) -> Column:
        return F.last(summary, ignorenulls=True).over(chunks.rowsBetween(W.unboundedPreceding, -1))

    def merge(self, local: Column, carry: Column | None) -> Column:
        return local if carry is None else F.coalesce(local, carry)


@dataclass(frozen=True)
class Lag:
    """Value of the row just before, null included."""

    value: Column

    def local(self, tl: Timeline) -> Column:
        value = F.struct(self.value.alias("x")) if tl.chunked else self.value
        return F.lag(value, 1).over(tl.window)

    def summary(self, tl: Timeline) -> Column:
        return F.max_by(F.struct(self.value.alias("x")), tl.order_value)

    def carry(self, summary: Column, chunks: WindowSpec) -> Column:
        return F.lag(summary, 1).over(chunks)

    def merge(self, local: Column, carry: Column | None) -> Column:
        return local if carry is None else F.coalesce(local, carry)["x"]


@dataclass(frozen=True)
class Next:
    """Value of the row just after, null included."""

    value: Column

    def local(self, tl: Timeline) -> Column:
        value = F.struct(self.value.alias("x")) if tl.chunked else self.value
        return F.lead(value, 1).over(tl.window)

    def summary(self, tl: Timeline) -> Column:
        return F.min_by(F.struct(self.value.alias("x")), tl.order_value)

    def carry(self, summary: Column, chunks: WindowSpec) -> Column:
        return F.lead(summary, 1).over(chunks)

    def merge(self, local: Column, carry: Column | None) -> Column:
        return local if carry is None else F.coalesce(local, carry)["x"]


@dataclass(frozen=True)
class SumBefore:
    """Sum of the non-null values strictly before the row; 0 if there are none."""

    value: Column

    def local(self, tl: Timeline) -> Column:
        return F.sum(self.value).over(tl.before)

    def summary(self, tl: Timeline) -> Column:
        return F.sum(self.value)

    def carry(self, summary: Column, chunks: WindowSpec) -> Column:
        return F.sum(summary).over(chunks.rowsBetween(W.unboundedPreceding, -1))

    def merge(self, local: Column, carry: Column | None) -> Column:
        mine = F.coalesce(local, F.lit(0))
        return mine if carry is None else mine + F.coalesce(carry, F.lit(0))


@dataclass(frozen=True)
class Total:
    """Sum of the values of all rows of the entity."""

    value: Column

    def local(self, tl: Timeline) -> Column:
        return F.sum(self.value).over(W.partitionBy(*tl.keys))

    def summary(self, tl: Timeline) -> Column:
        return F.sum(self.value)

    def carry(self, summary: Column, chunks: WindowSpec) -> Column:
        return F.sum(summary).over(chunks.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))

    def merge(self, local: Column, carry: Column | None) -> Column:
        return local if carry is None else F.coalesce(carry, local)


def RowsBefore() -> SumBefore:
    """Number of rows strictly before: the 0-based position."""
    return SumBefore(F.lit(1).cast("long"))


def RowTotal() -> Total:
    return Total(F.lit(1).cast("long"))


class Timeline:
    """Rows of entities in a total order, with running values added step by step."""

    def __init__(self, df: DataFrame, entity: list[str] | str, order: list[str]):
        self.entity = [entity] if isinstance(entity, str) else list(entity)
        self.order = list(order)
        self.df, self.chunked = spread(df, self.entity, self.order)
        self._windows()

    def _windows(self) -> None:
        self.keys = self.entity + ([CHUNK] if self.chunked else [])
        self.window = W.partitionBy(*self.keys).orderBy(*self.order)
        self.before = self.window.rowsBetween(W.unboundedPreceding, -1)
        self.order_value = F.struct(*self.order)

    def _with(self, df: DataFrame) -> Timeline:
        other = object.__new__(Timeline)
        other.entity, other.order, other.df, other.chunked = self.entity, self.order, df, self.chunked
        other._windows()
        return other

    def result(self) -> DataFrame:
        return self.df.drop(CHUNK) if self.chunked else self.df

    def map(self, **columns: Column) -> Timeline:
        """Add row-wise columns."""
        return self._with(self.df.withColumns(columns))

    def running(self, **parts) -> Timeline:
        """Add one column per named running value."""
        names = list(parts)
        local = self.df.select("*", *[parts[n].local(self).alias(n) for n in names])
        if not self.chunked:
            return self._with(local.withColumns({n: parts[n].merge(F.col(n), None) for n in names}))
        summary = self.df.groupBy(*self.keys).agg(*[parts[n].summary(self).alias(n) for n in names])
        chunks = W.partitionBy(*self.entity).orderBy(CHUNK)
        carry = self._of_cut_entities(summary, {n: parts[n].carry(F.col(n), chunks) for n in names})
        return self._join_carry(local, carry, {n: parts[n].merge for n in names})

    def _of_cut_entities(self, summary: DataFrame, carries: dict[str, Column]) -> DataFrame:
        """One row per chunk of every entity that has more than one chunk."""
        chunk_count = F.count(F.lit(1)).over(W.partitionBy(*self.entity))
        columns = [F.col(k).alias("_c_" + k) for k in self.keys]
        columns += [c.alias("_c_" + n) for n, c in carries.items()]
        return summary.select(*columns, chunk_count.alias("_chunks")).where("_chunks > 1").drop("_chunks")

    def _join_carry(self, local: DataFrame, carry: DataFrame, merges: dict) -> Timeline:
        joined = local.join(carry, same_key(local, carry, self.keys, "_c_"), "left")
        merged = joined.withColumns({n: m(F.col(n), F.col("_c_" + n)) for n, m in merges.items()})
        return self._with(merged.drop(*carry.columns))

    def ema(self, alpha: float, eligible: Column, **values: Column) -> Timeline:
        """Exponential average of the eligible values strictly before the row.

        Recurrence ``s = (1-alpha)*s + alpha*x`` over eligible rows, started at the first
        value; null before the first eligible row. Eligible rows are numbered and cut into
        blocks long enough for the weight of anything before the previous block to be
        under 1e-18, so a weighted running sum per block plus the end of the previous block
        gives the state: constant work per row whatever the length of the history.
        """
        keep = 1.0 - alpha
        size = max(2, math.ceil(math.log(1e-18) / math.log(keep)))
        names = list(values)
        started = self.df.withColumn("_ok", eligible)
        started = started.withColumns({"_x_" + n: F.when(F.col("_ok"), v) for n, v in values.items()})
        seen = F.coalesce(F.sum(F.col("_ok").cast("long")).over(self.before), F.lit(0))
        started = started.withColumn("_seen", seen)
        started = started.withColumns({"_block": F.floor(F.col("_seen") / size), "_at": F.col("_seen") % size})
        power = F.pow(F.lit(keep), F.col("_at"))
        in_block = W.partitionBy(*self.keys, "_block").orderBy(*self.order)
        so_far = in_block.rowsBetween(W.unboundedPreceding, 0)
        blocks = started.withColumns(
            {"_l_" + n: alpha * power * F.sum(F.col("_x_" + n) / power).over(so_far) for n in names}
        )
        # Same order as self.window, since blocks never decrease along it; naming the
        # block first lets Spark keep the sort of the step above.
        along = W.partitionBy(*self.keys).orderBy("_block", *self.order)
        earlier = along.rowsBetween(W.unboundedPreceding, -1)
        block_end = F.col("_ok") & (F.col("_at") == size - 1)
        ends = blocks.withColumns(
            {
                **{
                    "_e_" + n: F.last(F.when(block_end, F.col("_l_" + n)), ignorenulls=True).over(earlier)
                    for n in names
                },
                **{
                    "_f_" + n: F.first(F.col("_x_" + n), ignorenulls=True).over(
                        along.rowsBetween(W.unboundedPreceding, 0)
                    )
                    for n in names
                },
            }
        )
        # State after each eligible row as if the chunk started from zero.
        local = ends.withColumns(
            {
                "_s_" + n: F.when(
                    F.col("_ok"), F.col("_l_" + n) + power * keep * F.coalesce(F.col("_e_" + n), F.lit(0.0))
                )
                for n in names
            }
        )
        if self.chunked:
            at = F.when(F.col("_ok"), self.order_value)
            parts = [F.sum(F.col("_ok").cast("long")).alias("_m")]
            for n in names:
                parts += [F.max_by("_s_" + n, at).alias("_s_" + n), F.min_by("_x_" + n, at).alias("_f_" + n)]
            # Chunks without an eligible row are left out of the fold, so the last `size` chunks
            # hold at least `size` eligible rows; what was before weighs under 1e-18.
            held = W.partitionBy(*self.entity, F.col("_m") > 0).orderBy(CHUNK).rowsBetween(-size, 0)
            chunks = W.partitionBy(*self.entity).orderBy(CHUNK).rowsBetween(W.unboundedPreceding, -1)

            def leaving(n: str) -> Column:
                ended = F.collect_list(F.struct(F.col("_m").alias("m"), F.col("_s_" + n).alias("s"), F.col("_f_" + n).alias("f")))
                state = F.aggregate(
                    ended.over(held),
                    F.lit(None).cast("double"),
                    lambda state, c: c["s"] + F.coalesce(state, c["f"]) * F.pow(F.lit(keep), c["m"]),
                )
                return F.when(F.col("_m") > 0, state)

            summary = local.groupBy(*self.keys).agg(*parts)
            summary = summary.withColumns({"_after_" + n: leaving(n) for n in names})
            carry = self._of_cut_entities(
                summary, {n: F.last("_after_" + n, ignorenulls=True).over(chunks) for n in names}
            )
            local = local.join(carry, same_key(local, carry, self.keys, "_c_"), "left")
        else:
            carry = None
            local = local.withColumns({"_c_" + n: F.lit(None).cast("double") for n in names})
        state = {
            "_s_" + n: F.col("_s_" + n)
            + F.pow(F.lit(keep), F.col("_seen") + 1) * F.coalesce(F.col("_c_" + n), F.col("_f_" + n))
            for n in names
        }
        done = local.withColumns(state)
        done = done.withColumns(
            {
                n: F.coalesce(F.last(F.col("_s_" + n), ignorenulls=True).over(earlier), F.col("_c_" + n))
                for n in names
            }
        )
        extra = ["_ok", "_seen", "_block", "_at"]
        extra += [p + n for n in names for p in ("_x_", "_l_", "_e_", "_f_", "_s_", "_c_")]
        if carry is not None:
            extra += ["_c_" + k for k in self.keys]
        return self._with(done.drop(*extra))

    def tails(self, name: str, value: Column, length: int) -> Timeline:
        """Add an array of the values of the last ``length`` rows up to the current one."""
        boxed = F.struct(value.alias("x"))
        local = self.df.withColumn(name, F.collect_list(boxed).over(self.window.rowsBetween(-(length - 1), 0)))
        unbox = lambda a: F.transform(a, lambda e: e["x"])
        if not self.chunked or length == 1:
            return self._with(local.withColumn(name, unbox(F.col(name))))
        latest = W.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order])
        ranked = self.df.select(*self.keys, *self.order, boxed.alias("_b"), F.row_number().over(latest).alias("_r"))
        ranked = ranked.where(F.col("_r") <= length - 1)
        listed = F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col("_b").alias("b"))))
        summary = ranked.groupBy(*self.keys).agg(F.transform(listed, lambda e: e["b"]).alias(name))
        chunks = W.partitionBy(*self.entity).orderBy(CHUNK).rowsBetween(-(length - 1), -1)
        carry = self._of_cut_entities(summary, {name: F.flatten(F.collect_list(F.col(name)).over(chunks))})

        def merge(mine: Column, before: Column) -> Column:
            both = F.concat(F.coalesce(before, F.array().cast(local.schema[name].dataType)), mine)
            return unbox(F.slice(both, F.greatest(F.size(both) - (length - 1), F.lit(1)), length))

        return self._join_carry(local, carry, {name: merge})
