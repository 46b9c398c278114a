"""Row numbers over a whole table without a task that sees all of it.

Cut points are drawn from the table's own places by hash; a row's range is the number of cut
points at or before it, so it is a function of the row and does not change if a task runs
again. Ranges are sorted side by side, and the sizes of the ranges before one give the number
at which it starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.scale import attach

RANGES = 1024


def _cut_points(places: DataFrame, ranges: int) -> DataFrame:
    """One row with at most ``ranges`` sorted places, spread over the distinct ones."""
    size = places.agg(F.count(F.lit(1)).alias("n"))
    thin = F.greatest(F.lit(1), F.floor(F.col("_size.n") / (8 * ranges)))
    drawn = attach(places, "_size", size).where(F.pmod(F.xxhash64("_at"), thin) == 0)
    seats = drawn.groupBy(F.pmod(F.xxhash64("_at", F.lit(3)), F.lit(ranges)).alias("_seat"))
    chosen = seats.agg(F.max_by("_at", F.xxhash64("_at", F.lit(5))).alias("_at"))
    return chosen.agg(F.array_sort(F.collect_list("_at")).alias("cuts"))


def in_ranges(df: DataFrame, order: list[str], ranges: int = RANGES) -> DataFrame:
    """``df`` with ``_range``, the number of cut points at or before the row.

    Ranges follow each other in ``order`` (ascending, null first); there are ``ranges`` + 1 at most.
    """
    at = F.struct(*order)
    cut = attach(df, "_cuts", _cut_points(df.select(at.alias("_at")), ranges)).withColumn("_at", at)
    # by halving: a step is taken if the cut point it leads to is at or before the row
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(ranges.bit_length()))])
    taken = lambda found, step: found + F.when(F.get("_cuts.cuts", found + step - 1) <= F.col("_at"), step).otherwise(0)
    # known not to be null, so that a join on it does not work it out once more for a filter
    return cut.withColumn("_range", F.coalesce(F.aggregate(steps, F.lit(0), taken), F.lit(0))).drop("_cuts", "_at")


def range_starts(ranged: DataFrame) -> DataFrame:
    """One row per range: ``_range``, ``_size``, ``_start`` (rows in the ranges before)."""
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))


def number_in_ranges(ranged: DataFrame, starts: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``in_ranges`` with ``_start``, and their 0-based place within the whole table as ``_number``."""
    known = ranged.join(F.broadcast(starts.select("_range", "_start")), "_range")
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return known.withColumn("_number", F.col("_start") + place)


def row_numbers(df: DataFrame, order: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """Adds ``name``: the 0-based place of each row in ``order`` (ascending, null first).

    Rows equal in ``order`` get consecutive numbers in any order; an empty table stays empty.
    """
    ranged = in_ranges(df, order, ranges)
    numbered = number_in_ranges(ranged, range_starts(ranged), order)
    return numbered.withColumn(name, F.col("_number").cast("long")).drop("_range", "_start", "_number")
