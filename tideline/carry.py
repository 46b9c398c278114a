"""Arrow functions over one column of a frame, whatever the other columns are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_results(frame: DataFrame, column: str, run: Callable, results: str, keep: bool = False) -> DataFrame:
    """The columns of ``frame`` and those that ``run`` computes from ``column``.

    ``run`` maps Arrow batches with the columns ``row`` and ``value`` to batches with ``row``
    and the columns of ``results`` (a schema string). All other columns travel inside ``row``
    under names of their own, so none can clash with a result while the function runs. In the
    output an input column named like a result is replaced by it; ``column`` itself goes
    unless ``keep`` is set.
    """
    new = T.StructType.fromDDL(results)
    gone = {f.name.lower() for f in new} | (set() if keep else {column.lower()})
    names = [c for c in frame.columns if c.lower() not in gone]
    row = F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    packed = frame.select(row.alias("row"), F.col(f"`{column}`").alias("value"))
    schema = T.StructType([packed.schema["row"], *new])
    done = packed.mapInArrow(run, schema)
    return done.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)], *[F.col(f.name) for f in new])
