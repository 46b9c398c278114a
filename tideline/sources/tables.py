"""Typed tables: schemas by role, checks, and readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.expressions import lenient_bool, null_if_nan

# fixed values: columns and types of the five input tables
_ENTRY = "user_id bigint, text_id bigint, text string, timestamp timestamp"
_CONTEXT = "collection_phase int, is_words boolean"
_LEVELS = "valence double, arousal double"
_CHANGE = "disposition_change_valence double, disposition_change_arousal double"
SCHEMAS = {
    "entries": f"{_ENTRY}, {_CONTEXT}, {_LEVELS}",
    "entries_with_deltas": f"{_ENTRY}, {_CONTEXT}, {_LEVELS}, state_change_valence double, state_change_arousal double",
    "entries_with_halves": f"{_ENTRY}, {_LEVELS}, group int, {_CHANGE}",
    "entries_with_half_means": f"{_ENTRY}, {_CONTEXT}, {_LEVELS}, text_num int, num_texts_per_user int, group int, "
    "mean_valence_half1 double, mean_valence_half2 double, mean_arousal_half1 double, mean_arousal_half2 double, "
    f"{_CHANGE}",
    "users": f"user_id bigint, {_CHANGE}",
}
LEVEL_RANGE = (-5.0, 5.0)  # fixed value: bounds of raw target values


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> DataFrame:
    """Raise with the names of missing columns; further columns are allowed."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def normalise(df: DataFrame, schema: str | T.StructType, what: str = "table") -> DataFrame:
    """Cast the declared columns; a value that cannot be cast fails the job in ANSI mode.
    NaN becomes null and missing text becomes empty. Other columns pass unchanged."""
    declared = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    require_columns(df, declared.names, what)
    out = []
    types = {f.name: f.dataType for f in declared.fields}
    for name in df.columns:
        c = F.col(name)
        if name not in types:
            out.append(c)
        elif isinstance(types[name], T.DoubleType):
            out.append(null_if_nan(c).alias(name))
        elif isinstance(types[name], T.BooleanType) and isinstance(df.schema[name].dataType, T.StringType):
            out.append(F.when(c.isNotNull(), lenient_bool(c)).alias(name))
        elif name == "text":
            out.append(F.coalesce(c.cast("string"), F.lit("")).alias(name))
        else:
            out.append(c.cast(types[name]).alias(name))
    return df.select(*out)


def read_any(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Parquet, or CSV with a header by file name. CSV columns are read as text and cast
    by :func:`normalise`, so no pass over the data is spent on inference. ``multi_line``
    allows line breaks in quoted values; such a file is read by one task."""
    if path.rstrip("/").endswith((".csv", ".csv.gz")):
        return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)
    return spark.read.parquet(path)


def load_tables(
    spark: SparkSession, paths: dict[str, str], schemas: dict[str, str] | None = None, multi_line: bool = False
) -> dict[str, DataFrame]:
    """Lazily read named tables; all missing paths are reported together."""
    schemas = schemas or SCHEMAS
    tables, missing = {}, []
    for name, path in paths.items():
        try:
            raw = read_any(spark, path, multi_line)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            missing.append(path)
            continue
        tables[name] = normalise(raw, schemas[name], name)
    if missing:
        raise FileNotFoundError(f"missing: {missing}")
    return tables


def first_available(spark: SparkSession, *paths: str) -> DataFrame:
    """The first path that exists, e.g. a processed table before the raw one."""
    for path in paths:
        try:
            return read_any(spark, path)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    raise FileNotFoundError(f"none of {paths}")


def summary(tables: dict[str, DataFrame], entity: dict[str, str], flag: dict[str, str | None]) -> DataFrame:
    """Per table: rows, distinct entities, rows with the flag true, false and null."""
    rows = []
    for name, df in tables.items():
        f = F.col(flag[name]) if flag.get(name) else F.lit(None).cast("boolean")
        rows.append(
            df.agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("n_rows"),
                F.countDistinct(entity[name]).alias("n_entities"),
                F.count_if(f).alias("n_true"),
                F.count_if(~f).alias("n_false"),
                F.count_if(f.isNull()).alias("n_null"),
            )
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
