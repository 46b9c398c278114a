"""Writers, and the append-only evaluation log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.metrics import LOG_SCHEMA


def write_parquet(df: DataFrame, path: str, overwrite: bool = False, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*(partition_by or [])).parquet(path)


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; refuses to replace an existing output unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def log_rows(rows: DataFrame, **identity) -> DataFrame:
    """Metric rows in the log's columns: run identity added, unknown metrics null, other
    columns left out."""
    full = rows.withColumns({k: F.lit(v) for k, v in identity.items()})
    return full.select(
        *[
            (F.col(f.name) if f.name in full.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in T.StructType.fromDDL(LOG_SCHEMA).fields
        ]
    )


def append_log(rows: DataFrame, path: str, **identity) -> None:
    """Add the rows of a run and seed to the log.

    A run's rows are staged and then take the place of the rows that the same run and seed had,
    so writing them again adds none.
    """
    full = log_rows(rows, **identity)
    writer = full.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_id", "seed").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log, or an empty one if nothing was written yet."""
    try:
        columns = T.StructType.fromDDL(LOG_SCHEMA).names
        return spark.read.schema(LOG_SCHEMA).parquet(path).select(*columns)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], LOG_SCHEMA)
