"""Keyed vector stores: one row per key with a float array of constant length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources import npz
from tideline.sources.tables import require_columns


def load_vectors(spark: SparkSession, path: str, key: list[str], vector: str, check: bool = True) -> DataFrame:
    """Read (key..., vector); uneven lengths raise."""
    df = require_columns(spark.read.parquet(path), [*key, vector], path).select(*key, vector)
    if check:
        dimension(df, vector)
    return df


def dimension(df: DataFrame, vector: str) -> int:
    """The common length of all vectors."""
    ends = df.agg(F.min(F.size(vector)).alias("lo"), F.max(F.size(vector)).alias("hi")).first()
    if ends["lo"] is None or ends["lo"] != ends["hi"] or ends["lo"] < 1:
        raise ValueError(f"vectors of uneven length: {ends['lo']} to {ends['hi']}")
    return ends["lo"]


def save_vectors(df: DataFrame, path: str, key: list[str], vector: str, mode: str = "errorifexists") -> None:
    """Write (key..., vector) as parquet; rows stay aligned by key, not by position."""
    df.select(*key, F.col(vector).cast("array<float>").alias(vector)).write.mode(mode).parquet(path)


def import_npz(
    spark: SparkSession, path: str, key: list[str], matrix: str = "embeddings", vector: str = "vec", key_type: str = "bigint",
    rows: int = npz.ROWS,
) -> DataFrame:
    """Rows of an NPZ file, or of a folder of them (a matrix and one parallel array per key), ``rows`` of them a task."""
    spark.dataSource.register(npz.VectorFiles)
    schema = ", ".join([f"`{k}` {key_type}" for k in key] + [f"`{vector}` array<float>"])
    return spark.read.format(npz.FORMAT).schema(schema).options(matrix=matrix, rows=rows).load(path)


def export_npz(
    df: DataFrame, path: str, key: list[str], vector: str, matrix: str = "embeddings", overwrite: bool = False,
    file_bytes: int = npz.FILE_BYTES,
) -> None:
    """Write (key..., vector) as a folder of NPZ files of about ``file_bytes`` each, beside those that are there.

    Null keys or vectors and vectors of uneven length raise.
    """
    df.sparkSession.dataSource.register(npz.VectorFiles)
    slim = df.select(*key, F.col(vector).cast("array<float>").alias(vector))
    writer = slim.write.format(npz.FORMAT).mode("overwrite" if overwrite else "append")
    writer.options(matrix=matrix, bytes=file_bytes).save(path)
