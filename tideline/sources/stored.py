"""Tables written in two phases, with a manifest, and digests that tell whether a table is still the same.

A stored table is a folder with data in a folder of its own per write and a small manifest
that names it. Data come first; creating the manifest is the step that makes the table exist.
A write that fails leaves the table as it was, and lost executors only repeat tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest.json"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, in tests the warehouse."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def once(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read from there: for inputs of many jobs."""
    path = f"{shared_folder(df.sparkSession)}/tideline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_text(columns: list[str]) -> Column:
    """A row as text in which different rows differ: each value with its length, ``-`` for null."""
    parts = []
    for c in columns:
        value = F.col(f"`{c}`").cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.length(value).cast("string"), F.lit(":"), value)))
    return F.concat_ws("|", *parts)


def digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: ``n`` and ``digest`` of a table's rows, whatever their order and partitions.

    Each row gives a hash of 128 bits; the halves are summed, so partial sums merge, and a changed,
    missing, added or repeated row changes the sums. Columns must have a text form.
    """
    names = columns or df.columns
    hashed = df.select(F.md5(row_text(names).cast("binary")).alias("h"))
    half = lambda at: F.coalesce(F.sum(F.conv(F.substring("h", at, 16), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return hashed.agg(F.count(F.lit(1)).alias("n"), F.concat_ws("-", half(1), half(17)).alias("digest"))


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, f"{path}/{MANIFEST}")
    return files.exists(place)


def _put_manifest(spark: SparkSession, path: str, content: dict, overwrite: bool) -> None:
    files, place = _files(spark, f"{path}/{MANIFEST}")
    if not overwrite:
        # creation fails if another writer was first
        out = files.create(place, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        return
    _, staged = _files(spark, f"{path}/.{uuid.uuid4().hex}")
    out = files.create(staged, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    if files.exists(place):
        files.delete(place, False)
    if not files.rename(staged, place):
        raise OSError(f"{path}: the manifest was not renamed")


def write(
    df: DataFrame, path: str, overwrite: bool = False, form: str = "parquet", order: list[str] | None = None, made_of: str = ""
) -> dict:
    """Write a table as Parquet or CSV (with a header in each part); returns its manifest.

    With ``order`` the parts follow each other in that order, so that the files, taken by name, are
    sorted. An existing table is refused unless ``overwrite`` is set; then readers see the old
    table until the new manifest is there. ``made_of`` is any text, such as a digest of the inputs.
    """
    spark = df.sparkSession
    if not overwrite and exists(spark, path):
        raise FileExistsError(f"{path} is already there")
    version = f"data-{uuid.uuid4().hex}"
    rows = df.orderBy(*order) if order else df
    writer = rows.write.mode("errorifexists")
    (writer.option("header", True).option("escape", '"') if form == "csv" else writer).format(form).save(f"{path}/{version}")
    found = digest(_read(spark, path, version, form, df.schema)).first()
    content = {
        "version": version, "form": form, "rows": found["n"], "digest": found["digest"], "made_of": made_of, "schema": df.schema.json(),
    }
    try:
        _put_manifest(spark, path, content, overwrite)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            raise FileExistsError(f"{path} is already there") from error
        raise
    return content


def _read(spark: SparkSession, path: str, version: str, form: str, schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema)
    if form == "csv":
        # a header in each part; empty values stay apart from null
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.format(form).load(f"{path}/{version}")


def manifest(spark: SparkSession, path: str) -> dict:
    """What a stored table's manifest says; FileNotFoundError if there is none."""
    try:
        return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        raise FileNotFoundError(f"{path}: no stored table") from error


def read(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A stored table. ``check`` compares its rows with the manifest's digest; a difference is an error."""
    known = manifest(spark, path)
    df = _read(spark, path, known["version"], known["form"], T.StructType.fromJson(json.loads(known["schema"])))
    if check:
        found = digest(df).first()
        if (found["n"], found["digest"]) != (known["rows"], known["digest"]):
            raise ValueError(f"{path}: {found['n']} rows that are not the {known['rows']} rows of its manifest")
    return df


def reused(inputs: DataFrame, path: str, create: Callable[[DataFrame], DataFrame], recipe: str = "") -> DataFrame:
    """``create(inputs)``, stored at ``path`` and read from there as long as nothing has changed.

    The stored table is used if it was made of the same rows (by digest, order does not matter)
    under the same ``recipe`` and still holds what was written; else it is made anew.
    """
    spark = inputs.sparkSession
    own = digest(inputs).first()
    made_of = f"{recipe}:{own['n']}:{own['digest']}"
    if exists(spark, path) and manifest(spark, path)["made_of"] == made_of:
        try:
            return read(spark, path)
        except (ValueError, AnalysisException):
            pass  # not what was written: made anew
    write(create(inputs), path, overwrite=True, made_of=made_of)
    return read(spark, path, check=False)
