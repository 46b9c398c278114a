"""What several operators of this package share: tables, lasting intermediate results, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are cut into words at spaces and \t to \r.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def durable(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet to the shared folder that ``spark.checkpoint.dir`` names.

    Where it names none (tests), to a folder inside the warehouse, which all executors share.
    Lost executors cost nothing that is already written. Unlike a checkpoint, the table that
    is read again carries no constraints of the plan that made it.
    """
    spark = frame.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"
    path = f"{folder}/tideline-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def fold_ascii(column):
    """A-Z to a-z; other letters as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower())


def crc_bucket(column, of: int):
    """crc32 of the value as text, modulo ``of``; null counts as the text 'null'."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("null")).cast("binary")) % of


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of the links: the smallest node that it can reach.

    Each round moves every node to its smallest neighbour and contracts the links, so long
    chains shrink fast and a star takes one round. Rounds are checkpointed; nothing but
    emptiness reaches the driver.
    """
    edges = durable(
        links.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    roots = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        step = durable(
            both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root"))
        )
        if roots is None:
            roots = step
        else:
            move = step.select(F.col("node").alias("root"), F.col("root").alias("to"))
            roots = durable(
                roots.join(move, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
            )
        left, right = step.toDF("a", "ra"), step.toDF("b", "rb")
        edges = durable(
            edges.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
            .distinct()
        )
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
