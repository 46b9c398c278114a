"""Leak-free splits. A split is a table of keys with a ``part`` column, never a list of
row positions. Memberships come from a hash of the key and a seed, so they do not
depend on partitioning, input order or the table's size."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.expressions import digest_number, key_digest
from tideline.numbering import row_numbers
from tideline.operators.joins import refuse, require_unique
from tideline.roles import Roles
from tideline.scale import whole
from tideline.timeline import RowsBefore, Timeline

HASH_RANGE = 2**32


def hash_ranked(keys: DataFrame, key: str, seed: int) -> DataFrame:
    """Distinct keys with ``_rank``, their 0-based place in hash order, and ``_n``, their
    number.

    Keys are grouped by the first four hex digits of the hash. These 65,536 groups are
    even by construction, so each is ranked on its own, and the at most 65,536 group
    sizes give the ranks at which the groups start. No task sees all keys.
    """
    tagged = keys.select(key).distinct().withColumn("_h", key_digest(F.col(key), F.lit(seed)))
    tagged = tagged.withColumn("_p", F.substring("_h", 1, 4))
    sizes = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_m"))
    all_groups = W.partitionBy(F.lit(0))
    before = all_groups.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_p",
        F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"),
        F.sum("_m").over(all_groups).alias("_n"),
    )
    ranked = tagged.join(F.broadcast(starts), "_p")
    place = F.row_number().over(W.partitionBy("_p").orderBy("_h", key)) - 1
    return ranked.withColumn("_rank", F.col("_start") + place).drop("_p", "_start", "_h")


def group_split(df: DataFrame, entity: str, seed: int, share: float = 0.2) -> DataFrame:
    """(entity, part): ceil(share * entities) entities are 'val', all others 'train'."""
    ranked = hash_ranked(df, entity, seed)
    held_out = F.ceil(F.lit(share) * F.col("_n"))
    return ranked.select(entity, F.when(F.col("_rank") < held_out, "val").otherwise("train").alias("part"))


def shuffled_group_split(df: DataFrame, entity: str, seed: int, train_share: float = 0.8) -> DataFrame:
    """(entity, part): floor(train_share * entities) entities are 'train'."""
    ranked = hash_ranked(df, entity, seed)
    kept = F.floor(F.lit(train_share) * F.col("_n"))
    return ranked.select(entity, F.when(F.col("_rank") < kept, "train").otherwise("val").alias("part"))


def group_folds(df: DataFrame, entity: str, folds: int, seed: int = 42) -> DataFrame:
    """(entity, fold): each entity in one fold, folds balanced by rows. Entities are
    dealt out from the largest down, forwards and backwards in turn. With fewer
    entities than folds there is one fold, the held-out part of a group split."""
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_rows"))
    enough = sizes.limit(folds).count() >= folds and folds >= 2
    if not enough:
        parts = group_split(df, entity, seed).join(sizes, entity)
        return parts.select(entity, F.when(F.col("part") == "val", 0).otherwise(-1).alias("fold"), F.col("_rows").alias("n_rows"))
    ordered = whole(sizes.withColumn("_fewer", -F.col("_rows")))
    ranked = Timeline(ordered, "_all", ["_fewer", entity]).running(_rank=RowsBefore()).result()
    turn, seat = F.floor(F.col("_rank") / folds) % 2, F.col("_rank") % folds
    fold = F.when(turn == 0, seat).otherwise(folds - 1 - seat)
    return ranked.select(entity, fold.cast("int").alias("fold"), F.col("_rows").alias("n_rows"))


def row_fold(key: list[Column], folds: int, seed: int = 42) -> Column:
    """Fold of a row, from its key alone."""
    return (digest_number(key_digest(*key, F.lit(seed))) % folds).cast("int")


def row_part(key: list[Column], seed: int = 42, share: float = 0.2) -> Column:
    """'val' for about ``share`` of the rows, from the key alone; no shuffle."""
    limit = math.floor(share * HASH_RANGE)
    return F.when(digest_number(key_digest(*key, F.lit(seed))) < limit, "val").otherwise("train")


def load_split(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(key, part, id_type) from a split file in JSON: row positions under
    ``train_indices``/``val_indices`` or keys under ``train_ids``/``val_ids``, whose
    kind is in ``id_type`` and defaults to row positions. ``lines`` reads a folder with a
    document per line (:func:`save_split`) instead of one document."""
    raw = spark.read.option("multiLine", not lines).json(path)
    names = raw.columns
    if {"train_indices", "val_indices"} <= set(names):
        train, val, kind = "train_indices", "val_indices", F.lit("row_index")
    elif {"train_ids", "val_ids"} <= set(names):
        given = F.col("id_type") if "id_type" in names else F.lit(None).cast("string")
        train, val, kind = "train_ids", "val_ids", F.coalesce(given, F.lit("row_index"))
    else:
        raise ValueError(f"{path}: not a split file")
    parts = [raw.select(F.explode(c).alias("key"), F.lit(p).alias("part"), kind.alias("id_type"))
             for c, p in ((train, "train"), (val, "val"))]
    return parts[0].unionByName(parts[1])


def save_split(rows: DataFrame, path: str, key: str, id_type: str = "row_index", per_document: int = 65_536) -> None:
    """Write rows of (``key``, part) as JSON lines of the layouts that :func:`load_split` reads.

    A document has the keys of one range of ``per_document`` numbers, so none holds the whole split.
    """
    names = ("train_indices", "val_indices") if id_type == "row_index" else ("train_ids", "val_ids")
    lists = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col(key)))).alias(n) for n, p in zip(names, ("train", "val"), strict=True)]
    documents = rows.groupBy(F.floor(F.col(key) / per_document).alias("_d")).agg(*lists).drop("_d")
    documents.withColumn("id_type", F.lit(id_type)).write.mode("errorifexists").json(path)


def apply_split(df: DataFrame, split: DataFrame, roles: Roles, key: str | None = None, check: bool = True) -> DataFrame:
    """The rows that a frozen split names, with their ``part``.

    Positions count all rows from 0 in the order (entity, time, tie), over ranges of the table;
    other keys are values of ``key`` (the tie column if not given). Rows that the split does not name go. A
    key that no row has, or that the split names twice, is an error; ``check=False`` leaves that out.
    """
    key = key or roles.tie
    named = split.select(F.when(F.col("id_type") == "row_index", "row_index").otherwise("key").alias("_kind"), F.col("key").cast("long").alias("_key"), "part")
    kinds = {r["_kind"] for r in named.select("_kind").distinct().collect()}
    positions, keys = named.where(F.col("_kind") == "row_index"), named.where(F.col("_kind") == "key")
    own = F.col(key).cast("long")
    if check:
        require_unique(named, ["_kind", "_key"], "split")
        lost = "the split names rows that are not there"
        if "row_index" in kinds:
            there = F.coalesce(F.col("_key").between(0, df.count() - 1), F.lit(False))
            refuse(positions.where(~there), ["_kind", "_key"], lost)
        if "key" in kinds:
            refuse(keys.join(df.select(own.alias("_key")), "_key", "left_anti"), ["_kind", "_key"], lost)
    # rows are numbered only if the split has positions
    placed = []
    if "row_index" in kinds:
        numbered = row_numbers(df, [roles.entity, *roles.order], "_position")
        placed.append(numbered.withColumn("_key", F.col("_position")).join(positions, "_key"))
    if "key" in kinds or not placed:
        placed.append(df.withColumn("_key", own).join(keys, "_key"))
    return reduce(DataFrame.unionByName, [p.select(*df.columns, "part") for p in placed])


def load_or_create(spark: SparkSession, path: str, create) -> DataFrame:
    """The split table at ``path``; written there first if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        create().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def split_summary(split: DataFrame, key: list[str], expected: int | None = None) -> DataFrame:
    """One row: sizes of both parts, keys listed twice, keys in both parts, and whether
    the split is valid."""
    per_key = split.groupBy(*key).agg(
        F.count_if(F.col("part") == "train").alias("t"), F.count_if(F.col("part") == "val").alias("v")
    )
    found = per_key.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_val"),
        F.count_if((F.col("t") > 1) | (F.col("v") > 1)).alias("n_repeated"),
        F.count_if((F.col("t") > 0) & (F.col("v") > 0)).alias("n_in_both"),
    )
    valid = (F.col("n_train") > 0) & (F.col("n_val") > 0) & (F.col("n_repeated") == 0) & (F.col("n_in_both") == 0)
    if expected is not None:
        valid = valid & (F.col("n_train") + F.col("n_val") == F.lit(expected))
    return found.withColumn("valid", valid)


def entities_in_both_parts(rows: DataFrame, entity: str) -> DataFrame:
    """Entities with rows on both sides of a row-level split."""
    parts = rows.groupBy(entity).agg(F.min("part").alias("_a"), F.max("part").alias("_b"))
    return parts.where("_a <> _b").select(entity)


def trial_rows(df: DataFrame, split: DataFrame, roles: Roles, n: int) -> DataFrame:
    """First ``n`` rows by key with the parts they have in a split."""
    head = df.select(*roles.key).orderBy(*roles.key).limit(n)
    return split.join(F.broadcast(head), [c for c in roles.key if c in split.columns], "left_semi")
