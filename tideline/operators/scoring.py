"""Batch scoring with a user's model, and reuse of stored scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import key_census


def score_batches(
    df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], columns: list[str], schema: str
) -> DataFrame:
    """Score rows with a model that Spark cannot express.

    ``load`` runs once per task and returns a function from a batch of the selected
    columns to a batch of ``schema``. Only the selected columns cross to Python, in
    Arrow batches of ``spark.sql.execution.arrow.maxRecordsPerBatch`` rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            if model is None:
                model = load()
            yield model(batch)

    return df.select(*columns).mapInPandas(run, schema)


def same_key_set(keys: DataFrame, stored: DataFrame, on: list[str]) -> bool:
    """True if the stored rows have exactly the wanted keys, each once."""
    return key_census(keys, stored, on).where("n_left <> 1 or n_right <> 1").isEmpty()


def reuse_or_score(df: DataFrame, stored: DataFrame | None, on: list[str], score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored scores if they cover exactly these rows, else fresh ones."""
    if stored is not None and same_key_set(df, stored, on):
        return stored
    return score(df)


def with_known_scores(df: DataFrame, stored: DataFrame, on: list[str]) -> DataFrame:
    """Mark each row with whether a stored score exists."""
    known = stored.select(*on).distinct().withColumn("has_score", F.lit(True))
    return df.join(known, on, "left").withColumn("has_score", F.coalesce("has_score", F.lit(False)))
