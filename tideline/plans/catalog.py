"""All registered queries."""

from tideline.plans import evaluation, history, ingest, models, quality, relational, storage  # noqa: F401
from tideline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
