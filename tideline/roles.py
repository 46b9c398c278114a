"""Column roles: which column plays which part in an operator."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Roles:
    """Names of the columns an operator works on.

    ``(ts, tie)`` is the total order of an entity's rows; no operator relies on
    the physical order of a table.
    """

    entity: str = "user_id"
    ts: str = "ts"
    tie: str = "event_id"
    targets: tuple[str, str] = ("v", "a")
    deltas: tuple[str, str] = ("dv", "da")
    flag: str = "flag"

    @property
    def order(self) -> list[str]:
        return [self.ts, self.tie]

    @property
    def key(self) -> list[str]:
        return [self.entity, self.tie]

    def order_value(self) -> Column:
        """One comparable value per row, for ``max_by`` and ``min_by``."""
        return F.struct(*self.order)

    def eligible(self) -> Column:
        """Both deltas are known."""
        return F.col(self.deltas[0]).isNotNull() & F.col(self.deltas[1]).isNotNull()
