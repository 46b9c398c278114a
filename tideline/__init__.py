"""tideline: entity-timeline analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame, parameterised by
column roles (:class:`tideline.roles.Roles`).
"""

from tideline.roles import Roles
from tideline.timeline import Timeline

__all__ = ["Roles", "Timeline"]
