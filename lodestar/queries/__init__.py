"""Registered queries, each next to the SQL it must agree with."""

from lodestar.queries import (  # noqa: F401  (the modules register themselves)
    columns,
    dimensions,
    joins,
    logs,
    measures,
    quality,
    time,
)
from lodestar.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
