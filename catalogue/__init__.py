"""Every operator as a query on the given tables, next to the SQL that checks it."""

from catalogue.base import ORACLES, QUERIES
from catalogue import (  # noqa: F401  (importing registers the queries)
    drift,
    io,
    joins,
    learning,
    metrics,
    quality,
    registry,
    rows,
    scoring,
    slo,
    split,
    streams,
    trailing,
)

__all__ = ["ORACLES", "QUERIES"]
