"""The registered queries with the SQL that gives the same result."""

from catalogue.registry import ORACLES, QUERIES
from catalogue import (  # noqa: F401  fill the registry
    correlation,
    distribution,
    duplicates,
    encoding,
    missing,
    outliers,
    rules,
    schema,
    scope,
    sources,
    whole,
)

__all__ = ["ORACLES", "QUERIES"]
