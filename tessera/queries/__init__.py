"""All queries, registered by the modules of this package."""

from tessera.queries import content, files, functions, loading, relational  # noqa: F401
from tessera.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
