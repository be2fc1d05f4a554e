"""Ready queries over the test tables, each with its DuckDB twin."""

from forgetide.plans.registry import ORACLES, QUERIES
from forgetide.plans import archive, commits, documents, identity, metrics, people, routing, storage, text  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
