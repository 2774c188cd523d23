"""Registered queries: each operator over the test tables, with its DuckDB check.

``QUERIES`` maps a name to a function (Tables) -> DataFrame, ``ORACLES`` a name to SQL.
"""

from . import cleaning, evaluation, packing, sampling, segments, sources, streams  # noqa: F401
from .core import ORACLES, QUERIES, Tables

__all__ = ["ORACLES", "QUERIES", "Tables"]
