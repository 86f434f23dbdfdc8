"""Registered queries and the SQL each of them is compared with."""

from scansio.checks import (  # noqa: F401
    features, metrics, models, prepared, rows, sampling, scalars, sources)
from scansio.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
