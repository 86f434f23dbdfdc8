"""Evaluate a shared subexpression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once however often ``use`` mentions it.

    Branches and lambdas would otherwise repeat the expression; the variable of
    a transform over a one-element array holds its value instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
