"""Evaluating a column once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it.

    Without it a column that occurs in the body of a lambda is computed for every
    element, and one that occurs n times in an expression is planned n times.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
