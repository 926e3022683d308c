"""A value that several parts of an expression need, computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once and written once in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)
