"""Evaluate an expression once inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An outer expression captured by a lambda is evaluated again for every element, and the
    optimizer inlines a helper column back into the lambda. A lambda variable is not inlined.
    """
    return F.transform(F.array(value), body).getItem(0)
