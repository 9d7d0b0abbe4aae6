"""Name an intermediate column value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with `value` computed once, however often body uses it.

    Projection collapsing would otherwise paste a regex chain into every use.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]
