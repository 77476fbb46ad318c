"""A value that an expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once for each row, however often the body uses it.

    A column that an inner lambda refers to may be computed anew for each
    element; the variable of a lambda is not.
    """
    return F.transform(F.array(value), body)[0]


def first_of(value: Column, *options: Callable[[Column], Column]) -> Column:
    """The first option of the value that isn't null."""
    return let(value, lambda v: F.coalesce(*[f(v) for f in options]))
