"""Name a value inside an expression, so that it is planned and evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``: a one-element array makes the value a lambda variable.

    Expressions over arrays refer to their parts many times; without a name the
    tree of each part is repeated at every mention.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(items: Column, test: Callable[[Column], Column]) -> Column:
    """Positions (from 0) of the items that pass the test, in order."""
    return F.filter(
        F.transform(items, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()
    )
