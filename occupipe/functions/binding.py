"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Spark does not share common subexpressions inside lambdas, so a value that a lambda
    uses for every element would otherwise be computed for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
