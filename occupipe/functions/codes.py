"""Functions on code strings. Codes are text: leading characters matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4, 5)


def level(code: Column, k: int) -> Column:
    """The first ``k`` characters."""
    return F.substring(code, 1, k)


def remainder(code: Column, k: int = 1) -> Column:
    """What follows the first ``k`` characters."""
    return F.substr(code, F.lit(k + 1))


def normalise(column: Column) -> Column:
    """``1234.0`` becomes ``1234``; text that is no number becomes null."""
    return column.cast("string").try_cast("double").try_cast("bigint").cast("string")


def is_real(code: Column) -> Column:
    """No ``X`` anywhere: the rule for taxonomy rows."""
    return ~F.contains(code, F.lit("X"))


def not_x_group(code: Column) -> Column:
    """Not led by ``X``: the weaker rule for definition rows."""
    return ~F.startswith(code, F.lit("X"))


def has_length(code: Column, k: int) -> Column:
    return F.length(code) == k


def others(code: Column) -> Column:
    """The residual sibling of a code: its last character replaced by 9."""
    return F.concat(F.substr(code, F.lit(1), F.length(code) - 1), F.lit("9"))


def week_bucket(day: Column, iso_year: bool = False) -> Column:
    """``yyyy-ww`` from the calendar year and the ISO week.

    The two disagree around New Year: 2019-12-30 gives ``2019-01``. ``iso_year=True``
    takes the year that the ISO week belongs to instead.
    """
    if iso_year:
        year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    else:
        year = F.date_format(day, "yyyy")
    return F.concat(year, F.lit("-"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def month_bucket(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
