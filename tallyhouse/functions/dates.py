"""Calendar expressions used by the analyses."""

from pyspark.sql import Column, functions as F


def month_name(day: Column) -> Column:
    return F.date_format(day, "MMMM")


def month_end(day: Column) -> Column:
    return F.last_day(day)


def days_between(start: Column, end: Column) -> Column:
    """Days from ``start`` to ``end``; positive when ``end`` is later."""
    return F.datediff(end, start)
