"""Number expressions: money stays decimal until the last step, so sums do not depend on order."""

from pyspark.sql import Column, functions as F


def money(amount: Column) -> Column:
    """Round a decimal amount half-up to cents and hand it out as a double."""
    return F.round(amount, 2).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """Fractional quotient; NULL when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def average(total: Column, count: Column) -> Column:
    """Mean of a decimal total, rounded half-up to cents."""
    return F.round(ratio(total, count).cast("decimal(38,6)"), 2).cast("double")


def percent(fraction: Column) -> Column:
    """Format 0.1163 as '11.63%'; NULL stays NULL.

    The rounding is done on a decimal first, because ``format_number`` rounds half-even.
    """
    points = F.round((fraction * 100).cast("decimal(28,10)"), 2)
    return F.concat(F.format_number(points, 2), F.lit("%"))
