"""String expressions used by the cleaning steps."""

from pyspark.sql import Column, functions as F


def sentence_case(value: Column) -> Column:
    """Trim, then upper-case the first letter of the whole string and lower-case the rest.

    ``initcap`` would capitalise every word ('New York'); the warehouse stores 'New york'.
    """
    trimmed = F.trim(value)
    return F.concat(F.upper(F.left(trimmed, F.lit(1))), F.lower(F.substring(trimmed, 2, 2**31 - 1)))


def text_length(value: Column) -> Column:
    """Length without trailing blanks."""
    return F.length(F.rtrim(value))
