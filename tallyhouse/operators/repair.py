"""Typing and row repair as column expressions."""

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# What a whole text has to look like to be read as a type. Casts alone are not strict: they take years
# for dates, text behind a date, and suffixes of numbers.
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_PATTERNS = {"date": r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "int": r"[+-]?[0-9]+", "bigint": r"[+-]?[0-9]+", "double": _NUMBER, "decimal": _NUMBER}
WHOLE_PART = r"[+-]?[0-9]+(?:\.[0-9]*)?"


def date_pattern(date_format: str) -> str:
    """What texts of a date format look like: one or two digits for M and d, as many as letters for others."""
    parts = re.findall(r"y+|M+|d+|[^yMd]+", date_format)
    out = []
    for part in parts:
        if part[0] in "yMd":
            if len(part) > 2 and part[0] != "y":
                raise ValueError(f"names in dates are not supported: {date_format}")
            out.append("[0-9]{1,2}" if len(part) == 1 else f"[0-9]{{{len(part)}}}")
        elif re.search("[A-Za-z']", part):
            raise ValueError(f"only y, M and d stand for parts of a date: {date_format}")
        else:
            out.append(re.escape(part))
    return "".join(out)


def full_match(name: str, pattern: str) -> Column:
    """Whether the whole text, but for outer blanks, has this form."""
    return F.trim(F.col(name)).rlike(f"^(?:{pattern})\\z")


def _unrounded(data_type: str) -> str:
    """Plain numbers with no more digits than a decimal type has: most texts, and no cast can round them."""
    digits, scale = map(int, re.findall("[0-9]+", data_type))
    return f"[+-]?[0-9]{{1,{digits - scale}}}(?:\\.[0-9]{{0,{scale}}})?"


def parse(name: str, data_type: str, date_formats: Sequence[str] = ()) -> Column:
    """The text column as ``data_type``; NULL where the whole text does not fit. Dates that are not ISO are
    tried against ``date_formats`` (of y, M and d) in turn."""
    fits, value = full_match(name, _PATTERNS[data_type.split("(")[0]]), F.col(name).try_cast(data_type)
    if data_type.startswith("decimal"):  # a value that the cast would round doesn't fit
        whole = fits & (value == F.col(name).try_cast("decimal(38,18)"))
        return F.when(full_match(name, _unrounded(data_type)) | whole, value)
    value = F.when(fits, value)
    if data_type == "date":
        others = [F.when(full_match(name, date_pattern(f)), F.try_to_date(F.trim(F.col(name)), f)) for f in date_formats]
        value = F.coalesce(value, *others)
    return value


def whole_part(name: str) -> Column:
    """A number without its fraction, as int; NULL for exponents, suffixes and what is too large."""
    number = F.substring_index(F.trim(F.col(name)), ".", 1)
    return F.when(full_match(name, WHOLE_PART), number.try_cast("int"))


def misfit(name: str, parsed: Column) -> Column:
    """Whether the column holds text that could not be parsed."""
    return F.col(name).isNotNull() & parsed.isNull()


def strict(name: str, parsed: Column, data_type: str) -> Column:
    """``parsed``, failing the job on the first text that does not fit.

    ``parsed`` stands in it once: a projection over all columns must stay below the 8000 bytes of code
    beyond which Java leaves a method uncompiled (tested)."""
    message = F.concat(F.lit(f"column {name} is not a valid {data_type}: "), F.col(name))
    return F.coalesce(parsed, F.when(F.col(name).isNotNull(), F.raise_error(message).cast(data_type)))


def fill_null(name: str, replacement: str) -> Column:
    return F.coalesce(F.col(name), F.lit(replacement))


def replace_sentinels(name: str, sentinels: Sequence[str], replacement: str) -> Column:
    """Replace placeholder spellings; the comparison ignores case and outer blanks, NULL stays NULL."""
    return F.when(F.upper(F.trim(F.col(name))).isin(*sentinels), replacement).otherwise(F.col(name))


def replace_values(value: Column, corrections: Mapping[str, str]) -> Column:
    """Replace exact values by a short fixed mapping."""
    out = value
    for wrong, right in corrections.items():
        out = F.when(value == wrong, right).otherwise(out)
    return out


def quarantine(df: DataFrame, parsed: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split untyped rows into (castable, rejected); rejected rows name the failing columns."""
    reasons = F.array_compact(
        F.array(*[F.when(misfit(c, p), F.lit(c)) for c, p in parsed.items()])
    )
    tagged = df.withColumn("failed_columns", reasons)
    good = tagged.filter(F.size("failed_columns") == 0).drop("failed_columns")
    return good, tagged.filter(F.size("failed_columns") > 0)
