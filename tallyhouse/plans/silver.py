"""Raw text rows to typed, repaired, unique order lines.

All repairs are column expressions in one projection; only the deduplication shuffles.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions.text import sentence_case
from tallyhouse.operators.dedup import first_per_key, total_order
from tallyhouse.operators.ordering import grouped_row_number
from tallyhouse.operators.repair import (
    fill_null,
    parse,
    quarantine,
    replace_sentinels,
    replace_values,
    strict,
    whole_part,
)
from tallyhouse.sources.raw_csv import MALFORMED, SOURCE
from tallyhouse.sources.shared import SharedFolder

# What the source data is known to get wrong, and the target types.
UNKNOWN = "Unknown"
MISSING_CITY = ("NONE", "")
STATE_CORRECTIONS = {"Ca-2015-108119": "Arkansas"}
MISPLACED_STATE = "Ca-20%"
CATEGORY_CORRECTIONS = {"Technlogy": "Technology", "Furnture": "Furniture"}
LINE_KEY = ("Order_ID", "Product_ID")
TYPES = {
    "Order_Date": "date",
    "Ship_Date": "date",
    "Sales": "decimal(18,4)",
    "Profit": "decimal(18,6)",
    "Discount": "decimal(18,4)",
    "Quantity": "int",
}
DATE_FORMATS = ("M/d/yyyy",)
# Which of two lines of the same key is first: the date, then everything else.
DEDUP_ORDER = (
    "Order_Date", "Ship_Date", "Sales", "Quantity", "Discount", "Profit", "City", "State",
    "Customer_Name", "Product_Name",
)


def typed_columns(strictly: bool = True, date_formats: Sequence[str] = DATE_FORMATS) -> dict[str, Column]:
    """Text to types. By default a value that does not fit fails the job, else it becomes NULL."""
    parsed = {c: parse(c, t, date_formats) for c, t in TYPES.items()}
    return {c: strict(c, p, TYPES[c]) for c, p in parsed.items()} if strictly else parsed


def postal_code(strictly: bool = True) -> Column:
    """'10001.0' to 10001; a fraction is cut off. What is no plain number or too large does not fit."""
    parsed = whole_part("Postal_Code")
    return strict("Postal_Code", parsed, "int") if strictly else parsed


def castable(
    bronze: DataFrame, date_formats: Sequence[str] = DATE_FORMATS
) -> tuple[DataFrame, DataFrame]:
    """Raw lines that ``repaired`` accepts, and the rejected ones with the columns at fault.

    Lines that the reader kept as malformed are among the rejected, which keep the name of their file."""
    parsed = typed_columns(False, date_formats) | {"Postal_Code": postal_code(False)}
    if MALFORMED in bronze.columns:
        parsed |= {MALFORMED: F.lit(None).cast("string")}
    good, rejected = quarantine(bronze, parsed)
    return good.drop(MALFORMED, SOURCE), rejected


def customer_name() -> Column:
    return fill_null("Customer_Name", UNKNOWN)


def known_city() -> Column:
    return replace_sentinels("City", MISSING_CITY, UNKNOWN)


def city() -> Column:
    return sentence_case(known_city())


def cased_state() -> Column:
    return sentence_case(F.col("State"))


def state() -> Column:
    return replace_values(cased_state(), STATE_CORRECTIONS)


def category() -> Column:
    return replace_values(F.col("Category"), CATEGORY_CORRECTIONS)


def repaired(bronze: DataFrame, date_formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Every type fixed and every value repaired; repeated lines still present."""
    return bronze.withColumns(
        typed_columns(date_formats=date_formats)
        | {
            "Postal_Code": postal_code(),
            "Customer_Name": customer_name(),
            "City": city(),
            "State": state(),
            "Category": category(),
        }
    )


def dedup(lines: DataFrame) -> DataFrame:
    return first_per_key(lines, LINE_KEY, total_order(lines, DEDUP_ORDER, LINE_KEY))


def duplicate_preview(lines: DataFrame, folder: SharedFolder) -> DataFrame:
    """All lines with their place inside their key; places above 1 are what ``dedup`` removes."""
    order = total_order(lines, DEDUP_ORDER, LINE_KEY)
    return grouped_row_number(lines, LINE_KEY, order, "rn", folder)


def silver_sales(bronze: DataFrame, date_formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    return dedup(repaired(bronze, date_formats))
