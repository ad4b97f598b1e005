"""Silver lines to a star schema: four dimensions and one fact table."""

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.operators.dedup import first_per_key
from tallyhouse.operators.ordering import global_row_number
from tallyhouse.plans.silver import UNKNOWN
from tallyhouse.sources.shared import SharedFolder

PLACE = ("Country", "State", "City", "Region")
# The fact table has a folder per year; files are sorted by day, so days skip row groups inside a year.
YEAR = "Order_Year"
CLUSTERED = ("Order_Date", "Customer_ID")


def dim_customer(silver: DataFrame, prefer_known: bool = False) -> DataFrame:
    """One row per customer under its alphabetically first name.

    The filler 'Unknown' takes part in that choice, so it wins over later names; with
    ``prefer_known`` it is taken only where the customer has no other name.
    """
    variants = silver.select("Customer_ID", "Customer_Name", "Segment").distinct()
    order = [F.col("Customer_Name").asc_nulls_first(), F.col("Segment").asc_nulls_first()]
    if prefer_known:
        order.insert(0, F.col("Customer_Name").eqNullSafe(UNKNOWN).asc())
    return first_per_key(variants, ["Customer_ID"], order)


def product_members(silver: DataFrame) -> DataFrame:
    """One row per product under its alphabetically first name."""
    variants = silver.select("Product_ID", "Product_Name", "Category", "Sub_Category").distinct()
    order = [F.col(c).asc_nulls_first() for c in ("Product_Name", "Category", "Sub_Category")]
    return first_per_key(variants, ["Product_ID"], order)


def dim_product(silver: DataFrame, folder: SharedFolder) -> DataFrame:
    order = [F.col("Product_ID").asc_nulls_first()]
    keyed = global_row_number(product_members(silver), order, "Product_Key", folder)
    return keyed.select("Product_Key", "Product_ID", "Product_Name", "Category", "Sub_Category")


def dim_geography(silver: DataFrame, folder: SharedFolder) -> DataFrame:
    places = silver.select(*PLACE).distinct()
    order = [F.col(c).asc_nulls_first() for c in PLACE]
    keyed = global_row_number(places, order, "Geo_Key", folder)
    return keyed.select("Geo_Key", "City", "State", "Region", "Country")


def dim_date(silver: DataFrame) -> DataFrame:
    return silver.select("Order_Date").distinct().select(
        "Order_Date", F.year("Order_Date").alias("Year"), F.month("Order_Date").alias("Month")
    )


def fact_sales(silver: DataFrame, geography: DataFrame, product: DataFrame) -> DataFrame:
    """Silver lines with surrogate keys; a line without a match keeps NULL keys.

    Country is part of the place match, so a city name used in two countries cannot repeat lines.
    No broadcast is forced: Spark broadcasts a dimension only while its files are small enough,
    and splits hot products and places in the sort-merge join beyond that.
    """
    s, g, p = silver.alias("s"), geography.alias("g"), product.alias("p")
    same_place = (
        (F.col("s.Region") == F.col("g.Region"))
        & (F.col("s.City") == F.col("g.City"))
        & (F.col("s.State") == F.col("g.State"))
        & F.col("s.Country").eqNullSafe(F.col("g.Country"))
    )
    return (
        s.join(g, same_place, "left")
        .join(p, F.col("s.Product_ID") == F.col("p.Product_ID"), "left")
        .select(
            "s.Order_ID", "s.Product_ID", "s.Customer_ID", "g.Geo_Key", "p.Product_Key",
            "s.Order_Date", "s.Sales", "s.Quantity", "s.Profit", "s.Discount",
        )
    )


def with_year(fact: DataFrame) -> DataFrame:
    """The year of the order as last column; NULL without a date."""
    return fact.withColumn(YEAR, F.year("Order_Date"))


def within(fact: DataFrame, first_day: Column, last_day: Column) -> DataFrame:
    """Lines of these days, both included, from the folders of their years only.

    The days may be scalar subqueries: Spark runs these first and then prunes. Lines without a date
    are in no period."""
    years = F.col(YEAR).between(F.year(first_day), F.year(last_day))
    return fact.filter(years & F.col("Order_Date").between(first_day, last_day))
