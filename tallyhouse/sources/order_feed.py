"""Raw order lines made from normalised trade tables (lineitem, orders, customer, part, ...).

The tables are clean; the feed carries the defects that cleaning must repair: missing and placeholder
values, mixed casing, an order id in the State column, misspelt categories and repeated lines.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyhouse.sources.raw_csv import RAW_COLUMNS


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _three_ways(selector: Column, upper_case: Column, lower_case: Column, as_is: Column) -> Column:
    return F.when(selector == 0, upper_case).when(selector == 1, lower_case).otherwise(as_is)


def order_feed(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line and arrival. Lines are shuffled twice, by part and by order; what hangs on an order is
    joined to the orders, which are fewer, and places come last: lines carry no names of them."""
    lines = _table(spark, folder, "lineitem").withColumn("ship_day", F.to_date("l_shipdate"))
    orders = _table(spark, folder, "orders").withColumn("order_day", F.to_date("o_orderdate"))
    customers = _table(spark, folder, "customer")
    parts = _table(spark, folder, "part")
    nations = _table(spark, folder, "nation")
    regions = _table(spark, folder, "region")
    bought = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    )

    order, line, who = F.col("l_orderkey"), F.col("l_linenumber"), F.col("c_custkey")
    spelling = line % 3
    port = F.concat(F.lit("Port City "), (who % 40).cast("string"))
    sales = (
        F.col("l_extendedprice").cast("decimal(18,2)")
        * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    ).cast("decimal(18,4)")
    margin_points = (F.expr("int(substring(p_brand, 7))") % 4) * 15 - 10
    profit = (sales * margin_points * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,6)")
    technology = F.when(order % 10 == 3, "Technlogy").otherwise("Technology")
    furniture = F.when(order % 10 == 4, "Furnture").otherwise("Furniture")
    kind = F.col("p_type")

    values = {
        "Order_ID": F.concat(F.lit("OR-"), order.cast("string")),
        "Order_Date": F.date_add("order_day", F.col("day_shift")).cast("string"),
        "Ship_Date": F.col("ship_day").cast("string"),
        "Customer_ID": F.concat(F.lit("CU-"), who.cast("string")),
        "Customer_Name": F.when((order + line) % 33 == 0, F.lit(None)).otherwise(
            F.concat(F.when(who % 5 == 0, "Zoe ").otherwise("Ann "), who.cast("string"))
        ),
        "Segment": F.col("c_mktsegment"),
        "Country": F.lit("Synthetica"),
        "City": F.when(
            (order * 7 + line) % 32 == 0,
            _three_ways(spelling, F.lit("NONE"), F.lit(" none "), F.lit("")),
        ).otherwise(
            _three_ways(
                spelling, F.upper(port), F.lower(port), F.concat(F.lit(" "), port, F.lit(" "))
            )
        ),
        "State": F.when(order % 1000 == 7, "CA-2015-108119").otherwise(
            _three_ways(spelling, F.upper("n_name"), F.lower("n_name"), F.col("n_name"))
        ),
        "Postal_Code": F.when(
            who % 11 != 0, F.concat((F.lit(10000) + who % 80000).cast("string"), F.lit(".0"))
        ),
        "Region": F.col("r_name"),
        "Product_ID": F.concat(F.lit("PR-"), F.col("p_partkey").cast("string")),
        "Category": F.when(kind.isin("MEDIUM", "LARGE"), technology)
        .when(kind.isin("STANDARD", "SMALL"), furniture)
        .otherwise("Office Supplies"),
        "Sub_Category": F.col("p_brand"),
        "Product_Name": F.concat(F.col("p_name"), F.when(line == 7, " v2").otherwise("")),
        "Sales": sales.cast("string"),
        "Quantity": F.col("l_quantity").cast("int").cast("string"),
        "Discount": F.col("l_discount").cast("decimal(4,2)").cast("string"),
        "Profit": profit.cast("string"),
    }
    # Every fourth order arrives twice, the second time dated one day later.
    shifts = F.when(order % 4 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    repeated = joined.withColumn("day_shift", F.explode(shifts))
    return repeated.select(*[values[c].alias(c) for c in RAW_COLUMNS])
