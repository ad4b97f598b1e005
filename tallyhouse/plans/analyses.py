"""Business questions over the star schema.

Plans aggregate the fact table on its own keys before joining a dimension wherever the measures
allow it, so what is shuffled and joined is one row per key instead of one per line. Windows
without PARTITION BY appear only over results that are already one row per year, tier or region;
rankings and running sums over customers, products or lines use the range-partitioned operators.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyhouse.functions import average, days_between, money, month_end, month_name, percent, ratio
from tallyhouse.operators.ordering import (
    Key,
    first_rows,
    ntile_scores,
    peers_within,
    running_sum,
    running_sum_with_peers,
    tile,
)
from tallyhouse.sources.shared import SharedFolder

# Labels and thresholds of the reports.
TOP_MONTHS = 4
TOP_PERCENT = 5
PARETO_SHARE = "0.8"
ONE_TIME, OCCASIONAL, LOYAL = "One-Time Buyer", "Occasional Buyer", "Loyal Buyer"
LOSS, LOW, MODERATE, HIGH = "Loss-Making", "Low Margin", "Moderate Margin", "High Margin"


def _totals() -> list[Column]:
    """Sales and profit of lines, or of rows that are totals already."""
    return [F.sum("Sales").alias("sales"), F.sum("Profit").alias("profit")]


def kpi_summary(fact: DataFrame) -> DataFrame:
    totals = fact.agg(*_totals(), F.count_distinct("Order_ID").alias("orders"))
    return totals.select(
        money(F.col("sales")).alias("total_sales"),
        money(F.col("profit")).alias("total_profit"),
        percent(ratio(F.col("profit"), F.col("sales"))).alias("profit_margin_pct"),
        average(F.col("sales"), F.col("orders")).alias("avg_order_value"),
    )


def region_performance(fact: DataFrame, geography: DataFrame) -> DataFrame:
    """Shares use the rounded sums. The grand total covers lines without a place too, so those stay
    in until it is known."""
    per_place = fact.groupBy("Geo_Key").agg(*_totals())
    places = geography.select("Geo_Key", "Region", F.lit(True).alias("matched"))
    per_region = per_place.join(places, "Geo_Key", "left").groupBy("matched", "Region").agg(*_totals())
    rounded = per_region.select(
        "matched",
        F.col("Region").alias("region"),
        F.round("sales", 2).alias("region_sales"),
        F.round("profit", 2).alias("region_profit"),
        F.round(F.sum("sales").over(Window.partitionBy()), 2).alias("all_sales"),
    ).filter("matched")
    return rounded.select(
        "region",
        money(F.col("region_sales")).alias("sales_by_region"),
        money(F.col("region_profit")).alias("profit_by_region"),
        money(F.col("all_sales")).alias("total_sales"),
        percent(ratio(F.col("region_sales"), F.col("all_sales"))).alias("sales_contribution_pct"),
        percent(ratio(F.col("region_profit"), F.col("region_sales"))).alias("profit_margin_pct"),
    )


def category_performance(fact: DataFrame, product: DataFrame) -> DataFrame:
    """Average profit is per fact line."""
    lines = fact.select("Product_Key", "Order_ID", "Sales", "Profit")
    per_category = (
        lines.join(product.select("Product_Key", "Category"), "Product_Key")
        .groupBy("Category")
        .agg(*_totals(), F.count("Profit").alias("n"), F.count_distinct("Order_ID").alias("orders"))
    )
    return per_category.select(
        F.col("Category").alias("category"),
        average(F.col("profit"), F.col("n")).alias("avg_profit"),
        money(F.col("profit")).alias("total_profit"),
        money(F.col("sales")).alias("total_sales"),
        F.col("orders").alias("total_orders"),
    ).orderBy(F.desc("total_sales"))


def segment_performance(fact: DataFrame, customer: DataFrame) -> DataFrame:
    """Sums and customers from one row per customer, orders from distinct (segment, order) pairs:
    no row is multiplied to count two things at once."""
    segments = customer.select("Customer_ID", "Segment")
    sums = (
        fact.groupBy("Customer_ID").agg(*_totals())
        .join(segments, "Customer_ID")
        .groupBy("Segment")
        .agg(*_totals(), F.count("Customer_ID").alias("customers"))
    )
    orders = (
        fact.select("Customer_ID", "Order_ID").distinct()
        .join(segments, "Customer_ID")
        .select(F.col("Segment").alias("in_segment"), "Order_ID").distinct()
        .groupBy("in_segment")
        .agg(F.count("Order_ID").alias("orders"))
    )
    per_segment = sums.join(orders, F.col("Segment").eqNullSafe(F.col("in_segment")))
    return per_segment.select(
        F.col("Segment").alias("segment"),
        money(F.col("sales")).alias("total_sales"),
        money(F.col("profit")).alias("total_profit"),
        percent(ratio(F.col("profit"), F.col("sales"))).alias("profit_margin_pct"),
        F.col("orders").alias("total_orders"),
        F.col("customers").alias("total_customers"),
    ).orderBy(F.desc("total_sales"))


def _yearly(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.year("Order_Date").alias("yr")).agg(*_totals())


def growth(yearly: DataFrame) -> DataFrame:
    """``yearly`` has one row per year: yr, sales, profit."""
    by_year = Window.orderBy("yr")
    sales, profit = F.col("sales"), F.col("profit")
    before = yearly.withColumns(
        {"sales_before": F.lag("sales").over(by_year), "profit_before": F.lag("profit").over(by_year)}
    )
    return before.select(
        "yr",
        money(sales).alias("total_sales"),
        money(profit).alias("total_profit"),
        money(F.col("sales_before")).alias("prev_yr_sales"),
        money(F.col("profit_before")).alias("prev_yr_profit"),
        percent(ratio(sales - F.col("sales_before"), F.col("sales_before"))).alias("sales_growth_pct"),
        percent(ratio(profit - F.col("profit_before"), F.col("profit_before"))).alias(
            "profit_growth_pct"
        ),
    ).orderBy("yr")


def yoy_growth(fact: DataFrame) -> DataFrame:
    return growth(_yearly(fact))


def compound_growth(yearly: DataFrame) -> DataFrame:
    """NULL when there is only one year."""
    ends = yearly.filter("yr IS NOT NULL").agg(
        F.min_by("sales", "yr").alias("first"),
        F.max_by("sales", "yr").alias("last"),
        (F.max("yr") - F.min("yr")).alias("t"),
    )
    rate = F.pow(ratio(F.col("last"), F.col("first")), ratio(F.lit(1), F.col("t"))) - 1
    return ends.select(percent(rate).alias("cagr_pct"))


def cagr(fact: DataFrame) -> DataFrame:
    return compound_growth(_yearly(fact))


def _months(fact: DataFrame) -> DataFrame:
    """One row per calendar month, its sales rounded to cents. The month end is the group key; year
    and name follow from it."""
    day = F.col("month_end")
    return (
        fact.groupBy(month_end(F.col("Order_Date")).alias("month_end"))
        .agg(F.sum("Sales").alias("sales"))
        .select(
            F.year(day).alias("yr"),
            month_name(day).alias("month_name"),
            "month_end",
            F.round("sales", 2).alias("monthly_sales"),
        )
    )


def monthly_sales(fact: DataFrame) -> DataFrame:
    return _months(fact).withColumn("monthly_sales", money(F.col("monthly_sales")))


def _ranked_months(fact: DataFrame) -> DataFrame:
    best_first = Window.partitionBy("yr").orderBy(F.desc("monthly_sales"))
    return _months(fact).withColumn("rnk", F.rank().over(best_first))


def rank_months(fact: DataFrame) -> DataFrame:
    return _ranked_months(fact).withColumn("monthly_sales", money(F.col("monthly_sales")))


def topk_months_per_year(fact: DataFrame, k: int = TOP_MONTHS) -> DataFrame:
    return rank_months(fact).filter(F.col("rnk") <= k)


def peak_season(fact: DataFrame) -> DataFrame:
    return (
        _ranked_months(fact)
        .filter(F.col("rnk") <= TOP_MONTHS)
        .groupBy("month_name")
        .agg(F.count(F.lit(1)).alias("peak_frequency"), F.sum("monthly_sales").alias("total"))
        .select(
            "month_name",
            "peak_frequency",
            average(F.col("total"), F.col("peak_frequency")).alias("avg_peak_sales"),
        )
        .orderBy(F.desc("peak_frequency"), F.desc("avg_peak_sales"))
    )


def case_tiers(fact: DataFrame) -> DataFrame:
    """Customers by number of orders: 1, 2 to 4, 5 or more."""
    orders = F.col("total_orders")
    return (
        fact.groupBy(F.col("Customer_ID").alias("customer_id"))
        .agg(F.count_distinct("Order_ID").alias("total_orders"))
        .withColumn(
            "customer_type",
            F.when(orders == 1, ONE_TIME).when(orders.between(2, 4), OCCASIONAL).otherwise(LOYAL),
        )
    )


def customer_frequency_tiers(fact: DataFrame) -> DataFrame:
    tiers = case_tiers(fact).groupBy("customer_type").agg(F.count(F.lit(1)).alias("customer_count"))
    share = ratio(F.col("customer_count"), F.sum("customer_count").over(Window.partitionBy()))
    return tiers.withColumn("pct_of_total", percent(share)).orderBy(F.desc("customer_count"))


def _spend(fact: DataFrame) -> DataFrame:
    return fact.groupBy(F.col("Customer_ID").alias("customer_id")).agg(
        F.sum("Sales").alias("sale_per_cust")
    )


def top_pct_customers(
    fact: DataFrame, customer: DataFrame, folder: SharedFolder, top: int = TOP_PERCENT
) -> DataFrame:
    """Equal spenders are ranked by customer id."""
    rounded = _spend(fact).select("customer_id", F.round("sale_per_cust", 2).alias("spent"))
    spent = folder.keep(rounded, "spent")
    best, customers = first_rows(spent, "spent", "customer_id", (top, 100), "place", folder)
    ranked = best.withColumn("percentile_rank", tile("place", str(customers), 100))
    names = customer.select(
        F.col("Customer_ID").alias("customer_id"), F.col("Customer_Name").alias("customer_name")
    )
    return (
        ranked.join(names, "customer_id")
        .select(
            "customer_id", "customer_name", money(F.col("spent")).alias("total_spent"),
            "percentile_rank",
        )
        .orderBy(F.desc("total_spent"), "customer_id")
    )


def running_total_by_category(
    fact: DataFrame, product: DataFrame, folder: SharedFolder
) -> DataFrame:
    """Few categories, each a large share of all lines: one category spans many tasks."""
    lines = fact.select("Product_Key", "Product_ID", "Order_Date", "Order_ID", "Sales").join(
        product.select("Product_Key", "Category"), "Product_Key"
    )
    keys = lines.select("Category", "Order_Date", "Order_ID", "Product_ID", "Sales")
    order = [F.col(c).asc_nulls_first() for c in ("Order_Date", "Order_ID", "Product_ID")]
    summed = running_sum(
        keys, "Sales", order, "running", folder, within=["Category"], in_order=True
    )
    return summed.select(
        F.col("Category").alias("category"),
        F.col("Order_Date").alias("order_date"),
        F.col("Order_ID").alias("order_id"),
        money(F.col("Sales")).alias("order_sales"),
        money(F.col("running")).alias("running_total_sales"),
    )


def running_sum_range(fact: DataFrame, folder: SharedFolder) -> DataFrame:
    spent = folder.keep(_spend(fact), "spent")  # used twice: summed per value, and joined back
    summed = running_sum_with_peers(spent, "sale_per_cust", "running_total", folder)
    return summed.select(
        "customer_id",
        F.col("sale_per_cust").cast("double").alias("sale_per_cust"),
        money(F.col("running_total")).alias("running_total"),
    )


def share_of_total(fact: DataFrame) -> DataFrame:
    """Every customer next to the grand total. The total is a scalar subquery over the same
    per-customer sums, so both share one scan and one shuffle."""
    spent = _spend(fact)
    total = spent.select(F.sum("sale_per_cust")).scalar()
    return spent.select(
        "customer_id",
        money(F.col("sale_per_cust")).alias("sale_per_cust"),
        money(total).alias("total_sales"),
        percent(ratio(F.col("sale_per_cust"), total)).alias("share_pct"),
    )


def _pareto(
    fact: DataFrame, key: str, dimension: DataFrame, output: str, folder: SharedFolder
) -> DataFrame:
    """Members whose running revenue, largest first, stays within 80 % of all revenue, as a share
    of the dimension's rows. Members with equal revenue are counted together, and the member that
    crosses the line is left out."""
    per_member = fact.groupBy(key).agg(F.sum("Sales").alias("revenue"))
    n = peers_within(per_member, "revenue", PARETO_SHARE, folder)
    members = dimension.agg(F.count(F.lit(1)).alias("members"))
    return members.select(percent(ratio(F.lit(n).cast("bigint"), F.col("members"))).alias(output))


def pareto_customers(fact: DataFrame, customer: DataFrame, folder: SharedFolder) -> DataFrame:
    return _pareto(fact, "Customer_ID", customer, "customer_pct_driving_80_pct_revenue", folder)


def pareto_products(fact: DataFrame, product: DataFrame, folder: SharedFolder) -> DataFrame:
    return _pareto(fact, "Product_ID", product, "product_pct_driving_80_pct_revenue", folder)


def distinct_customer_years(fact: DataFrame) -> DataFrame:
    return fact.select(
        F.col("Customer_ID").alias("customer_id"), F.year("Order_Date").alias("current_yr")
    ).distinct()


def yoy_churn(fact: DataFrame) -> DataFrame:
    """Customers of a year who bought again in exactly the next one; the last year is left out.

    One look-ahead per customer over the distinct years replaces a self join; a customer has at
    most one row per calendar year there.
    """
    by_customer = Window.partitionBy("customer_id").orderBy("current_yr")
    next_yr = F.lead("current_yr").over(by_customer)
    active = distinct_customer_years(fact).withColumn("next_yr", next_yr)
    returned = F.col("customer_id").isNotNull() & (F.col("next_yr") == F.col("current_yr") + 1)
    per_year = (
        active.groupBy("current_yr")
        .agg(
            F.count("customer_id").alias("total_customers"),
            F.count_if(returned).alias("retained_customers"),
        )
        .withColumn("last_yr", F.max("current_yr").over(Window.partitionBy()))
        .filter("current_yr <> last_yr")
    )
    churned = F.col("total_customers") - F.col("retained_customers")
    return per_year.select(
        "current_yr",
        "total_customers",
        "retained_customers",
        churned.alias("churned_customers"),
        percent(ratio(churned, F.col("total_customers"))).alias("churn_rate"),
    ).orderBy("current_yr")


def self_join_next_year(fact: DataFrame, folder: SharedFolder) -> DataFrame:
    """Each (customer, year) with the same customer's next year, where there is one. The pairs are
    written once: the two sides differ in their NULL filter and would each scan the fact table."""
    now = folder.keep(distinct_customer_years(fact), "customer_years")
    later = now.select(
        F.col("customer_id").alias("repeated_id"), (F.col("current_yr") - 1).alias("yr_before")
    )
    matched = (now["customer_id"] == later["repeated_id"]) & (now["current_yr"] == later["yr_before"])
    return now.join(later, matched, "left").drop("yr_before")


def segment_margin_yoy(fact: DataFrame, customer: DataFrame) -> DataFrame:
    per_customer = fact.groupBy("Customer_ID", F.year("Order_Date").alias("yr")).agg(*_totals())
    per_segment = (
        per_customer.join(customer.select("Customer_ID", "Segment"), "Customer_ID")
        .groupBy("yr", F.col("Segment").alias("segment"))
        .agg(*_totals())
        .withColumn("margin", ratio(F.col("profit"), F.col("sales")))
    )
    before = F.lag("margin").over(Window.partitionBy("segment").orderBy("yr"))
    return per_segment.select(
        "yr",
        "segment",
        money(F.col("sales")).alias("total_sales"),
        money(F.col("profit")).alias("total_profit"),
        percent(F.col("margin")).alias("profit_margin_pct"),
        percent(before).alias("prev_yr_margin_pct"),
    ).orderBy("segment", "yr")


def rfm_scores(fact: DataFrame, folder: SharedFolder, best_is_high: bool = False) -> DataFrame:
    """Recency, frequency and money per customer, each cut into fifths.

    By default fifth 1 holds the most recent, most frequent and highest-spending customers; with
    ``best_is_high`` the three orders are reversed, so that 5 is best. Ties go by customer id.
    """
    base = fact.groupBy(F.col("Customer_ID").alias("customer_id")).agg(
        F.max("Order_Date").alias("last_order"),
        F.count_distinct("Order_ID").alias("frequency"),
        F.round(F.sum("Sales"), 2).alias("monetary"),
    )
    # A later last order is a smaller recency, so it runs the other way round, NULLs included.
    if best_is_high:
        scores = {
            "r_score": Key("last_order"),
            "f_score": Key("frequency", nulls_first=True),
            "m_score": Key("monetary", nulls_first=True),
        }
    else:
        scores = {
            "r_score": Key("last_order", descending=True, nulls_first=True),
            "f_score": Key("frequency", descending=True),
            "m_score": Key("monetary", descending=True),
        }
    kept = folder.keep(base, "customers")
    return ntile_scores(kept, 5, scores, Key("customer_id", nulls_first=True), folder)


def rfm(fact: DataFrame, folder: SharedFolder, best_is_high: bool = False) -> DataFrame:
    scored = rfm_scores(fact, folder, best_is_high)
    as_of = scored.select(F.max("last_order")).scalar()
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    # Segment names and score borders, tested in this order.
    segment = (
        F.when((r >= 4) & (f >= 4), "Champion")
        .when((r >= 3) & (f >= 3), "Loyal Customer")
        .when((r >= 4) & (f < 3), "Recent Customer")
        .when((r < 3) & (f >= 4), "At-Risk Loyal")
        .otherwise("Needs Attention")
    )
    return scored.select(
        "customer_id",
        days_between(F.col("last_order"), as_of).alias("recency_days"),
        "frequency",
        money(F.col("monetary")).alias("monetary"),
        "r_score",
        "f_score",
        "m_score",
        (r + f + m).alias("rfm_total_score"),
        segment.alias("customer_segment"),
    ).orderBy(F.desc("rfm_total_score"), "customer_id")


def subcategory_profitability(fact: DataFrame, product: DataFrame) -> DataFrame:
    lines = fact.select("Product_Key", "Order_ID", "Sales", "Profit")
    members = product.select("Product_Key", "Category", "Sub_Category")
    per_group = (
        lines.join(members, "Product_Key")
        .groupBy("Category", "Sub_Category")
        .agg(*_totals(), F.count_distinct("Order_ID").alias("orders"))
        .withColumn("margin", ratio(F.col("profit"), F.col("sales")))
    )
    points = F.col("margin") * 100
    band = (
        F.when(F.col("profit") < 0, LOSS)
        .when(points < 10, LOW)
        .when(points < 25, MODERATE)
        .when(points.isNotNull(), HIGH)
    )
    return per_group.select(
        F.col("Category").alias("category"),
        F.col("Sub_Category").alias("sub_category"),
        money(F.col("sales")).alias("total_sales"),
        money(F.col("profit")).alias("total_profit"),
        percent(F.col("margin")).alias("profit_margin_pct"),
        F.col("orders").alias("total_orders"),
        band.alias("margin_category"),
    ).orderBy(F.desc("total_profit"))
