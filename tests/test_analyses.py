"""Analyses on hand-made facts: borders, ties, gaps and single years."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import analyses as A

SCHEMA = (
    "Order_ID string, Product_ID string, Customer_ID string, Geo_Key bigint, Product_Key bigint, "
    "Order_Date date, Sales decimal(18,4), Quantity int, Profit decimal(18,6), Discount decimal(18,4)"
)


def fact(spark, *lines):
    """Lines as (order, customer, day, sales[, profit[, product key[, geo key]]])."""
    rows = []
    for order, customer, day, sales, *rest in lines:
        profit, product, geo = (list(rest) + [1, 1, 1][len(rest):])[:3]
        rows.append((order, f"P{product}", customer, geo, product, datetime.date.fromisoformat(day),
                     Decimal(str(sales)), 1, Decimal(str(profit)), Decimal(0)))
    return spark.createDataFrame(rows, SCHEMA)


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns or df.columns).collect()]


# Published yearly sales and profit, and the growth rates published for them.
YEARS = [(2014, 500872, 49556), (2015, 508688, 61556), (2016, 668612, 81477), (2017, 780128, 93271)]


@pytest.fixture()
def yearly(spark):
    rows = [(y, Decimal(s), Decimal(p)) for y, s, p in YEARS]
    return spark.createDataFrame(rows, "yr int, sales decimal(28,4), profit decimal(28,6)")


def test_published_growth(yearly):
    assert got(A.growth(yearly), "sales_growth_pct") == [(None,), ("1.56%",), ("31.44%",), ("16.68%",)]
    assert got(A.growth(yearly), "profit_growth_pct") == [(None,), ("24.22%",), ("32.36%",), ("14.48%",)]
    assert got(A.compound_growth(yearly)) == [("15.92%",)]


def test_growth_of_one_year(spark):
    one = fact(spark, ("O1", "C1", "2020-05-05", 10))
    assert got(A.cagr(one)) == [(None,)]
    assert got(A.yoy_growth(one), "prev_yr_sales", "sales_growth_pct") == [(None, None)]


def test_kpis_and_zero_sales(spark):
    assert got(A.kpi_summary(fact(spark, ("O1", "C", "2020-01-01", 10, 2), ("O1", "C", "2020-01-01", 5, 1, 2),
                                  ("O2", "C", "2020-01-01", 5, 0)))) == [(20.0, 3.0, "15.00%", 10.0)]
    assert got(A.kpi_summary(fact(spark, ("O1", "C", "2020-01-01", 0, 2)))) == [(0.0, 2.0, None, 0.0)]


def test_region_total_covers_lines_without_a_place(spark):
    geography = spark.createDataFrame([(1, "East"), (2, "West"), (3, None)], "Geo_Key bigint, Region string")
    lines = fact(spark, ("O1", "C", "2020-01-01", 10, 1, 1, 1), ("O2", "C", "2020-01-01", 20, 1, 1, 2),
                 ("O3", "C", "2020-01-01", 30, 1, 1, 3), ("O4", "C", "2020-01-01", 40, 1, 1, None))
    rows = got(A.region_performance(lines, geography), "region", "sales_by_region", "total_sales",
               "sales_contribution_pct")
    assert sorted(rows, key=str) == [("East", 10.0, 100.0, "10.00%"), ("West", 20.0, 100.0, "20.00%"),
                                     (None, 30.0, 100.0, "30.00%")]


def test_frequency_tiers(spark):
    lines = [(f"O{c}{i}", f"C{c}", "2020-01-01", 1) for c, n in ((1, 1), (2, 2), (4, 4), (5, 5)) for i in range(n)]
    lines.append(("O10", "C1", "2020-01-01", 1, 1, 2))  # a second line of the same order
    rows = got(A.customer_frequency_tiers(fact(spark, *lines)))
    assert sorted(rows) == [("Loyal Buyer", 1, "25.00%"), ("Occasional Buyer", 2, "50.00%"),
                            ("One-Time Buyer", 1, "25.00%")]


def test_churn_needs_exactly_the_next_year(spark, folder):
    lines = fact(spark, ("O1", "A", "2018-01-01", 1), ("O2", "A", "2020-01-01", 1),
                 ("O3", "B", "2018-03-01", 1), ("O4", "B", "2019-01-01", 1), ("O5", "B", "2018-04-01", 1))
    want = [(2018, 2, 1, 1, "50.00%"), (2019, 1, 0, 1, "100.00%")]
    assert got(A.yoy_churn(lines)) == want
    joined = A.self_join_next_year(lines, folder)
    assert sorted(got(joined), key=str) == [("A", 2018, None), ("A", 2020, None), ("B", 2018, "B"),
                                            ("B", 2019, None)]


@pytest.mark.parametrize(
    "profit, band",
    [(-0.01, "Loss-Making"), (0, "Low Margin"), (9.99, "Low Margin"), (10, "Moderate Margin"),
     (24.99, "Moderate Margin"), (25, "High Margin")],
)
def test_margin_bands(spark, profit, band):
    product = spark.createDataFrame([(1, "T", "S")], "Product_Key bigint, Category string, Sub_Category string")
    rows = A.subcategory_profitability(fact(spark, ("O1", "C", "2020-01-01", 100, profit)), product)
    assert got(rows, "margin_category") == [(band,)]


def test_pareto_leaves_out_the_member_that_crosses(spark, folder):
    customers = spark.createDataFrame([(c,) for c in "ABCDE"], "Customer_ID string")
    exact = fact(spark, ("1", "A", "2020-01-01", 50), ("2", "B", "2020-01-01", 30), ("3", "C", "2020-01-01", 20))
    assert got(A.pareto_customers(exact, customers, folder)) == [("40.00%",)]
    crossing = fact(spark, ("1", "A", "2020-01-01", 50), ("2", "B", "2020-01-01", 31), ("3", "C", "2020-01-01", 19))
    assert got(A.pareto_customers(crossing, customers, folder)) == [("20.00%",)]
    tied = fact(spark, ("1", "A", "2020-01-01", 50), ("2", "B", "2020-01-01", 25), ("3", "C", "2020-01-01", 25))
    assert got(A.pareto_customers(tied, customers, folder)) == [("20.00%",)]
    single = fact(spark, ("1", "A", "2020-01-01", 50))
    assert got(A.pareto_customers(single, customers, folder)) == [("0.00%",)]


def test_peak_months_keep_ties(spark):
    lines = [("O1", "C", "2020-01-05", 50), ("O2", "C", "2020-02-05", 40), ("O3", "C", "2020-03-05", 30),
             ("O4", "C", "2020-04-05", 20), ("O5", "C", "2020-05-05", 20), ("O6", "C", "2020-06-05", 10)]
    top = A.topk_months_per_year(fact(spark, *lines))
    assert sorted(got(top, "month_name", "rnk"), key=lambda r: r[1:] + r[:1]) == [
        ("January", 1), ("February", 2), ("March", 3), ("April", 4), ("May", 4)]
    season = A.peak_season(fact(spark, *lines, ("O7", "C", "2021-01-09", 50.05)))
    assert got(season)[0] == ("January", 2, 50.03)


def test_category_average_is_per_line(spark):
    product = spark.createDataFrame([(1, "T"), (2, "T")], "Product_Key bigint, Category string")
    lines = fact(spark, ("O1", "C", "2020-01-01", 10, 3, 1), ("O1", "C", "2020-01-01", 10, 6, 2))
    assert got(A.category_performance(lines, product)) == [("T", 4.5, 9.0, 20.0, 1)]


def test_segment_counts(spark):
    customer = spark.createDataFrame([("A", "S1"), ("B", "S1"), ("C", "S2")], "Customer_ID string, Segment string")
    lines = fact(spark, ("O1", "A", "2020-01-01", 10, 1), ("O1", "B", "2020-01-01", 10, 1),
                 ("O2", "B", "2020-01-01", 10, 1, 2), ("O3", "C", "2020-01-01", 5, 1))
    assert got(A.segment_performance(lines, customer)) == [
        ("S1", 30.0, 3.0, "10.00%", 2, 2), ("S2", 5.0, 1.0, "20.00%", 1, 1)]


def test_segment_margin_looks_back_within_segment(spark):
    customer = spark.createDataFrame([("A", "S1"), ("B", "S2")], "Customer_ID string, Segment string")
    lines = fact(spark, ("O1", "A", "2019-01-01", 10, 1), ("O2", "A", "2020-01-01", 10, 2),
                 ("O3", "B", "2020-01-01", 10, 3))
    assert got(A.segment_margin_yoy(lines, customer), "yr", "segment", "prev_yr_margin_pct") == [
        (2019, "S1", None), (2020, "S1", "10.00%"), (2020, "S2", None)]


def test_running_total_restarts_per_category(spark, folder):
    product = spark.createDataFrame([(1, "T"), (2, "F")], "Product_Key bigint, Category string")
    lines = fact(spark, ("O2", "C", "2020-01-02", 5), ("O1", "C", "2020-01-01", 10),
                 ("O1", "C", "2020-01-01", 7, 1, 2), ("O3", "C", "2020-01-02", 1))
    totals = A.running_total_by_category(lines, product, folder)
    assert got(totals, "category", "order_id", "running_total_sales") == [
        ("F", "O1", 7.0), ("T", "O1", 10.0), ("T", "O2", 15.0), ("T", "O3", 16.0)]


def test_rfm_labels_and_reversal(spark, folder):
    lines = [(f"O{c}{i}", f"C{c}", f"2020-01-{10 + c:02d}", c) for c in range(5) for i in range(c + 1)]
    as_written = {r.customer_id: r for r in A.rfm(fact(spark, *lines), folder).collect()}
    # C4 is the most recent, most frequent and highest-spending customer.
    assert as_written["C4"][4:] == (1, 1, 1, 3, "Needs Attention")
    assert as_written["C0"][4:] == (5, 5, 5, 15, "Champion")
    assert (as_written["C4"].recency_days, as_written["C0"].recency_days) == (0, 4)
    corrected = {r.customer_id: r for r in A.rfm(fact(spark, *lines), folder, True).collect()}
    assert corrected["C4"][4:] == (5, 5, 5, 15, "Champion")
    assert corrected["C0"][4:] == (1, 1, 1, 3, "Needs Attention")


def test_top_customers(spark, folder):
    names = spark.createDataFrame([(f"C{i:03d}", f"N{i}") for i in range(200)],
                                  "Customer_ID string, Customer_Name string")
    lines = [(f"O{i}", f"C{i:03d}", "2020-01-01", 1000 - i // 2) for i in range(200)]
    top = got(A.top_pct_customers(fact(spark, *lines), names, folder))
    assert [r[0] for r in top] == [f"C{i:03d}" for i in range(10)]
    assert [r[3] for r in top] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_churn_adds_up(house):
    for r in A.yoy_churn(house.fact_sales).collect():
        assert r.retained_customers + r.churned_customers == r.total_customers


def test_last_running_total_is_the_category_total(house):
    running = A.running_total_by_category(house.fact_sales, house.dim_product, house.folder)
    last = running.groupBy("category").agg(F.max("running_total_sales").alias("t"))
    totals = A.category_performance(house.fact_sales, house.dim_product)
    assert sorted(got(last)) == sorted(got(totals, "category", "total_sales"))
