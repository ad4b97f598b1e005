"""Every check passes on a sound warehouse and fails on a seeded fault."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.plans import quality as Q
from tallyhouse.plans.warehouse import GOLD

CHECKS = [
    Q.check_not_null, Q.check_null_fks, Q.check_key_types, Q.check_primary_keys, Q.check_foreign_keys,
    Q.reconcile_counts, Q.reconcile_totals, Q.reconcile_orders, Q.crosscheck_dimensions,
]


@pytest.fixture(scope="module")
def tables(house):
    return {t: house[t] for t in ("bronze", "silver", *GOLD)}


def failed(report):
    return {r["check"] for r in report.filter("NOT passed").collect()}


def test_sound_warehouse(tables):
    for check in CHECKS:
        assert failed(check(tables)) == set(), check.__name__
    report = Q.quality_report(tables)
    assert report.count() == 8 + 4 + 4 + 4 + 1 + 2 + 1 + 3 + 4
    assert failed(report) == set()


def nulled(df, column):
    first = F.min("Order_ID") if "Order_ID" in df.columns else F.min(column)
    key = "Order_ID" if "Order_ID" in df.columns else column
    hit = F.col(key) == df.select(first).scalar()
    return df.withColumn(column, F.when(~hit, F.col(column)))


@pytest.mark.parametrize(
    "check, table, fault, expected",
    [
        (Q.check_not_null, "fact_sales", lambda d: nulled(d, "Geo_Key"), {"fact_sales.Geo_Key not null"}),
        (Q.check_not_null, "dim_date", lambda d: nulled(d, "Order_Date"), {"dim_date.Order_Date not null"}),
        (Q.check_null_fks, "fact_sales", lambda d: nulled(d, "Product_Key"), {"null_product_keys"}),
        (Q.check_key_types, "fact_sales", lambda d: d.withColumn("Geo_Key", F.col("Geo_Key").cast("string")),
         {"fact_sales.Geo_Key type"}),
        (Q.check_primary_keys, "dim_customer", lambda d: d.union(d.limit(1)), {"dim_customer.Customer_ID unique"}),
        (Q.check_foreign_keys, "dim_geography", lambda d: d.filter("Geo_Key > 3"),
         {"fact_sales.Geo_Key in dim_geography"}),
        (Q.check_foreign_keys, "dim_customer", lambda d: d.limit(0), {"fact_sales.Customer_ID in dim_customer"}),
        (Q.reconcile_counts, "fact_sales", lambda d: d.union(d.limit(1)), {"rows"}),
        (Q.reconcile_totals, "fact_sales",
         lambda d: d.withColumn("Sales", F.col("Sales") + F.lit(Decimal("0.01"))), {"total_sales"}),
        (Q.reconcile_totals, "fact_sales", lambda d: d.withColumn("Profit", F.col("Profit") * 2), {"total_profit"}),
        (Q.reconcile_orders, "fact_sales", lambda d: d.withColumn("Order_ID", F.lit("one")), {"orders"}),
        (Q.crosscheck_dimensions, "dim_product", lambda d: d.filter("Product_Key > 1"), {"dim_product rows"}),
    ],
)
def test_seeded_fault(tables, check, table, fault, expected):
    broken = {**tables, table: fault(tables[table])}
    assert failed(check(broken)) == expected
    alone = {n for c in CHECKS for n in failed(c(broken))}
    assert failed(Q.quality_report(broken)) == alone >= expected


def test_all_checks_count_as_each_check_alone(tables):
    """With NULLs, orphans, repeated keys and lost lines at once."""
    broken = {
        **tables,
        "fact_sales": nulled(tables["fact_sales"], "Customer_ID"),
        "dim_product": tables["dim_product"].union(tables["dim_product"].limit(2)),
        "dim_customer": nulled(tables["dim_customer"].filter("Customer_ID <> 'CU-1'"), "Customer_ID"),
        "silver": tables["silver"].filter("Quantity > 2"),
        "dim_date": tables["dim_date"].limit(0),
    }
    alone = {tuple(r[c] for c in ("check", "expected", "actual", "passed")) for q in CHECKS if q is not Q.check_key_types for r in q(broken).collect()}
    assert {tuple(r) for r in Q.all_checks(broken).collect()} == alone


def test_checks_of_empty_tables(tables):
    none = {t: df.limit(0) for t, df in tables.items()}
    assert failed(Q.quality_report(none)) == set() and Q.quality_report(none).count() == 31
    assert {r.value for r in Q.profile_silver(none).collect()} == {0}


def test_foreign_key_check_counts_rows(tables):
    lost = tables["dim_customer"].filter("Customer_ID <> 'CU-1'")
    row = Q.check_foreign_keys({**tables, "dim_customer": lost}).filter("NOT passed").first()
    assert row.actual == tables["fact_sales"].filter("Customer_ID = 'CU-1'").count() > 1


def test_profile(tables):
    """What the raw lines at this scale contain."""
    profile = {r.measure: r.value for r in Q.profile_silver(tables).collect()}
    assert profile["raw_rows"] == 7529 and profile["clean_rows"] == 5942
    assert profile["null_customer_names"] == 234 and profile["missing_cities"] == 219
    assert profile["misplaced_states"] == 6 and profile["misspelt_categories"] == 269 + 195
    assert profile["null_postal_codes"] == 600 and profile["distinct_categories"] == 3


def test_dimension_sizes(tables):
    sizes = {r.dimension: r.row_count for r in Q.dimension_counts(tables).collect()}
    assert sizes == {"dim_customer": 150, "dim_product": 200, "dim_geography": 169, "dim_date": 1084}


def test_key_types_of_an_empty_fact(tables):
    wrong = tables["fact_sales"].limit(0).withColumn("Geo_Key", F.col("Geo_Key").cast("string"))
    rows = Q.check_key_types({**tables, "fact_sales": wrong}).collect()
    assert len(rows) == 4 and [r["check"] for r in rows if not r.passed] == ["fact_sales.Geo_Key type"]
    assert {r.rows_checked for r in rows} == {0}


def test_expected_dimension_sizes(tables):
    report = Q.quality_report(tables, {"dim_customer": 150, "dim_product": 7})
    assert failed(report) == {"dim_product expected rows"}
