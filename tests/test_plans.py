"""Physical plans: what is read, shuffled, broadcast and gathered."""

import re

import pytest

from tallyhouse.catalogue import QUERIES
from tallyhouse.plans import silver as S
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_cross_product(house, name):
    text = plan(QUERIES[name](house))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_python_workers(house):
    for name, query in QUERIES.items():
        text = plan(query(house))
        assert "Python" not in text and "InPandas" not in text, name


def test_distinct_counts_do_not_multiply_rows(house):
    assert "Expand" not in plan(QUERIES["segment_performance"](house))


def test_dedup_limits_before_the_shuffle(house):
    text = plan(S.silver_sales(house.bronze))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange") == 1


def test_distinct_counts_shuffle_on_the_counted_column_first(house):
    """A hot customer's orders are spread over tasks before they are counted."""
    assert "hashpartitioning(Customer_ID" in plan(QUERIES["case_tiers"](house))
    exchanges = [l for l in plan(QUERIES["case_tiers"](house)).splitlines() if "Exchange" in l]
    assert "Order_ID" in exchanges[-1] and "Customer_ID" in exchanges[-1]


@pytest.mark.parametrize(
    "name, columns",
    [("kpi_summary", "Order_ID,Sales,Profit"), ("yoy_growth", "Order_Date,Sales,Profit"),
     ("yoy_churn", "Customer_ID,Order_Date"), ("cagr", "Order_Date,Sales")],
)
def test_scans_read_only_what_is_used(house, name, columns):
    schemas = re.findall(r"ReadSchema: struct<(.*?)>", plan(QUERIES[name](house)))
    assert schemas
    for schema in schemas:
        assert set(re.findall(r"(\w+):", schema)) == set(columns.split(","))


def test_filters_reach_the_scan(house):
    text = plan(house.fact_sales.filter("Customer_ID = 'CU-1' AND Quantity > 5"))
    assert "PushedFilters: [IsNotNull(Customer_ID), IsNotNull(Quantity), EqualTo(Customer_ID,CU-1)" in text


@pytest.mark.parametrize(
    "name", ["rfm", "rfm_scores", "top_pct_customers", "running_sum_range", "running_total_by_category",
             "pareto_customers", "pareto_products"],
)
def test_global_orders_gather_only_slice_summaries(house, name):
    """SinglePartition may hold per-slice rows or aggregates, never customers, products or lines."""
    spark = house.bronze.sparkSession
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several slices
    try:
        lines = plan(QUERIES[name](house)).splitlines()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = " ".join(lines[i + 1 : i + 4])
            assert "partial_" in below or "__slice" in below or "merge_" in below, (name, below)
    if name in ("running_total_by_category", "running_sum_range"):
        assert any("Bucketed: true" in line for line in lines)


def test_running_total_is_sorted_without_another_shuffle(house):
    text = plan(QUERIES["running_total_by_category"](house))
    assert "rangepartitioning" not in text  # the range shuffle is behind the written slices
    assert "REPARTITION_BY_NUM" not in text and "Bucketed: true" in text


@pytest.mark.parametrize("name", ["duplicate_preview", "running_total_by_category"])
def test_slices_are_not_shuffled_again(house, name):
    """What stands between the window over slices and the table of slices is a scan, not an exchange."""
    text = plan(QUERIES[name](house))
    below = text[text.index("Window [") :].split("FileScan")[0]
    assert "Exchange" not in below


def test_scores_leave_customers_where_they_are(house):
    """The three scores are comparisons with borders: no window, no join, no shuffle of customers."""
    text = plan(QUERIES["rfm_scores"](house))
    assert "Window" not in text and "Join" not in text and "hashpartitioning" not in text


def test_dimension_joins_are_broadcast_only_while_small(spark, house):
    """No forced broadcast: with the size limit at zero the joins become sort-merge."""
    assert "BroadcastHashJoin" in plan(QUERIES["category_performance"](house))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("category_performance", "segment_performance", "region_performance",
                     "subcategory_profitability", "segment_margin_yoy"):
            text = plan(QUERIES[name](house))
            assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_results_do_not_depend_on_broadcasts_or_partition_counts(spark):
    """The whole build and the analyses once more with sort-merge joins and many partitions."""
    from tallyhouse.plans.warehouse import Warehouse
    from tallyhouse.sources.order_feed import order_feed
    from tallyhouse.sources.shared import SharedFolder

    names = ("running_total_by_category", "rfm", "pareto_products", "segment_performance", "surrogate_keys")

    def results():
        house = Warehouse(SharedFolder.of(spark).root, lambda: order_feed(spark, SMALL))
        return {n: sorted(map(tuple, QUERIES[n](house).collect()), key=str) for n in names}

    usual = results()
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "23",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        assert results() == usual
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_totals_share_the_scan_of_the_fact_table(house):
    df = QUERIES["share_of_total"](house)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final or "ReusedSubquery" in final


def test_hot_product_is_split_in_the_fact_join(spark, house):
    """A third of the lines sell one product; the sort-merge join splits that partition."""
    from pyspark.sql import functions as F

    from tallyhouse.plans import gold

    hot = house.silver.withColumn(
        "Product_ID", F.when(F.col("Order_ID").endswith("1") | F.col("Order_ID").endswith("5")
                             | F.col("Order_ID").endswith("9"), "PR-1").otherwise(F.col("Product_ID")))
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        fact = gold.fact_sales(hot.repartition(8), house.dim_geography, house.dim_product)
        rows = fact.collect()
        assert "SortMergeJoin(skew=true)" in plan(fact)
        assert len(rows) == house.silver.count()
    finally:
        for k in changed:
            spark.conf.unset(k)


def test_top_months_are_limited_before_the_shuffle(house):
    text = plan(QUERIES["topk_months_per_year"](house))
    assert text.count("WindowGroupLimit") == 2


def test_self_join_does_not_scan_the_fact_table_twice(house):
    text = plan(QUERIES["self_join_next_year"](house))
    assert "fact_sales" not in text and "Order_Date" not in text


def test_checks_read_each_table_once(house):
    """Six tables, six scans; values are counted before the one shuffle of them."""
    from tallyhouse.plans.quality import quality_report

    text = plan(quality_report(house))
    assert text.count("FileScan") == 6 and text.count("Exchange") == 2 and "Join" not in text
    assert plan(QUERIES["profile_silver"](house)).count("FileScan") == 2


def test_last_day_reads_its_year_only(house):
    """The years' folders are pruned by the result of the subquery; of seven years one is read."""
    df = QUERIES["scalar_subquery"](house)
    text = plan(df)
    pruned = [l for l in text.splitlines() if "FileScan" in l and "Order_Year" in l and "Subquery" in l.split("PartitionFilters:")[1].split("PushedFilters")[0]]
    assert pruned
    lines = [l for l in text.splitlines() if "FileScan" in l and "Order_ID" in l]
    assert lines == pruned
    # The whole fact is read once, for its total; the lookups of the day are of the dates' table.
    assert text.count("ReadSchema: struct<Sales:decimal(18,4)>") == 1
    assert "ReadSchema: struct<Order_Date:date,Sales" not in text
    assert house.fact_sales.select("Order_Year").distinct().count() == 7
    assert df.count() == house.fact_sales.filter(house.fact_sales.Order_Date == df.first()["Order_Date"]).count() > 0


@pytest.mark.parametrize("name", ["kpi_summary", "yoy_growth", "category_performance", "yoy_churn", "rank_months"])
def test_reports_on_a_period_prune_years(house, name):
    text = plan(QUERIES[name](house.period("1995-03-01", "1996-02-28")))
    scans = [l for l in text.splitlines() if "FileScan" in l and "Order_Year" in l]
    assert scans
    for scan in scans:
        assert "PartitionFilters: [isnotnull(Order_Year" in scan and "1995" in scan and "GreaterThanOrEqual(Order_Date,1995-03-01)" in scan


def test_cleaning_stays_below_what_java_compiles(spark, house):
    """A generated method of more than 8000 bytes stays interpreted, which is several times slower."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    good, rejected = S.castable(house.bronze)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # whole plans at once
    try:
        for df in (S.repaired(house.bronze), S.silver_sales(house.bronze), S.repaired(good), rejected, house._source()):
            code = debug.codegenString(df.select("*")._jdf.queryExecution().executedPlan())
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
            assert sizes and max(sizes) < 8000, sizes
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
