"""Every named query, as a function of a warehouse."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.functions import (
    days_between,
    money,
    month_end,
    month_name,
    percent,
    ratio,
    sentence_case,
    text_length,
)
from tallyhouse.plans import analyses as A, gold, quality as Q, silver as S
from tallyhouse.plans.warehouse import Warehouse
from tallyhouse.sources.raw_csv import RAW_COLUMNS, read_raw, write_raw

Query = Callable[[Warehouse], DataFrame]


def _bronze_ingest(w: Warehouse) -> DataFrame:
    """The raw lines through a CSV file and back, all columns text. As plain text the file would be four times bronze."""
    path = w.folder.fresh("landing")
    write_raw(w.bronze, path, "gzip")
    return read_raw(w.bronze.sparkSession, path, RAW_COLUMNS)


def _silver_snapshot(w: Warehouse) -> DataFrame:
    return w.folder.keep(w.bronze, "snapshot")


def _bronze_column(w: Warehouse, **values: Column) -> DataFrame:
    """Line keys next to computed columns, over all raw rows."""
    return w.bronze.select("Order_ID", "Product_ID", *[v.alias(n) for n, v in values.items()])


def _cast_types(w: Warehouse) -> DataFrame:
    types = S.typed_columns()
    amounts = {c: types[c].cast("double") for c in ("Sales", "Profit", "Discount")}
    return _bronze_column(w, **{**types, **amounts})


def _detect_misplaced_state(w: Warehouse) -> DataFrame:
    lines = _bronze_column(w, City=S.city(), State=S.cased_state())
    return lines.filter(F.col("State").like(S.MISPLACED_STATE))


def _doubled(df: DataFrame) -> DataFrame:
    """Exact amounts as doubles, for output."""
    return df.withColumns({c: F.col(c).cast("double") for c in ("Sales", "Profit", "Discount")})


def _filter_predicates(w: Warehouse) -> DataFrame:
    """How many raw lines each kind of predicate keeps, in one pass."""
    quantity, day = F.col("Quantity").cast("int"), F.col("Order_Date").cast("date")
    predicates = {
        "is null": F.col("Customer_Name").isNull(),
        "is not null": F.col("Postal_Code").isNotNull(),
        "in": F.upper(F.trim("City")).isin(*S.MISSING_CITY),
        "like": F.col("State").like("CA-20%"),
        "=": F.col("Category") == "Technlogy",
        "<>": F.col("Region") != "ASIA",
        "<": quantity < 10,
        "<=": quantity <= 10,
        ">": quantity > 40,
        ">=": quantity >= 40,
        "between": quantity.between(2, 4),
        "and": (quantity > 25) & (day >= F.lit("1998-01-01").cast("date")),
    }
    counts = w.bronze.agg(*[F.count_if(p).alias(n) for n, p in predicates.items()])
    pairs = [F.struct(F.lit(n).alias("predicate"), F.col(f"`{n}`").alias("n")) for n in predicates]
    return counts.select(F.inline(F.array(*pairs)))


def _scalar_subquery(w: Warehouse) -> DataFrame:
    """Lines of the last day, each next to all sales: one subquery in WHERE, one in SELECT.

    The day comes from the dates' table, which has exactly the fact's days; of the fact only its year
    is read, and the sales column for the total."""
    fact = w.fact_sales
    last_day = w.dim_date.select(F.max("Order_Date")).scalar()
    all_sales = fact.select(F.sum("Sales")).scalar()
    in_year = F.col(gold.YEAR) == F.year(last_day)
    return fact.filter(in_year & (F.col("Order_Date") == last_day)).select(
        "Order_ID",
        "Product_ID",
        "Order_Date",
        F.col("Sales").cast("double").alias("Sales"),
        money(all_sales).alias("all_sales"),
    )


def _agg_basic(w: Warehouse) -> DataFrame:
    return (
        w.fact_sales.groupBy(F.year("Order_Date").alias("yr"))
        .agg(
            F.sum("Sales").alias("s"),
            F.sum("Profit").alias("p"),
            F.count("Profit").alias("profit_count"),
            F.count(F.lit(1)).alias("line_count"),
            F.count("Geo_Key").alias("placed_lines"),
            F.min("Order_Date").alias("first_day"),
            F.max("Order_Date").alias("last_day"),
            F.min("Sales").cast("double").alias("smallest_sale"),
            F.max("Sales").cast("double").alias("largest_sale"),
        )
        .select(
            "yr",
            money(F.col("s")).alias("total_sales"),
            money(F.col("p")).alias("total_profit"),
            F.round(ratio(F.col("p"), F.col("profit_count")).cast("decimal(38,6)"), 2)
            .cast("double")
            .alias("avg_profit"),
            "line_count", "placed_lines", "first_day", "last_day", "smallest_sale", "largest_sale",
        )
    )


def _agg_count_distinct(w: Warehouse) -> DataFrame:
    """One pass per column: each reads and shuffles a single column's distinct values."""
    out = None
    for c in ("Order_ID", "Customer_ID", "City", "State", "Order_Date"):
        one = w.silver.agg(F.count_distinct(c).alias("n")).select(F.lit(c).alias("column_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _surrogate_keys(w: Warehouse) -> DataFrame:
    """Both keyed dimensions as (dimension, member, key)."""
    product = w.dim_product.select(
        F.lit("product").alias("dimension"),
        F.col("Product_ID").alias("member"),
        F.col("Product_Key").alias("surrogate_key"),
    )
    place = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("?")) for c in gold.PLACE])
    geography = w.dim_geography.select(
        F.lit("geography").alias("dimension"),
        place.alias("member"),
        F.col("Geo_Key").alias("surrogate_key"),
    )
    return product.unionByName(geography)


def _rfm_scores(w: Warehouse) -> DataFrame:
    scored = A.rfm_scores(w.fact_sales, w.folder)
    return scored.select("customer_id", "r_score", "f_score", "m_score")


def _scalar_strings(w: Warehouse) -> DataFrame:
    city = F.col("City")
    return _bronze_column(
        w,
        City=city,
        upper_city=F.upper(city),
        lower_city=F.lower(city),
        left_city=F.left(city, F.lit(6)),
        rest_of_city=F.substring(city, 2, 2**31 - 1),
        city_length=text_length(city),
        trimmed_city=F.trim(city),
        place=F.concat(sentence_case(city), F.lit(", "), F.col("Postal_Code")),
    )


def _scalar_dates(w: Warehouse) -> DataFrame:
    day, shipped = F.col("Order_Date"), F.col("Ship_Date")
    return w.silver.select(
        "Order_ID",
        "Product_ID",
        F.year(day).alias("order_year"),
        F.month(day).alias("order_month"),
        month_name(day).alias("order_month_name"),
        month_end(day).alias("order_month_end"),
        days_between(day, shipped).alias("days_to_ship"),
    )


def _scalar_math(w: Warehouse) -> DataFrame:
    sales = F.col("Sales")
    return w.silver.select(
        "Order_ID",
        "Product_ID",
        money(sales).alias("rounded_sales"),
        F.pow(F.col("Discount").cast("double") + 1, F.lit(2.0)).alias("discount_factor_squared"),
        ratio(F.col("Quantity"), F.lit(7)).alias("weeks_of_stock"),
        (F.col("Quantity") * F.lit(100.0)).alias("quantity_times_100"),
    )


def _percent_format(w: Warehouse) -> DataFrame:
    margin = ratio(F.col("Profit"), F.col("Sales"))
    share = ratio(F.col("Quantity"), F.lit(50))
    return w.silver.select(
        "Order_ID",
        "Product_ID",
        margin.alias("margin"),
        percent(margin).alias("margin_pct"),
        percent(share).alias("quantity_pct"),
        percent(F.nullif(F.col("Discount").cast("double"), F.lit(0.0))).alias("discount_pct"),
    )


QUERIES: dict[str, Query] = {
    # sources and layers
    "bronze_ingest": _bronze_ingest,
    "silver_snapshot": _silver_snapshot,
    "silver_sales": lambda w: _doubled(w.silver),
    "dim_customer": lambda w: w.dim_customer,
    "dim_product": lambda w: w.dim_product,
    "dim_geography": lambda w: w.dim_geography,
    "dim_date": lambda w: w.dim_date,
    "fact_sales": lambda w: _doubled(w.fact_sales).drop(gold.YEAR),
    # typing and repair
    "cast_types": _cast_types,
    "postal_code_int": lambda w: _bronze_column(w, Postal_Code=S.postal_code()),
    "fill_null_names": lambda w: _bronze_column(w, Customer_Name=S.customer_name()),
    "replace_sentinel_city": lambda w: _bronze_column(w, City=S.known_city()),
    "normalize_casing": lambda w: _bronze_column(w, City=S.city(), State=S.cased_state()),
    "normalize_casing_idempotent": lambda w: _bronze_column(
        w, City=sentence_case(S.city()), State=sentence_case(S.cased_state())
    ),
    "detect_misplaced_state": _detect_misplaced_state,
    "fix_misplaced_state": lambda w: _bronze_column(w, State=S.state()),
    "fix_category_typos": lambda w: _bronze_column(w, Category=S.category()),
    "filter_predicates": _filter_predicates,
    # distinct and dedup
    "distinct_categories": lambda w: w.bronze.select(S.category().alias("Category")).distinct(),
    "distinct_customer_years": lambda w: A.distinct_customer_years(w.fact_sales),
    "dedup_orders": lambda w: _doubled(S.dedup(S.repaired(w.bronze))),
    "duplicate_preview": lambda w: _doubled(S.duplicate_preview(S.repaired(w.bronze), w.folder)),
    # joins, aggregates, windows, functions
    "self_join_next_year": lambda w: A.self_join_next_year(w.fact_sales, w.folder),
    "scalar_subquery": _scalar_subquery,
    "case_tiers": lambda w: A.case_tiers(w.fact_sales),
    "agg_basic": _agg_basic,
    "agg_count_distinct": _agg_count_distinct,
    "monthly_sales": lambda w: A.monthly_sales(w.fact_sales),
    "rank_months": lambda w: A.rank_months(w.fact_sales),
    "topk_months_per_year": lambda w: A.topk_months_per_year(w.fact_sales),
    "surrogate_keys": _surrogate_keys,
    "rfm_scores": _rfm_scores,
    "running_sum_range": lambda w: A.running_sum_range(w.fact_sales, w.folder),
    "share_of_total": lambda w: A.share_of_total(w.fact_sales),
    "scalar_strings": _scalar_strings,
    "scalar_dates": _scalar_dates,
    "scalar_math": _scalar_math,
    "percent_format": _percent_format,
    # data quality
    "check_not_null": Q.check_not_null,
    "check_null_fks": Q.check_null_fks,
    "check_key_types": Q.check_key_types,
    "check_primary_keys": Q.check_primary_keys,
    "check_foreign_keys": Q.check_foreign_keys,
    "reconcile_counts": Q.reconcile_counts,
    "reconcile_totals": Q.reconcile_totals,
    "reconcile_orders": Q.reconcile_orders,
    "dimension_counts": Q.dimension_counts,
    "crosscheck_dimensions": Q.crosscheck_dimensions,
    "all_checks": Q.all_checks,
    "profile_silver": Q.profile_silver,
    # analyses
    "kpi_summary": lambda w: A.kpi_summary(w.fact_sales),
    "region_performance": lambda w: A.region_performance(w.fact_sales, w.dim_geography),
    "category_performance": lambda w: A.category_performance(w.fact_sales, w.dim_product),
    "segment_performance": lambda w: A.segment_performance(w.fact_sales, w.dim_customer),
    "yoy_growth": lambda w: A.yoy_growth(w.fact_sales),
    "cagr": lambda w: A.cagr(w.fact_sales),
    "peak_season": lambda w: A.peak_season(w.fact_sales),
    "customer_frequency_tiers": lambda w: A.customer_frequency_tiers(w.fact_sales),
    "top_pct_customers": lambda w: A.top_pct_customers(w.fact_sales, w.dim_customer, w.folder),
    "running_total_by_category": lambda w: A.running_total_by_category(
        w.fact_sales, w.dim_product, w.folder
    ),
    "pareto_customers": lambda w: A.pareto_customers(w.fact_sales, w.dim_customer, w.folder),
    "pareto_products": lambda w: A.pareto_products(w.fact_sales, w.dim_product, w.folder),
    "yoy_churn": lambda w: A.yoy_churn(w.fact_sales),
    "segment_margin_yoy": lambda w: A.segment_margin_yoy(w.fact_sales, w.dim_customer),
    "rfm": lambda w: A.rfm(w.fact_sales, w.folder),
    "rfm_corrected": lambda w: A.rfm(w.fact_sales, w.folder, best_is_high=True),
    "subcategory_profitability": lambda w: A.subcategory_profitability(
        w.fact_sales, w.dim_product
    ),
}
