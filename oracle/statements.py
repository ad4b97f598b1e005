"""For each named query the SQL that gives the same rows, for DuckDB."""

from oracle.layers import ON_BRONZE, ON_GOLD, ON_REPAIRED, ON_SILVER


def _money(x: str) -> str:
    return f"CAST(round({x}, 2) AS DOUBLE)"


def _ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def _pct(x: str) -> str:
    points = f"CAST(round(CAST(({x}) * 100 AS DECIMAL(28,10)), 2) AS DOUBLE)"
    return f"CASE WHEN ({x}) IS NOT NULL THEN format('{{:,.2f}}%', {points}) END"


def _avg(total: str, n: str) -> str:
    return f"CAST(round(CAST({_ratio(total, n)} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def _raw(columns: str) -> str:
    return f"{ON_BRONZE} SELECT Order_ID, Product_ID, {columns} FROM bronze"


def _cased(x: str) -> str:
    return f"(upper(left(trim({x}), 1)) || lower(substr(trim({x}), 2)))"


_KNOWN = "(CASE WHEN upper(trim(City)) IN ('NONE', '') THEN 'Unknown' ELSE City END)"
_TYPO = """(CASE WHEN Category = 'Technlogy' THEN 'Technology'
                 WHEN Category = 'Furnture' THEN 'Furniture' ELSE Category END)"""
_DOUBLES = """* REPLACE (CAST(Sales AS DOUBLE) AS Sales, CAST(Profit AS DOUBLE) AS Profit,
                         CAST(Discount AS DOUBLE) AS Discount)"""

_YEARLY = """yearly AS (
  SELECT CAST(year(Order_Date) AS INTEGER) AS yr, sum(Sales) AS s, sum(Profit) AS p FROM fact GROUP BY 1
)"""
_MONTHS = """months AS (
  SELECT CAST(year(Order_Date) AS INTEGER) AS yr, monthname(Order_Date) AS month_name,
         last_day(Order_Date) AS month_end, round(sum(Sales), 2) AS total
  FROM fact GROUP BY 1, 2, 3
),
ranked AS (
  SELECT *, CAST(rank() OVER (PARTITION BY yr ORDER BY total DESC) AS INTEGER) AS rnk FROM months
)"""
_TIERS = """tiers AS (
  SELECT Customer_ID AS customer_id, count(DISTINCT Order_ID) AS total_orders,
    CASE WHEN count(DISTINCT Order_ID) = 1 THEN 'One-Time Buyer'
         WHEN count(DISTINCT Order_ID) BETWEEN 2 AND 4 THEN 'Occasional Buyer'
         ELSE 'Loyal Buyer' END AS customer_type
  FROM fact GROUP BY Customer_ID
)"""
_SPEND = """spend AS (
  SELECT Customer_ID AS customer_id, sum(Sales) AS spent FROM fact GROUP BY Customer_ID
)"""
_YEARS = """active AS (
  SELECT Customer_ID AS customer_id, CAST(year(Order_Date) AS INTEGER) AS current_yr
  FROM fact GROUP BY ALL
)"""


def _pareto(key: str, dimension: str, output: str) -> str:
    return f"""{ON_GOLD},
    revenue AS (SELECT {key} AS k, sum(Sales) AS s FROM fact GROUP BY {key}),
    summed AS (SELECT s, sum(s) OVER (ORDER BY s DESC NULLS LAST) AS running, sum(s) OVER () AS everything
               FROM revenue),
    picked AS (SELECT count(*) AS n FROM summed WHERE running <= CAST('0.8' AS DECIMAL(2,1)) * everything)
    SELECT {_pct(_ratio('n', f'(SELECT count(*) FROM {dimension})'))} AS {output} FROM picked"""


def _rfm_base(best_is_high: bool) -> str:
    recency, more = ("DESC NULLS LAST", "ASC NULLS FIRST") if best_is_high else (
        "ASC NULLS FIRST", "DESC NULLS LAST")
    return f"""{ON_GOLD},
    base AS (
      SELECT Customer_ID AS customer_id,
        CAST(date_diff('day', max(Order_Date), (SELECT max(Order_Date) FROM fact)) AS INTEGER)
          AS recency_days,
        count(DISTINCT Order_ID) AS frequency, round(sum(Sales), 2) AS spent
      FROM fact GROUP BY Customer_ID
    ),
    scores AS (
      SELECT *,
        CAST(ntile(5) OVER (ORDER BY recency_days {recency}, customer_id NULLS FIRST) AS INTEGER) AS r_score,
        CAST(ntile(5) OVER (ORDER BY frequency {more}, customer_id NULLS FIRST) AS INTEGER) AS f_score,
        CAST(ntile(5) OVER (ORDER BY spent {more}, customer_id NULLS FIRST) AS INTEGER) AS m_score
      FROM base
    )"""


# Score borders, as published.
def _rfm(best_is_high: bool) -> str:
    return f"""{_rfm_base(best_is_high)}
    SELECT customer_id, recency_days, frequency, CAST(spent AS DOUBLE) AS monetary,
      r_score, f_score, m_score, r_score + f_score + m_score AS rfm_total_score,
      CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champion'
           WHEN r_score >= 3 AND f_score >= 3 THEN 'Loyal Customer'
           WHEN r_score >= 4 AND f_score < 3 THEN 'Recent Customer'
           WHEN r_score < 3 AND f_score >= 4 THEN 'At-Risk Loyal'
           ELSE 'Needs Attention' END AS customer_segment
    FROM scores ORDER BY rfm_total_score DESC, customer_id"""


def _violations(*checks: tuple[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS c, CAST(({count}) AS BIGINT) AS n" for name, count in checks
    )
    return f"""{ON_GOLD}
    SELECT c AS "check", CAST(0 AS DOUBLE) AS expected, CAST(n AS DOUBLE) AS actual, n = 0 AS passed
    FROM ({rows}) found"""


def _nulls(table: str, key: str) -> str:
    return f"SELECT count(*) FROM {table} WHERE {key} IS NULL"


def _repeats(dimension: str, key: str) -> str:
    return f"SELECT count(*) FROM (SELECT {key} FROM {dimension} GROUP BY 1 HAVING count(*) > 1) r"


def _orphans(dimension: str, key: str) -> str:
    return (
        f"SELECT count(*) FROM fact f WHERE f.{key} IS NOT NULL AND NOT EXISTS "
        f"(SELECT 1 FROM {dimension} d WHERE d.{key} = f.{key})"
    )


def _paired(*checks: tuple[str, str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS c, CAST(({e}) AS DECIMAL(38,2)) AS e, CAST(({a}) AS DECIMAL(38,2)) AS a"
        for name, e, a in checks
    )
    return f"""{ON_GOLD}
    SELECT c AS "check", CAST(e AS DOUBLE) AS expected, CAST(a AS DOUBLE) AS actual,
           e IS NOT DISTINCT FROM a AS passed
    FROM ({rows}) compared"""


_KEYS = (
    ("dim_customer", "Customer_ID"),
    ("dim_product", "Product_Key"),
    ("dim_geography", "Geo_Key"),
    ("dim_date", "Order_Date"),
)

_PREDICATES = {
    "is null": "Customer_Name IS NULL",
    "is not null": "Postal_Code IS NOT NULL",
    "in": "upper(trim(City)) IN ('NONE', '')",
    "like": "State LIKE 'CA-20%'",
    "=": "Category = 'Technlogy'",
    "<>": "Region <> 'ASIA'",
    "<": "CAST(Quantity AS INTEGER) < 10",
    "<=": "CAST(Quantity AS INTEGER) <= 10",
    ">": "CAST(Quantity AS INTEGER) > 40",
    ">=": "CAST(Quantity AS INTEGER) >= 40",
    "between": "CAST(Quantity AS INTEGER) BETWEEN 2 AND 4",
    "and": "CAST(Quantity AS INTEGER) > 25 AND Order_Date >= '1998-01-01'",
}

STATEMENTS: dict[str, str] = {
    # sources and layers
    "bronze_ingest": f"{ON_BRONZE} SELECT * FROM bronze",
    "silver_snapshot": f"{ON_BRONZE} SELECT * FROM bronze",
    "silver_sales": f"{ON_SILVER} SELECT {_DOUBLES} FROM silver",
    "dim_customer": f"{ON_GOLD} SELECT * FROM dim_customer",
    "dim_product": f"{ON_GOLD} SELECT * FROM dim_product",
    "dim_geography": f"{ON_GOLD} SELECT * FROM dim_geography",
    "dim_date": f"{ON_GOLD} SELECT * FROM dim_date",
    "fact_sales": f"{ON_GOLD} SELECT {_DOUBLES} FROM fact",
    # typing and repair
    "cast_types": _raw(
        """CAST(Order_Date AS DATE) AS Order_Date, CAST(Ship_Date AS DATE) AS Ship_Date,
        CAST(CAST(Sales AS DECIMAL(18,4)) AS DOUBLE) AS Sales,
        CAST(CAST(Profit AS DECIMAL(18,6)) AS DOUBLE) AS Profit,
        CAST(CAST(Discount AS DECIMAL(18,4)) AS DOUBLE) AS Discount,
        CAST(Quantity AS INTEGER) AS Quantity"""
    ),
    "postal_code_int": _raw("CAST(trunc(CAST(Postal_Code AS DOUBLE)) AS INTEGER) AS Postal_Code"),
    "fill_null_names": _raw(
        "CASE WHEN Customer_Name IS NULL THEN 'Unknown' ELSE Customer_Name END AS Customer_Name"
    ),
    "replace_sentinel_city": _raw(f"{_KNOWN} AS City"),
    "normalize_casing": _raw(f"{_cased(_KNOWN)} AS City, {_cased('State')} AS State"),
    "normalize_casing_idempotent": _raw(
        f"{_cased(_cased(_KNOWN))} AS City, {_cased(_cased('State'))} AS State"
    ),
    "detect_misplaced_state": _raw(f"{_cased(_KNOWN)} AS City, {_cased('State')} AS State")
    + f" WHERE {_cased('State')} LIKE 'Ca-20%'",
    "fix_misplaced_state": _raw(
        f"CASE WHEN {_cased('State')} = 'Ca-2015-108119' THEN 'Arkansas' ELSE {_cased('State')} END AS State"
    ),
    "fix_category_typos": _raw(f"{_TYPO} AS Category"),
    "filter_predicates": f"{ON_BRONZE} "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS predicate, CAST(count(*) AS BIGINT) AS n FROM bronze WHERE {condition}"
        for name, condition in _PREDICATES.items()
    ),
    # distinct and dedup
    "distinct_categories": f"{ON_BRONZE} SELECT DISTINCT {_TYPO} AS Category FROM bronze",
    "distinct_customer_years": f"{ON_GOLD}, {_YEARS} SELECT * FROM active",
    "dedup_orders": f"{ON_REPAIRED} SELECT {_DOUBLES} FROM (SELECT * EXCLUDE (rn) FROM numbered WHERE rn = 1) t",
    "duplicate_preview": f"{ON_REPAIRED} SELECT {_DOUBLES} FROM numbered",
    # joins, aggregates, windows, functions
    "self_join_next_year": f"""{ON_GOLD}, {_YEARS}
    SELECT a.customer_id, a.current_yr, b.customer_id AS repeated_id
    FROM active a LEFT JOIN active b ON b.customer_id = a.customer_id AND b.current_yr = a.current_yr + 1""",
    "scalar_subquery": f"""{ON_GOLD}
    SELECT Order_ID, Product_ID, Order_Date, CAST(Sales AS DOUBLE) AS Sales,
      {_money('(SELECT sum(Sales) FROM fact)')} AS all_sales
    FROM fact WHERE Order_Date = (SELECT max(Order_Date) FROM fact)""",
    "case_tiers": f"{ON_GOLD}, {_TIERS} SELECT * FROM tiers",
    "agg_basic": f"""{ON_GOLD}
    SELECT CAST(year(Order_Date) AS INTEGER) AS yr, {_money('sum(Sales)')} AS total_sales,
      {_money('sum(Profit)')} AS total_profit, {_avg('sum(Profit)', 'count(Profit)')} AS avg_profit,
      count(*) AS line_count, count(Geo_Key) AS placed_lines, min(Order_Date) AS first_day,
      max(Order_Date) AS last_day, CAST(min(Sales) AS DOUBLE) AS smallest_sale,
      CAST(max(Sales) AS DOUBLE) AS largest_sale
    FROM fact GROUP BY 1""",
    "agg_count_distinct": f"{ON_SILVER} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n FROM silver"
        for c in ("Order_ID", "Customer_ID", "City", "State", "Order_Date")
    ),
    "monthly_sales": f"""{ON_GOLD}, {_MONTHS}
    SELECT yr, month_name, month_end, CAST(total AS DOUBLE) AS monthly_sales FROM months""",
    "rank_months": f"""{ON_GOLD}, {_MONTHS}
    SELECT yr, month_name, month_end, CAST(total AS DOUBLE) AS monthly_sales, rnk FROM ranked""",
    "topk_months_per_year": f"""{ON_GOLD}, {_MONTHS}
    SELECT yr, month_name, month_end, CAST(total AS DOUBLE) AS monthly_sales, rnk
    FROM ranked WHERE rnk <= 4""",
    "surrogate_keys": f"""{ON_GOLD}
    SELECT 'product' AS dimension, Product_ID AS member, Product_Key AS surrogate_key FROM dim_product
    UNION ALL
    SELECT 'geography', coalesce(Country, '?') || '|' || coalesce(State, '?') || '|' ||
      coalesce(City, '?') || '|' || coalesce(Region, '?'), Geo_Key FROM dim_geography""",
    "rfm_scores": f"{_rfm_base(False)} SELECT customer_id, r_score, f_score, m_score FROM scores",
    "running_sum_range": f"""{ON_GOLD}, {_SPEND}
    SELECT customer_id, CAST(spent AS DOUBLE) AS sale_per_cust,
      {_money('sum(spent) OVER (ORDER BY spent DESC NULLS LAST)')} AS running_total
    FROM spend""",
    "share_of_total": f"""{ON_GOLD}, {_SPEND}
    SELECT customer_id, {_money('spent')} AS sale_per_cust, {_money('sum(spent) OVER ()')} AS total_sales,
      {_pct(_ratio('spent', '(SELECT sum(Sales) FROM fact)'))} AS share_pct
    FROM spend""",
    "scalar_strings": _raw(
        f"""City, upper(City) AS upper_city, lower(City) AS lower_city, left(City, 6) AS left_city,
        substr(City, 2) AS rest_of_city, CAST(length(rtrim(City)) AS INTEGER) AS city_length,
        trim(City) AS trimmed_city, {_cased('City')} || ', ' || Postal_Code AS place"""
    ),
    "scalar_dates": f"""{ON_SILVER}
    SELECT Order_ID, Product_ID, CAST(year(Order_Date) AS INTEGER) AS order_year,
      CAST(month(Order_Date) AS INTEGER) AS order_month, monthname(Order_Date) AS order_month_name,
      last_day(Order_Date) AS order_month_end,
      CAST(date_diff('day', Order_Date, Ship_Date) AS INTEGER) AS days_to_ship
    FROM silver""",
    "scalar_math": f"""{ON_SILVER}
    SELECT Order_ID, Product_ID, {_money('Sales')} AS rounded_sales,
      pow(CAST(Discount AS DOUBLE) + 1, 2) AS discount_factor_squared,
      CAST(Quantity AS DOUBLE) / 7 AS weeks_of_stock, CAST(Quantity AS DOUBLE) * 100 AS quantity_times_100
    FROM silver""",
    "percent_format": f"""{ON_SILVER}
    SELECT Order_ID, Product_ID, {_ratio('Profit', 'Sales')} AS margin,
      {_pct(_ratio('Profit', 'Sales'))} AS margin_pct, {_pct(_ratio('Quantity', '50'))} AS quantity_pct,
      {_pct('NULLIF(CAST(Discount AS DOUBLE), 0)')} AS discount_pct
    FROM silver""",
    # data quality
    "check_not_null": _violations(
        *[(f"{t}.{k} not null", _nulls(t, k)) for t, k in _KEYS],
        *[(f"fact_sales.{k} not null", _nulls("fact", k)) for _, k in _KEYS],
    ),
    "check_null_fks": _violations(
        ("null_geo_keys", _nulls("fact", "Geo_Key")),
        ("null_product_keys", _nulls("fact", "Product_Key")),
        ("null_customer_ids", _nulls("fact", "Customer_ID")),
        ("null_order_dates", _nulls("fact", "Order_Date")),
    ),
    "check_key_types": f"{ON_GOLD} SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT 'fact_sales.{k} type' AS "check",
          (SELECT any_value(replace(lower(typeof({k})), 'varchar', 'string')) FROM {t}) AS expected,
          replace(lower(typeof({k})), 'varchar', 'string') AS actual, count(*) AS rows_checked,
          lower(typeof({k})) = (SELECT any_value(lower(typeof({k}))) FROM {t}) AS passed
        FROM fact GROUP BY ALL"""
        for t, k in _KEYS
    )
    + ") types",
    "check_primary_keys": _violations(*[(f"{t}.{k} unique", _repeats(t, k)) for t, k in _KEYS]),
    "check_foreign_keys": _violations(
        *[(f"fact_sales.{k} in {t}", _orphans(t, k)) for t, k in _KEYS]
    ),
    "reconcile_counts": _paired(
        ("rows", "SELECT count(*) FROM silver", "SELECT count(*) FROM fact")
    ),
    "reconcile_totals": _paired(
        ("total_sales", "SELECT round(sum(Sales), 2) FROM silver", "SELECT round(sum(Sales), 2) FROM fact"),
        ("total_profit", "SELECT round(sum(Profit), 2) FROM silver", "SELECT round(sum(Profit), 2) FROM fact"),
    ),
    "reconcile_orders": _paired(
        ("orders", "SELECT count(DISTINCT Order_ID) FROM silver", "SELECT count(DISTINCT Order_ID) FROM fact")
    ),
    "dimension_counts": f"{ON_GOLD} "
    + " UNION ALL ".join(f"SELECT '{t}' AS dimension, count(*) AS row_count FROM {t}" for t, _ in _KEYS),
    "crosscheck_dimensions": _paired(
        *[
            (f"{t} rows", f"SELECT count(DISTINCT {c}) FROM silver", f"SELECT count(*) FROM {t}")
            for t, c in (
                ("dim_customer", "Customer_ID"),
                ("dim_product", "Product_ID"),
                ("dim_date", "Order_Date"),
            )
        ]
    ),
    "profile_silver": f"{ON_SILVER} SELECT measure, CAST(value AS BIGINT) AS value FROM ("
    + " UNION ALL ".join(
        f"SELECT '{measure}' AS measure, ({count}) AS value"
        for measure, count in (
            ("raw_rows", "SELECT count(*) FROM bronze"),
            ("null_customer_names", "SELECT count(*) FROM bronze WHERE Customer_Name IS NULL"),
            ("missing_cities", "SELECT count(*) FROM bronze WHERE upper(trim(City)) IN ('NONE', '')"),
            ("misplaced_states", "SELECT count(*) FROM cased WHERE cased_state LIKE 'Ca-20%'"),
            ("misspelt_categories",
             "SELECT count(*) FROM bronze WHERE Category IN ('Technlogy', 'Furnture')"),
            ("null_postal_codes", "SELECT count(*) FROM bronze WHERE Postal_Code IS NULL"),
            ("clean_rows", "SELECT count(*) FROM silver"),
            ("distinct_cities", "SELECT count(DISTINCT City) FROM repaired"),
            ("distinct_states_before_fix", "SELECT count(DISTINCT cased_state) FROM cased"),
            ("distinct_states", "SELECT count(DISTINCT State) FROM repaired"),
            ("distinct_categories", "SELECT count(DISTINCT Category) FROM repaired"),
        )
    )
    + ") profile",
    # analyses
    "kpi_summary": f"""{ON_GOLD}
    SELECT {_money('sum(Sales)')} AS total_sales, {_money('sum(Profit)')} AS total_profit,
      {_pct(_ratio('sum(Profit)', 'sum(Sales)'))} AS profit_margin_pct,
      {_avg('sum(Sales)', 'count(DISTINCT Order_ID)')} AS avg_order_value
    FROM fact""",
    "region_performance": f"""{ON_GOLD},
    regional AS (
      SELECT Region, round(sum(Sales), 2) AS s, round(sum(Profit), 2) AS p
      FROM fact JOIN dim_geography USING (Geo_Key) GROUP BY Region
    ),
    everything AS (SELECT round(sum(Sales), 2) AS t FROM fact)
    SELECT Region AS region, CAST(s AS DOUBLE) AS sales_by_region, CAST(p AS DOUBLE) AS profit_by_region,
      CAST(t AS DOUBLE) AS total_sales, {_pct(_ratio('s', 't'))} AS sales_contribution_pct,
      {_pct(_ratio('p', 's'))} AS profit_margin_pct
    FROM regional, everything""",
    "category_performance": f"""{ON_GOLD}
    SELECT Category AS category, {_avg('sum(Profit)', 'count(Profit)')} AS avg_profit,
      {_money('sum(Profit)')} AS total_profit, {_money('sum(Sales)')} AS total_sales,
      count(DISTINCT Order_ID) AS total_orders
    FROM fact JOIN dim_product USING (Product_Key) GROUP BY Category ORDER BY total_sales DESC""",
    "segment_performance": f"""{ON_GOLD}
    SELECT Segment AS segment, {_money('sum(Sales)')} AS total_sales, {_money('sum(Profit)')} AS total_profit,
      {_pct(_ratio('sum(Profit)', 'sum(Sales)'))} AS profit_margin_pct,
      count(DISTINCT Order_ID) AS total_orders, count(DISTINCT Customer_ID) AS total_customers
    FROM fact JOIN dim_customer USING (Customer_ID) GROUP BY Segment ORDER BY total_sales DESC""",
    "yoy_growth": f"""{ON_GOLD}, {_YEARLY},
    paired AS (
      SELECT now.yr, now.s, now.p, prev.s AS ps, prev.p AS pp
      FROM yearly now LEFT JOIN yearly prev
        ON prev.yr = (SELECT max(e.yr) FROM yearly e WHERE e.yr < now.yr)
    )
    SELECT yr, {_money('s')} AS total_sales, {_money('p')} AS total_profit, {_money('ps')} AS prev_yr_sales,
      {_money('pp')} AS prev_yr_profit, {_pct(_ratio('s - ps', 'ps'))} AS sales_growth_pct,
      {_pct(_ratio('p - pp', 'pp'))} AS profit_growth_pct
    FROM paired ORDER BY yr""",
    "cagr": f"""{ON_GOLD}, {_YEARLY},
    ends AS (SELECT arg_min(s, yr) AS a, arg_max(s, yr) AS b, max(yr) - min(yr) AS t FROM yearly)
    SELECT {_pct(f"pow({_ratio('b', 'a')}, {_ratio('1', 't')}) - 1")} AS cagr_pct FROM ends""",
    "peak_season": f"""{ON_GOLD}, {_MONTHS}
    SELECT month_name, count(*) AS peak_frequency, {_avg('sum(total)', 'count(*)')} AS avg_peak_sales
    FROM ranked WHERE rnk <= 4 GROUP BY month_name ORDER BY peak_frequency DESC, avg_peak_sales DESC""",
    "customer_frequency_tiers": f"""{ON_GOLD}, {_TIERS}
    SELECT customer_type, count(*) AS customer_count,
      {_pct(_ratio('count(*)', '(SELECT count(*) FROM tiers)'))} AS pct_of_total
    FROM tiers GROUP BY customer_type ORDER BY customer_count DESC""",
    "top_pct_customers": f"""{ON_GOLD}, {_SPEND},
    hundredths AS (
      SELECT customer_id, round(spent, 2) AS spent,
        CAST(ntile(100) OVER (ORDER BY round(spent, 2) DESC NULLS LAST, customer_id NULLS FIRST) AS INTEGER)
          AS percentile_rank
      FROM spend
    )
    SELECT h.customer_id, c.Customer_Name AS customer_name, CAST(spent AS DOUBLE) AS total_spent,
      percentile_rank
    FROM hundredths h JOIN dim_customer c ON c.Customer_ID = h.customer_id
    WHERE percentile_rank <= 5 ORDER BY total_spent DESC""",
    "running_total_by_category": f"""{ON_GOLD}
    SELECT Category AS category, f.Order_Date AS order_date, f.Order_ID AS order_id,
      {_money('f.Sales')} AS order_sales,
      {_money('''sum(f.Sales) OVER (PARTITION BY Category
          ORDER BY f.Order_Date NULLS FIRST, f.Order_ID NULLS FIRST, f.Product_ID NULLS FIRST
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)''')} AS running_total_sales
    FROM fact f JOIN dim_product p ON p.Product_Key = f.Product_Key
    ORDER BY category, order_date""",
    "pareto_customers": _pareto("Customer_ID", "dim_customer", "customer_pct_driving_80_pct_revenue"),
    "pareto_products": _pareto("Product_ID", "dim_product", "product_pct_driving_80_pct_revenue"),
    "yoy_churn": f"""{ON_GOLD}, {_YEARS},
    counted AS (
      SELECT a.current_yr, count(a.customer_id) AS total, count(b.customer_id) AS kept
      FROM active a
      LEFT JOIN active b ON b.customer_id = a.customer_id AND b.current_yr = a.current_yr + 1
      WHERE a.current_yr <> (SELECT max(current_yr) FROM active)
      GROUP BY a.current_yr
    )
    SELECT current_yr, total AS total_customers, kept AS retained_customers,
      total - kept AS churned_customers, {_pct(_ratio('total - kept', 'total'))} AS churn_rate
    FROM counted ORDER BY current_yr""",
    "segment_margin_yoy": f"""{ON_GOLD},
    margins AS (
      SELECT CAST(year(f.Order_Date) AS INTEGER) AS yr, c.Segment AS segment, sum(Sales) AS s,
        sum(Profit) AS p, {_ratio('sum(Profit)', 'sum(Sales)')} AS m
      FROM fact f JOIN dim_customer c ON c.Customer_ID = f.Customer_ID GROUP BY 1, 2
    ),
    moved AS (SELECT *, lag(m) OVER (PARTITION BY segment ORDER BY yr) AS before FROM margins)
    SELECT yr, segment, {_money('s')} AS total_sales, {_money('p')} AS total_profit,
      {_pct('m')} AS profit_margin_pct, {_pct('before')} AS prev_yr_margin_pct
    FROM moved ORDER BY segment, yr""",
    "rfm": _rfm(False),
    "rfm_corrected": _rfm(True),
    "subcategory_profitability": f"""{ON_GOLD},
    grouped AS (
      SELECT Category AS category, Sub_Category AS sub_category, sum(Sales) AS s, sum(Profit) AS p,
        count(DISTINCT Order_ID) AS total_orders, {_ratio('sum(Profit)', 'sum(Sales)')} AS m
      FROM fact JOIN dim_product USING (Product_Key) GROUP BY 1, 2
    )
    SELECT category, sub_category, {_money('s')} AS total_sales, {_money('p')} AS total_profit,
      {_pct('m')} AS profit_margin_pct, total_orders,
      CASE WHEN p < 0 THEN 'Loss-Making' WHEN m * 100 < 10 THEN 'Low Margin'
           WHEN m * 100 < 25 THEN 'Moderate Margin' WHEN m IS NOT NULL THEN 'High Margin' END
        AS margin_category
    FROM grouped ORDER BY total_profit DESC""",
}

# All pass/fail checks on figures, one after the other.
STATEMENTS["all_checks"] = " UNION ALL ".join(
    f"SELECT * FROM ({STATEMENTS[name]})"
    for name in (
        "check_not_null", "check_null_fks", "check_primary_keys", "check_foreign_keys",
        "reconcile_counts", "reconcile_totals", "reconcile_orders", "crosscheck_dimensions",
    )
)
