"""Constraints and reconciliations as reports: check, expected, actual, passed.

Parquet tables take no PRIMARY KEY, FOREIGN KEY or NOT NULL, so each constraint is a query that
counts what would violate it. Comparisons are made on exact values, shown as doubles.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, functions as F

from tallyhouse.plans import silver as cleaning
from tallyhouse.sources.shared import in_share, share_count

if TYPE_CHECKING:
    from tallyhouse.plans.warehouse import Warehouse

    Tables = Mapping[str, DataFrame] | Warehouse

# Primary keys of the dimensions and what the fact table refers to.
KEYS = {
    "dim_customer": "Customer_ID",
    "dim_product": "Product_Key",
    "dim_geography": "Geo_Key",
    "dim_date": "Order_Date",
}
# Names of the four audits.
NULL_AUDITS = {
    "null_geo_keys": "Geo_Key",
    "null_product_keys": "Product_Key",
    "null_customer_ids": "Customer_ID",
    "null_order_dates": "Order_Date",
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rows(one_row: DataFrame, values: dict[str, Column], key: str, value: str) -> DataFrame:
    """Turn a one-row aggregate into one row per named value."""
    pairs = [F.struct(F.lit(n).alias(key), v.alias(value)) for n, v in values.items()]
    return one_row.select(F.inline(F.array(*pairs)))


def _zero_expected(counts: DataFrame) -> DataFrame:
    return counts.select(
        "check",
        F.lit(0.0).alias("expected"),
        F.col("actual").cast("double").alias("actual"),
        (F.col("actual") == 0).alias("passed"),
    )


def _count_nulls(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    nulls = table.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns.values()])
    return _rows(nulls, {n: F.col(c) for n, c in columns.items()}, "check", "actual")


def check_not_null(tables: Tables) -> DataFrame:
    """NULLs in dimension keys and in the keys the fact table refers to them with."""
    parts = [_count_nulls(tables[t], {f"{t}.{k} not null": k}) for t, k in KEYS.items()]
    fact_keys = {f"fact_sales.{k} not null": k for k in KEYS.values()}
    parts.append(_count_nulls(tables["fact_sales"], fact_keys))
    return _zero_expected(_union(parts))


def check_null_fks(tables: Tables) -> DataFrame:
    return _zero_expected(_count_nulls(tables["fact_sales"], NULL_AUDITS))


def check_key_types(tables: Tables) -> DataFrame:
    """Type of each fact key against the dimension key; one row per key, also for an empty fact."""
    fact = tables["fact_sales"]

    def one(dimension: str, key: str) -> Column:
        expected = tables[dimension].schema[key].dataType.simpleString()
        actual = fact.schema[key].dataType.simpleString()
        return F.struct(
            F.lit(f"fact_sales.{key} type").alias("check"),
            F.lit(expected).alias("expected"),
            F.lit(actual).alias("actual"),
            F.col("rows_checked"),
            F.lit(actual == expected).alias("passed"),
        )

    checked = fact.agg(F.count(F.lit(1)).alias("rows_checked"))
    return checked.select(F.inline(F.array(*[one(t, k) for t, k in KEYS.items()])))


def check_primary_keys(tables: Tables) -> DataFrame:
    """Key values that occur more than once."""

    def one(dimension: str, key: str) -> DataFrame:
        repeated = tables[dimension].groupBy(key).count().filter("count > 1")
        return repeated.agg(F.count(F.lit(1)).alias("actual")).select(
            F.lit(f"{dimension}.{key} unique").alias("check"), "actual"
        )

    return _zero_expected(_union([one(t, k) for t, k in KEYS.items()]))


def check_foreign_keys(tables: Tables) -> DataFrame:
    """Fact rows whose key is missing from the dimension; NULL keys are left to the NULL checks.

    The fact side is counted per key first, so a hot key reaches the join as one row."""

    def one(dimension: str, key: str) -> DataFrame:
        used = tables["fact_sales"].filter(F.col(key).isNotNull()).groupBy(key).count()
        orphans = used.join(tables[dimension].select(key), key, "left_anti")
        return orphans.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("actual")).select(
            F.lit(f"fact_sales.{key} in {dimension}").alias("check"), "actual"
        )

    return _zero_expected(_union([one(t, k) for t, k in KEYS.items()]))


def _compared(expected: DataFrame, actual: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Two one-row aggregates with equal columns; ``checks`` maps check names to columns."""
    left = _rows(expected, {n: F.col(c) for n, c in checks.items()}, "check", "expected")
    right = _rows(actual, {n: F.col(c) for n, c in checks.items()}, "check", "actual")
    return left.join(right, "check").select(
        "check",
        F.col("expected").cast("double").alias("expected"),
        F.col("actual").cast("double").alias("actual"),
        F.col("expected").eqNullSafe(F.col("actual")).alias("passed"),
    )


def reconcile_counts(tables: Tables) -> DataFrame:
    def count(t: str) -> DataFrame:
        return tables[t].agg(F.count(F.lit(1)).alias("n"))

    return _compared(count("silver"), count("fact_sales"), {"rows": "n"})


def reconcile_totals(tables: Tables) -> DataFrame:
    def sums(t: str) -> DataFrame:
        wide = "decimal(38,2)"
        return tables[t].agg(
            F.round(F.sum("Sales"), 2).cast(wide).alias("s"),
            F.round(F.sum("Profit"), 2).cast(wide).alias("p"),
        )

    return _compared(sums("silver"), sums("fact_sales"), {"total_sales": "s", "total_profit": "p"})


def reconcile_orders(tables: Tables) -> DataFrame:
    def orders(t: str) -> DataFrame:
        return tables[t].agg(F.count_distinct("Order_ID").alias("n"))

    return _compared(orders("silver"), orders("fact_sales"), {"orders": "n"})


def dimension_counts(tables: Tables, expected: Mapping[str, int] | None = None) -> DataFrame:
    """Rows per dimension; with ``expected`` counts a check of those dimensions."""
    if expected is not None:
        counted = [
            tables[t].agg(F.count(F.lit(1)).alias("actual")).select(
                F.lit(f"{t} expected rows").alias("check"),
                F.lit(float(n)).alias("expected"),
                F.col("actual").cast("double").alias("actual"),
                (F.col("actual") == n).alias("passed"),
            )
            for t, n in expected.items()
        ]
        return _union(counted)

    def count(t: str) -> DataFrame:
        return tables[t].agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(t).alias("dimension"), "row_count"
        )

    return _union([count(t) for t in KEYS])


def crosscheck_dimensions(tables: Tables) -> DataFrame:
    """Distinct values in silver against dimension rows. One distinct count per pass: each reads a
    single column, where a combined one would multiply the rows."""

    def one(dimension: str, column: str) -> DataFrame:
        distinct = tables["silver"].agg(F.count_distinct(column).alias("n"))
        rows = tables[dimension].agg(F.count(F.lit(1)).alias("n"))
        return _compared(distinct, rows, {f"{dimension} rows": "n"})

    return _union(
        [
            one("dim_customer", "Customer_ID"),
            one("dim_product", "Product_ID"),
            one("dim_date", "Order_Date"),
        ]
    )


# Which columns of silver and of the fact table are tallied beside the dimension keys, and the
# dimensions whose rows must be the distinct values of a column of silver.
_ORDERS = "Order_ID"
_MEMBERS = {"dim_customer": "Customer_ID", "dim_product": "Product_ID", "dim_date": "Order_Date"}
_AMOUNTS = ("Sales", "Profit")
# In how many shares of the values at most a large warehouse is tallied.
TALLY_SHARES = 2


def _tally(tables: Tables, share: tuple[int, int] = (0, 1)) -> DataFrame:
    """kind, value, and the rows with that value in the column ``kind``: of its dimension, of silver and of the fact.

    Every table is read once. A row becomes one short row per tallied column, which are counted where
    they are read, so a hot value reaches the shuffle as one row per task. Amounts are kinds of their own,
    one per table, so a task sends one row of them. ``share`` (which, of how many) takes a part of the values."""
    kinds = {t: [k] for t, k in KEYS.items()}
    kinds["silver"] = [_ORDERS, *_MEMBERS.values()]
    kinds["fact_sales"] = [_ORDERS, *KEYS.values()]

    def one(table: str) -> DataFrame:
        def item(kind: str, value: Column, amounts: bool) -> Column:
            sums = [F.when(F.lit(amounts), F.col(a)).alias(a) for a in _AMOUNTS if table not in KEYS]
            return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), *sums)

        items = [item(k, F.col(k), False) for k in kinds[table]]
        if table not in KEYS:
            items.append(item(table, F.lit(None), True))
        return tables[table].select(F.inline(F.array(*items))).withColumn("table", F.lit(table))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(t) for t in kinds])
    if share[1] > 1:
        rows = rows.filter(in_share(*share, ["kind", "value"]))
    table = F.col("table")
    here = {"dimension": table.isin(*KEYS), "silver": table == "silver", "fact_sales": table == "fact_sales"}
    counts = [F.count_if(c).alias(n) for n, c in here.items()]
    return rows.groupBy("kind", "value").agg(*counts, *[F.sum(a).alias(a) for a in _AMOUNTS])


def _figures(tally: DataFrame) -> tuple[DataFrame, dict[str, tuple[str, str | None]]]:
    """One row of figures, and per check the figure that is expected (none: zero) and the actual one."""
    known = F.col("value").isNotNull()
    figures: dict[str, Column] = {}
    checks: dict[str, tuple[str, str | None]] = {}

    def total(rows: str, condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col(rows))), F.lit(0))

    def add(check: str, actual: Column, expected: Column | None = None) -> None:
        at = len(checks)
        figures[f"actual_{at}"] = actual
        if expected is not None:
            figures[f"expected_{at}"] = expected
        checks[check] = (f"actual_{at}", None if expected is None else f"expected_{at}")

    for table, key in KEYS.items():
        kind = F.col("kind") == key
        add(f"{table}.{key} not null", total("dimension", kind & ~known))
        add(f"fact_sales.{key} not null", total("fact_sales", kind & ~known))
        add(f"{table}.{key} unique", F.count_if(kind & (F.col("dimension") > 1)))
        add(f"fact_sales.{key} in {table}", total("fact_sales", kind & known & (F.col("dimension") == 0)))
    for audit, key in NULL_AUDITS.items():
        add(audit, total("fact_sales", (F.col("kind") == key) & ~known))
    orders = F.col("kind") == _ORDERS
    add("rows", total("fact_sales", orders), total("silver", orders))
    for amount in _AMOUNTS:
        silver, fact = (
            F.round(F.sum(F.when(F.col("kind") == t, F.col(amount))), 2).cast("decimal(38,2)")
            for t in ("silver", "fact_sales")
        )
        add(f"total_{amount.lower()}", fact, silver)
    add("orders", *[F.count_if(orders & known & (F.col(t) > 0)) for t in ("fact_sales", "silver")])
    for table, column in _MEMBERS.items():
        distinct = F.count_if((F.col("kind") == column) & known & (F.col("silver") > 0))
        add(f"{table} rows", total("dimension", F.col("kind") == KEYS[table]), distinct)
    for table, key in KEYS.items():
        figures[table] = total("dimension", F.col("kind") == key)
    return tally.agg(*[v.alias(n) for n, v in figures.items()]), checks


def _all_figures(tables: Tables) -> tuple[DataFrame, dict[str, tuple[str, str | None]]]:
    """``_figures`` of all values. Over a large warehouse they are counted in shares of the values, one after
    the other, so that the disk never holds shuffle files of all; every figure is a sum over values."""
    folder = getattr(tables, "folder", None)
    n = 1 if folder is None else share_count(TALLY_SHARES, tables["silver"], tables["fact_sales"])
    if n == 1:
        return _figures(_tally(tables))
    parts = [_figures(_tally(tables, (i, n))) for i in range(n)]
    kept = _union([folder.keep(figures, "figures") for figures, _ in parts])
    sums = [F.sum(f.name).cast(f.dataType).alias(f.name) for f in kept.schema]
    return kept.agg(*sums), parts[0][1]


def _judged(check: str, actual: str, expected: str | None, shown: str) -> Column:
    wanted = F.lit(0) if expected is None else F.col(expected)
    return F.struct(
        F.lit(check).alias("check"),
        wanted.cast("double").cast(shown).alias("expected"),
        F.col(actual).cast("double").cast(shown).alias("actual"),
        wanted.eqNullSafe(F.col(actual)).alias("passed"),
    )


def all_checks(tables: Tables) -> DataFrame:
    """Constraints and reconciliations, all figures from one tally of key values: each table is read
    once (a large warehouse once per share of the values), and no join is needed to find what a dimension lacks."""
    figures, checks = _all_figures(tables)
    return figures.select(F.inline(F.array(*[_judged(c, a, e, "double") for c, (a, e) in checks.items()])))


def quality_report(tables: Tables, expected_rows: Mapping[str, int] | None = None) -> DataFrame:
    """Every pass/fail check in one table; ``expected_rows`` per dimension are checked if given."""
    figures, checks = _all_figures(tables)
    rows = [_judged(c, a, e, "string") for c, (a, e) in checks.items()]

    def row(check: str, expected: Column, actual: Column) -> Column:
        told = {"expected": expected, "actual": actual}
        return F.struct(
            F.lit(check).alias("check"),
            *[v.cast("string").alias(n) for n, v in told.items()],
            expected.eqNullSafe(actual).alias("passed"),
        )

    for table, key in KEYS.items():
        types = [tables[t].schema[key].dataType.simpleString() for t in (table, "fact_sales")]
        rows.append(row(f"fact_sales.{key} type", *map(F.lit, types)))
    for table, n in (expected_rows or {}).items():
        rows.append(row(f"{table} expected rows", F.lit(float(n)), F.col(table).cast("double")))
    return figures.select(F.inline(F.array(*rows)))


def profile_silver(tables: Tables) -> DataFrame:
    """The audits around cleaning: what was found in bronze and what is left in silver.

    Bronze is read once: its lines are counted per place and category, of which there are few, and
    the distinct values are counted among those groups."""
    counts = {
        "raw_rows": F.lit(True),
        "null_customer_names": F.col("Customer_Name").isNull(),
        "missing_cities": F.upper(F.trim("City")).isin(*cleaning.MISSING_CITY),
        "misplaced_states": cleaning.cased_state().like(cleaning.MISPLACED_STATE),
        "misspelt_categories": F.col("Category").isin(*cleaning.CATEGORY_CORRECTIONS),
        "null_postal_codes": F.col("Postal_Code").isNull(),
    }
    values = {
        "distinct_cities": cleaning.city(),
        "distinct_states_before_fix": cleaning.cased_state(),
        "distinct_states": cleaning.state(),
        "distinct_categories": cleaning.category(),
    }
    groups = tables["bronze"].groupBy(*[v.alias(n) for n, v in values.items()]).agg(
        *[F.count_if(c).alias(n) for n, c in counts.items()]
    )
    found = groups.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts],
        *[F.count_distinct(n).alias(n) for n in values],
    )
    left = tables["silver"].agg(F.count(F.lit(1)).alias("clean_rows"))
    return _rows(found, {c: F.col(c) for c in found.columns}, "measure", "value").unionByName(
        _rows(left, {"clean_rows": F.col("clean_rows")}, "measure", "value")
    )
