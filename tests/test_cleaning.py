"""Cleaning rules on hand-made rows."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyhouse.functions import average, days_between, money, percent, ratio, sentence_case, text_length
from tallyhouse.plans import gold, silver as S
from tallyhouse.sources.raw_csv import RAW_COLUMNS, raw_schema, read_raw, write_raw

GOOD = {
    "Order_ID": "O1", "Order_Date": "2016-11-08", "Ship_Date": "2016-11-11", "Customer_ID": "C1",
    "Customer_Name": "Ann", "Segment": "Consumer", "Country": "X", "City": "NEW YORK",
    "State": "new york", "Postal_Code": "10001.0", "Region": "East", "Product_ID": "P1",
    "Category": "Technology", "Sub_Category": "Phones", "Product_Name": "Phone", "Sales": "10.5",
    "Quantity": "2", "Discount": "0.2", "Profit": "1.25",
}


def raw(spark, *changes):
    return spark.createDataFrame([[{**GOOD, **c}[n] for n in RAW_COLUMNS] for c in changes], raw_schema())


def column(df, name):
    return [r[0] for r in df.select(name).collect()]


def one(spark, expression):
    return spark.range(1).select(expression).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [("NEW YORK", "New york"), (" san francisco ", "San francisco"), ("x", "X"), ("", ""),
     (None, None), ("\tABC", "\tabc"), ("o'NEILL-éÀ", "O'neill-éà")],
)
def test_sentence_case(spark, text, expected):
    value = F.lit(text).cast("string")
    assert one(spark, sentence_case(value)) == expected
    assert one(spark, sentence_case(sentence_case(value))) == expected


@pytest.mark.parametrize(
    "value, expected",
    [(0.1163, "11.63%"), (-0.0740, "-7.40%"), (0.00125, "0.13%"), (0.01005, "1.01%"),
     (12.345678, "1,234.57%"), (0.0, "0.00%"), (-0.00001, "0.00%"), (None, None)],
)
def test_percent(spark, value, expected):
    assert one(spark, percent(F.lit(value).cast("double"))) == expected


def test_numbers_and_dates(spark):
    assert one(spark, money(F.lit("2.345").cast("decimal(18,4)"))) == 2.35
    assert one(spark, money(F.lit("-2.345").cast("decimal(18,4)"))) == -2.35
    assert one(spark, ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, average(F.lit("0.02").cast("decimal(18,4)"), F.lit(8))) == 0.0
    assert one(spark, average(F.lit("0.04").cast("decimal(18,4)"), F.lit(8))) == 0.01
    day = lambda s: F.lit(s).cast("date")
    assert one(spark, days_between(day("2016-01-01"), day("2016-01-11"))) == 10
    assert one(spark, days_between(day("2016-01-11"), day("2016-01-01"))) == -10
    assert one(spark, text_length(F.lit("ab  "))) == 2


def test_city_and_state(spark):
    rows = raw(spark, {"City": "NONE"}, {"City": " none "}, {"City": ""}, {"City": None},
               {"City": " LOS angeles"}, {"State": "CA-2015-108119"}, {"State": "CA-2015-999"})
    clean = S.repaired(rows)
    assert column(clean, "City") == ["Unknown"] * 3 + [None, "Los angeles", "New york", "New york"]
    assert column(clean, "State")[5:] == ["Arkansas", "Ca-2015-999"]


def test_category_name_and_types(spark):
    rows = raw(spark, {"Category": "Technlogy"}, {"Category": "Furnture"}, {"Category": "technlogy"},
               {"Customer_Name": None})
    clean = S.repaired(rows)
    assert column(clean, "Category") == ["Technology", "Furniture", "technlogy", "Technology"]
    assert column(clean, "Customer_Name")[3] == "Unknown"
    first = clean.first()
    assert first.Order_Date == datetime.date(2016, 11, 8) and first.Quantity == 2
    assert first.Sales == Decimal("10.5") and first.Postal_Code == 10001


def test_two_date_spellings(spark):
    rows = raw(spark, {"Order_Date": "11/8/2016"}, {"Order_Date": "2016-11-08"}, {"Order_Date": None})
    assert column(S.repaired(rows), "Order_Date") == [datetime.date(2016, 11, 8)] * 2 + [None]


@pytest.mark.parametrize(
    "change",
    [
        {"Postal_Code": "bad"}, {"Postal_Code": "1e12"}, {"Postal_Code": "NaN"}, {"Postal_Code": "99999999999.0"},
        {"Postal_Code": "5d"}, {"Postal_Code": "1e3"}, {"Postal_Code": "5f"}, {"Postal_Code": "."}, {"Postal_Code": ""},
        {"Sales": "x"}, {"Sales": "5d"}, {"Sales": "0x10"}, {"Quantity": "2L"},
        {"Order_Date": "2016"}, {"Order_Date": "2016-11"}, {"Order_Date": "2016-11-08Tgarbage"}, {"Order_Date": "2016-11-08 25:99"},
        {"Order_Date": "+2016-1-1"}, {"Order_Date": "2016-02-30"}, {"Order_Date": "13/45/2016"}, {"Order_Date": "11/8/16"},
        {"Order_Date": "11/8/2016 x"}, {"Order_Date": "2016-11-08\n2017-01-01"}, {"Sales": "1.23456789"}, {"Profit": "-0.1234567"},
        {"Discount": "0.00001"}, {"Quantity": "2.5"}, {"Order_Date": "soon"},
    ],
)
def test_bad_value_fails_or_is_set_aside(spark, change):
    rows = raw(spark, {}, change)
    with pytest.raises(Exception, match="is not a valid"):
        S.repaired(rows).collect()
    good, rejected = S.castable(rows)
    assert good.count() == 1 and S.repaired(good).count() == 1
    assert rejected.first().failed_columns == list(change)


@pytest.mark.parametrize("text", ["10001.5", "10001.0", "10001.", " 10001 ", "-3.99", "+7", "0.9", "007"])
def test_fractions_of_postal_codes_are_cut_off(spark, text):
    """On both sides: the plan, and the SQL that it is compared with."""
    import duckdb

    ours = S.repaired(raw(spark, {"Postal_Code": text})).first().Postal_Code
    theirs = duckdb.sql(f"SELECT CAST(trunc(CAST('{text}' AS DOUBLE)) AS INTEGER)").fetchall()[0][0]
    assert ours == theirs


def test_other_date_formats(spark):
    rows = raw(spark, {"Order_Date": "08.11.2016"}, {"Order_Date": "2016-11-8"}, {"Order_Date": " 01.02.2017 "})
    found = S.silver_sales(rows, ["dd.MM.yyyy"])
    assert set(column(found, "Order_Date")) <= {datetime.date(2016, 11, 8), datetime.date(2017, 2, 1)}
    good, rejected = S.castable(rows, ["dd.MM.yyyy"])
    assert (good.count(), rejected.count()) == (3, 0)
    assert S.castable(rows)[1].count() == 2  # not among the usual formats
    assert S.castable(raw(spark, {"Order_Date": "8.11.2016"}), ["dd.MM.yyyy"])[1].count() == 1
    for wrong in ("MMM d yyyy", "yyyy-MM-dd'T'HH"):
        with pytest.raises(ValueError):
            S.typed_columns(True, [wrong])


def test_extra_columns_stay(spark):
    rows = raw(spark, {}).withColumn("Ship_Mode", F.lit("First Class"))
    assert column(S.silver_sales(rows), "Ship_Mode") == ["First Class"]


def test_dedup_keeps_earliest_then_total_order(spark, folder):
    rows = raw(
        spark,
        {"Order_ID": "A", "Order_Date": "2016-01-02"}, {"Order_ID": "A", "Order_Date": "2016-01-01"},
        {"Order_ID": "B", "Sales": "9"}, {"Order_ID": "B", "Sales": "7"},
        {"Order_ID": "C", "Order_Date": None}, {"Order_ID": "C", "Order_Date": "2016-01-01"},
        {"Order_ID": "D"}, {"Order_ID": "D"}, {"Order_ID": "D", "Product_ID": "P2"},
    )
    kept = {(r.Order_ID, r.Product_ID): r for r in S.silver_sales(rows).collect()}
    assert len(kept) == 5
    assert kept["A", "P1"].Order_Date == datetime.date(2016, 1, 1)
    assert kept["B", "P1"].Sales == 7
    assert kept["C", "P1"].Order_Date is None
    preview = S.duplicate_preview(S.repaired(rows), folder)
    assert preview.count() == 9 and preview.filter("rn = 1").count() == 5


def test_dimensions(spark, folder):
    rows = S.repaired(raw(
        spark,
        {"Customer_Name": "Zoe"}, {"Customer_Name": None, "Order_ID": "O2"},
        {"Customer_ID": "C2", "Customer_Name": None, "Product_ID": "P0", "City": None},
        {"Product_Name": "A phone", "Order_ID": "O3", "City": "Rome"},
    ))
    customers = {r.Customer_ID: r.Customer_Name for r in gold.dim_customer(rows).collect()}
    assert customers == {"C1": "Ann", "C2": "Unknown"}
    only_zoe = rows.filter("Customer_Name <> 'Ann'")
    assert {r.Customer_Name for r in gold.dim_customer(only_zoe).collect()} == {"Unknown"}
    known = {r.Customer_ID: r.Customer_Name for r in gold.dim_customer(only_zoe, True).collect()}
    assert known == {"C1": "Zoe", "C2": "Unknown"}

    product = gold.dim_product(rows, folder)
    assert [tuple(r)[:3] for r in product.orderBy("Product_Key").collect()] == [
        (1, "P0", "Phone"), (2, "P1", "A phone")]
    places = gold.dim_geography(rows, folder)
    assert [r.City for r in places.orderBy("Geo_Key").collect()] == [None, "New york", "Rome"]

    fact = gold.fact_sales(rows, places, product.filter("Product_ID <> 'P0'"))
    by_customer = {(r.Order_ID, r.Customer_ID): r for r in fact.collect()}
    assert len(by_customer) == 4
    assert by_customer["O1", "C2"].Geo_Key is None and by_customer["O1", "C2"].Product_Key is None
    assert by_customer["O3", "C1"].Product_Key == 2


def test_same_place_in_two_countries_does_not_repeat_lines(spark, folder):
    rows = S.repaired(raw(spark, {}, {"Country": "Y", "Order_ID": "O2"}, {"Country": None, "Order_ID": "O3"}))
    fact = gold.fact_sales(rows, gold.dim_geography(rows, folder), gold.dim_product(rows, folder))
    assert sorted((r.Order_ID, r.Geo_Key) for r in fact.collect()) == [("O1", 2), ("O2", 3), ("O3", 1)]


def test_raw_file_round_trip(spark, folder):
    rows = raw(spark, {"City": ""}, {"City": None}, {"City": ' a,"b" '}, {"City": "c\\"}, {"City": "tab\t"})
    path = folder.fresh("csv")
    write_raw(rows, path)
    want = sorted(map(tuple, rows.collect()), key=str)
    assert sorted(map(tuple, read_raw(spark, path).collect()), key=str) == want
    assert sorted(map(tuple, read_raw(spark, path, RAW_COLUMNS).collect()), key=str) == want


def test_strict_types_hold_without_ansi(spark):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception, match="is not a valid"):
            S.repaired(raw(spark, {"Sales": "x"})).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_percent_against_decimal_arithmetic(spark):
    """Many quotients, short ones included, whose halves fall exactly on the rounding border."""
    from decimal import ROUND_HALF_UP

    pairs = [(a, b) for b in (1, 3, 7, 8, 32, 800, 20000, 99999) for a in range(-60, 60, 7)]
    df = spark.createDataFrame(pairs, "a int, b int")
    for row in df.select("a", "b", percent(ratio(F.col("a"), F.col("b"))).alias("p")).collect():
        points = (Decimal(repr(row.a / row.b * 100))).quantize(Decimal("1e-10"), ROUND_HALF_UP)
        cents = points.quantize(Decimal("0.01"), ROUND_HALF_UP)
        assert row.p == f"{cents if cents else Decimal('0.00'):,.2f}%", row


def test_sentence_case_against_python(spark):
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("aBc Zé-'\t9") for _ in range(rng.randrange(9))) for _ in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for row in df.select("w", sentence_case(F.col("w")).alias("s")).collect():
        t = row.w.strip(" ")
        assert row.s == t[:1].upper() + t[1:].lower()


def test_dedup_of_a_key_that_holds_a_third_of_all_rows(spark, house):
    """Copies of one line, dated differently, spread over many tasks: one survives, the earliest."""
    lines = S.repaired(house.bronze)
    hot = lines.limit(1).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3800)))).select(
        *[F.date_add("Order_Date", F.col("n")).alias(c) if c == "Order_Date" else c for c in lines.columns]
    )
    mixed = lines.unionByName(hot).repartition(16)
    kept = S.dedup(mixed)
    assert kept.count() == house.silver.count()
    columns = house.silver.columns
    assert kept.select(columns).exceptAll(house.silver).count() == 0


def test_decimals_with_and_without_the_wide_cast(spark):
    """Plain numbers are read by one cast; others still only where no digit is lost."""
    from tallyhouse.operators.repair import parse, whole_part

    texts = {
        "1": "1.0000", " +1.5 ": "1.5000", "-.25": "-0.2500", "1.": "1.0000", "1.23450": "1.2345", "1.23451": None,
        "99999999999999.9999": "99999999999999.9999", "100000000000000": None, "000000000000000000012.5": "12.5000",
        "1e2": "100.0000", "1e-4": "0.0001", "1e-5": None, "1.5d": None, "": None, ".": None, "1\n": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["v"] for r in df.select("t", parse("t", "decimal(18,4)").alias("v")).collect()}
    assert got == {t: v if v is None else Decimal(v) for t, v in texts.items()}
    texts = {"10001.0": 10001, " -7. ": -7, "+12.99": 12, "12": 12, ".5": None, "1.2.3": None, "1e3": None, "9999999999.0": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", whole_part("t").alias("v")).collect()} == texts
