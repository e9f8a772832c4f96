"""Column functions on inline fixtures (FIXTURES F-A, F-B, F-C, F-D)."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from shelfrank.functions import clean as C
from shelfrank.functions import periods as P


def test_money_br_and_currency(spark):
    rows = [("1.234,56",), ("-5,00",), ("0,00",), ("5,",), ("R$ 10,00",), ("abc",), ("",), (None,),
            ("inf",), ("1d",), ("1_000",), ("  7,5 ",)]
    df = spark.createDataFrame(rows, "raw string")
    got = df.select("raw", C.parse_money("raw").alias("v1"), C.parse_money("raw", currency=True).alias("v2")).collect()
    v1 = {r.raw: r.v1 for r in got}
    v2 = {r.raw: r.v2 for r in got}
    assert v1["1.234,56"] == Decimal("1234.56")
    assert v1["-5,00"] == Decimal("-5.00")  # P4 drops it later
    assert v1["5,"] == Decimal("5.00")
    assert v1["R$ 10,00"] == 0 and v2["R$ 10,00"] == Decimal("10.00")
    for bad in ("abc", "", None, "inf", "1d", "1_000", "0,00"):
        assert v1[bad] == 0
    assert v1["  7,5 "] == Decimal("7.50")


def test_money_plain_mode(spark):
    df = spark.createDataFrame([("1234.56",)], "raw string")
    r = df.select(C.parse_money("raw", "br").alias("br"), C.parse_money("raw", "plain").alias("plain")).first()
    assert r.br == Decimal("123456.00") and r.plain == Decimal("1234.56")


def test_dates_day_first(spark):
    rows = [("05/01/2024",), ("1/2/2024",), ("31/02/2024",), ("05/13/2024",), (None,), ("2024-01-05",)]
    df = spark.createDataFrame(rows, "raw string")
    got = {r.raw: r.d for r in df.select("raw", C.parse_date("raw").alias("d")).collect()}
    assert got["05/01/2024"] == dt.date(2024, 1, 5)
    assert got["1/2/2024"] == dt.date(2024, 2, 1)
    assert got["31/02/2024"] is None and got["05/13/2024"] is None and got[None] is None
    assert got["2024-01-05"] is None
    iso = df.select(C.parse_date("raw", ("d/M/yyyy", "yyyy-MM-dd")).alias("d")).collect()
    assert dt.date(2024, 1, 5) in [r.d for r in iso]
    b = df.select(C.month_bucket(C.parse_date("raw")).alias("m")).collect()
    assert sorted(r.m for r in b).count("NaT") == 4


def test_week_keys_match_percent_w(spark):
    cases = {"2023-01-01": "2023-W00", "2023-01-02": "2023-W01", "2024-01-01": "2024-W01",
             "2024-12-30": "2024-W53", "2025-01-01": "2025-W00", "2025-01-05": "2025-W00",
             "2025-01-06": "2025-W01", "2025-12-31": "2025-W52"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("d", F.to_date("s"))
    got = {r.s: r.k for r in df.select("s", P.week_key("d").alias("k")).collect()}
    assert got == cases
    # brute force against Python's %W over four years of days
    days = [dt.date(2018, 1, 1) + dt.timedelta(n) for n in range(1500)]
    d2 = spark.createDataFrame([(d,) for d in days], "d date")
    got2 = {r.d: r.k for r in d2.select("d", P.week_key("d").alias("k")).collect()}
    assert all(got2[d] == d.strftime("%Y-W%W") for d in days)


def test_labels(spark):
    df = spark.createDataFrame([("2025-01",), ("2025-13",), ("NaT",), ("2025-W01",), ("2024-01-05",),
                                ("2025-W00",)], "k string")
    got = {r.k: (r.lab, r.iso) for r in df.select("k", P.period_label("k").alias("lab"),
                                                  P.period_label("k", iso_label=True).alias("iso")).collect()}
    assert got["2025-01"][0] == "Janeiro/2025"
    assert got["2025-13"][0] == "2025-13" or got["2025-13"][0].endswith("/2025")
    assert got["NaT"][0] == "NaT"
    assert got["2024-01-05"][0] == "05/01/2024"
    # %W week 1 of 2025 starts Monday 6 January; the ISO reading starts 30 December
    assert got["2025-W01"][0] == "Semana 01 (06/01 - 12/01)"
    assert got["2025-W01"][1] == "Semana 01 (30/12 - 05/01)"
    assert got["2025-W00"][0] == "Semana 00 (30/12 - 05/01)"


def test_products_and_store_ids(spark):
    rows = [("  pão  de queijo ",), (" x  y\t",), ("",), ("   ",), (None,), ("nan",)]
    df = spark.createDataFrame(rows, "raw string")
    got = df.select("raw", C.normalise_product("raw").alias("c"),
                    C.normalise_product("raw", collapse_ws=False).alias("l")).collect()
    m = {r.raw: (r.c, r.l) for r in got}
    assert m["  pão  de queijo "] == ("PÃO DE QUEIJO", "PÃO  DE QUEIJO")
    assert m[" x  y\t"] == ("X Y", "X  Y")
    valid = df.select(C.valid_product(C.normalise_product("raw")).alias("v")).collect()
    assert [r.v for r in valid] == [True, True, False, False, None, False] or \
        [bool(r.v) for r in valid] == [True, True, False, False, False, False]
    ids = spark.createDataFrame([("007",), ("12",), ("A1",)], "s string")
    assert [r.n for r in ids.select(C.store_number("s").alias("n")).collect()] == [7, 12, None]


def test_currency_text(spark):
    df = spark.createDataFrame([(Decimal("1234.56"),)], "v decimal(18,2)")
    r = df.select(C.brl_text("v").alias("b"), C.usd_grouped_text("v").alias("u")).first()
    assert r.b == "R$ 1.234,56" and r.u == "R$ 1,234.56"
