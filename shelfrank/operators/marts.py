"""Aggregations of the sales fact into marts.

All are ``groupBy().agg()`` so Spark does a partial (map-side) aggregate
before the shuffle: a store holding a third of all rows only sends one
partial sum per (store, key) and map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.functions.periods import GRANULARITIES, month_key, period_key


def _sum(df: DataFrame, keys: list[str], out: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("value").alias(out))


def product_month_sales(sales: DataFrame, date_col: str = "d", item_cols=("product",)) -> DataFrame:
    """A1: store × product × month. Rows without a date go to month ``NaT``
    (the cleaning's ``invalid_dates='bucket'`` policy, D1).

    Grouping is on the month's first day (``month_start``, kept in the
    output); the text key is formatted on the aggregated rows only.
    ``item_cols=()`` gives store-month totals without the product dimension.
    """
    items = list(item_cols)
    agg = _sum(sales.withColumn("month_start", F.trunc(F.col(date_col), "month")),
               ["store_id", *items, "month_start"])
    return agg.select("store_id", *items,
                      F.coalesce(month_key("month_start"), F.lit("NaT")).alias("month"), "value",
                      "month_start")


def in_month_range(sales: DataFrame, lo: str, hi: str, date_col: str = "d") -> DataFrame:
    """Sales of the months ``lo`` .. ``hi`` (``yyyy-MM``, inclusive).

    Written as a date range on the fact, not as a test of the month text
    after the aggregate: Spark pushes ``d >= first day of lo`` and
    ``d < first day after hi`` into the parquet scan (row groups and files
    outside the range are skipped), and every month in the range stays
    whole, so month totals and rankings are unchanged. Undated sales fall
    outside every range.
    """
    d = F.col(date_col)
    start = F.to_date(F.lit(f"{lo}-01"))
    end = F.add_months(F.to_date(F.lit(f"{hi}-01")), 1)
    return sales.filter((d >= start) & (d < end))


def product_totals(sales: DataFrame) -> DataFrame:
    """A2: store × product."""
    return _sum(sales, ["store_id", "product"])


def product_history(month_sales: DataFrame) -> DataFrame:
    """A5 + A6 (+ J1 folded in): one pass over the month mart gives the
    product total and its ``month -> value`` map, sorted by month.

    The collected list is one entry per month of one product, so it is
    bounded by the calendar span, not by the data size.
    """
    return month_sales.groupBy("store_id", "product").agg(
        F.sum("value").alias("value"),
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("month"), F.col("value"))))
        ).alias("history"),
    )


def first_day(d: Column, granularity: str) -> Column:
    """First day of the period: a date that tells periods apart. A %W week is
    fixed by its Monday and the calendar year, so it starts on 1 January when
    its Monday lies in the year before."""
    if granularity == "day":
        return d
    if granularity == "week":
        return F.greatest(F.date_sub(d, F.weekday(d)), F.trunc(d, "year"))
    if granularity == "month":
        return F.trunc(d, "month")
    raise ValueError(f"unknown granularity {granularity!r}")


def period_of(start: str, granularity: str) -> Column:
    """The text key, never null (``NaT`` without a date): a join on a nullable
    key would make Spark filter each branch of a mart below its aggregate, and
    branches with different filters cannot share one scan of the fact."""
    return F.coalesce(period_key(start, granularity), F.lit("NaT"))


def period_mart(sales: DataFrame, granularity: str, date_col: str = "d") -> DataFrame:
    """A3/A4: store × period × product for one granularity (P17: ``period``).

    Groups on the period's first day and formats the text key after the
    aggregate.
    """
    agg = _sum(sales.withColumn("_k", first_day(F.col(date_col), granularity)), ["store_id", "_k", "product"])
    return agg.select("store_id", period_of("_k", granularity).alias("period"), "product", "value")


def multi_granularity_mart(sales: DataFrame, granularities=GRANULARITIES,
                           date_col: str = "d", item_cols=("product",)) -> DataFrame:
    """A4 + P18: day mart aggregated once; week and month are re-aggregated
    from it, not from the fact, on date keys that are formatted afterwards.
    Output: granularity, store_id, period, *item_cols, value. ``item_cols=()``
    gives store-period totals (A7/A16) without the product dimension: far
    fewer groups to shuffle than summing the product-level mart.
    """
    items = list(item_cols)
    day = _sum(sales.withColumn("_k", F.col(date_col)), ["store_id", "_k", *items])
    out = None
    for g in granularities:
        p = day if g == "day" else _sum(day.withColumn("_k", first_day(F.col("_k"), g)), ["store_id", "_k", *items])
        p = p.select(F.lit(g).alias("granularity"), "store_id", period_of("_k", g).alias("period"), *items, "value")
        out = p if out is None else out.unionByName(p)
    return out


def period_totals(mart: DataFrame, keys=("store_id", "period")) -> DataFrame:
    """Total over all products of a store-period (not only the ranked ones)."""
    return mart.groupBy(*keys).agg(F.sum("value").alias("total"))


def store_totals(sales: DataFrame) -> DataFrame:
    """Store total."""
    return sales.groupBy("store_id").agg(F.sum("value").alias("total"))
