"""Run statistics and spans (A10, A11, A12), cache statistics (A18) and the
output check of written documents (K7). All are single aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_statistics(ranking: DataFrame, keys=("store_id", "month")) -> DataFrame:
    """A10 over a monthly ranking: stores, store-months, items, revenue (sum of
    month totals) and items per store-month (0 when there is none)."""
    store, period = keys
    per_month = ranking.groupBy(*keys).agg(F.count(F.lit(1)).alias("items"),
                                           F.first("period_total").alias("period_total"))
    return per_month.agg(
        F.countDistinct(store).alias("stores"),
        F.count(F.lit(1)).alias("store_months"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("items"),
        F.coalesce(F.sum("period_total"), F.lit(0)).alias("revenue"),
    ).withColumn(
        "items_per_month",
        F.coalesce(F.col("items") / F.nullif(F.col("store_months"), F.lit(0)), F.lit(0.0)))


def data_span(sales: DataFrame, date_col: str = "d") -> DataFrame:
    """first/last day and first/last month of the dated sales, with the
    total value and row count of the fact — one aggregate, one scan."""
    return sales.agg(
        F.min(date_col).alias("first_day"), F.max(date_col).alias("last_day"),
        F.date_format(F.min(date_col), "yyyy-MM").alias("first_month"),
        F.date_format(F.max(date_col), "yyyy-MM").alias("last_month"),
        F.sum("value").alias("total_value"), F.count(F.lit(1)).alias("fact_rows"),
    )


def periods_per_store(mart: DataFrame, group_cols=("store_id",), period_col: str = "period") -> DataFrame:
    """Distinct periods and mart rows per store (a partial aggregate)."""
    return mart.groupBy(*group_cols).agg(F.countDistinct(period_col).alias("n_periods"),
                                         F.count(F.lit(1)).alias("n_rows"))


def store_order(stores: DataFrame) -> DataFrame:
    """Position of each store in text order and in numeric order (ids
    that are no numbers first). ``stores`` has one row per store: a dimension,
    so one task orders it."""
    number = F.expr("try_cast(store_id AS INT)")
    return stores.select(
        "store_id", F.row_number().over(Window.orderBy("store_id")).alias("text_order"),
        F.row_number().over(Window.orderBy(number.asc_nulls_first(), F.col("store_id"))).alias("numeric_order"))
