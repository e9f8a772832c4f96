"""Month-on-month change per product.

"Previous" is the previous *calendar* month: a plain ``lag`` would take the
last month with sales, which may be years back (SURVEY D13), so the month of
the lagged row is compared with the calendar. A product of a store has one row
per month, so its window is bounded by the calendar span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The reference's texts for a product without a previous month
# and for a product without sales.
NEW_TEXT = "Novo (sem vendas anteriores)"
NO_DATA_TEXT = "Sem dados"


def shift_month(month: Column, months: int) -> Column:
    """``yyyy-MM`` text shifted by ``months``; null for a malformed key (``NaT``)."""
    first = F.try_to_timestamp(F.concat(month, F.lit("-01")), F.lit("yyyy-MM-dd")).cast("date")
    return F.date_format(F.add_months(first, months), "yyyy-MM")


def _cents(c: Column) -> Column:
    return (c * 100).cast("long")


def change_columns(cur: Column, prev: Column) -> tuple[Column, Column]:
    """(change_pct, change_text) from decimal current and previous values.

    The ratio is rounded half away from zero to one decimal with integer
    arithmetic on cents, so every engine gives the same text: ``+27.6%``.
    """
    cur_c, prev_c = _cents(cur), _cents(F.coalesce(prev, F.lit(0)))
    num = (cur_c - prev_c) * 1000
    # tenths of a percent, half up: (2|num| + prev) div (2 prev)
    tenths = _int_div(F.abs(num) * 2 + prev_c, prev_c * 2)
    sign = F.when(num < 0, F.lit("-")).otherwise(F.lit("+"))
    signed = F.when(num < 0, -tenths).otherwise(tenths)
    text = F.concat(sign, _int_div(tenths, F.lit(10)).cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))
    safe = prev_c > 0
    pct = (F.when(safe, signed.cast("double") / F.lit(10.0))
           .when(cur_c > 0, F.lit(100.0)).otherwise(F.lit(0.0)))
    txt = F.when(safe, text).when(cur_c > 0, F.lit(NEW_TEXT)).otherwise(F.lit(NO_DATA_TEXT))
    return pct, txt


def _int_div(a: Column, b: Column) -> Column:
    """Floor division of non-negative longs by a positive long, exact: what is
    divided is a multiple of b, in decimals."""
    whole = (a - F.pmod(a, b)).cast("decimal(20,0)")
    return F.when(b > 0, (whole / b.cast("decimal(20,0)")).cast("long"))


def month_over_month(month_sales: DataFrame, keys=("store_id", "product")) -> DataFrame:
    """Adds ``previous`` (value of the previous calendar month, 0 if none),
    ``change_pct`` and ``change_text`` to a store × product × month mart.

    One shuffle of the mart's rows and no self-join. Undated rows (month
    ``NaT``) are nobody's previous month and have none.
    """
    k = list(keys)
    if "month_start" in month_sales.columns:
        # the mart's own date key: no month text is parsed
        order, before = F.col("month_start"), F.add_months("month_start", -1)
    else:
        order, before = F.col("month"), shift_month(F.col("month"), -1)
    w = Window.partitionBy(*k).orderBy(order)
    last = F.lag(order).over(w)
    j = month_sales.select(*k, "month", "value", F.when(last == before, F.lag("value").over(w)).alias("previous"))
    pct, txt = change_columns(F.col("value"), F.col("previous"))
    return j.select(*k, "month", "value",
                    F.coalesce(F.col("previous"), F.lit(0).cast("decimal(18,2)")).alias("previous"),
                    pct.alias("change_pct"), txt.alias("change_text"))
