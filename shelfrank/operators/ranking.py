"""TOP/BOTTOM rankings per store-period.

A ranking is one row per store-period with an array of its listed items (at
most top_n + bottom_n); lists, sums and texts are made from it inside the row,
and the flat forms explode it.

Both ends come from one pass (:func:`ends`). The products of a store-period are
dealt over ``SALTS`` slices by their hash, so that a hot store-period is no
single task; one sort of each slice gives its first and last rows, its count and
its sum, and one aggregate of these few rows gives the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.config import DEFAULT, Params

#: Slices of a store-period.
SALTS = 16


def ends(mart: DataFrame, keys: list[str], first: int, last: int, positive_last: bool = False) -> DataFrame:
    """keys -> ``top`` and ``low``: arrays of (product, value), the first and last
    rows in descending value order (ties by product, D14), both in that order;
    ``n_products``, ``period_total`` (A7). ``positive_last`` takes ``low`` from
    the rows with a positive value (W5)."""
    order = Window.partitionBy(*keys, "_salt").orderBy(F.col("value").desc(), F.col("product").asc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counted = F.count_if(F.col("value") > 0) if positive_last else F.count(F.lit(1))
    # one window specification, so one sort
    sliced = mart.select(*keys, "product", "value", F.pmod(F.xxhash64("product"), F.lit(SALTS)).alias("_salt")).select(
        *keys, "product", "value", F.row_number().over(order).alias("_rn"), counted.over(whole).alias("_n"),
        F.count(F.lit(1)).over(whole).alias("_rows"), F.sum("value").over(whole).alias("_sum"))
    at_top, at_low = F.col("_rn") <= first, (F.col("_rn") <= F.col("_n")) & (F.col("_n") - F.col("_rn") < last)
    head = F.col("_rn") == 1
    rec = F.struct((-F.col("value")).alias("minus"), F.col("product"), F.col("value"))
    # sort_array, not array_sort: the natural order needs no lambda
    listed = lambda cond: F.sort_array(F.collect_list(F.when(cond, rec)))
    found = sliced.where(at_top | at_low | head).groupBy(*keys).agg(
        listed(at_top).alias("_top"), listed(at_low).alias("_low"), F.sum(F.when(head, F.col("_rows"))).alias("n_products"),
        F.sum(F.when(head, F.col("_sum"))).alias("period_total"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["product"].alias("product"), x["value"].alias("value")))
    n_low = F.least(F.size("_low"), F.lit(last))
    return found.select(*keys, bare(F.slice("_top", 1, first)).alias("top"),
                        bare(F.slice("_low", F.size("_low") - n_low + 1, n_low)).alias("low"), "n_products", "period_total")


def _not_annotated() -> list[Column]:
    """What the annotation fills in."""
    return [F.lit(None).cast("string").alias(c) for c in ("diagnosis", "action")]


def _item(x: Column, kind: Column, **more) -> Column:
    return F.struct(x["product"].alias("product"), kind.alias("kind"), x["value"].alias("value"), *[c.alias(n) for n, c in more.items()],
                    *_not_annotated())


def monthly_lists(mart: DataFrame, keys=("store_id", "period"), params: Params = DEFAULT) -> DataFrame:
    """Keys, ``items`` (product, kind, value, rank; 1 = best; diagnosis and
    action, null until they are annotated), ``n_products``, ``period_total``. ``TOP 10`` / ``BOTTOM 10`` per store-period; a period with
    at most top_n + bottom_n products is listed whole as ``GERAL``."""
    tn, bn = params.top_n, params.bottom_n
    n = F.col("n_products")
    few = n <= tn + bn
    top = F.transform("top", lambda x, i: _item(x, F.when(few, "GERAL").otherwise(f"TOP {tn}"), rank=(i + 1).cast("int")))
    rank = lambda i: (n - F.size("low") + i + 1).cast("int")
    low = F.transform("low", lambda x, i: _item(x, F.when(few, "GERAL").otherwise(f"BOTTOM {bn}"), rank=rank(i)))
    # a row of a small period that the top list has is not listed again
    items = F.concat(top, F.filter(low, lambda x: x["rank"] > tn))
    return ends(mart, list(keys), tn, bn).select(*keys, items.alias("items"), "n_products", "period_total")


def overlap_lists(mart: DataFrame, keys=("store_id", "period"), params: Params = DEFAULT) -> DataFrame:
    """W5 + U1: keys, ``items`` (i, product, kind, value, pos; diagnosis and action,
    null until they are annotated), ``n_products``, ``total``. TOP n, then BOTTOM n
    of the positive values; with fewer than top_n + bottom_n products a row is in
    both (D7). ``pos`` counts within a list, ``i`` over both; both are in descending
    value order."""
    item = lambda kind, ahead: lambda x, p: F.struct(
        (ahead + p + 1).cast("int").alias("i"), x["product"].alias("product"), F.lit(kind).alias("kind"), x["value"].alias("value"),
        (p + 1).cast("int").alias("pos"), *_not_annotated())
    items = F.concat(F.transform("top", item("TOP", F.lit(0))), F.transform("low", item("BOTTOM", F.size("top"))))
    return ends(mart, list(keys), params.top_n, params.bottom_n, positive_last=True).select(
        *keys, items.alias("items"), "n_products", F.col("period_total").alias("total"))


def flat(lists: DataFrame, keys, *more: str, col: str = "items") -> DataFrame:
    """One row per listed item: keys, the item's fields, and the columns ``more``."""
    return lists.select(*keys, *more, F.explode(col).alias("_x")).select(*keys, "_x.*", *more)


def monthly_top_bottom(mart: DataFrame, keys=("store_id", "period"), params: Params = DEFAULT) -> DataFrame:
    """W4, flat: keys, product, kind, value, rank, n_products, period_total."""
    return flat(monthly_lists(mart, keys, params), keys, "n_products", "period_total").drop("diagnosis", "action")


def top_bottom_overlap(mart: DataFrame, keys=("store_id", "period"), params: Params = DEFAULT) -> DataFrame:
    """W5 + U1, flat: keys, product, kind (TOP/BOTTOM), value, pos."""
    return flat(overlap_lists(mart, keys, params), keys).drop("i", "diagnosis", "action")


def summed(items: Column, of) -> Column:
    """Sum of the values of the items for which ``of`` holds."""
    zero = F.lit(0).cast("decimal(38,2)")
    return F.aggregate(F.filter(items, of), zero, lambda a, x: (a + x["value"]).cast("decimal(38,2)"))


def with_sums(lists: DataFrame) -> DataFrame:
    """Adds ``top_sum``, ``bottom_sum``, ``n_items``; ``GERAL`` counts in
    neither sum (D18)."""
    items = F.col("items")
    return lists.select("*", summed(items, lambda x: x["kind"].startswith("TOP")).alias("top_sum"),
                        summed(items, lambda x: x["kind"].startswith("BOTTOM")).alias("bottom_sum"),
                        F.size(items).cast("bigint").alias("n_items"))


def kind_sums(ranking: DataFrame, keys=("store_id", "period")) -> DataFrame:
    """A9 of a flat ranking."""
    k = list(keys)
    return ranking.groupBy(*k).agg(
        F.coalesce(F.sum(F.when(F.col("kind").contains("TOP"), F.col("value"))), F.lit(0)).alias("top_sum"),
        F.coalesce(F.sum(F.when(F.col("kind").contains("BOTTOM"), F.col("value"))), F.lit(0)).alias("bottom_sum"),
        F.count(F.lit(1)).alias("n_items"),
    )


def recent_periods(totals: DataFrame, keys=("store_id",), period_col: str = "period",
                   params: Params = DEFAULT) -> DataFrame:
    """Flag the newest ``annotated_periods`` periods of each store.

    Input is one row per store-period (a period total, or its lists), so a
    store's window holds its distinct periods only — bounded by the calendar.
    """
    k = list(keys)
    w = Window.partitionBy(*k).orderBy(F.col(period_col).desc())
    return totals.withColumn("recency", F.row_number().over(w).cast("int")).withColumn(
        "annotated", F.col("recency") <= params.annotated_periods)


def latest_period(totals: DataFrame, keys=("store_id",), period_col: str = "period") -> DataFrame:
    """Newest period of each store (partial max aggregate)."""
    return totals.groupBy(*keys).agg(F.max(period_col).alias("latest_period"))
