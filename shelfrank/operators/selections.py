"""A period's selection as the dashboard shows it.

A selection is one row: its keys, the period's ``total`` and ``items``, the
annotated lists of ``ranking.overlap_lists``, at most top_n + bottom_n of them.
Merging, classes, ranks, lists, summary and search are higher-order functions
on arrays, so none of them joins, sorts or shuffles rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.config import DEFAULT, Params
from shelfrank.operators.abc import abc_class
from shelfrank.operators.annotate import NO_MODEL, said

_SUM = "decimal(38,2)"
_INSIGHTS = "array<struct<text: string, action: string>>"
_MERGED = (f"array<struct<product: string, kind: string, value_once: {_SUM}, value_twice: {_SUM}, first_pos: int, "
           f"insights: {_INSIGHTS}>>")


def merge(selections: DataFrame, dedupe: bool = True) -> DataFrame:
    """``products``, an array of (product, kind, value, value_once,
    value_twice, first_pos, insights), one entry per product in place of ``items``.

    With ``dedupe`` a product listed in both TOP and BOTTOM counts once;
    otherwise its value is added twice, as the dashboard does (D7). Kind and
    position are those of its first entry; ``insights`` keeps list order and skips
    entries with no or an empty diagnosis or the "no model" text (F17).
    """
    def insight(x: Column) -> Column:
        diagnosis, action = said(x)
        told = F.array(F.struct(diagnosis.alias("text"), action.alias("action"))).cast(_INSIGHTS)
        return F.when(F.coalesce(~diagnosis.isin("", NO_MODEL), F.lit(False)), told).otherwise(F.array().cast(_INSIGHTS))

    def step(done: Column, x: Column) -> Column:
        """One item more; items come by product, so its product is the last or new."""
        last = F.try_element_at(done, F.lit(-1))
        new = F.struct(x["product"].alias("product"), x["kind"].alias("kind"), x["value"].cast(_SUM).alias("value_once"),
                       x["value"].cast(_SUM).alias("value_twice"), x["i"].alias("first_pos"), insight(x).alias("insights"))
        more = F.struct(last["product"].alias("product"), last["kind"].alias("kind"), last["value_once"].alias("value_once"),
                        (last["value_twice"] + x["value"]).cast(_SUM).alias("value_twice"), last["first_pos"].alias("first_pos"),
                        F.concat(last["insights"], insight(x)).alias("insights"))
        return F.when(last["product"] == x["product"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(more))).otherwise(
            F.concat(done, F.array(new))).cast(_MERGED)

    ordered = F.sort_array(F.transform("items", lambda x: F.struct(
        x["product"].alias("product"), x["i"].alias("i"), x["kind"].alias("kind"), x["value"].alias("value"),
        x["diagnosis"].alias("diagnosis"), x["action"].alias("action"))))
    products = F.aggregate(ordered, F.array().cast(_MERGED), step)
    value = "value_once" if dedupe else "value_twice"
    return selections.select(*[c for c in selections.columns if c not in ("items", "status")], F.transform(
        products, lambda x: x.withField("value", x[value])).alias("products"))


def classify(merged: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """W8 + W9: ``products`` in descending value order, with ``rank``,
    ``cum_value`` and ``abc_class``; the denominator is the full period total (A7).
    A zero total gives class A, as the dashboard's pct = 0."""
    by_value = F.sort_array(F.transform("products", lambda x: F.struct(
        (-x["value"]).alias("minus"), *[x[c].alias(c) for c in ("product", "kind", "value", "first_pos", "insights")])))
    # running sums in one fold: each step appends the sum up to its product
    cums = F.aggregate(by_value, F.array().cast(f"array<{_SUM}>"), lambda a, x: F.concat(
        a, F.array((F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast(_SUM)) + x["value"]).cast(_SUM))))
    total = F.col("total")

    def ranked(z: Column, i: Column) -> Column:
        x, cum = z["x"], z["cum"]
        label = F.when(total > 0, abc_class(cum, total, params)).otherwise(F.lit("A"))
        return F.struct(*[x[c].alias(c) for c in ("product", "kind", "value", "first_pos", "insights")],
                        cum.alias("cum_value"), (i + 1).cast("int").alias("rank"), label.alias("abc_class"))

    return merged.withColumn("products", F.transform(F.arrays_zip(by_value.alias("x"), cums.alias("cum")), ranked))


def _numbered(products: Column, n: int, name: str, label: str) -> Column:
    return F.transform(F.slice(products, 1, n), lambda x, i: F.struct(
        F.lit(label).alias(name), (i + 1).cast("int").alias("pos"), x["product"].alias("product"), x["value"].alias("value"), x["abc_class"].alias("abc_class")))


def kind_lists(classified: DataFrame, n: int = 10) -> DataFrame:
    """``lists``, the first ``n`` products of the TOP and of the BOTTOM list,
    both in descending value order: (list, pos, product, value, abc_class)."""
    own = lambda kind: F.filter("products", lambda x: x["kind"] == kind)
    return classified.withColumn("lists", F.concat(*[_numbered(own(k), n, "list", k) for k in ("TOP", "BOTTOM")]))


def best_worst(classified: DataFrame, n: int = 10) -> DataFrame:
    """``lists``, best n and worst n of each class (worst: positive values,
    lowest first): (list, pos, product, value, abc_class)."""
    def both(c: str) -> list[Column]:
        own = F.filter("products", lambda x: x["abc_class"] == c)
        return [_numbered(own, n, "list", "best"), _numbered(F.reverse(F.filter(own, lambda x: x["value"] > 0)), n, "list", "worst")]

    return classified.withColumn("lists", F.concat(*[x for c in "ABC" for x in both(c)]))


def summary(classified: DataFrame, keys=("store_id", "period")) -> DataFrame:
    """A17 + A14: products, products with an insight, insights, products per
    class, the integer share of class A (F19) and the period total."""
    products = F.col("products")
    of = lambda c: F.filter(products, lambda x: x["abc_class"] == c)
    insights = F.aggregate(products, F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["insights"]))
    in_a = F.aggregate(of("A"), F.lit(0).cast(_SUM), lambda a, x: (a + x["value"]).cast(_SUM)).cast("double")
    total = F.col("total").cast("double")
    return classified.where(F.size("products") > 0).select(
        *keys, F.size(products).cast("bigint").alias("n_products"),
        F.size(F.filter(products, lambda x: F.size(x["insights"]) > 0)).cast("bigint").alias("n_with_insight"), insights.alias("n_insights"),
        *[F.size(of(c)).cast("bigint").alias(f"n_{c.lower()}") for c in "ABC"],
        F.floor(F.try_divide(in_a, total) * F.lit(100.0) + F.lit(0.5)).cast("int").alias("share_a"), total.alias("total"))


def search(merged: DataFrame, term: str, keys=("store_id", "period")) -> DataFrame:
    """F17 + F18 + F20 + F21: one row per product with an insight whose name or
    any insight holds ``term``, whatever the case; a blank term keeps all. Columns:
    keys, product, ``first_insight``, ``action`` (null for none), ``n_insights``."""
    t = term.strip().lower()
    found = F.filter("products", lambda x: F.size(x["insights"]) > 0)
    if t:
        found = F.filter(found, lambda x: F.lower(x["product"]).contains(t) | F.exists(
            x["insights"], lambda y: F.coalesce(F.lower(y["text"]).contains(t), F.lit(False))))
    first = F.try_element_at(F.col("p.insights"), F.lit(1))
    return merged.select(*keys, F.explode(found).alias("p")).select(
        *keys, "p.product", first["text"].alias("first_insight"), F.when(~first["action"].isin("-", ""), first["action"]).alias("action"),
        F.size("p.insights").alias("n_insights"))
