"""ABC (Pareto) classes per store (W1–W3, A8, T1) and their mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.config import DEFAULT, Params
from shelfrank.operators.prefix import running_totals


def abc_class(cum: Column, total: Column, params: Params = DEFAULT) -> Column:
    """W3 on exact decimals: cum*100 <= A*total -> A, <= B*total -> B, else C.

    The item that crosses the A limit is B; a store with one product is C (D6).
    """
    return (
        F.when(cum * 100 <= total * params.limit_a, F.lit("A"))
        .when(cum * 100 <= total * params.limit_b, F.lit("B"))
        .otherwise(F.lit("C"))
    )


def pct(part: Column, total: Column) -> Column:
    """Share in percent as double (division of the exact decimals' doubles)."""
    return part.cast("double") / total.cast("double") * F.lit(100.0)


def classify(totals: DataFrame, group_cols=("store_id",), params: Params = DEFAULT,
             total_col: str | None = None) -> DataFrame:
    """Running share in descending value order, ties by product.

    ``totals`` has one row per (group, product) and a decimal ``value``.
    ``total_col`` names a column holding the denominator (W8 uses the full
    period total); by default it is the group's own sum. Groups whose total
    is not > 0 get no rows (A8 guard). Output adds rank, cum_value,
    group_total, share_pct, cum_pct, abc_class.
    """
    keys = [*group_cols, "product"]
    narrow = [*keys, "value", *([total_col] if total_col else [])]
    wide = [c for c in totals.columns if c not in narrow]
    order = [F.col("value").desc(), F.col("product").asc()]
    ranked = running_totals(totals.select(*narrow), list(group_cols), order, "value",
                            total_col="_own_total")
    if wide:
        # wide columns (the month history) are not sliced and written with the rows
        ranked = ranked.join(totals.select(*keys, *wide), keys)
    denom = F.col(total_col) if total_col else F.col("_own_total")
    return (
        ranked.withColumn("group_total", denom)
        .drop("_own_total")
        .filter(F.col("group_total") > 0)
        .withColumn("share_pct", pct(F.col("value"), F.col("group_total")))
        .withColumn("cum_pct", pct(F.col("cum_value"), F.col("group_total")))
        .withColumn("abc_class", abc_class(F.col("cum_value"), F.col("group_total"), params))
    )


def _bucket(value: Column) -> Column:
    """Number of a value's bucket, larger for larger values: ``PER_OCTAVE`` to a
    factor of two, so a few thousand for any decimals; 0 and below is the last."""
    return F.when(value > 0, F.floor(F.log2(value.cast("double")) * PER_OCTAVE).cast("int")).otherwise(F.lit(-(1 << 20)))


#: Buckets of the value histogram to a factor of two.
PER_OCTAVE = 64


def class_limits(totals: DataFrame, group_cols=("store_id",), params: Params = DEFAULT) -> DataFrame:
    """Where the running share of a group crosses its limits, by weighted selection:
    group, ``group_total``, and for ``a`` and ``b`` the crossing value ``v_`` and
    how many products of exactly that value, in product order, still lie within
    the limit (``k_``, of ``c_``).

    A histogram of the values finds the bucket in which a limit is crossed, and
    among the distinct values of that bucket alone the crossing value. Both are
    aggregates with partial sums; no product is sorted. Values are 0 or more (P4).
    """
    g = list(group_cols)
    positive = F.when(F.col("value") < 0, F.raise_error(F.lit("values must be 0 or more"))).otherwise(F.col("value"))
    rows = totals.select(*g, positive.alias("value"), _bucket(F.col("value")).alias("_b"))
    limits = {"a": params.limit_a, "b": params.limit_b}

    def crossing(hist: DataFrame, by: list[str], order: str) -> DataFrame:
        """``hist`` with the sum up to a row; the rows in which a limit is crossed."""
        w = Window.partitionBy(*by).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return hist.withColumn("_upto", F.coalesce(F.col("_before"), F.lit(0)) + F.sum("_sum").over(w)).withColumn("_from", F.col("_upto") - F.col("_sum"))

    hist = rows.groupBy(*g, "_b").agg(F.sum("value").alias("_sum")).withColumn("_before", F.lit(0).cast("decimal(38,2)"))
    hist = crossing(hist, g, "_b").withColumn("group_total", F.sum("_sum").over(Window.partitionBy(*g)))
    crossed = lambda limit: (F.col("_from") * 100 <= F.col("group_total") * limit) & (F.col("_upto") * 100 > F.col("group_total") * limit)
    near = hist.where(crossed(limits["a"]) | crossed(limits["b"])).select(*g, "_b", "group_total", F.col("_from").alias("_before"))
    values = rows.join(near, [*g, "_b"]).groupBy(*g, "_b", "value").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_sum"), F.first("_before").alias("_before"), F.first("group_total").alias("group_total"))
    values = crossing(values, [*g, "_b"], "value")
    out = []
    for name, limit in limits.items():
        room = (F.col("group_total") * limit - F.col("_from") * 100) / (F.col("value") * 100)
        at = F.when(crossed(limit), F.struct("value", F.floor(room).cast("bigint").alias("k"), F.col("_n").alias("c")))
        out.append(F.max(at).alias(name))
    found = values.groupBy(*g).agg(F.first("group_total").alias("group_total"), *out)
    return found.select(*g, "group_total", *[F.col(f"{n}.{f}").alias(f"{f[0]}_{n}") for n in limits for f in ("value", "k", "c")])


def classes(totals: DataFrame, group_cols=("store_id",), params: Params = DEFAULT) -> DataFrame:
    """W3 where no rank is asked: group, product, value, ``group_total``,
    ``abc_class``, as :func:`classify` has them, without its sort of all rows.

    Only products whose total equals a crossing value are put in order, and of
    these only where some of them lie within the limit and some do not.
    """
    g = list(group_cols)
    found = totals.select(*g, "product", "value").join(class_limits(totals, group_cols, params), g).where("group_total > 0")
    tied = lambda n: (F.col("value") == F.col(f"v_{n}")) & (F.col(f"k_{n}") > 0) & (F.col(f"k_{n}") < F.col(f"c_{n}"))
    split = F.coalesce(tied("a") | tied("b"), F.lit(False))
    place = F.row_number().over(Window.partitionBy(*g, "value").orderBy("product"))
    placed = found.where(~split).withColumn("_at", F.lit(1)).unionByName(found.where(split).withColumn("_at", place))
    # no crossing value: the limit is never passed
    within = lambda n: F.coalesce((F.col("value") > F.col(f"v_{n}")) | ((F.col("value") == F.col(f"v_{n}")) & (F.col("_at") <= F.col(f"k_{n}"))), F.lit(True))
    label = F.when(within("a"), "A").when(within("b"), "B").otherwise("C")
    return placed.select(*g, "product", "value", "group_total", label.alias("abc_class"))


def class_mix(classified: DataFrame, group_cols=("store_id",)) -> DataFrame:
    """A14 + F19: products, value and integer share (half up) per class.

    The denominator is the group total the classes were computed against.
    """
    g = list(group_cols)
    return (
        classified.groupBy(*g, "abc_class")
        .agg(F.count(F.lit(1)).alias("products"),
             F.sum("value").alias("class_value"),
             F.first("group_total").alias("group_total"))
        .withColumn("share_int",
                    F.floor(pct(F.col("class_value"), F.col("group_total")) + F.lit(0.5)).cast("int"))
        .drop("group_total")
    )
