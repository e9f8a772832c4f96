"""Exact running totals inside groups that may be too large for one task.

A plain ``sum().over(Window.partitionBy(g).orderBy(o))`` puts a whole group
in one task. Here the rows are range-partitioned on ``(g, o)`` so every
output partition holds a contiguous slice of the global order; a group that
holds a third of all rows is spread over many slices. Each slice computes
local running sums; per-slice totals (at most partitions + groups rows) give
each slice its offset. Result = local + offset, identical to the plain window.

The sliced rows are checkpointed to the shared checkpoint folder before the
two branches read them: range bounds come from a sample, so recomputing the
exchange (exchange reuse is not guaranteed, e.g. above a Python UDF) could
put a row in another slice. The checkpoint fixes every row's slice, and a
lost executor recomputes nothing below it. The rows are post-aggregate
(one per group member), so the write is small next to the fact scan; pass
narrow rows and join wide columns to the result.

The number of slices, and so of files written, follows the rows: AQE merges
the range partitions up to its advisory size. (Without AQE there are as many
as shuffle partitions.) The files go when nothing refers to the frame any more
(``spark.cleaner.referenceTracking.cleanCheckpoints``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.session import materialize


def running_totals(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column],
    value_col: str = "value",
    cum_col: str = "cum_value",
    rank_col: str = "rank",
    total_col: str = "group_total",
    slices: int | None = None,
) -> DataFrame:
    """Adds ``cum_col`` (running sum, ROWS frame), ``rank_col`` (row number)
    and ``total_col`` (group total) in ``order_cols`` order within ``group_cols``.

    ``order_cols`` must give a total order inside a group (add a unique
    tie-break column), otherwise the running sum is not defined. ``slices``
    fixes the number of slices (tests).
    """
    by = [*[F.col(c).asc() for c in group_cols], *order_cols]
    ranged = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    ranged = materialize(ranged.withColumn("_slice", F.spark_partition_id()))
    keys = [*group_cols, "_slice"]
    w_local = (Window.partitionBy(*keys).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select(
        "*",
        F.sum(value_col).over(w_local).alias("_lcum"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(*order_cols)).alias("_lrank"),
    )
    # One row per (group, slice): offsets of earlier slices of the same group.
    w_prev = (Window.partitionBy(*group_cols).orderBy("_slice")
              .rowsBetween(Window.unboundedPreceding, -1))
    w_all = Window.partitionBy(*group_cols)
    blocks = (
        ranged.groupBy(*keys)
        .agg(F.sum(value_col).alias("_bsum"), F.count(F.lit(1)).alias("_bcnt"))
        .select(
            *keys,
            F.coalesce(F.sum("_bsum").over(w_prev), F.lit(0)).alias("_off"),
            F.coalesce(F.sum("_bcnt").over(w_prev), F.lit(0)).alias("_roff"),
            F.sum("_bsum").over(w_all).alias(total_col),
        )
    )
    out = local.join(blocks, keys, "inner")
    return out.select(
        *[c for c in df.columns],
        (F.col("_lcum") + F.col("_off")).alias(cum_col),
        (F.col("_lrank") + F.col("_roff")).cast("int").alias(rank_col),
        F.col(total_col),
    )
