"""Day, week and month marts that are kept up by day.

Three folders below one path, each partitioned by the first day of its periods.
A load brings whole days: their partitions of the day mart are replaced (dynamic
partition overwrite), and only the weeks and months in which such a day lies are
summed again, from the day mart, reading the partitions of those periods alone.
All other files stay as they are.

A load that is run again has the same result, so a load that failed between two
folders is mended by running it again.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfrank.functions.periods import GRANULARITIES
from shelfrank.operators.marts import first_day, period_of
from shelfrank.session import drop_path, drop_table, persist_table

#: A mart's columns in its folder; ``k`` is the first day of the period.
SCHEMA = "store_id string, product string, value decimal(38,2), k date"


def _replace(mart: DataFrame, path: str) -> None:
    mart.hint("rebalance", "k").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("k").parquet(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def load_days(sales: DataFrame, path: str, days: Iterable[date] | None = None) -> dict[str, int]:
    """Puts the whole days of ``sales`` (store_id, product, value, d) into the
    marts below ``path``; periods written by granularity.

    ``days``: the days that the load covers, where it may be that some of them
    have no sales any more; by default those with sales. Undated sales are left
    out, as in the multi-granularity job (P6b). The days and periods of a load
    are listed on the driver, as the calendar bounds them.
    """
    spark, base = sales.sparkSession, path.rstrip("/")
    dated = sales.where(F.col("d").isNotNull())
    if days is not None:
        days = set(days)
        dated = dated.where(F.col("d").isin(sorted(days)))
    mart = persist_table(dated.groupBy("store_id", "product", F.col("d").alias("k")).agg(F.sum("value").cast("decimal(38,2)").alias("value")),
                         spark, "loaded-days")
    found = {r.k for r in mart.select("k").distinct().collect()}
    _replace(mart, f"{base}/day")
    drop_table(mart)
    for gone in sorted((days or set()) - found):
        drop_path(spark, f"{base}/day/k={gone.isoformat()}")
    changed, written = found | (days or set()), {"day": len(found)}
    if not changed:
        return written
    listed = spark.createDataFrame([(d,) for d in sorted(changed)], "d date")
    for g in GRANULARITIES:
        if g == "day":
            continue
        starts = [r.k for r in listed.select(first_day(F.col("d"), g).alias("k")).distinct().collect()]
        # a condition on the partition column alone: other days' files are not opened
        own = _read(spark, f"{base}/day").withColumn("k", first_day(F.col("k"), g)).where(F.col("k").isin(starts))
        _replace(own.groupBy("store_id", "product", "k").agg(F.sum("value").cast("decimal(38,2)").alias("value")), f"{base}/{g}")
        left = {r.k for r in _read(spark, f"{base}/day").select("k").distinct().select(first_day(F.col("k"), g).alias("k")).distinct().collect()}
        for gone in sorted(set(starts) - left):
            drop_path(spark, f"{base}/{g}/k={gone.isoformat()}")
        written[g] = len(set(starts) & left)
    return written


def read_marts(spark: SparkSession, path: str, granularities: Iterable[str] = GRANULARITIES) -> DataFrame:
    """The kept marts as ``marts.multi_granularity_mart`` has them: granularity,
    store_id, period, product, value. Marts that were never loaded are empty."""
    out = None
    for g in granularities:
        m = _read(spark, f"{path.rstrip('/')}/{g}")
        m = m.select(F.lit(g).alias("granularity"), "store_id", period_of("k", g).alias("period"), "product", "value")
        out = m if out is None else out.unionByName(m)
    return out
