"""Marts kept up by day, and counts taken on the job's own pass."""

import glob
import os
import re
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfrank.operators import kept_marts, marts
from shelfrank.operators.clean import clean_sales, quality_counts

FACT = "store_id string, product string, value decimal(18,2), d date"


def fact(spark, first, n, by=1):
    rows = [(f"s{i % 3}", f"p{i % 5}", Decimal(i % 17 + by), first + timedelta(i // 15)) for i in range(15 * n)]
    return spark.createDataFrame([*rows, ("s1", "p1", Decimal(9), None)], FACT)


def rows(df):
    return sorted(tuple(r) for r in df.select("granularity", "store_id", "period", "product", F.col("value").cast("decimal(38,2)")).collect())


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/part-*", recursive=True)}


def test_two_overlapping_loads_equal_one(spark, tmp_dir):
    start = date(2023, 12, 11)  # weeks and months are cut at the turn of the year
    path = f"{tmp_dir}/m"
    assert rows(kept_marts.read_marts(spark, path)) == []
    whole = fact(spark, start, 40)
    first, second = whole.where("d < date'2024-01-05' OR d IS NULL"), whole.where("d >= date'2024-01-01' OR d IS NULL")
    # the overlap had other values at the first load
    kept_marts.load_days(first.withColumn("value", F.when(F.col("d") >= F.lit(date(2024, 1, 1)), F.lit(1).cast("decimal(18,2)")).otherwise(F.col("value"))), path)
    before = files(path)
    assert kept_marts.load_days(second, path) == {"day": 19, "week": 3, "month": 1}
    want = rows(marts.multi_granularity_mart(whole.where("d IS NOT NULL")))
    assert rows(kept_marts.read_marts(spark, path)) == want
    # December and its weeks, and the days before the overlap, were not written
    after = files(path)
    assert all(after.get(f) == t for f, t in before.items() if re.search(r"/(day|week|month)/k=2023", f))
    assert not any(f in after for f in before if "/day/k=2024" in f)
    again = files(path)
    kept_marts.load_days(spark.createDataFrame([], FACT), path)
    assert files(path) == again


def test_days_that_lost_their_sales(spark, tmp_dir):
    path, start = f"{tmp_dir}/m", date(2024, 3, 1)
    kept_marts.load_days(fact(spark, start, 10), path)
    gone = [start + timedelta(i) for i in range(3, 10)]
    kept_marts.load_days(spark.createDataFrame([], FACT), path, days=gone)
    left = fact(spark, start, 10).where(F.col("d") < F.lit(gone[0]))
    assert rows(kept_marts.read_marts(spark, path)) == rows(marts.multi_granularity_mart(left))
    kept_marts.load_days(spark.createDataFrame([], FACT), path, days=[start + timedelta(i) for i in range(10)])
    assert rows(kept_marts.read_marts(spark, path)) == []


def test_weeks_read_their_own_days_only(spark, tmp_dir):
    path = f"{tmp_dir}/m"
    kept_marts.load_days(fact(spark, date(2024, 3, 1), 30), path)
    own = kept_marts._read(spark, f"{path}/day").withColumn("k", marts.first_day(F.col("k"), "week")).where(F.col("k").isin([date(2024, 3, 4)]))
    own.collect()
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*k", plan)


def test_counts_come_from_the_job_s_own_pass(spark, tmp_dir):
    raw = spark.createDataFrame([("1", "A", "1,00", "01/01/2024"), ("1", " ", "2,00", "01/01/2024"), (None, "B", "3,005", "x"),
                                 ("2", "C", "-1,00", "02/01/2024"), ("2", "C", "junk", "02/01/2024"), ("2", "D", "5,00", "31/02/2024")],
                                "store_id string, product string, value_raw string, date_raw string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    counts = Observation("quality")
    cleaned = clean_sales(raw.mapInArrow(count, raw.schema), counts=counts)
    marts.product_month_sales(cleaned).write.parquet(f"{tmp_dir}/mart")
    assert counts.get == quality_counts(raw).first().asDict()
    assert seen.value == 6
