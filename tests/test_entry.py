"""Driver contract and FIXTURES §2 counts."""

from pyspark.sql import functions as F

import __spark_entry__ as e


def test_entry_region_stores_counts(spark):
    df = e.entry(spark)
    rows = df.collect()
    assert len(rows) == 310
    by = {}
    for r in rows:
        by[r.abc_class] = by.get(r.abc_class, 0) + 1
    assert by == {"A": 173, "B": 74, "C": 63}


def test_every_query_has_a_callable(spark):
    qs, sqls = e.queries(), e.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 50


def test_monthly_ranking_counts_sf001(spark):
    df = e.queries()["monthly_top_bottom"](spark, "/root/testdata/sf0.01")
    got = {r.kind: r.n for r in df.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"TOP 10": 11230, "BOTTOM 10": 11230, "GERAL": 12480}


def test_scale_conf_bounds():
    from shelfrank.session import scale_conf
    big = scale_conf(100 * 10**12, 4000)  # 100 TB: a quarter of it in 256 MiB partitions
    assert 90_000 < int(big["spark.sql.shuffle.partitions"]) < 95_000
    assert big["spark.sql.adaptive.enabled"] == "true"
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(10**9, 8)  # 1 GB on 8 cores: at least 3 waves
    assert small["spark.sql.shuffle.partitions"] == "24"
