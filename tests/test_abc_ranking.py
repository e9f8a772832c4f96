"""ABC limits (F-E), running totals vs brute force, rankings (F-I), variation."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfrank.operators import abc, marts, ranking, variation
from shelfrank.operators.prefix import running_totals

SCHEMA = "store_id string, product string, value decimal(18,2)"


def classes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = abc.classify(df).orderBy("store_id", "rank").collect()
    return [(r.product, r.abc_class) for r in out]


def test_abc_limits(spark):
    assert classes(spark, [("s", "a", Decimal(80)), ("s", "b", Decimal(15)), ("s", "c", Decimal(5))]) == \
        [("a", "A"), ("b", "B"), ("c", "C")]
    assert classes(spark, [("s", "only", Decimal(10))]) == [("only", "C")]
    assert classes(spark, [("s", "a", Decimal(50)), ("s", "b", Decimal(30)), ("s", "d", Decimal(10)),
                           ("s", "c", Decimal(10))]) == [("a", "A"), ("b", "A"), ("c", "B"), ("d", "C")]
    ten = [("s", f"p{i}", Decimal(1)) for i in range(10)]
    got = [c for _, c in classes(spark, ten)]
    assert got.count("A") == 8 and got.count("B") == 1 and got.count("C") == 1
    assert classes(spark, [("s", "z", Decimal(0))]) == []  # zero total -> no items (A8)


def test_running_totals_match_plain_window_on_skew(spark):
    rnd = random.Random(7)
    rows = [("hot", f"p{i:05d}", Decimal(rnd.randint(1, 50))) for i in range(3000)]  # many ties
    rows += [(f"s{j}", f"p{i}", Decimal(rnd.randint(1, 9))) for j in range(20) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    order = [F.col("value").desc(), F.col("product").asc()]
    fast = running_totals(df, ["store_id"], order, slices=16)
    w = Window.partitionBy("store_id").orderBy(*order)
    brute = df.select("store_id", "product",
                      F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_value"),
                      F.row_number().over(w).alias("rank"),
                      F.sum("value").over(Window.partitionBy("store_id")).alias("group_total"))
    a = sorted(tuple(r) for r in fast.select("store_id", "product", "cum_value", "rank", "group_total").collect())
    b = sorted(tuple(r) for r in brute.collect())
    assert a == b


def test_abc_invariants(spark):
    rnd = random.Random(3)
    rows = [(f"s{j}", f"p{i}", Decimal(rnd.randint(1, 1000)) / 100) for j in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    c = abc.classify(df)
    mix = abc.class_mix(c).groupBy("store_id").agg(F.sum("class_value").alias("v"))
    tot = marts.store_totals(df)
    assert sorted(mix.collect()) == sorted(tot.withColumnRenamed("total", "v").collect())
    # class is monotone in rank
    for s in range(4):
        seq = [r.abc_class for r in c.filter(F.col("store_id") == f"s{s}").orderBy("rank").collect()]
        assert seq == sorted(seq)


def _mart(spark, n):
    rows = [("s", "2024-01", f"p{i:02d}", Decimal(100 - i)) for i in range(n)]
    return spark.createDataFrame(rows, "store_id string, period string, product string, value decimal(18,2)")


def test_monthly_top_bottom_sizes(spark):
    for n, kinds in [(3, {"GERAL": 3}), (20, {"GERAL": 20}), (25, {"TOP 10": 10, "BOTTOM 10": 10})]:
        r = ranking.monthly_top_bottom(_mart(spark, n)).collect()
        got = {}
        for x in r:
            got[x.kind] = got.get(x.kind, 0) + 1
        assert got == kinds
    r = ranking.monthly_top_bottom(_mart(spark, 25)).collect()
    ranks = sorted(x["rank"] for x in r)
    assert ranks == list(range(1, 11)) + list(range(16, 26))


def test_overlap_sizes(spark):
    for n, total, twice in [(3, 6, 3), (15, 20, 5), (25, 20, 0)]:
        r = ranking.top_bottom_overlap(_mart(spark, n)).collect()
        assert len(r) == total
        names = [x.product for x in r]
        assert sum(1 for p in set(names) if names.count(p) == 2) == twice


def test_month_over_month_uses_calendar_month(spark):
    rows = [("s", "a", "2024-01", Decimal(100)), ("s", "a", "2024-02", Decimal("127.6")),
            ("s", "a", "2024-05", Decimal(50)), ("s", "b", "2024-02", Decimal(0))]
    df = spark.createDataFrame(rows, "store_id string, product string, month string, value decimal(18,2)")
    got = {(r.product, r.month): (r.previous, r.change_pct, r.change_text)
           for r in variation.month_over_month(df).collect()}
    assert got[("a", "2024-02")] == (Decimal("100.00"), 27.6, "+27.6%")
    assert got[("a", "2024-05")][2] == "Novo (sem vendas anteriores)"  # April had no sales
    assert got[("a", "2024-01")][1] == 100.0
    assert got[("b", "2024-02")][2] == "Sem dados"


def test_month_over_month_text_months_and_nat(spark):
    # text month keys (no month_start column), an undated bucket, a year boundary
    rows = [("s", "a", "2023-12", Decimal(10)), ("s", "a", "2024-01", Decimal(20)),
            ("s", "a", "NaT", Decimal(5)), ("s", "b", "2024-01", Decimal(7))]
    df = spark.createDataFrame(rows, "store_id string, product string, month string, value decimal(18,2)")
    got = {(r.product, r.month): (r.value, r.previous, r.change_text)
           for r in variation.month_over_month(df).collect()}
    assert set(got) == {("a", "2023-12"), ("a", "2024-01"), ("a", "NaT"), ("b", "2024-01")}
    assert got[("a", "2024-01")] == (Decimal("20.00"), Decimal("10.00"), "+100.0%")
    assert got[("a", "NaT")][1:] == (Decimal("0.00"), "Novo (sem vendas anteriores)")
    assert got[("b", "2024-01")][2] == "Novo (sem vendas anteriores)"


# ------------------------------------------------------------ classes without ranks

@pytest.mark.parametrize("seed", range(3))
def test_classes_by_weighted_selection_equal_the_ranking(spark, seed):
    """Groups with ties, one product, one huge product, zeros, and equal values only."""
    import random
    rng = random.Random(seed)
    rows = []
    for s in range(12):
        n = rng.choice([1, 2, 5, 40, 200])
        pool = rng.choice([[5], [1, 2], [0, 1, 3], list(range(1, 1000)), [10 ** 9, 1, 2, 3]])
        rows += [(f"s{s}", f"p{rng.randrange(10 ** 6)}-{i}", Decimal(rng.choice(pool)) / rng.choice([1, 100])) for i in range(n)]
    rows += [("flat", f"p{i}", Decimal(7)) for i in range(100)] + [("none", "p", Decimal(0)), ("none", "q", Decimal(0))]
    df = spark.createDataFrame(rows, "store_id string, product string, value decimal(28,2)")
    want = {tuple(r) for r in abc.classify(df).select("store_id", "product", "value", "group_total", "abc_class").collect()}
    got = [tuple(r) for r in abc.classes(df).collect()]
    assert len(got) == len(want) and set(got) == want


def test_class_mix_sorts_and_checkpoints_nothing(spark, tmp_dir):
    df = spark.createDataFrame([("s", f"p{i}", Decimal(i + 1)) for i in range(50)], "store_id string, product string, value decimal(28,2)")
    df.write.parquet(f"{tmp_dir}/t")
    plan = abc.class_mix(abc.classes(spark.read.parquet(f"{tmp_dir}/t")))._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ExistingRDD" not in plan
    with pytest.raises(Exception, match="0 or more"):
        abc.classes(spark.createDataFrame([("s", "p", Decimal(-1)), ("s", "q", Decimal(5))], df.schema)).collect()
