"""Plan shape: month ranges reach the parquet scan, and a ranking whose
caller drops the period total still reads the fact once."""

import os
import re
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from shelfrank.operators import marts, ranking


def _fact(spark, tmp_dir):
    rows = [(f"s{i % 3}", f"p{i % 40}", Decimal(i % 97 + 1), date(2024, 1, 1) + timedelta(days=i % 120))
            for i in range(3000)]
    path = os.path.join(tmp_dir, "fact")
    spark.createDataFrame(rows, "store_id string, product string, value decimal(18,2), d date") \
        .write.parquet(path)
    return spark.read.parquet(path)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_month_range_is_pushed_into_the_scan(spark, tmp_dir):
    plan = _plan(marts.product_month_sales(marts.in_month_range(_fact(spark, tmp_dir), "2024-02", "2024-03")))
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", plan).group(1)
    assert "GreaterThanOrEqual(d,2024-02-01)" in pushed and "LessThan(d,2024-04-01)" in pushed


def test_rankings_read_the_fact_once_and_sort_once(spark, tmp_dir):
    """Both ends, sums and totals from one scan, one sort and no join."""
    fact = _fact(spark, tmp_dir)
    lists = ranking.monthly_lists(marts.product_month_sales(fact), ("store_id", "month"))
    sums = ranking.with_sums(lists)
    flat = ranking.monthly_top_bottom(marts.product_month_sales(fact), ("store_id", "month"))
    overlap = ranking.top_bottom_overlap(marts.period_mart(fact, "month"))
    for df in (sums.drop("items", "period_total"), flat, overlap):
        plan = _plan(df)
        assert len(re.findall("FileScan", plan)) == 1 and "Join" not in plan
        assert len(re.findall(r"\bSort \[", plan)) == 1, plan
    assert sums.count() == flat.select("store_id", "month").distinct().count()
    assert sums.filter(F.col("n_items") > 20).count() == 0
    plain = {tuple(r) for r in ranking.kind_sums(flat, ("store_id", "month")).collect()}
    assert {tuple(r) for r in sums.select("store_id", "month", "top_sum", "bottom_sum", "n_items").collect()} == plain


def test_a_hot_store_period_is_dealt_over_slices(spark):
    mart = spark.range(5000).select(F.lit("s").alias("store_id"), F.lit("p").alias("period"), F.concat(F.lit("x"), F.col("id")).alias("product"),
                                    (F.col("id") % 977 + 1).cast("decimal(18,2)").alias("value"))
    e = ranking.ends(mart, ["store_id", "period"], 10, 10).collect()[0]
    rows = sorted((-(i % 977 + 1), f"x{i}") for i in range(5000))
    assert [(x["product"], int(x["value"])) for x in e.top] == [(p, -v) for v, p in rows[:10]]
    assert [(x["product"], int(x["value"])) for x in e.low] == [(p, -v) for v, p in rows[-10:]]
    assert e.n_products == 5000 and e.period_total == -sum(v for v, _ in rows)
    assert re.search(r"hashpartitioning\([^)]*_salt", _plan(ranking.ends(mart, ["store_id", "period"], 10, 10)))


def test_month_over_month_has_no_join(spark, tmp_dir):
    from shelfrank.operators import variation
    mom = variation.month_over_month(marts.product_month_sales(_fact(spark, tmp_dir)))
    plan = _plan(mom)
    assert "Join" not in plan
    assert len({re.sub(r"#\d+", "", c) for c in re.findall(r"FileScan parquet \[([^\]]*)\]", plan)}) == 1


def test_period_ranking_scans_its_fact_once(spark):
    """In the plan that ran: one scan of the fact, for both facts; week and month
    reuse the day mart's exchange."""
    from shelfrank.plans import queries as q

    for fact, table in (("daily", "events"), ("sales", "lineitem")):
        df = ranking.recent_periods(q.period_lists(spark, "/root/testdata/sf0.001", fact), ("granularity", "store_id"))
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan[plan.index("== Final Plan =="):plan.index("== Initial Plan ==")]
        assert len(re.findall(rf"FileScan parquet .*{table}\.parquet", final)) == 1, final


def test_selections_are_made_in_their_row(spark):
    """Merge, classes, lists, summary and search: no join, sort, window or shuffle
    above the written rows."""
    from decimal import Decimal as D

    from shelfrank.operators import selections as S
    item = "struct<i: int, product: string, kind: string, value: decimal(18,2), pos: int, diagnosis: string, action: string>"
    rows = spark.createDataFrame([("s", "p", D(20), [(1, "X", "TOP", D(10), 1, "d1", "a"), (2, "Y", "TOP", D(10), 2, S.NO_MODEL, "-"),
                                                     (3, "X", "BOTTOM", D(10), 1, "", "-"), (4, "Z", "BOTTOM", D(0), 2, "d4", "-")])],
                                 f"store_id string, period string, total decimal(18,2), items array<{item}>").withColumn("status", F.lit(None).cast("string"))
    merged = S.merge(rows)
    done = S.classify(merged)
    for df in (merged, done, S.kind_lists(done), S.best_worst(done), S.summary(done), S.search(merged, "d")):
        assert not re.search("Join|Exchange|Sort|Window|Aggregate", _plan(df))
    products = [(x.product, int(x.value), x.kind, x["rank"], x.abc_class, [y.text for y in x.insights]) for x in done.collect()[0].products]
    assert products == [("X", 10, "TOP", 1, "A", ["d1"]), ("Y", 10, "TOP", 2, "C", []), ("Z", 0, "BOTTOM", 3, "C", ["d4"])]
    assert [int(x.value) for x in S.merge(rows, dedupe=False).collect()[0].products] == [20, 10, 0]
    assert [(x.list, x.pos, x.product) for x in S.kind_lists(done, 1).collect()[0].lists] == [("TOP", 1, "X"), ("BOTTOM", 1, "Z")]
    assert [(x.abc_class, x.list, x.product) for x in S.best_worst(done).collect()[0].lists] == [
        ("A", "best", "X"), ("A", "worst", "X"), ("C", "best", "Y"), ("C", "best", "Z"), ("C", "worst", "Y")]
    assert tuple(S.summary(done).collect()[0]) == ("s", "p", 3, 2, 2, 1, 0, 2, 50, 20.0)
    assert [tuple(r) for r in S.search(merged, " D4 ").collect()] == [("s", "p", "Z", "d4", None, 1)]
    assert {r.product for r in S.search(merged, "").collect()} == {"X", "Z"}
    assert [r.product for r in S.search(merged, "x").collect()] == ["X"]
    zero = S.classify(S.merge(rows.withColumn("total", F.lit(0).cast("decimal(18,2)"))))
    assert {x.abc_class for x in zero.collect()[0].products} == {"A"} and S.summary(zero).collect()[0].share_a is None


def test_running_totals_write_files_by_rows_not_by_shuffle_partitions(spark, tmp_dir):
    import glob

    from shelfrank.operators.prefix import running_totals
    from shelfrank.session import checkpoint_dir
    totals = marts.product_totals(_fact(spark, tmp_dir))
    checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before, files = spark.conf.get("spark.sql.shuffle.partitions"), set(glob.glob(f"{folder}/rdd-*/part-*"))
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        out = running_totals(totals, ["store_id"], [F.col("value").desc(), F.col("product").asc()])
        assert out.count() == 120
        assert len(set(glob.glob(f"{folder}/rdd-*/part-*")) - files) < 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_abc_lines_are_summed_without_a_list_per_store(spark):
    from shelfrank.plans.registry import QUERIES
    plan = _plan(QUERIES["abc_documents"](spark, "/root/testdata/sf0.001"))
    assert "collect_list" not in plan and "partial_max_by" in plan


def test_nested_and_summed_lines_of_one_store(spark):
    from shelfrank.operators import documents
    lines = spark.createDataFrame([(7, "7", i, (f"p{i:02d}", 1.0, "A", {"2024-01": 1.0}, f"a{i}")) for i in (3, 0, 2, 1)], documents.ABC_LINE)
    nested = documents.nest_abc(lines).collect()[0]
    assert [x.produto for x in nested.itens] == ["p00", "p01", "p02", "p03"]
    assert documents.abc_summary(lines).collect()[0] == (7, "7", 4, "p00", "p03", "a3")
