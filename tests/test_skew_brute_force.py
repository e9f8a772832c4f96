"""Rankings, month-on-month and the multi-granularity mart against plain
Python on a skewed fixture: one store-period holds most rows, with many ties;
other groups sit on the 20/21-product boundary of the TOP/BOTTOM rule."""

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

from shelfrank.config import DEFAULT
from shelfrank.operators import marts, ranking, variation

MART = "store_id string, period string, product string, value decimal(18,2)"


def _skewed_mart(spark):
    rnd = random.Random(11)
    rows = [("hot", "2024-01", f"p{i:05d}", Decimal(rnd.randint(0, 40))) for i in range(4000)]
    for j, n in enumerate([1, 5, 19, 20, 21, 25, 40]):
        rows += [(f"s{j}", "2024-02", f"q{i:03d}", Decimal(rnd.randint(0, 6))) for i in range(n)]
    return rows, spark.createDataFrame(rows, MART)


def _groups(rows):
    g = defaultdict(list)
    for s, p, prod, v in rows:
        g[(s, p)].append((prod, v))
    # Value descending, ties by product ascending
    return {k: sorted(v, key=lambda x: (-x[1], x[0])) for k, v in g.items()}


def test_monthly_top_bottom_matches_python_on_skew(spark):
    rows, mart = _skewed_mart(spark)
    tn, bn = DEFAULT.top_n, DEFAULT.bottom_n
    want = set()
    for (s, p), items in _groups(rows).items():
        n, total = len(items), sum(v for _, v in items)
        for r, (prod, v) in enumerate(items, 1):
            if n <= tn + bn:
                kind = "GERAL"
            elif r <= tn:
                kind = f"TOP {tn}"
            elif n - r < bn:
                kind = f"BOTTOM {bn}"
            else:
                continue
            want.add((s, p, prod, kind, v, r, n, total))
    got = {tuple(r) for r in ranking.monthly_top_bottom(mart).select(
        "store_id", "period", "product", "kind", "value", "rank", "n_products", "period_total").collect()}
    assert got == want


def test_overlap_lists_match_python_on_skew(spark):
    rows, mart = _skewed_mart(spark)
    want = set()
    for (s, p), items in _groups(rows).items():
        for pos, (prod, v) in enumerate(items[:DEFAULT.top_n], 1):
            want.add((s, p, prod, "TOP", v, pos))
        positive = [x for x in items if x[1] > 0]
        for pos, (prod, v) in enumerate(positive[-DEFAULT.bottom_n:], 1):
            want.add((s, p, prod, "BOTTOM", v, pos))
    got = {tuple(r) for r in ranking.top_bottom_overlap(mart).select(
        "store_id", "period", "product", "kind", "value", "pos").collect()}
    assert got == want


def test_month_over_month_matches_python(spark):
    rnd = random.Random(5)
    months = [f"{y}-{m:02d}" for y in (2023, 2024) for m in range(1, 13)]
    rows = []
    for prod in range(60):
        # gaps on purpose: a product skips months, so "previous" is often absent
        for mo in rnd.sample(months, rnd.randint(1, 20)):
            rows.append(("hot" if prod < 40 else "s1", f"p{prod}", mo, Decimal(rnd.randint(0, 900)) / 4))
    df = spark.createDataFrame(rows, "store_id string, product string, month string, value decimal(18,2)")
    val = {(s, p, m): v for s, p, m, v in rows}

    def prev_month(m):
        y, mm = int(m[:4]), int(m[5:])
        return f"{y - 1}-12" if mm == 1 else f"{y}-{mm - 1:02d}"

    got = {(r.store_id, r.product, r.month): (r.previous, r.change_text)
           for r in variation.month_over_month(df).collect()}
    assert set(got) == set(val)
    for k, v in val.items():
        prev = val.get((k[0], k[1], prev_month(k[2])), Decimal(0))
        text = got[k][1]
        assert got[k][0] == prev
        if prev > 0:
            ratio = (v - prev) / prev * 100
            tenths = int((abs(ratio) * 10 + Decimal("0.5")).to_integral_value(rounding="ROUND_FLOOR"))
            assert text == f"{'-' if ratio < 0 else '+'}{tenths // 10}.{tenths % 10}%"
        else:
            assert text == ("Novo (sem vendas anteriores)" if v > 0 else "Sem dados")


def test_week_and_month_sums_equal_day_sums(spark):
    rnd = random.Random(9)
    start = date(2023, 12, 20)
    rows = [("hot" if i % 3 else "s2", f"p{rnd.randint(0, 30)}", Decimal(rnd.randint(1, 500)),
             start + timedelta(days=rnd.randint(0, 70))) for i in range(3000)]
    df = spark.createDataFrame(rows, "store_id string, product string, value decimal(18,2), d date")
    m = marts.multi_granularity_mart(df)
    tot = {(r.granularity, r.store_id): r.v for r in
           m.groupBy("granularity", "store_id").agg({"value": "sum"}).withColumnRenamed("sum(value)", "v").collect()}
    for s in ("hot", "s2"):
        want = sum(v for st, _, v, _ in rows if st == s)
        assert tot[("day", s)] == tot[("week", s)] == tot[("month", s)] == want
    # %W keys: the days before the year's first Monday are week 00
    keys = {r.period for r in m.filter("granularity = 'week'").collect()}
    assert "2024-W00" not in keys and "2023-W51" in keys  # 2024 starts on a Monday
    assert {r.period for r in m.filter("granularity = 'day' AND period = '2024-01-01'").collect()}


def test_granularity_subset_equals_full_mart_rows(spark):
    rows = [("s", f"p{i % 7}", Decimal(i), date(2024, 1, 1) + timedelta(days=i % 40)) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "store_id string, product string, value decimal(18,2), d date")
    full = marts.multi_granularity_mart(df)
    only = marts.multi_granularity_mart(df, granularities=("week",))
    assert {r.granularity for r in only.collect()} == {"week"}
    assert sorted(only.collect()) == sorted(full.filter("granularity = 'week'").collect())


def test_month_range_keeps_whole_months(spark):
    rows = [("s", "a", Decimal(1), date(2024, 1, 31)), ("s", "a", Decimal(2), date(2024, 2, 1)),
            ("s", "a", Decimal(4), date(2024, 3, 31)), ("s", "a", Decimal(8), date(2024, 4, 1)),
            ("s", "a", Decimal(16), None)]
    df = spark.createDataFrame(rows, "store_id string, product string, value decimal(18,2), d date")
    got = {r.month: r.value for r in marts.product_month_sales(marts.in_month_range(df, "2024-02", "2024-03"))
           .collect()}
    assert got == {"2024-02": Decimal("2.00"), "2024-03": Decimal("4.00")}


def test_product_free_totals_equal_mart_totals(spark):
    rnd = random.Random(4)
    rows = [(f"s{i % 3}", f"p{rnd.randint(0, 20)}", Decimal(rnd.randint(1, 900)) / 4,
             date(2024, 1, 1) + timedelta(days=rnd.randint(0, 60))) for i in range(2000)]
    df = spark.createDataFrame(rows, "store_id string, product string, value decimal(18,2), d date")
    keys = ("granularity", "store_id", "period")
    via_mart = marts.period_totals(marts.multi_granularity_mart(df), keys)
    direct = marts.multi_granularity_mart(df, item_cols=()).withColumnRenamed("value", "total")
    assert sorted(via_mart.collect()) == sorted(direct.select(*keys, "total").collect())
