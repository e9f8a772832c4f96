"""Registered queries over the driver's tables and their DuckDB twins.

Each query reads whole tables. Decimals are exact through the plan and cast
to double only in the last projection, in both engines (SURVEY D5).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from shelfrank.operators import abc, marts, selections
from shelfrank.plans.registry import ORACLE, query
from shelfrank.plans.stub_model import stub_annotator
from shelfrank.sources.tables import DAILY_SQL, SALES_SQL, daily_fact, sales_fact


def with_sales(ctes_and_select: str, daily: bool = False) -> str:
    """``WITH sales AS (<fact>)`` + the rest (which starts with ``,`` or ``SELECT``)."""
    return f"WITH sales AS ({DAILY_SQL if daily else SALES_SQL}){ctes_and_select}"


def dbl(c):
    return F.col(c).cast("double")


# --------------------------------------------------------------------------- ABC

ABC_CTES = """,
t AS (SELECT store_id, product, SUM(value) AS value FROM sales GROUP BY store_id, product),
r AS (
  SELECT store_id, product, value,
         SUM(value) OVER (PARTITION BY store_id ORDER BY value DESC, product
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_value,
         CAST(ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY value DESC, product) AS INTEGER) AS rank,
         SUM(value) OVER (PARTITION BY store_id) AS group_total
  FROM t),
c AS (
  SELECT *, CASE WHEN cum_value * 100 <= group_total * 80 THEN 'A'
                 WHEN cum_value * 100 <= group_total * 95 THEN 'B' ELSE 'C' END AS abc_class
  FROM r WHERE group_total > 0)
"""


def abc_frame(spark, sf):
    return abc.classify(marts.product_totals(sales_fact(spark, sf)))


@query("abc_classes", with_sales(ABC_CTES + """
SELECT store_id, product, CAST(value AS DOUBLE) AS total_value, rank,
       CAST(value AS DOUBLE) / CAST(group_total AS DOUBLE) * 100.0 AS share_pct,
       CAST(cum_value AS DOUBLE) / CAST(group_total AS DOUBLE) * 100.0 AS cum_pct,
       abc_class
FROM c"""))
def q_abc_classes(spark, sf):
    return abc_frame(spark, sf).select(
        "store_id", "product", dbl("value").alias("total_value"), "rank",
        "share_pct", "cum_pct", "abc_class")


# --------------------------------------------------------------------------- marts

MONTH_MART_CTE = """,
m AS (SELECT store_id, product, strftime(d, '%Y-%m') AS month, SUM(value) AS value
      FROM sales GROUP BY store_id, product, strftime(d, '%Y-%m'))
"""


def month_mart(spark, sf):
    return marts.product_month_sales(sales_fact(spark, sf))


@query("product_month_sales", with_sales(MONTH_MART_CTE + """
SELECT store_id, product, month, CAST(value AS DOUBLE) AS value FROM m"""))
def q_product_month_sales(spark, sf):
    return month_mart(spark, sf).select("store_id", "product", "month", dbl("value").alias("value"))


@query("product_month_history", with_sales(MONTH_MART_CTE + """
SELECT store_id, product, CAST(SUM(value) AS DOUBLE) AS total_value,
       CAST(COUNT(*) AS INTEGER) AS n_months,
       string_agg(month || '=' || CAST(value AS VARCHAR), ';' ORDER BY month) AS history
FROM m GROUP BY store_id, product"""))
def q_product_month_history(spark, sf):
    h = marts.product_history(month_mart(spark, sf))
    text = F.array_join(F.transform(F.map_entries("history"),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return h.select("store_id", "product", dbl("value").alias("total_value"),
                    F.size("history").alias("n_months"), text.alias("history"))


PERIOD_SQL = {
    "day": "strftime(d, '%Y-%m-%d')",
    "week": "strftime(d, '%Y-W%W')",
    "month": "strftime(d, '%Y-%m')",
}


def _mart_sql(g: str) -> str:
    return with_sales(f"""
SELECT store_id, {PERIOD_SQL[g]} AS period, product, CAST(SUM(value) AS DOUBLE) AS value
FROM sales GROUP BY store_id, {PERIOD_SQL[g]}, product""", daily=True)


def _register_mart(g: str):
    @query(f"{g}_mart", _mart_sql(g))
    def q(spark, sf):
        return marts.period_mart(daily_fact(spark, sf), g).select(
            "store_id", "period", "product", dbl("value").alias("value"))
    return q


for _g in ("day", "week", "month"):
    _register_mart(_g)


MULTI_CTE = f""",
mm AS (
  SELECT 'day' AS granularity, store_id, {PERIOD_SQL['day']} AS period, product, SUM(value) AS value
  FROM sales GROUP BY store_id, {PERIOD_SQL['day']}, product
  UNION ALL
  SELECT 'week', store_id, {PERIOD_SQL['week']}, product, SUM(value)
  FROM sales GROUP BY store_id, {PERIOD_SQL['week']}, product
  UNION ALL
  SELECT 'month', store_id, {PERIOD_SQL['month']}, product, SUM(value)
  FROM sales GROUP BY store_id, {PERIOD_SQL['month']}, product)
"""


def multi_mart(spark, sf, fact: str = "daily"):
    """Day/week/month mart of the events fact (``daily``) or of the lineitem
    fact (``sales``: about one product per store-day at sf0.01, so small
    periods where TOP and BOTTOM overlap)."""
    f = daily_fact(spark, sf) if fact == "daily" else sales_fact(spark, sf)
    return marts.multi_granularity_mart(f)


@query("all_granularities", with_sales(MULTI_CTE + """
SELECT granularity, store_id, period, product, CAST(value AS DOUBLE) AS value FROM mm""", daily=True))
def q_all_granularities(spark, sf):
    return multi_mart(spark, sf).select("granularity", "store_id", "period", "product",
                                        dbl("value").alias("value"))


@query("kept_marts", with_sales(MULTI_CTE + """
SELECT granularity, store_id, period, product, CAST(value AS DOUBLE) AS value FROM mm""", daily=True))
def q_kept_marts(spark, sf):
    """A4 kept up by day: the events in two loads that overlap by ten days, the
    marts read back."""
    from datetime import timedelta

    from shelfrank.operators import kept_marts
    sales, path = daily_fact(spark, sf), _scratch(spark, "kept-marts")
    lo, hi = sales.agg(F.min("d"), F.max("d")).first()
    middle = lo + (hi - lo) / 2
    kept_marts.load_days(sales.where(F.col("d") <= F.lit(middle + timedelta(5))), path)
    kept_marts.load_days(sales.where(F.col("d") >= F.lit(middle - timedelta(5))), path)
    return kept_marts.read_marts(spark, path).withColumn("value", dbl("value"))


@query("period_totals", with_sales(MULTI_CTE + """
SELECT granularity, store_id, period, CAST(SUM(value) AS DOUBLE) AS total
FROM mm GROUP BY granularity, store_id, period""", daily=True))
def q_period_totals(spark, sf):
    # totals over all products: aggregated without the product dimension
    t = marts.multi_granularity_mart(daily_fact(spark, sf), item_cols=())
    return t.select("granularity", "store_id", "period", dbl("value").alias("total"))


# --------------------------------------------------------------------------- rankings

MONTHLY_RANK_CTES = MONTH_MART_CTE + """,
rr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, month ORDER BY value DESC, product) AS rn,
              COUNT(*) OVER (PARTITION BY store_id, month) AS n_products,
              SUM(value) OVER (PARTITION BY store_id, month) AS period_total
       FROM m),
tb AS (SELECT store_id, month, product,
              CASE WHEN n_products <= 20 THEN 'GERAL' WHEN rn <= 10 THEN 'TOP 10' ELSE 'BOTTOM 10' END AS kind,
              value, CAST(rn AS INTEGER) AS rank, n_products, period_total
       FROM rr WHERE n_products <= 20 OR rn <= 10 OR n_products - rn < 10)
"""

MONTHLY_RANK_SELECT = """
SELECT store_id, month, product, kind, CAST(value AS DOUBLE) AS value, rank, n_products,
       CAST(period_total AS DOUBLE) AS month_total
FROM tb"""


MKEYS = ["store_id", "month"]


def monthly_ranking(spark, sf):
    from shelfrank.operators import ranking
    return ranking.monthly_top_bottom(month_mart(spark, sf), MKEYS)


def monthly_rows(spark, sf):
    """W4 as one row per store-month, with the sums (A9), label (F2) and season
    (J5) that its prompt shows."""
    from shelfrank.functions.periods import month_label
    from shelfrank.operators import ranking
    from shelfrank.sources.dims import with_season
    lists = ranking.with_sums(ranking.monthly_lists(month_mart(spark, sf), MKEYS))
    return with_season(lists.withColumn("label", month_label("month")), spark)


def _monthly_out(df):
    return df.select("store_id", "month", "product", "kind", dbl("value").alias("value"), "rank",
                     "n_products", dbl("period_total").alias("month_total"))


@query("monthly_top_bottom", with_sales(MONTHLY_RANK_CTES + MONTHLY_RANK_SELECT))
def q_monthly_top_bottom(spark, sf):
    return _monthly_out(monthly_ranking(spark, sf))


# One store, one store-month, a month range — the filters are the
# operators; Catalyst pushes the store filter below the aggregate.
SINGLE_STORE = "1"
SINGLE_MONTH = "1997-06"
RANGE_LO, RANGE_HI = "1996-01", "1996-12"


@query("single_store_monthly", with_sales(MONTHLY_RANK_CTES + MONTHLY_RANK_SELECT
                                          + f"\nWHERE store_id = '{SINGLE_STORE}'"))
def q_single_store_monthly(spark, sf):
    from shelfrank.operators import ranking
    m = month_mart(spark, sf).filter(F.col("store_id") == SINGLE_STORE)
    return _monthly_out(ranking.monthly_top_bottom(m, ("store_id", "month")))


@query("single_period", with_sales(MONTHLY_RANK_CTES + MONTHLY_RANK_SELECT
                                   + f"\nWHERE store_id = '{SINGLE_STORE}' AND month = '{SINGLE_MONTH}'"))
def q_single_period(spark, sf):
    from shelfrank.operators import ranking
    s = marts.in_month_range(sales_fact(spark, sf), SINGLE_MONTH, SINGLE_MONTH)
    m = marts.product_month_sales(s.filter(F.col("store_id") == SINGLE_STORE))
    return _monthly_out(ranking.monthly_top_bottom(m, ("store_id", "month")))


@query("period_range", with_sales(MONTHLY_RANK_CTES + MONTHLY_RANK_SELECT
                                  + f"\nWHERE month BETWEEN '{RANGE_LO}' AND '{RANGE_HI}'"))
def q_period_range(spark, sf):
    from shelfrank.operators import ranking
    s = marts.in_month_range(sales_fact(spark, sf), RANGE_LO, RANGE_HI)
    return _monthly_out(ranking.monthly_top_bottom(marts.product_month_sales(s), ("store_id", "month")))


@query("top_bottom_sums", with_sales(MONTHLY_RANK_CTES + """
SELECT store_id, month,
       CAST(COALESCE(SUM(CASE WHEN kind LIKE '%TOP%' THEN value END), 0) AS DOUBLE) AS top_sum,
       CAST(COALESCE(SUM(CASE WHEN kind LIKE '%BOTTOM%' THEN value END), 0) AS DOUBLE) AS bottom_sum,
       COUNT(*) AS n_items
FROM tb GROUP BY store_id, month"""))
def q_top_bottom_sums(spark, sf):
    from shelfrank.operators import ranking
    s = ranking.with_sums(ranking.monthly_lists(month_mart(spark, sf), MKEYS))
    return s.select("store_id", "month", dbl("top_sum").alias("top_sum"),
                    dbl("bottom_sum").alias("bottom_sum"), "n_items")


@query("period_top_bottom_overlap", with_sales(MULTI_CTE + """,
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY granularity, store_id, period ORDER BY value DESC, product) AS rn,
             COUNT(*) OVER (PARTITION BY granularity, store_id, period) AS n
      FROM mm),
pv AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY granularity, store_id, period ORDER BY value DESC, product) AS prn,
              COUNT(*) OVER (PARTITION BY granularity, store_id, period) AS np
       FROM mm WHERE value > 0)
SELECT granularity, store_id, period, product, 'TOP' AS kind, CAST(value AS DOUBLE) AS value,
       CAST(rn AS INTEGER) AS pos FROM o WHERE rn <= 10
UNION ALL
SELECT granularity, store_id, period, product, 'BOTTOM', CAST(value AS DOUBLE),
       CAST(prn - GREATEST(np - 10, 0) AS INTEGER) FROM pv WHERE np - prn < 10""", daily=True))
def q_period_top_bottom_overlap(spark, sf):
    from shelfrank.operators import ranking
    r = ranking.top_bottom_overlap(multi_mart(spark, sf), ("granularity", "store_id", "period"))
    return r.select("granularity", "store_id", "period", "product", "kind",
                    dbl("value").alias("value"), "pos")


@query("last_seven_periods", with_sales(MULTI_CTE + """
SELECT granularity, store_id, period,
       CAST(ROW_NUMBER() OVER (PARTITION BY granularity, store_id ORDER BY period DESC) AS INTEGER) AS recency,
       ROW_NUMBER() OVER (PARTITION BY granularity, store_id ORDER BY period DESC) <= 7 AS annotated
FROM (SELECT DISTINCT granularity, store_id, period FROM mm) p""", daily=True))
def q_last_seven_periods(spark, sf):
    from shelfrank.operators import ranking
    # a store's periods, without the product dimension
    t = marts.multi_granularity_mart(daily_fact(spark, sf), item_cols=())
    return ranking.recent_periods(t, ("granularity", "store_id")).select(
        "granularity", "store_id", "period", "recency", "annotated")


@query("latest_period", with_sales(MULTI_CTE + """
SELECT granularity, store_id, MAX(period) AS latest_period FROM mm GROUP BY granularity, store_id""",
                                   daily=True))
def q_latest_period(spark, sf):
    from shelfrank.operators import ranking
    return ranking.latest_period(marts.multi_granularity_mart(daily_fact(spark, sf), item_cols=()),
                                 ("granularity", "store_id"))


# --------------------------------------------------------------------------- variation, dims, labels

@query("month_over_month", with_sales(MONTH_MART_CTE + """,
j AS (SELECT a.store_id, a.product, a.month, a.value, COALESCE(b.value, 0) AS previous,
             CAST(a.value * 100 AS BIGINT) AS cur_c, CAST(COALESCE(b.value, 0) * 100 AS BIGINT) AS prev_c
      FROM m a LEFT JOIN m b
        ON a.store_id = b.store_id AND a.product = b.product
       AND b.month = strftime(CAST(a.month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')),
k AS (SELECT *, (cur_c - prev_c) * 1000 AS num FROM j),
t AS (SELECT *, CASE WHEN prev_c > 0 THEN (2 * abs(num) + prev_c) // (2 * prev_c) END AS tenths FROM k)
SELECT store_id, product, month, CAST(value AS DOUBLE) AS value, CAST(previous AS DOUBLE) AS previous,
       CASE WHEN prev_c > 0 THEN CAST(CASE WHEN num < 0 THEN -tenths ELSE tenths END AS DOUBLE) / 10.0
            WHEN cur_c > 0 THEN 100.0 ELSE 0.0 END AS change_pct,
       CASE WHEN prev_c > 0 THEN (CASE WHEN num < 0 THEN '-' ELSE '+' END) || CAST(tenths // 10 AS VARCHAR)
                                 || '.' || CAST(tenths % 10 AS VARCHAR) || '%'
            WHEN cur_c > 0 THEN 'Novo (sem vendas anteriores)' ELSE 'Sem dados' END AS change_text
FROM t"""))
def q_month_over_month(spark, sf):
    from shelfrank.operators import variation
    v = variation.month_over_month(month_mart(spark, sf))
    return v.select("store_id", "product", "month", dbl("value").alias("value"),
                    dbl("previous").alias("previous"), "change_pct", "change_text")


def _season_values() -> str:
    from shelfrank.sources.dims import SEASONS

    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(m)}, {q(a)}, {q(b)}, {q(c)})" for m, a, b, c in SEASONS)


def _month_names_sql() -> str:
    from shelfrank.functions.periods import MONTH_NAMES
    return "[" + ", ".join(f"'{n}'" for n in MONTH_NAMES) + "]"


@query("season_context", with_sales(f""",
mt AS (SELECT store_id, strftime(d, '%Y-%m') AS month, SUM(value) AS total FROM sales
       GROUP BY store_id, strftime(d, '%Y-%m')),
se(mm, season, events, trend) AS (VALUES {_season_values()})
SELECT mt.store_id, mt.month, CAST(mt.total AS DOUBLE) AS total,
       {_month_names_sql()}[CAST(substr(mt.month, 6, 2) AS INTEGER)] || '/' || substr(mt.month, 1, 4) AS label,
       COALESCE(se.season, 'N/A') AS season, COALESCE(se.events, 'Período padrão') AS events,
       COALESCE(se.trend, 'análise geral') AS trend
FROM mt LEFT JOIN se ON substr(mt.month, 6, 2) = se.mm"""))
def q_season_context(spark, sf):
    from shelfrank.functions.periods import month_label
    from shelfrank.sources.dims import with_season
    # month totals, aggregated without the product dimension
    t = marts.product_month_sales(sales_fact(spark, sf, product=False), item_cols=()).withColumnRenamed("value", "total")
    return with_season(t, spark).select(
        "store_id", "month", dbl("total").alias("total"), month_label("month").alias("label"),
        "season", "events", "trend")


def _store_names_values() -> str:
    from shelfrank.sources.dims import STORE_NAMES
    return ", ".join(f"('{i}', '{n}')" for i, n in STORE_NAMES)


@query("store_names", with_sales(f""",
st AS (SELECT DISTINCT store_id FROM sales),
nm(store_id, store_name) AS (VALUES {_store_names_values()})
SELECT st.store_id, COALESCE(nm.store_name, 'Loja ' || st.store_id) AS store_name
FROM st LEFT JOIN nm ON st.store_id = nm.store_id"""))
def q_store_names(spark, sf):
    from shelfrank.sources.dims import with_store_name
    st = sales_fact(spark, sf, product=False).select("store_id").distinct()
    return with_store_name(st, spark).select("store_id", "store_name")


@query("store_order", with_sales(""",
st AS (SELECT DISTINCT store_id FROM sales)
SELECT store_id,
       CAST(ROW_NUMBER() OVER (ORDER BY store_id) AS INTEGER) AS text_order,
       CAST(ROW_NUMBER() OVER (ORDER BY TRY_CAST(store_id AS INTEGER) NULLS FIRST, store_id) AS INTEGER)
         AS numeric_order
FROM st"""))
def q_store_order(spark, sf):
    from shelfrank.operators import quality
    return quality.store_order(sales_fact(spark, sf, product=False).select("store_id").distinct())


def _week_label_sql(iso: bool) -> str:
    y = "CAST(substr(period, 1, 4) AS INTEGER)"
    w = "CAST(substr(period, 7, 2) AS INTEGER)"
    if iso:
        base = f"(make_date({y}, 1, 4) - CAST(isodow(make_date({y}, 1, 4)) - 1 AS INTEGER))"
    else:
        base = f"(make_date({y}, 1, 1) + CAST((8 - isodow(make_date({y}, 1, 1))) % 7 AS INTEGER))"
    start = f"({base} + CAST(7 * ({w} - 1) AS INTEGER))"
    return (f"'Semana ' || substr(period, 7, 2) || ' (' || strftime({start}, '%d/%m') || ' - ' "
            f"|| strftime({start} + 6, '%d/%m') || ')'")


def _label_sql(iso: bool) -> str:
    return f"""CASE WHEN period LIKE '%W%' THEN {_week_label_sql(iso)}
     WHEN regexp_matches(period, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
       THEN substr(period, 9, 2) || '/' || substr(period, 6, 2) || '/' || substr(period, 1, 4)
     WHEN regexp_matches(period, '^\\d{{4}}-\\d{{2}}$')
       THEN {_month_names_sql()}[CAST(substr(period, 6, 2) AS INTEGER)] || '/' || substr(period, 1, 4)
     ELSE period END"""


@query("period_labels", with_sales(MULTI_CTE + f"""
SELECT granularity, period, {_label_sql(False)} AS label, {_label_sql(True)} AS label_iso
FROM (SELECT DISTINCT granularity, period FROM mm) p""", daily=True))
def q_period_labels(spark, sf):
    from shelfrank.functions.periods import period_label
    p = multi_mart(spark, sf).select("granularity", "period").distinct()
    return p.select("granularity", "period", period_label("period").alias("label"),
                    period_label("period", iso_label=True).alias("label_iso"))


# --------------------------------------------------------------------------- cleaning

from shelfrank.functions import clean as C  # noqa: E402
from shelfrank.sources import tables as T  # noqa: E402


def raw_sql(rest: str) -> str:
    return f"WITH raw AS ({T.RAW_SALES_SQL}){rest}"


@query("money_parse", raw_sql(f""",
p AS (SELECT l_orderkey, l_linenumber, value_raw, {T.money_sql('value_raw')} AS value FROM raw)
SELECT l_orderkey, l_linenumber, value_raw, CAST(value AS DOUBLE) AS value FROM p WHERE value > 0"""))
def q_money_parse(spark, sf):
    r = T.raw_sales_text(spark, sf).withColumn("value", C.parse_money("value_raw"))
    return r.filter(F.col("value") > 0).select("l_orderkey", "l_linenumber", "value_raw",
                                               dbl("value").alias("value"))


@query("money_parse_currency", raw_sql(f""",
p AS (SELECT l_orderkey, l_linenumber, value_raw, {T.money_sql('value_raw', True)} AS value FROM raw)
SELECT l_orderkey, l_linenumber, value_raw, CAST(value AS DOUBLE) AS value,
       'R$ ' || translate(format('{{:,.2f}}', value), ',.', '.,') AS brl_text,
       'R$ ' || format('{{:,.2f}}', value) AS grouped_text
FROM p WHERE value > 0"""))
def q_money_parse_currency(spark, sf):
    r = T.raw_sales_text(spark, sf).withColumn("value", C.parse_money("value_raw", currency=True))
    return r.filter(F.col("value") > 0).select(
        "l_orderkey", "l_linenumber", "value_raw", dbl("value").alias("value"),
        C.brl_text(F.col("value")).alias("brl_text"), C.usd_grouped_text(F.col("value")).alias("grouped_text"))


@query("date_parse", raw_sql(f"""
SELECT l_orderkey, l_linenumber, date_raw, {T.date_sql('date_raw')} AS d,
       COALESCE(strftime({T.date_sql('date_raw')}, '%Y-%m'), 'NaT') AS month
FROM raw"""))
def q_date_parse(spark, sf):
    r = T.raw_sales_text(spark, sf).withColumn("d", C.parse_date("date_raw"))
    return r.select("l_orderkey", "l_linenumber", "date_raw", "d", C.month_bucket("d").alias("month"))


CLEAN_CTE = f""",
f AS (SELECT store_id, {T.product_sql('product')} AS product, {T.money_sql('value_raw')} AS value,
             {T.date_sql('date_raw')} AS d FROM raw),
cs AS (SELECT *, COALESCE(strftime(d, '%Y-%m'), 'NaT') AS month FROM f
       WHERE value > 0 AND product IS NOT NULL AND product <> '' AND product <> 'NAN' AND {T.store_sql('store_id')})
"""


@query("aggregation_counts", raw_sql(CLEAN_CTE + """,
m AS (SELECT store_id, product, month, COUNT(*) AS n FROM cs GROUP BY store_id, product, month)
SELECT CAST(SUM(n) AS BIGINT) AS valid_rows, COUNT(*) AS store_month_products,
       COUNT(DISTINCT (store_id, product)) AS store_products
FROM m"""))
def q_aggregation_counts(spark, sf):
    """A13, the counts logged after aggregation: cleaned rows, store × month ×
    product rows (monthly job) and store × product rows ("unique products",
    ABC job), undated sales in month ``NaT``. One month-level aggregate,
    re-aggregated; no pass over the fact per count."""
    from shelfrank.operators.clean import clean_sales
    f = clean_sales(T.raw_sales_text(spark, sf)).withColumn("month", C.month_bucket("d"))
    m = f.groupBy("store_id", "product", "month").agg(F.count(F.lit(1)).alias("n"))
    return m.agg(F.sum("n").cast("bigint").alias("valid_rows"),
                 F.count(F.lit(1)).alias("store_month_products"),
                 F.count_distinct("store_id", "product").alias("store_products"))


@query("invalid_dates", raw_sql(CLEAN_CTE + """
SELECT 'bucket' AS policy, store_id, month, COUNT(*) AS n_rows, CAST(SUM(value) AS DOUBLE) AS value
FROM cs GROUP BY store_id, month
UNION ALL
SELECT 'drop', store_id, month, COUNT(*), CAST(SUM(value) AS DOUBLE)
FROM cs WHERE d IS NOT NULL GROUP BY store_id, month"""))
def q_invalid_dates(spark, sf):
    """Both policies from one aggregate; dropping undated rows removes
    exactly the ``NaT`` groups."""
    from shelfrank.operators.clean import clean_sales
    c = clean_sales(T.raw_sales_text(spark, sf)).withColumn("month", C.month_bucket("d"))
    g = c.groupBy("store_id", "month").agg(F.count(F.lit(1)).alias("n_rows"), dbl_sum("value"))
    policies = F.when(F.col("month") == "NaT", F.array(F.lit("bucket"))).otherwise(
        F.array(F.lit("bucket"), F.lit("drop")))
    return g.select(F.explode(policies).alias("policy"), "store_id", "month", "n_rows", "value")


def dbl_sum(c):
    return F.sum(c).cast("double").alias(c)


@query("product_normalise", f"""
WITH pr AS (
  SELECT p_partkey,
         CASE WHEN p_partkey % 97 = 0 THEN ' '
              WHEN p_partkey % 4 = 0 THEN p_name
              WHEN p_partkey % 4 = 1 THEN upper(replace(p_name, ' ', '  '))
              WHEN p_partkey % 4 = 2 THEN chr(160) || ' ' || p_name || ' '
              ELSE p_name || chr(9) END AS raw
  FROM part)
SELECT p_partkey, raw, {T.product_sql('raw')} AS clean, {T.product_sql('raw', False)} AS light,
       ({T.product_sql('raw')} IS NOT NULL AND {T.product_sql('raw')} <> ''
        AND {T.product_sql('raw')} <> 'NAN') AS valid
FROM pr""")
def q_product_normalise(spark, sf):
    p = T.table(spark, sf, "part").select("p_partkey", "p_name")
    k = F.col("p_partkey") % 4
    name = F.col("p_name")
    raw = (F.when(F.col("p_partkey") % 97 == 0, F.lit(" ")).when(k == 0, name)
           .when(k == 1, F.upper(F.replace(name, F.lit(" "), F.lit("  "))))
           .when(k == 2, F.concat(F.lit("\u00a0 "), name, F.lit(" ")))
           .otherwise(F.concat(name, F.lit("\t"))))
    p = p.select("p_partkey", raw.alias("raw"))
    clean = C.normalise_product("raw")
    return p.select("p_partkey", "raw", clean.alias("clean"),
                    C.normalise_product("raw", collapse_ws=False).alias("light"),
                    C.valid_product(clean).alias("valid"))


@query("store_id_cast", """
WITH s AS (
  SELECT s_suppkey,
         CASE s_suppkey % 3 WHEN 0 THEN CAST(s_nationkey AS VARCHAR)
                            WHEN 1 THEN lpad(CAST(s_nationkey AS VARCHAR), 3, '0')
                            ELSE 'L' || CAST(s_nationkey AS VARCHAR) END AS store_id
  FROM supplier)
SELECT s_suppkey, store_id, TRY_CAST(store_id AS INTEGER) AS store_num FROM s""")
def q_store_id_cast(spark, sf):
    s = T.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nk = F.col("s_nationkey").cast("string")
    k = F.col("s_suppkey") % 3
    sid = F.when(k == 0, nk).when(k == 1, F.lpad(nk, 3, "0")).otherwise(F.concat(F.lit("L"), nk))
    s = s.select("s_suppkey", sid.alias("store_id"))
    return s.withColumn("store_num", C.store_number("store_id"))


@query("data_quality", raw_sql(f""",
f AS (SELECT {T.product_sql('product')} AS product, {T.money_sql('value_raw')} AS value,
             {T.date_sql('date_raw')} AS d, {T.store_sql('store_id')} AS stored,
             regexp_matches(value_raw, ',[0-9]{{2}}0*[1-9]') AS rounded FROM raw),
g AS (SELECT *, (product IS NOT NULL AND product <> '' AND product <> 'NAN') AS named FROM f)
SELECT COUNT(*) AS rows_read,
       COUNT(*) FILTER (WHERE NOT value > 0) AS non_positive_values,
       COUNT(*) FILTER (WHERE rounded) AS rounded_values,
       COUNT(*) FILTER (WHERE value > 0 AND d IS NULL) AS invalid_dates,
       COUNT(*) FILTER (WHERE value > 0 AND NOT named) AS invalid_products,
       COUNT(*) FILTER (WHERE value > 0 AND NOT stored) AS invalid_stores,
       COUNT(*) FILTER (WHERE value > 0 AND named AND stored) AS valid_rows
FROM g"""))
def q_data_quality(spark, sf):
    from shelfrank.operators.clean import quality_counts
    return quality_counts(T.raw_sales_text(spark, sf))


@query("data_quality_observed", ORACLE["data_quality"])
def q_data_quality_observed(spark, sf):
    """A13 from the job's own pass: the monthly job runs on the cleaned fact, and
    the counts were taken on the way."""
    from pyspark.sql import Observation

    from shelfrank.operators.clean import clean_sales
    from shelfrank.plans import jobs
    counts = Observation("quality")
    with jobs.monthly_job(spark, clean_sales(T.raw_sales_text(spark, sf), counts=counts), _scratch(spark, "observed")):
        found = counts.get
    return spark.createDataFrame([found]).select(*[F.col(c).cast("bigint").alias(c) for c in found])


# --------------------------------------------------------------------------- run statistics

@query("run_statistics", with_sales(MONTHLY_RANK_CTES + """,
pm AS (SELECT store_id, month, COUNT(*) AS items, MIN(period_total) AS period_total FROM tb
       GROUP BY store_id, month)
SELECT COUNT(DISTINCT store_id) AS stores, COUNT(*) AS store_months, COALESCE(SUM(items), 0) AS items,
       CAST(COALESCE(SUM(period_total), 0) AS DOUBLE) AS revenue,
       COALESCE(CAST(SUM(items) AS DOUBLE) / NULLIF(COUNT(*), 0), 0.0) AS items_per_month
FROM pm"""))
def q_run_statistics(spark, sf):
    from shelfrank.operators import quality
    s = quality.run_statistics(monthly_ranking(spark, sf))
    return s.select("stores", "store_months", "items", dbl("revenue").alias("revenue"),
                    dbl("items_per_month").alias("items_per_month"))


@query("data_span", with_sales("""
SELECT MIN(d) AS first_day, MAX(d) AS last_day, strftime(MIN(d), '%Y-%m') AS first_month,
       strftime(MAX(d), '%Y-%m') AS last_month, CAST(SUM(value) AS DOUBLE) AS total_value,
       COUNT(*) AS fact_rows
FROM sales"""))
def q_data_span(spark, sf):
    from shelfrank.operators import quality
    return quality.data_span(sales_fact(spark, sf, product=False)).withColumn("total_value", dbl("total_value"))


@query("distinct_stores", with_sales(MULTI_CTE + """
SELECT granularity, store_id, COUNT(DISTINCT period) AS n_periods, COUNT(*) AS n_rows
FROM mm GROUP BY granularity, store_id""", daily=True))
def q_distinct_stores(spark, sf):
    from shelfrank.operators import quality
    return quality.periods_per_store(multi_mart(spark, sf), ("granularity", "store_id"))


# --------------------------------------------------------------------------- cache

# The "previous run" cache: ABC texts of the sales shipped before this day;
# every 7th product of a store has an empty text (a miss by rule J2).
CACHE_CUTOFF = "1998-01-01"


def _abc_sql(name: str, where: str = "") -> str:
    return f""",
{name}_t AS (SELECT store_id, product, SUM(value) AS value FROM sales {where} GROUP BY store_id, product),
{name} AS (
  SELECT store_id, product, value,
         ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY value DESC, product) AS rank,
         CASE WHEN SUM(value) OVER (PARTITION BY store_id ORDER BY value DESC, product
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100
                   <= SUM(value) OVER (PARTITION BY store_id) * 80 THEN 'A'
              WHEN SUM(value) OVER (PARTITION BY store_id ORDER BY value DESC, product
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * 100
                   <= SUM(value) OVER (PARTITION BY store_id) * 95 THEN 'B' ELSE 'C' END AS abc_class
  FROM {name}_t)"""


CACHE_CTES = (_abc_sql("cur") + _abc_sql("prev", f"WHERE d < DATE '{CACHE_CUTOFF}'") + """,
cache AS (SELECT store_id, product, abc_class,
                 CASE WHEN rank % 7 = 0 THEN '' ELSE 'Análise anterior ' || abc_class END AS analysis
          FROM prev),
hits AS (SELECT c.store_id, c.product, c.abc_class, c.rank, k.analysis
         FROM cur c JOIN cache k USING (store_id, product, abc_class) WHERE k.analysis <> ''),
miss AS (SELECT c.* FROM cur c WHERE NOT EXISTS (
           SELECT 1 FROM cache k WHERE k.store_id = c.store_id AND k.product = c.product
                                   AND k.abc_class = c.abc_class AND k.analysis <> '')),
mb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY rank, product) AS mpos FROM miss),
mb2 AS (SELECT *, CAST((mpos - 1) // 15 AS INTEGER) AS batch, CAST((mpos - 1) % 15 + 1 AS INTEGER) AS i FROM mb),
fresh AS (SELECT store_id, product, abc_class, rank,
                 CASE WHEN i = 3 THEN 'Análise indisponível'
                      ELSE 'Classe ' || abc_class || ' item ' || CAST(i AS VARCHAR) END AS analysis
          FROM mb2),
new AS (SELECT store_id, product, abc_class, analysis FROM fresh WHERE analysis <> 'Análise indisponível'),
upserted AS (SELECT * FROM cache k WHERE NOT EXISTS (
               SELECT 1 FROM new n WHERE n.store_id = k.store_id AND n.product = k.product
                                     AND n.abc_class = k.abc_class)
             UNION ALL SELECT * FROM new)
""")


def _abc_items(spark, sf):
    return abc_frame(spark, sf).select("store_id", "product", "abc_class", "rank", "value")


def _prev_cache(spark, sf):
    s = sales_fact(spark, sf).filter(F.col("d") < F.lit(CACHE_CUTOFF).cast("date"))
    p = abc.classify(marts.product_totals(s))
    text = F.when(F.col("rank") % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit("Análise anterior "), F.col("abc_class")))
    return p.select("store_id", "product", "abc_class", text.alias("analysis"))


@query("cache_hits", with_sales(CACHE_CTES + """
SELECT store_id, product, abc_class, rank, analysis FROM hits"""))
def q_cache_hits(spark, sf):
    from shelfrank.operators import cache
    return cache.hits(_abc_items(spark, sf), _prev_cache(spark, sf)).select(
        "store_id", "product", "abc_class", "rank", "analysis")


@query("cache_misses", with_sales(CACHE_CTES + """
SELECT store_id, product, abc_class, rank FROM miss"""))
def q_cache_misses(spark, sf):
    from shelfrank.operators import cache
    return cache.misses(_abc_items(spark, sf), _prev_cache(spark, sf)).select(
        "store_id", "product", "abc_class", "rank")


@query("annotation_batches", with_sales(CACHE_CTES + """
SELECT store_id, batch, COUNT(*) AS n_items, MIN(rank) AS first_rank, MAX(rank) AS last_rank,
       to_json(list({'produto': product, 'classe': abc_class} ORDER BY i)) AS items_json
FROM mb2 GROUP BY store_id, batch"""))
def q_annotation_batches(spark, sf):
    from shelfrank.operators import annotate, cache
    rows = annotate.batch_rows(annotate.abc_batches(cache.misses(_abc_items(spark, sf), _prev_cache(spark, sf))))
    rank = F.transform("items", lambda x: x["rank"])
    return rows.select("store_id", "batch", F.size("items").cast("bigint").alias("n_items"), F.array_min(rank).alias("first_rank"),
                       F.array_max(rank).alias("last_rank"),
                       annotate.items_json({"produto": "product", "classe": "abc_class"}).alias("items_json"))


def _abc_annotated(spark, sf, prev=None):
    from shelfrank.operators import cache
    prev = _prev_cache(spark, sf) if prev is None else prev
    return cache.annotate_abc(_abc_items(spark, sf), prev, stub_annotator)


@query("annotate_abc_items", with_sales(CACHE_CTES + """
SELECT store_id, product, abc_class, rank, analysis, true AS from_cache FROM hits
UNION ALL
SELECT store_id, product, abc_class, rank, analysis, false FROM fresh"""))
def q_annotate_abc_items(spark, sf):
    out, _ = _abc_annotated(spark, sf)
    return out.select("store_id", "product", "abc_class", "rank", "analysis", "from_cache")


@query("cache_upsert", with_sales(CACHE_CTES + """
SELECT store_id, product, abc_class, analysis FROM upserted"""))
def q_cache_upsert(spark, sf):
    from shelfrank.operators import cache
    prev = _prev_cache(spark, sf)
    _, new = _abc_annotated(spark, sf, prev)
    return cache.upsert(prev, new)


@query("cache_stats", with_sales(CACHE_CTES + """,
hm AS (SELECT store_id, COUNT(*) AS hits, 0 AS misses FROM hits GROUP BY store_id
       UNION ALL SELECT store_id, 0, COUNT(*) FROM fresh GROUP BY store_id)
SELECT hm.store_id, CAST(SUM(hits) AS BIGINT) AS hits, CAST(SUM(misses) AS BIGINT) AS misses,
       (SELECT COUNT(*) FROM cache) AS entries_before,
       (SELECT COUNT(*) FROM upserted) AS entries_after,
       (SELECT COUNT(DISTINCT store_id) FROM upserted) AS stores_after
FROM hm GROUP BY hm.store_id"""))
def q_cache_stats(spark, sf):
    from shelfrank.operators import cache
    prev = _prev_cache(spark, sf)
    out, new = _abc_annotated(spark, sf, prev)
    return cache.run_stats(out, prev, cache.upsert(prev, new))


# --------------------------------------------------------------------------- period annotation (X4) and dashboard

PKEYS = ["granularity", "store_id", "period"]

ANNOT_CTES = MULTI_CTE + """,
o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY granularity, store_id, period ORDER BY value DESC, product) AS rn,
             COUNT(*) OVER (PARTITION BY granularity, store_id, period) AS n
      FROM mm),
pv AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY granularity, store_id, period ORDER BY value DESC, product) AS prn,
              COUNT(*) OVER (PARTITION BY granularity, store_id, period) AS np
       FROM o WHERE value > 0),
it AS (SELECT granularity, store_id, period, product, 'TOP' AS kind, value, CAST(rn AS INTEGER) AS pos, n
       FROM o WHERE rn <= 10
       UNION ALL
       SELECT granularity, store_id, period, product, 'BOTTOM', value, CAST(prn - GREATEST(np - 10, 0) AS INTEGER), n
       FROM pv WHERE np - prn < 10),
li AS (SELECT *, CAST(CASE WHEN kind = 'TOP' THEN pos ELSE LEAST(n, 10) + pos END AS INTEGER) AS i FROM it),
rec AS (SELECT granularity, store_id, period,
               ROW_NUMBER() OVER (PARTITION BY granularity, store_id ORDER BY period DESC) <= 7 AS annotated
        FROM (SELECT DISTINCT granularity, store_id, period FROM mm) p),
lj AS (SELECT li.*, MAX(i) OVER (PARTITION BY granularity, store_id, period, product) AS j,
              FIRST_VALUE(product) OVER (PARTITION BY granularity, store_id, period ORDER BY i) AS p1,
              COUNT(*) OVER (PARTITION BY granularity, store_id, period) AS n_items
       FROM li),
ai AS (SELECT lj.granularity, lj.store_id, lj.period, product, kind, value, pos, i, n_items, p1, rec.annotated,
              CASE WHEN NOT rec.annotated THEN 'Período histórico'
                   WHEN product = p1 THEN 'revisado [a, ]'
                   ELSE (CASE WHEN j > LEAST(n, 10) THEN 'BOTTOM' ELSE 'TOP' END) || ' #' || CAST(j AS VARCHAR)
              END AS diagnosis,
              CASE WHEN NOT rec.annotated THEN '-' WHEN product = p1 THEN 'rever'
                   WHEN j % 3 <> 0 THEN 'manter' ELSE '-' END AS action
       FROM lj JOIN rec USING (granularity, store_id, period))
"""


def period_lists(spark, sf, fact: str = "daily"):
    """W5 as one row per store-period, with its total over all products."""
    from shelfrank.operators import ranking
    return ranking.overlap_lists(multi_mart(spark, sf, fact), PKEYS)


def asked_periods(spark, sf):
    """Those of the newest seven periods of each store."""
    from shelfrank.operators import ranking
    return ranking.recent_periods(period_lists(spark, sf), ("granularity", "store_id")).where("annotated")


def annotated_lists(spark, sf, fact: str = "daily"):
    from shelfrank.operators import annotate
    return annotate.annotate_periods(period_lists(spark, sf, fact), stub_annotator, PKEYS)


@query("annotate_items", with_sales(ANNOT_CTES + """
SELECT granularity, store_id, period, product, kind, CAST(value AS DOUBLE) AS value, pos, diagnosis, action
FROM ai""", daily=True))
def q_annotate_items(spark, sf):
    from shelfrank.operators import annotate
    a = annotate.flat_items(annotated_lists(spark, sf), PKEYS)
    return a.select(*PKEYS, "product", "kind", dbl("value").alias("value"), "pos", "diagnosis", "action")


@query("json_repair_parse", with_sales(ANNOT_CTES + """
SELECT granularity, store_id, period, CAST(i AS INTEGER) AS pos, product AS produto,
       kind || ' #' || CAST(i AS VARCHAR) AS diagnostico,
       CASE WHEN i % 3 <> 0 THEN 'manter' ELSE '-' END AS acao
FROM ai WHERE annotated
UNION ALL
SELECT DISTINCT granularity, store_id, period, CAST(n_items + 1 AS INTEGER), p1, 'revisado [a, ]', 'rever'
FROM ai WHERE annotated""", daily=True))
def q_json_repair_parse(spark, sf):
    from shelfrank.operators import annotate
    asked = asked_periods(spark, sf).withColumn("prompt", annotate.period_prompt())
    p = annotate.parse_replies(annotate.call_annotator(asked, stub_annotator, PKEYS), PKEYS)
    return p.select(*PKEYS, F.col("pos").cast("int").alias("pos"), "produto",
                    F.coalesce("diagnostico", F.lit(annotate.UNAVAILABLE)).alias("diagnostico"),
                    F.coalesce("acao", F.lit(annotate.NO_ACTION)).alias("acao"))


@query("prompt_text")
def q_prompt_text(spark, sf):
    """every prompt the three jobs would send."""
    from shelfrank.operators import annotate
    p15 = asked_periods(spark, sf).select(
        F.lit("period").alias("prompt_kind"), "store_id", F.concat_ws(":", "granularity", "period").alias("key"),
        annotate.period_prompt().alias("prompt"))
    p14 = monthly_rows(spark, sf).select(
        F.lit("month").alias("prompt_kind"), "store_id", F.col("month").alias("key"), annotate.month_prompt().alias("prompt"))
    p13 = _missed_batches(spark, sf).select(
        F.lit("abc").alias("prompt_kind"), "store_id", F.col("batch").cast("string").alias("key"), annotate.abc_prompt().alias("prompt"))
    return p15.unionByName(p14).unionByName(p13)


def _missed_batches(spark, sf):
    from shelfrank.operators import annotate, cache
    return annotate.batch_rows(annotate.abc_batches(cache.misses(_abc_items(spark, sf), _prev_cache(spark, sf))))


@query("period_prompt_text", with_sales(ANNOT_CTES + """,
pt AS (SELECT granularity, store_id, period, SUM(value) AS total FROM mm GROUP BY granularity, store_id, period),
ln AS (SELECT li.granularity, li.store_id, li.period,
              to_json(list(struct_pack(produto := product, tipo := kind, valor := CAST(value AS DOUBLE)) ORDER BY i))
                AS items_json
       FROM li JOIN rec USING (granularity, store_id, period) WHERE rec.annotated
       GROUP BY li.granularity, li.store_id, li.period)
SELECT granularity, store_id, period,
       'Sales review of one ' || granularity || ' (' || period || ') in store ' || store_id
       || '; revenue of all its products: ' || 'R$ ' || translate(format('{:,.2f}', CAST(total AS DECIMAL(18,2))), ',.', '.,')
       || '.' || chr(10) || 'ITEMS_JSON: ' || CAST(items_json AS VARCHAR) || chr(10)
       || 'Answer with a JSON array, one short object for each item, with the keys produto, diagnostico, acao.'
       AS prompt
FROM ln JOIN pt USING (granularity, store_id, period)""", daily=True))
def q_period_prompt_text(spark, sf):
    """F15 (+ W6): the prompt of every store-period among each store's newest
    seven, items in list order (TOP, then BOTTOM)."""
    from shelfrank.operators import annotate
    return asked_periods(spark, sf).select(*PKEYS, annotate.period_prompt().alias("prompt"))


def _brl_sql(c: str) -> str:
    return f"'R$ ' || translate(format('{{:,.2f}}', CAST({c} AS DECIMAL(18,2))), ',.', '.,')"


@query("monthly_prompt_text", with_sales(MONTHLY_RANK_CTES + f""",
se(mm, season, events, trend) AS (VALUES {_season_values()}),
ks AS (SELECT store_id, month, MIN(period_total) AS period_total,
              COALESCE(SUM(CASE WHEN kind LIKE '%TOP%' THEN value END), 0) AS top_sum,
              COALESCE(SUM(CASE WHEN kind LIKE '%BOTTOM%' THEN value END), 0) AS bottom_sum,
              COUNT(*) AS n_items,
              to_json(list(struct_pack(produto := product, tipo := kind,
                                       venda_este_mes := CAST(value AS DOUBLE)) ORDER BY rank)) AS items_json
       FROM tb GROUP BY store_id, month)
SELECT store_id, month,
       'Monthly menu review for store ' || store_id || ', '
       || {_month_names_sql()}[CAST(substr(month, 6, 2) AS INTEGER)] || '/' || substr(month, 1, 4)
       || '.' || chr(10) || 'Season: ' || COALESCE(se.season, 'N/A') || '. Context: '
       || COALESCE(se.events, 'Período padrão') || '.' || chr(10) || 'Month revenue, all products: '
       || {_brl_sql('period_total')} || chr(10) || 'Top items: ' || {_brl_sql('top_sum')}
       || '; bottom items: ' || {_brl_sql('bottom_sum')} || '; items listed: ' || CAST(n_items AS VARCHAR)
       || chr(10) || 'ITEMS_JSON: ' || CAST(items_json AS VARCHAR) || chr(10)
       || 'Judge each item on its own. Answer with a JSON array of objects with the keys produto, '
       || 'diagnostico, acao.' AS prompt
FROM ks LEFT JOIN se ON substr(ks.month, 6, 2) = se.mm"""))
def q_monthly_prompt_text(spark, sf):
    """F14 (+ J5, A7, A9, F2, F7, F8): the prompt of every store-month."""
    from shelfrank.operators import annotate
    return monthly_rows(spark, sf).select(*MKEYS, annotate.month_prompt().alias("prompt"))


@query("abc_prompt_text", with_sales(CACHE_CTES + """
SELECT store_id, batch,
       'ABC review for store ' || store_id || '. One line of advice per product, no comparisons, no trends.'
       || chr(10) || 'ITEMS_JSON: '
       || CAST(to_json(list(struct_pack(produto := product, classe := abc_class) ORDER BY i)) AS VARCHAR)
       || chr(10) || 'Answer with a JSON array of objects with the keys produto, analise.' AS prompt
FROM mb2 GROUP BY store_id, batch"""))
def q_abc_prompt_text(spark, sf):
    """F13 (+ W10, J3): one prompt per batch of 15 cache misses of a store."""
    from shelfrank.operators import annotate
    return _missed_batches(spark, sf).select("store_id", "batch", annotate.abc_prompt().alias("prompt"))


# ``prompt_text`` (registered above) is the union of the three prompt kinds,
# so its oracle is theirs, composed (each keeps its own WITH clause).
ORACLE["prompt_text"] = f"""
SELECT 'period' AS prompt_kind, store_id, granularity || ':' || period AS key, prompt
FROM ({ORACLE['period_prompt_text']}) p15
UNION ALL
SELECT 'month', store_id, month, prompt FROM ({ORACLE['monthly_prompt_text']}) p14
UNION ALL
SELECT 'abc', store_id, CAST(batch AS VARCHAR), prompt FROM ({ORACLE['abc_prompt_text']}) p13"""


SELECTION_CTES = ANNOT_CTES + """,
tot AS (SELECT granularity, store_id, period, SUM(value) AS total FROM mm GROUP BY granularity, store_id, period),
mg AS (SELECT granularity, store_id, period, product, MAX(value) AS value, arg_min(kind, i) AS kind,
              COUNT(*) FILTER (WHERE diagnosis IS NOT NULL AND diagnosis <> 'IA não disponível') AS n_insights
       FROM ai GROUP BY granularity, store_id, period, product),
sel AS (SELECT mg.*, tot.total,
               CAST(ROW_NUMBER() OVER (PARTITION BY mg.granularity, mg.store_id, mg.period
                                       ORDER BY value DESC, product) AS INTEGER) AS rank,
               SUM(value) OVER (PARTITION BY mg.granularity, mg.store_id, mg.period ORDER BY value DESC, product
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
        FROM mg JOIN tot USING (granularity, store_id, period)),
sc AS (SELECT *, CASE WHEN total > 0 THEN (CASE WHEN cum * 100 <= total * 80 THEN 'A'
                                                WHEN cum * 100 <= total * 95 THEN 'B' ELSE 'C' END)
                      ELSE 'A' END AS abc_class FROM sel)
"""


def selection(spark, sf):
    """One classified selection per store-period."""
    return selections.classify(selections.merge(annotated_lists(spark, sf)))


@query("selection_merge_modes", with_sales(ANNOT_CTES + """
SELECT 'dedupe' AS mode, granularity, store_id, period, product, CAST(MAX(value) AS DOUBLE) AS value,
       arg_min(kind, i) AS kind, CAST(MIN(i) AS INTEGER) AS first_pos
FROM ai GROUP BY granularity, store_id, period, product
UNION ALL
SELECT 'sum', granularity, store_id, period, product, CAST(SUM(value) AS DOUBLE),
       arg_min(kind, i), CAST(MIN(i) AS INTEGER)
FROM ai GROUP BY granularity, store_id, period, product"""))
def q_selection_merge_modes(spark, sf):
    """A15 + D7: a product listed in both TOP and BOTTOM of a small period
    counts once (``dedupe=True``) or twice, as the dashboard adds it. Runs
    on the lineitem fact, whose store-days hold a few products each."""
    from shelfrank.operators import ranking
    merged = ranking.flat(selections.merge(annotated_lists(spark, sf, fact="sales")), PKEYS, col="products")
    modes = F.array(F.struct(F.lit("dedupe").alias("mode"), dbl("value_once").alias("value")),
                    F.struct(F.lit("sum").alias("mode"), dbl("value_twice").alias("value")))
    m = merged.select(F.explode(modes).alias("m"), *PKEYS, "product", "kind", "first_pos")
    return m.select("m.mode", *PKEYS, "product", "m.value", "kind", "first_pos")


@query("selection_abc", with_sales(SELECTION_CTES + """
SELECT granularity, store_id, period, product, CAST(value AS DOUBLE) AS value, kind, abc_class, rank,
       CAST(n_insights AS INTEGER) AS n_insights, n_insights > 0 AS has_insight
FROM sc""", daily=True))
def q_selection_abc(spark, sf):
    from shelfrank.operators import ranking
    s = ranking.flat(selection(spark, sf), PKEYS, col="products")
    return s.select(*PKEYS, "product", dbl("value").alias("value"), "kind", "abc_class", "rank",
                    F.size("insights").alias("n_insights"), (F.size("insights") > 0).alias("has_insight"))


@query("class_best_worst", with_sales(SELECTION_CTES + """,
bw AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY granularity, store_id, period, abc_class
                                    ORDER BY value DESC, product) AS bpos
       FROM sc),
ww AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY granularity, store_id, period, abc_class
                                    ORDER BY value ASC, product DESC) AS wpos
       FROM sc WHERE value > 0)
SELECT granularity, store_id, period, abc_class, 'best' AS list, CAST(bpos AS INTEGER) AS pos, product,
       CAST(value AS DOUBLE) AS value FROM bw WHERE bpos <= 10
UNION ALL
SELECT granularity, store_id, period, abc_class, 'worst', CAST(wpos AS INTEGER), product, CAST(value AS DOUBLE)
FROM ww WHERE wpos <= 10""", daily=True))
def q_class_best_worst(spark, sf):
    from shelfrank.operators import ranking
    bw = ranking.flat(selections.best_worst(selection(spark, sf)), PKEYS, col="lists")
    return bw.select(*PKEYS, "abc_class", "list", "pos", "product", dbl("value").alias("value"))


@query("abc_class_mix", with_sales(ABC_CTES + """
SELECT store_id, abc_class, COUNT(*) AS products, CAST(SUM(value) AS DOUBLE) AS class_value,
       CAST(floor(CAST(SUM(value) AS DOUBLE) / CAST(MIN(group_total) AS DOUBLE) * 100.0 + 0.5) AS INTEGER)
         AS share_int
FROM c GROUP BY store_id, abc_class"""))
def q_abc_class_mix(spark, sf):
    # no rank is asked: the limits come from a histogram, nothing is sorted
    m = abc.class_mix(abc.classes(marts.product_totals(sales_fact(spark, sf))))
    return m.select("store_id", "abc_class", "products", dbl("class_value").alias("class_value"), "share_int")


SEARCH_TERM = "#2"


@query("insight_search", with_sales(SELECTION_CTES + f""",
ins AS (SELECT granularity, store_id, period, product,
               arg_min(diagnosis, i) AS first_insight, arg_min(action, i) AS first_action,
               COUNT(*) AS n_insights,
               bool_or(contains(lower(diagnosis), '{SEARCH_TERM}')) AS text_hit
        FROM ai WHERE diagnosis IS NOT NULL AND diagnosis <> 'IA não disponível'
        GROUP BY granularity, store_id, period, product)
SELECT granularity, store_id, period, product, first_insight, NULLIF(first_action, '-') AS action,
       CAST(n_insights AS INTEGER) AS n_insights
FROM ins WHERE contains(lower(product), '{SEARCH_TERM}') OR text_hit""", daily=True))
def q_insight_search(spark, sf):
    # the search needs the merged selection only, not its ABC classes
    return selections.search(selections.merge(annotated_lists(spark, sf)), SEARCH_TERM, PKEYS)


# --------------------------------------------------------------------------- documents, sinks, sources

def _scratch(spark, name):
    from shelfrank.session import scratch_path
    return scratch_path(spark, name)


def _abc_lines(spark, sf):
    """A19 + P19: ABC lines with month history and cached/new analyses."""
    from shelfrank.operators import cache, documents
    classified = abc.classify(marts.product_history(month_mart(spark, sf)))
    items, _ = cache.annotate_abc(classified, _prev_cache(spark, sf), stub_annotator)
    return documents.abc_documents(items)


ABC_LINES_CTES = CACHE_CTES + """,
ann AS (SELECT store_id, product, abc_class, rank, analysis, 0 AS fresh FROM hits
        UNION ALL SELECT store_id, product, abc_class, rank, analysis, 1 FROM fresh),
hm AS (SELECT store_id, product, COUNT(DISTINCT strftime(d, '%Y-%m')) AS n_months
       FROM sales GROUP BY store_id, product),
al AS (SELECT a.*, c.value, hm.n_months,
              CAST(ROW_NUMBER() OVER (PARTITION BY a.store_id ORDER BY fresh, a.rank, product) - 1 AS INTEGER) AS pos
       FROM ann a JOIN cur c USING (store_id, product) JOIN hm USING (store_id, product))"""


@query("abc_documents", with_sales(ABC_LINES_CTES + """
SELECT TRY_CAST(store_id AS INTEGER) AS id_loja, store_id, CAST(COUNT(*) AS INTEGER) AS n_items,
       arg_min(product, pos) AS first_product, arg_max(product, pos) AS last_product,
       arg_max(analysis, pos) AS last_analysis
FROM al GROUP BY store_id"""))
def q_abc_documents(spark, sf):
    """K1 + U3: the ABC lines written, read back and summed up per store."""
    from shelfrank.operators import documents
    path = documents.write_documents(_abc_lines(spark, sf), _scratch(spark, "abc"))
    return documents.abc_summary(documents.read_abc_documents(spark, path))


def _monthly_lines(spark, sf):
    """A20 + P19 + X4 (month prompts): one line per store-month."""
    from shelfrank.operators import annotate, documents
    return documents.monthly_documents(annotate.annotate_months(monthly_rows(spark, sf), stub_annotator, MKEYS))


def _listed(items, field):
    return F.aggregate(F.transform(items, lambda i: i[field].cast("decimal(18,2)")), F.lit(0).cast("decimal(28,2)"),
                       lambda x, y: (x + y).cast("decimal(28,2)")).cast("double")


@query("monthly_documents", with_sales(MONTHLY_RANK_CTES + """
SELECT TRY_CAST(store_id AS INTEGER) AS id_loja, store_id, month AS mes,
       CAST(MIN(period_total) AS DOUBLE) AS total_mensal, CAST(COUNT(*) AS INTEGER) AS n_items,
       CAST(SUM(value) AS DOUBLE) AS listed_value
FROM tb GROUP BY store_id, month"""))
def q_monthly_documents(spark, sf):
    """K2/K3: the monthly lines written in one folder per store and read back."""
    from shelfrank.operators import documents
    path = documents.write_documents(_monthly_lines(spark, sf), _scratch(spark, "monthly"), partition_by="store_id")
    return documents.read_month_documents(spark, path).select(
        "id_loja", "store_id", "mes", "total_mensal", F.size("itens").alias("n_items"),
        _listed("itens", "venda_este_mes").alias("listed_value"))


def _period_lines(spark, sf):
    """One line per store of a granularity."""
    from shelfrank.operators import documents
    return documents.period_documents(annotated_lists(spark, sf))


@query("period_documents", with_sales(ANNOT_CTES + """,
pt AS (SELECT granularity, store_id, period, SUM(value) AS total FROM mm GROUP BY granularity, store_id, period)
SELECT granularity AS granularidade, TRY_CAST(store_id AS INTEGER) AS id_loja, store_id,
       CAST(COUNT(*) AS INTEGER) AS n_periods, MIN(period) AS first_period, MAX(period) AS last_period,
       CAST(SUM(total) AS DOUBLE) AS total, true AS dated
FROM pt GROUP BY granularity, store_id""", daily=True))
def q_period_documents(spark, sf):
    """A20 + K4: the nested result files written per granularity and read back."""
    from shelfrank.operators import documents
    path = documents.write_documents(_period_lines(spark, sf), _scratch(spark, "periods"), partition_by="granularidade")
    loja = F.col("loja")
    docs = spark.read.schema(documents.PERIOD_LINE).json(path)
    return docs.select("granularidade", F.col("gerado_em").isNotNull().alias("dated"),
                       F.explode("dados_lojas").alias("loja")).select(
        "granularidade", loja["id_loja"].alias("id_loja"), loja["store_id"].alias("store_id"),
        F.size(loja["analises"]).alias("n_periods"), F.array_min(F.map_keys(loja["analises"])).alias("first_period"),
        F.array_max(F.map_keys(loja["analises"])).alias("last_period"),
        _listed(F.map_values(loja["analises"]), "total").alias("total"), "dated")


# Flat views of the three nested documents: every item of every written line,
# with its line's header fields and its position in the line's list, so the
# nesting, chunking and item order are value-checked against DuckDB.

def _doc_items(doc, head, fields):
    ex = doc.select(*head, F.posexplode("itens").alias("pos", "it"))
    return ex.select(*head, "pos", *[c.alias(n) for n, c in fields])


@query("abc_document_items", with_sales(ABC_LINES_CTES + """
SELECT TRY_CAST(store_id AS INTEGER) AS id_loja, store_id, pos, product AS produto,
       CAST(value AS DOUBLE) AS valor_total, abc_class AS classe, CAST(n_months AS INTEGER) AS n_historico,
       analysis AS analise_ia
FROM al"""))
def q_abc_document_items(spark, sf):
    """A19 + P19 + U3: items from the cache first, then the others, by rank."""
    it = F.col("item")
    return _abc_lines(spark, sf).select(
        "id_loja", "store_id", "pos", it["produto"].alias("produto"), it["valor_total"].alias("valor_total"),
        it["classe"].alias("classe"), F.size(it["historico"]).alias("n_historico"), it["analise_ia"].alias("analise_ia"))


@query("monthly_document_items", with_sales(MONTHLY_RANK_CTES + """,
lp AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id, month ORDER BY rank) AS lpos FROM tb)
SELECT TRY_CAST(store_id AS INTEGER) AS id_loja, store_id, month AS mes,
       CAST(period_total AS DOUBLE) AS total_mensal, CAST(lpos - 1 AS INTEGER) AS pos,
       product AS produto, kind AS tipo, CAST(value AS DOUBLE) AS venda_este_mes,
       CASE WHEN lpos = 1 THEN 'revisado [a, ]' ELSE kind || ' #' || CAST(lpos AS VARCHAR) END AS diagnostico,
       CASE WHEN lpos = 1 THEN 'rever' WHEN lpos % 3 <> 0 THEN 'manter' ELSE '-' END AS acao
FROM lp"""))
def q_monthly_document_items(spark, sf):
    """A20 + P19 + X4 (month prompts, stub annotator), flattened."""
    it = F.col("it")
    return _doc_items(_monthly_lines(spark, sf), ["id_loja", "store_id", "mes", "total_mensal"], [
        ("produto", it["produto"]), ("tipo", it["tipo"]), ("venda_este_mes", it["venda_este_mes"]),
        ("diagnostico", it["analise_ia"]["diagnostico"]), ("acao", it["analise_ia"]["acao"])])


@query("period_document_items", with_sales(ANNOT_CTES + """,
pt AS (SELECT granularity, store_id, period, SUM(value) AS total FROM mm GROUP BY granularity, store_id, period)
SELECT ai.granularity AS granularidade, TRY_CAST(ai.store_id AS INTEGER) AS id_loja, ai.store_id,
       ai.period AS periodo, CAST(pt.total AS DOUBLE) AS total, CAST(ai.i - 1 AS INTEGER) AS pos,
       ai.product AS produto, CAST(ai.value AS DOUBLE) AS valor, ai.kind AS tipo,
       ai.diagnosis AS diagnostico, ai.action AS acao
FROM ai JOIN pt USING (granularity, store_id, period)""", daily=True))
def q_period_document_items(spark, sf):
    """A20 (multi-granularity), flattened by the reader: TOP items first, then
    BOTTOM items."""
    from shelfrank.operators import documents
    path = documents.write_documents(_period_lines(spark, sf), _scratch(spark, "periods"))
    it = F.col("analise_ia")
    return documents.read_period_documents(spark, path).select(
        "granularidade", "id_loja", "store_id", "periodo", "total", "pos", "produto", "valor", "tipo",
        it["diagnostico"].alias("diagnostico"), it["acao"].alias("acao"))


@query("mixed_documents", f"SELECT * EXCLUDE (acao) FROM ({ORACLE['period_document_items']}) x")
def q_mixed_documents(spark, sf):
    """S7 by VARIANT: the period files in three shapes side by side, one by
    granularity (the nested form; periods in a list and the store's number as text;
    a single text as comment), read as one."""
    from shelfrank.operators import documents
    path, lists = _scratch(spark, "mixed"), annotated_lists(spark, sf)
    lines = documents.period_documents(lists)
    shop, g = F.col("dados_lojas")[0], F.col("granularidade")
    lines.where("granularidade = 'day'").select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)
    periods = F.transform(F.map_entries(shop["analises"]), lambda e: F.struct(
        e["key"].alias("periodo"), e["value"]["total"].alias("total"), e["value"]["itens"].alias("itens"), F.lit(1).alias("versao")))
    listed = F.struct(g.alias("granularidade"), F.array(F.struct(
        shop["id_loja"].cast("string").alias("id_loja"), shop["store_id"].alias("store_id"), periods.alias("analises"))).alias("dados_lojas"))
    lines.where("granularidade = 'week'").select(F.to_json(listed).alias("value")).write.mode("append").text(path)
    said = F.transform_values(shop["analises"], lambda p, d: F.struct(d["total"].alias("total"), F.transform(d["itens"], lambda i: F.struct(
        i["produto"].alias("produto"), i["valor"].alias("valor"), i["tipo"].alias("tipo"), i["analise_ia"]["diagnostico"].alias("analise_ia"),
        i["analise_ia"]["acao"].alias("conselho"))).alias("itens")))
    text = F.struct(g.alias("granularidade"), F.array(F.struct(shop["id_loja"].alias("id_loja"), shop["store_id"].alias("store_id"),
                                                               said.alias("analises"))).alias("dados_lojas"))
    lines.where("granularidade = 'month'").select(F.to_json(text).alias("value")).write.mode("append").text(path)
    return documents.read_mixed_documents(spark, path).drop("acao")


@query("index_document", with_sales("""
SELECT ['periods/granularidade=day', 'periods/granularidade=month', 'periods/granularidade=week'] AS arquivos,
       list(DISTINCT store_id ORDER BY store_id) AS lojas,
       strftime(MIN(d), '%Y-%m-%d') AS inicio, strftime(MAX(d), '%Y-%m-%d') AS fim
FROM sales""", daily=True))
def q_index_document(spark, sf):
    """K5: the index that the multi-granularity job writes about its own files."""
    from shelfrank.plans import jobs
    with jobs.multi_job(spark, daily_fact(spark, sf), _scratch(spark, "multi")) as r:
        return spark.read.json(r.outputs["index"]).select("arquivos", "lojas", "periodo_dados.inicio", "periodo_dados.fim")


RAW_CLEAN_AGG = f""",
f AS (SELECT store_id, {T.product_sql('product')} AS product, {T.money_sql('value_raw')} AS value,
             {T.date_sql('date_raw')} AS d FROM raw),
cs AS (SELECT * FROM f WHERE value > 0 AND product IS NOT NULL AND product <> '' AND product <> 'NAN'
          AND {T.store_sql('store_id')})
SELECT store_id, COUNT(*) AS n_rows, COUNT(d) AS dated_rows, CAST(SUM(value) AS DOUBLE) AS value,
       COUNT(DISTINCT product) AS products
FROM cs GROUP BY store_id"""


def _raw_export(spark, sf):
    """The raw text fact with the export's bracketed column names."""
    from shelfrank.config import DATE_RAW, PRODUCT, RAW_COLUMNS, STORE, VALUE_RAW
    names = dict(zip((STORE, PRODUCT, VALUE_RAW, DATE_RAW), RAW_COLUMNS))
    raw = T.raw_sales_text(spark, sf)
    return raw.select(*[F.col(c).alias(names[c]) for c in (STORE, PRODUCT, VALUE_RAW, DATE_RAW)])


def _clean_agg(fact):
    return fact.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("d").alias("dated_rows"),
        F.sum("value").cast("double").alias("value"), F.countDistinct("product").alias("products"))


@query("csv_round_trip", raw_sql(RAW_CLEAN_AGG))
def q_csv_round_trip(spark, sf):
    """Write the export as `;` CSV (ISO-8859-1), read it back with
    encoding detection, clean and aggregate."""
    from shelfrank.plans.jobs import load_fact
    path = _scratch(spark, "csv-export")
    _raw_export(spark, sf).write.option("sep", ";").option("header", True) \
        .option("encoding", "ISO-8859-1").csv(path)
    return _clean_agg(load_fact(spark, path, encoding="auto"))


XLSX_AGG = f""",
nat AS (SELECT CAST(s.s_nationkey AS VARCHAR) AS store_id, {T.product_sql('p.p_name')} AS product,
               CAST(l.l_extendedprice AS DECIMAL(18,2)) AS value, CAST(l.l_shipdate AS DATE) AS d
        FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_orderkey % 2 = 0),
txt AS (SELECT store_id, {T.product_sql('product')} AS product, {T.money_sql('value_raw')} AS value,
               {T.date_sql('date_raw')} AS d FROM raw WHERE l_orderkey % 2 = 1),
f AS (SELECT * FROM nat UNION ALL SELECT * FROM txt),
cs AS (SELECT * FROM f WHERE value > 0 AND product IS NOT NULL AND product <> '' AND product <> 'NAN'
          AND {T.store_sql('store_id')})
SELECT store_id, COUNT(*) AS n_rows, COUNT(d) AS dated_rows, CAST(SUM(value) AS DOUBLE) AS value,
       COUNT(DISTINCT product) AS products
FROM cs GROUP BY store_id"""


@query("xlsx_read", raw_sql(XLSX_AGG))
def q_xlsx_read(spark, sf):
    """S4 + P5: workbooks with native number and date cells beside workbooks
    with the export's text, read one task per file."""
    from shelfrank.config import RAW_COLUMNS
    from shelfrank.plans.jobs import load_fact
    from shelfrank.sources.files import write_xlsx_parts
    path = _scratch(spark, "xlsx-export")
    raw = T.raw_sales_text(spark, sf).where("l_orderkey % 2 = 1").select("store_id", "product", "value_raw", "date_raw")
    native = T.typed_sales(spark, sf).where("l_orderkey % 2 = 0").select("store_number", "product", "value", "d")
    for part in (raw, native):
        write_xlsx_parts(part.toDF(*RAW_COLUMNS), path).collect()
    return _clean_agg(load_fact(spark, path, fmt="xlsx"))


@query("csv_bad_lines", raw_sql(f""",
c AS (SELECT *, l_orderkey % 3 = 0 AS turned,
             CASE WHEN l_orderkey % 7 = 0 THEN 'long' WHEN l_orderkey % 11 = 0 THEN 'long'
                  WHEN l_orderkey % 13 = 0 THEN 'short' ELSE 'whole' END AS form FROM raw),
k AS (SELECT CASE WHEN turned AND form = 'short' THEN NULL ELSE store_id END AS store_id,
             CASE WHEN l_orderkey % 5 = 0 THEN product || ' "Q;x"' || chr(10) || 'z' ELSE product END AS product, value_raw,
             CASE WHEN NOT turned AND form = 'short' THEN NULL ELSE date_raw END AS date_raw
      FROM c WHERE form <> 'long'),
f AS (SELECT store_id, {T.product_sql('product')} AS product, {T.money_sql('value_raw')} AS value,
             {T.date_sql('date_raw')} AS d FROM k),
cs AS (SELECT * FROM f WHERE value > 0 AND product IS NOT NULL AND product <> '' AND product <> 'NAN'
          AND {T.store_sql('store_id')})
SELECT store_id, COUNT(*) AS n_rows, COUNT(d) AS dated_rows, CAST(SUM(value) AS DOUBLE) AS value,
       COUNT(DISTINCT product) AS products
FROM cs GROUP BY store_id"""))
def q_csv_bad_lines(spark, sf):
    """S1 + D8: files in two column orders, lines with surplus fields (empty
    and filled) and short lines; quoted fields with doubled quotes, separators
    and line breaks."""
    from shelfrank.config import RAW_COLUMNS
    from shelfrank.plans.jobs import load_fact
    path = _scratch(spark, "csv-bad-lines")
    raw = T.raw_sales_text(spark, sf)
    quoted = F.concat(F.lit('"'), F.replace("product", F.lit('"'), F.lit('""')), F.lit(' ""Q;x""\nz"'))
    raw = raw.withColumn("product", F.when(F.col("l_orderkey") % 5 == 0, quoted).otherwise(F.col("product")))
    cols = ["store_id", "product", "value_raw", "date_raw"]
    for turned in (False, True):
        names, order = list(RAW_COLUMNS), list(cols)
        if turned:
            names, order = names[::-1], order[::-1]
        whole = F.concat_ws(";", *order)
        line = (F.when(F.col("l_orderkey") % 7 == 0, F.concat(whole, F.lit(";")))
                .when(F.col("l_orderkey") % 11 == 0, F.concat(whole, F.lit(";;x")))
                .when(F.col("l_orderkey") % 13 == 0, F.concat_ws(";", *order[:3])).otherwise(whole))
        lines = raw.where((F.col("l_orderkey") % 3 == 0) == F.lit(turned)).select(line.alias("value"))
        lines.mapInPandas(_headed(";".join(names)), "value string").write.mode("append").text(path)
    return _clean_agg(load_fact(spark, path))


def _headed(header: str):
    """Puts a header line before the lines of each file."""
    def run(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches
    return run


@query("raw_file_jobs", raw_sql(f""",
f AS (SELECT store_id, {T.product_sql('product', False)} AS product, {T.money_sql('value_raw', True)} AS value,
             {T.date_sql('date_raw')} AS d FROM raw),
cs AS (SELECT * FROM f WHERE value > 0 AND d IS NOT NULL AND {T.store_sql('store_id')})
SELECT store_id, strftime(d, '%Y-%m') AS period, CAST(SUM(value) AS DOUBLE) AS value,
       CAST(COUNT(DISTINCT product) AS BIGINT) AS products
FROM cs GROUP BY store_id, strftime(d, '%Y-%m')"""))
def q_raw_file_jobs(spark, sf):
    """P3 + P11 + P6b on the job path: the export with currency signs (also
    before NBSP), product text trimmed at its ends only, undated rows dropped."""
    from shelfrank.plans.jobs import load_fact
    path = _scratch(spark, "csv-jobs")
    _raw_export(spark, sf).write.option("sep", ";").option("header", True) \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    fact = load_fact(spark, path, invalid_dates="drop", currency=True, collapse_ws=False, drop_invalid_products=False)
    m = marts.period_mart(fact, "month")
    return m.groupBy("store_id", "period").agg(F.sum("value").cast("double").alias("value"),
                                               F.count(F.lit(1)).alias("products"))


@query("result_reload", with_sales(ANNOT_CTES + """
SELECT granularity AS granularidade, store_id, period AS periodo, COUNT(*) AS items,
       CAST(SUM(value) AS DOUBLE) AS listed_value
FROM ai GROUP BY granularity, store_id, period""", daily=True))
def q_result_reload(spark, sf):
    """K4 + S7 + U4: write period documents per granularity, read them back
    (one reader over all folders) and count the items."""
    from shelfrank.operators import documents
    path = documents.write_documents(_period_lines(spark, sf), _scratch(spark, "periods"),
                                     partition_by="granularidade")
    back = documents.read_period_documents(spark, path)
    return back.groupBy("granularidade", "store_id", "periodo").agg(
        F.count(F.lit(1)).alias("items"),
        F.sum(F.col("valor").cast("decimal(18,2)")).cast("double").alias("listed_value"))


@query("cache_two_runs", with_sales(_abc_sql("cur") + _abc_sql("prev", f"WHERE d < DATE '{CACHE_CUTOFF}'") + """,
b1 AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY rank, product) - 1) % 15 + 1 AS i FROM prev),
c1 AS (SELECT store_id, product, abc_class, 'Classe ' || abc_class || ' item ' || CAST(i AS VARCHAR) AS analysis
       FROM b1 WHERE i <> 3),
m2 AS (SELECT c.* FROM cur c ANTI JOIN c1 USING (store_id, product, abc_class)),
b2 AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY rank, product) - 1) % 15 + 1 AS i FROM m2),
n2 AS (SELECT store_id, product, abc_class, 'Classe ' || abc_class || ' item ' || CAST(i AS VARCHAR) AS analysis
       FROM b2 WHERE i <> 3)
SELECT * FROM n2 UNION ALL SELECT * FROM c1 ANTI JOIN n2 USING (store_id, product, abc_class)"""))
def q_cache_two_runs(spark, sf):
    """S6 + K6 + F12: the ABC job twice on one folder, first on the older sales;
    the second run reads the cache that the first one wrote and replaces it."""
    from shelfrank.operators import cache
    from shelfrank.plans import jobs
    out = _scratch(spark, "abc-daily")
    sales = sales_fact(spark, sf)
    for part in (sales.filter(F.col("d") < F.lit(CACHE_CUTOFF).cast("date")), sales):
        with jobs.abc_job(spark, part, out, annotator=stub_annotator):
            pass
    return cache.read_json(spark, f"{out}/cache")


@query("output_check", f"""
SELECT 'abc' AS output, COUNT(*) AS records, CAST(0 AS BIGINT) AS corrupt FROM ({with_sales(CACHE_CTES + " SELECT * FROM cur")}) a
UNION ALL SELECT 'cache', COUNT(*), 0 FROM ({with_sales(CACHE_CTES + " SELECT * FROM upserted")}) c
UNION ALL SELECT 'monthly', COUNT(*), 0 FROM (SELECT DISTINCT store_id, month FROM ({with_sales(MONTHLY_RANK_CTES + " SELECT * FROM tb")}) t) m
UNION ALL SELECT 'periods', COUNT(*), 0 FROM (SELECT DISTINCT granularity, store_id FROM ({with_sales(MULTI_CTE + " SELECT * FROM mm", daily=True)}) t) p
UNION ALL SELECT 'index', 1, 0""")
def q_output_check(spark, sf):
    """K1–K7: run the three jobs on the fact (stub annotator) and check what
    they wrote: records and corrupt records of each output."""
    from shelfrank.operators import documents
    from shelfrank.plans import jobs
    out = _scratch(spark, "jobs")
    stub = stub_annotator
    with jobs.abc_job(spark, sales_fact(spark, sf), f"{out}/abc", annotator=stub, cache_in=_prev_cache(spark, sf)) as r1, \
            jobs.monthly_job(spark, sales_fact(spark, sf), f"{out}/monthly", annotator=stub) as r2, \
            jobs.multi_job(spark, daily_fact(spark, sf), f"{out}/multi", annotator=stub) as r3:
        found = documents.output_check(spark, {**r1.outputs, **r2.outputs, **r3.outputs})
    return found.select("output", "records", "corrupt")


@query("selection_lists", with_sales(SELECTION_CTES + """,
ls AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY granularity, store_id, period, kind
                                    ORDER BY value DESC, product) AS lpos
       FROM sc)
SELECT granularity, store_id, period, kind AS list, CAST(lpos AS INTEGER) AS pos, product,
       CAST(value AS DOUBLE) AS value, abc_class
FROM ls WHERE lpos <= 10""", daily=True))
def q_selection_lists(spark, sf):
    """First 10 of the TOP list and of the BOTTOM list of each selection
    (both in descending value order, as the dashboard shows them)."""
    from shelfrank.operators import ranking
    out = ranking.flat(selections.kind_lists(selection(spark, sf)), PKEYS, col="lists")
    return out.select(*PKEYS, "list", "pos", "product", dbl("value").alias("value"), "abc_class")


@query("selection_summary", with_sales(SELECTION_CTES + """
SELECT granularity, store_id, period, COUNT(*) AS n_products,
       COUNT(*) FILTER (WHERE n_insights > 0) AS n_with_insight,
       CAST(SUM(n_insights) AS BIGINT) AS n_insights,
       COUNT(*) FILTER (WHERE abc_class = 'A') AS n_a,
       COUNT(*) FILTER (WHERE abc_class = 'B') AS n_b,
       COUNT(*) FILTER (WHERE abc_class = 'C') AS n_c,
       CAST(floor(COALESCE(CAST(SUM(CASE WHEN abc_class = 'A' THEN value END) AS DOUBLE), 0.0)
                  / CAST(MIN(total) AS DOUBLE) * 100.0 + 0.5) AS INTEGER) AS share_a,
       CAST(MIN(total) AS DOUBLE) AS total
FROM sc GROUP BY granularity, store_id, period""", daily=True))
def q_selection_summary(spark, sf):
    """A17 + A14 on a selection."""
    return selections.summary(selection(spark, sf), PKEYS)
