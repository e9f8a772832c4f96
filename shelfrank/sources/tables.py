"""Sales facts built from the driver's parquet tables (FIXTURES §1).

The fact has four columns: ``store_id`` (string), ``product`` (string),
``value`` (decimal(18,2)) and ``d`` (date). In production the fact comes
from the raw sales export (:mod:`shelfrank.sources.files`); on the test
tables it is derived from TPC-H-style ``lineitem`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def sales_fact(spark: SparkSession, sf_dir: str, stores: str = "nation", product: bool = True) -> DataFrame:
    """lineitem ⋈ supplier ⋈ part (⋈ nation for region-stores).

    ``product=False`` leaves the product column out, and with it the join with
    ``part`` (every line has a part), for totals that do not need it.

    ``stores='nation'`` keys a store by the supplier's nation,
    ``stores='region'`` by the nation's region. Only the needed columns are
    selected so the parquet scans read four lineitem columns. Join strategy
    is left to Catalyst/AQE: at scale ``part`` and ``supplier`` are too big
    to broadcast and the joins are shuffled on their keys; ``nation`` is a
    25-row dimension and is broadcast by the size threshold.
    """
    li = table(spark, sf_dir, "lineitem").select(
        *(["l_partkey"] if product else []), "l_suppkey", "l_extendedprice", "l_shipdate"
    )
    # per-row text work happens on the dimension side, before the join
    part = table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("product"))
    if stores == "region":
        sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nation = table(spark, sf_dir, "nation").select(
            "n_nationkey", F.col("n_regionkey").cast("string").alias("store_id"))
        sup = sup.join(nation, sup.s_nationkey == nation.n_nationkey).select("s_suppkey", "store_id")
    elif stores == "nation":
        sup = table(spark, sf_dir, "supplier").select(
            "s_suppkey", F.col("s_nationkey").cast("string").alias("store_id"))
    else:
        raise ValueError(f"stores must be 'nation' or 'region', not {stores!r}")
    df = li.join(sup, li.l_suppkey == sup.s_suppkey)
    if product:
        df = df.join(part, li.l_partkey == part.p_partkey)
    return df.select(
        "store_id", *(["product"] if product else []),
        F.col("l_extendedprice").cast(MONEY).alias("value"),
        F.col("l_shipdate").cast("date").alias("d"),
    )


def typed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales with native types: l_orderkey, store_number (int), product,
    value (decimal), d (date)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    df = li.join(sup, li.l_suppkey == sup.s_suppkey).join(part, li.l_partkey == part.p_partkey)
    return df.select("l_orderkey", F.col("s_nationkey").cast("int").alias("store_number"), F.col("p_name").alias("product"),
                     F.col("l_extendedprice").cast(MONEY).alias("value"), F.col("l_shipdate").cast("date").alias("d"))


def daily_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense-day fact from ``events``: store = event type, product = user."""
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    return ev.select(
        F.col("event_type").alias("store_id"),
        F.concat(F.lit("USER "), F.col("user_id").cast("string")).alias("product"),
        F.col("value").cast(MONEY).alias("value"),
        F.col("ts").cast("date").alias("d"),
    )


# DuckDB twins of the two facts, used by the oracle SQL.
SALES_SQL = """
SELECT CAST(s.s_nationkey AS VARCHAR) AS store_id,
       UPPER(p.p_name) AS product,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS value,
       CAST(l.l_shipdate AS DATE) AS d
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

DAILY_SQL = """
SELECT event_type AS store_id,
       'USER ' || CAST(user_id AS VARCHAR) AS product,
       CAST(value AS DECIMAL(18,2)) AS value,
       CAST(ts AS DATE) AS d
FROM events
"""


def raw_sales_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sales fact re-rendered as the reference's raw export text.

    Every lineitem row is kept; a deterministic rule on the row's keys picks
    the text variant, so the cleaning operators meet every case they handle:
    money ``1.234,56`` / ``1.234,567`` / ``1234,56`` / ``R$ 1.234,56`` (space or
    NBSP) / negative / ``0,00``, blank stores,
    dates ``dd/MM/yyyy`` / ``d/M/yyyy`` / ISO (invalid) / ``31/02`` (invalid),
    products with case, doubled spaces, NBSP and tab noise, or blank.
    Columns: store_id, product, value_raw, date_raw (all strings) + keys.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    df = li.join(sup, li.l_suppkey == sup.s_suppkey).join(part, li.l_partkey == part.p_partkey)
    v = F.col("l_extendedprice").cast(MONEY)
    br = F.translate(F.format_number(v, 2), ",.", ".,")
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 10
    sign = F.when(F.col("l_orderkey") % 2 == 0, F.lit("R$\u00a0")).otherwise(F.lit("R$ "))
    money = (F.when((k <= 5) & (F.col("l_orderkey") % 83 == 0), F.concat(br, F.lit("7")))
             .when(k <= 5, br)
             .when(k == 6, F.replace(v.cast("string"), F.lit("."), F.lit(",")))
             .when(k == 7, F.concat(sign, br))
             .when(k == 8, F.concat(F.lit("-"), br))
             .otherwise(F.lit("0,00")))
    d = F.col("l_shipdate").cast("date")
    m = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10
    date = (F.when(m <= 6, F.date_format(d, "dd/MM/yyyy"))
            .when(m == 7, F.date_format(d, "d/M/yyyy"))
            .when(m == 8, F.date_format(d, "yyyy-MM-dd"))
            .otherwise(F.concat(F.lit("31/02/"), F.date_format(d, "yyyy"))))
    p = F.col("l_partkey") % 4
    name = F.col("p_name")
    product = (F.when(F.col("l_partkey") % 97 == 0, F.lit(" "))
               .when(p == 0, name)
               .when(p == 1, F.upper(F.replace(name, F.lit(" "), F.lit("  "))))
               .when(p == 2, F.concat(F.lit("\u00a0 "), name, F.lit(" ")))
               .otherwise(F.concat(name, F.lit("\t"))))
    return df.select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 89 == 0, F.lit(" \u00a0")).otherwise(
            F.col("s_nationkey").cast("string")).alias("store_id"),
        product.alias("product"), money.alias("value_raw"), date.alias("date_raw"))


RAW_SALES_SQL = r"""
SELECT l.l_orderkey, l.l_linenumber,
       CASE WHEN l.l_orderkey % 89 = 0 THEN ' ' || chr(160) ELSE CAST(s.s_nationkey AS VARCHAR) END AS store_id,
       CASE WHEN l.l_partkey % 97 = 0 THEN ' '
            WHEN l.l_partkey % 4 = 0 THEN p.p_name
            WHEN l.l_partkey % 4 = 1 THEN upper(replace(p.p_name, ' ', '  '))
            WHEN l.l_partkey % 4 = 2 THEN chr(160) || ' ' || p.p_name || ' '
            ELSE p.p_name || chr(9) END AS product,
       CASE WHEN (l.l_orderkey + l.l_linenumber) % 10 <= 5 AND l.l_orderkey % 83 = 0
              THEN translate(format('{:,.2f}', CAST(l.l_extendedprice AS DECIMAL(18,2))), ',.', '.,') || '7'
            WHEN (l.l_orderkey + l.l_linenumber) % 10 <= 5
              THEN translate(format('{:,.2f}', CAST(l.l_extendedprice AS DECIMAL(18,2))), ',.', '.,')
            WHEN (l.l_orderkey + l.l_linenumber) % 10 = 6
              THEN replace(CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), '.', ',')
            WHEN (l.l_orderkey + l.l_linenumber) % 10 = 7
              THEN 'R$' || CASE WHEN l.l_orderkey % 2 = 0 THEN chr(160) ELSE ' ' END || translate(format('{:,.2f}', CAST(l.l_extendedprice AS DECIMAL(18,2))), ',.', '.,')
            WHEN (l.l_orderkey + l.l_linenumber) % 10 = 8
              THEN '-' || translate(format('{:,.2f}', CAST(l.l_extendedprice AS DECIMAL(18,2))), ',.', '.,')
            ELSE '0,00' END AS value_raw,
       CASE WHEN (l.l_orderkey * 7 + l.l_linenumber) % 10 <= 6 THEN strftime(l.l_shipdate, '%d/%m/%Y')
            WHEN (l.l_orderkey * 7 + l.l_linenumber) % 10 = 7 THEN strftime(l.l_shipdate, '%-d/%-m/%Y')
            WHEN (l.l_orderkey * 7 + l.l_linenumber) % 10 = 8 THEN strftime(l.l_shipdate, '%Y-%m-%d')
            ELSE '31/02/' || strftime(l.l_shipdate, '%Y') END AS date_raw
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN part p ON l.l_partkey = p.p_partkey
"""

# DuckDB twins of the cleaning expressions (functions.clean).
WS_SQL = r"[\s\x{00A0}]"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{WS_SQL}+|{WS_SQL}+$', '', 'g')"


def money_sql(c: str, currency: bool = False) -> str:
    s = strip_sql(c)
    if currency:
        s = strip_sql(f"replace(replace({s}, 'R$', ''), ' ', '')")
    s = f"replace(replace({s}, '.', ''), ',', '.')"
    return (f"COALESCE(CASE WHEN regexp_matches({s}, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') "
            f"THEN TRY_CAST({s} AS DECIMAL(18,2)) END, CAST(0 AS DECIMAL(18,2)))")


def store_sql(c: str) -> str:
    """Rows with a store."""
    return f"({c} IS NOT NULL AND {strip_sql(c)} <> '')"


def date_sql(c: str) -> str:
    return f"CAST(TRY_STRPTIME({c}, '%d/%m/%Y') AS DATE)"


def product_sql(c: str, collapse_ws: bool = True) -> str:
    if collapse_ws:
        return f"upper(trim(regexp_replace({c}, '{WS_SQL}+', ' ', 'g')))"
    return f"upper({strip_sql(c)})"
