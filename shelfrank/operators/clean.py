"""From raw sales text to the sales fact (P1, P4, P6a/b, P10–P12) and the
data-quality counts of that step (A13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfrank.config import DATE_RAW, PRODUCT, RAW_COLUMNS, STORE, VALUE_RAW
from shelfrank.functions import clean as C


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required=(STORE, PRODUCT, VALUE_RAW, DATE_RAW)) -> DataFrame:
    """Raise when a required column is missing (checked on the schema only)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing columns {missing}; available {df.columns}")
    return df


def rename_raw(df: DataFrame) -> DataFrame:
    """Map the export's bracketed column names to our short names."""
    names = dict(zip(RAW_COLUMNS, (STORE, PRODUCT, VALUE_RAW, DATE_RAW)))
    return df.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])


def money_mode(raw: DataFrame, currency: bool = False) -> str:
    """D3 ``auto``: ``plain`` when every text of the value column is a plain
    number, else ``br``. One aggregate over the raw column."""
    if not isinstance(raw.schema[VALUE_RAW].dataType, T.StringType):
        return "plain"
    s = C.money_text(VALUE_RAW, "plain", currency)
    other = F.col(VALUE_RAW).isNotNull() & ~s.rlike(C.PLAIN_NUMBER)
    return "br" if raw.agg(F.count_if(other).alias("n")).first().n else "plain"


def flag_sales(raw: DataFrame, money: str = "br", currency: bool = False,
               collapse_ws: bool = True, date_formats=C.DEFAULT_DATE_FORMATS) -> DataFrame:
    """Parsed columns plus the flags every later filter and count uses.

    A numeric value column is taken as it is (P2: numbers pass), a date or
    timestamp column too; ``money='auto'`` looks at the text first (D3).
    """
    require_columns(raw)
    value_type, date_type = raw.schema[VALUE_RAW].dataType, raw.schema[DATE_RAW].dataType
    if isinstance(value_type, T.NumericType):
        # by its text, which is the shortest that gives the number: 2.675 is 2.68
        exact = isinstance(value_type, (T.DecimalType, T.IntegralType))
        number = F.col(VALUE_RAW) if exact else F.col(VALUE_RAW).cast("string").try_cast("decimal(38,10)")
        value = F.coalesce(number.try_cast(C.MONEY), F.lit(0).cast(C.MONEY))
        rounded = F.coalesce(number != number.try_cast(C.MONEY), F.lit(False))
    else:
        if money == "auto":
            money = money_mode(raw, currency)
        value = C.parse_money(F.col(VALUE_RAW), money, currency)
        rounded = C.money_rounded(F.col(VALUE_RAW), money, currency)
    if isinstance(date_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        d = F.col(DATE_RAW).cast("date")
    else:
        d = C.parse_date(F.col(DATE_RAW), date_formats)
    return raw.select(
        F.col(STORE).cast("string").alias("store_id"),
        C.normalise_product(F.col(PRODUCT).cast("string"), collapse_ws).alias("product"),
        value.alias("value"), d.alias("d"), rounded.alias("rounded"),
    )


def _valid_store() -> Column:
    """A null or blank store is no store."""
    return F.coalesce(C.strip("store_id") != "", F.lit(False))


def _counts() -> list[Column]:
    """A13 over the rows of ``flag_sales``."""
    pos = F.col("value") > 0
    good_prod, good_store = F.coalesce(C.valid_product(F.col("product")), F.lit(False)), _valid_store()
    return [
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(~pos).alias("non_positive_values"),
        F.count_if(F.col("rounded")).alias("rounded_values"),
        F.count_if(pos & F.col("d").isNull()).alias("invalid_dates"),
        F.count_if(pos & ~good_prod).alias("invalid_products"),
        F.count_if(pos & ~good_store).alias("invalid_stores"),
        F.count_if(pos & good_prod & good_store).alias("valid_rows"),
    ]


def clean_sales(raw: DataFrame, money: str = "br", currency: bool = False,
                invalid_dates: str = "bucket", collapse_ws: bool = True,
                drop_invalid_products: bool = True,
                date_formats=C.DEFAULT_DATE_FORMATS, counts: Observation | None = None) -> DataFrame:
    """Raw text -> fact (store_id, product, value, d).

    ``invalid_dates='bucket'`` keeps undated sales in month ``NaT`` (ABC and
    monthly jobs), ``'drop'`` removes them (multi-granularity job), D1.
    A null or blank store is dropped (D11).

    ``counts``: an ``Observation`` that gets the counts of ``quality_counts``
    from the first pass over the result, whatever it is for; ``counts.get`` has
    them when that pass has run, and the raw rows are not read for them again.
    """
    f = flag_sales(raw, money, currency, collapse_ws, date_formats)
    if counts is not None:
        f = f.observe(counts, *_counts())
    f = f.drop("rounded").filter(F.col("value") > 0)
    if invalid_dates == "drop":
        f = f.filter(F.col("d").isNotNull())
    elif invalid_dates != "bucket":
        raise ValueError("invalid_dates must be 'bucket' or 'drop'")
    if drop_invalid_products:
        f = f.filter(C.valid_product(F.col("product")))
    return f.filter(_valid_store())


def quality_counts(raw: DataFrame, money: str = "br", currency: bool = False,
                   collapse_ws: bool = True, date_formats=C.DEFAULT_DATE_FORMATS) -> DataFrame:
    """A13 in one aggregate pass: rows read, values <= 0 or unparsable, values
    rounded to two decimals (D5), and among positive values invalid dates,
    products and stores; ``valid_rows`` is what ``clean_sales`` keeps."""
    return flag_sales(raw, money, currency, collapse_ws, date_formats).agg(*_counts())
