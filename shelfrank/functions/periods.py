"""Period keys (P7–P9, F1) and period labels (F2–F4), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Portuguese month names, January to December, as the reference prints them.
MONTH_NAMES = [
    "Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho",
    "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro",
]

GRANULARITIES = ("day", "week", "month")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_key(d) -> Column:
    """``yyyy-MM-dd``."""
    return F.date_format(_c(d), "yyyy-MM-dd")


def month_key(d) -> Column:
    """``yyyy-MM``."""
    return F.date_format(_c(d), "yyyy-MM")


def week_number(d) -> Column:
    """Monday-based week of the year; days before the first Monday are week 0.

    Same as C/Python ``%W``: (day_of_year + 6 - weekday_monday0) / 7, floored.
    ``weekofyear`` is the ISO week and would be wrong here.
    """
    d = _c(d)
    return F.floor((F.dayofyear(d) + F.lit(6) - F.weekday(d)) / F.lit(7)).cast("int")


def week_key(d) -> Column:
    """``yyyy-Www`` with the %W week number."""
    d = _c(d)
    return F.format_string("%04d-W%02d", F.year(d), week_number(d))


def period_key(d, granularity: str) -> Column:
    if granularity == "day":
        return day_key(d)
    if granularity == "week":
        return week_key(d)
    if granularity == "month":
        return month_key(d)
    raise ValueError(f"unknown granularity {granularity!r}")


def month_label(key) -> Column:
    """``2025-01`` -> ``Janeiro/2025``; an unknown month number is kept as is,
    a key without exactly one ``-`` is returned unchanged."""
    key = _c(key)
    parts = F.split(key, "-")
    names = F.create_map(
        *[x for i, n in enumerate(MONTH_NAMES) for x in (F.lit(f"{i + 1:02d}"), F.lit(n))]
    )
    mm = F.element_at(parts, 2)
    label = F.concat(F.coalesce(F.element_at(names, mm), mm), F.lit("/"), F.element_at(parts, 1))
    return F.when(F.size(parts) == 2, label).otherwise(key)


def week_start(key, iso_label: bool = False) -> Column:
    """Monday that starts the week of a ``yyyy-Www`` key.

    Default: the %W week (week 1 starts on the year's first Monday, week 0 on
    the Monday before it). ``iso_label=True`` decodes the number as an ISO
    week, as the dashboard does (off by one week in some years, D15).
    """
    key = _c(key)
    y = F.substring(key, 1, 4).cast("int")
    w = F.substring(key, 7, 2).cast("int")
    if iso_label:
        # the first ISO week is the one with the first Thursday: 4 January is in it
        first_monday = F.date_trunc("week", F.make_date(y, F.lit(1), F.lit(4))).cast("date")
    else:
        first_monday = F.next_day(F.make_date(y - 1, F.lit(12), F.lit(31)), "Mon")
    return F.date_add(first_monday, (w - 1) * 7)


def week_label(key, iso_label: bool = False) -> Column:
    """``Semana ww (dd/MM - dd/MM)``."""
    key = _c(key)
    start = week_start(key, iso_label)
    end = F.date_add(start, 6)
    return F.concat(
        F.lit("Semana "), F.substring(key, 7, 2), F.lit(" ("),
        F.date_format(start, "dd/MM"), F.lit(" - "), F.date_format(end, "dd/MM"), F.lit(")"),
    )


def day_label(key) -> Column:
    """``yyyy-MM-dd`` -> ``dd/MM/yyyy``."""
    key = _c(key)
    return F.concat_ws("/", F.substring(key, 9, 2), F.substring(key, 6, 2), F.substring(key, 1, 4))


def period_label(key, iso_label: bool = False) -> Column:
    """Dashboard label of any period key; unknown forms are returned as is."""
    key = _c(key)
    return (
        F.when(key.contains("W"), week_label(key, iso_label))
        .when(key.rlike(r"^\d{4}-\d{2}-\d{2}$"), day_label(key))
        .when(key.rlike(r"^\d{4}-\d{2}$"), month_label(key))
        .otherwise(key)
    )
