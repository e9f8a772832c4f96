"""Column-level cleaning: money text (P2, P3, D3, D4), day-first dates (P5),
product text (P10–P12), store id (P16) and currency text (F7).

All are built-in expressions (no Python UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
# A plain decimal number after locale clean-up; exponent, underscore, inf/nan
# and type suffixes are refused before the cast.
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"
DEFAULT_DATE_FORMATS = ("d/M/yyyy",)
# Unicode-aware whitespace (Python's str.strip/\s), D10.
_WS = r"(?U)\s"
# What ``str.strip()`` removes (fixed values: the Unicode white space characters
# and the four ASCII separators).
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
              + "\u2028\u2029\u202f\u205f\u3000")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: removes Unicode whitespace (NBSP too) at both ends."""
    return F.btrim(_c(c), F.lit(WHITESPACE))


def money_text(c, mode: str = "br", currency: bool = False) -> Column:
    """The text as a plain decimal number, where it is one: see ``parse_money``."""
    s = strip(c)
    if currency:
        # NBSP is what pt-BR formatters put behind the currency sign
        s = strip(F.replace(F.replace(s, F.lit("R$"), F.lit("")), F.lit(" "), F.lit("")))
    if mode == "br":
        s = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    elif mode != "plain":
        raise ValueError(f"money mode must be 'br' or 'plain', not {mode!r}")
    return s


def parse_money(c, mode: str = "br", currency: bool = False) -> Column:
    """P2 (``currency=False``) / P3 (``currency=True``): text to decimal(18,2).

    ``mode='br'``: dots are thousands separators and the comma is the decimal
    mark (``1.234,56``); ``mode='plain'``: the text is a plain number. Null or
    unparsable text gives 0, so the ``value > 0`` filter (P4) drops it. For
    numeric columns and mode ``auto`` see ``operators.clean``.
    """
    s = money_text(c, mode, currency)
    v = F.when(s.rlike(PLAIN_NUMBER), s.try_cast(MONEY))
    return F.coalesce(v, F.lit(0).cast(MONEY))


def money_rounded(c, mode: str = "br", currency: bool = False) -> Column:
    """Whether a parsable text has more than two decimals, other than zeros."""
    s = money_text(c, mode, currency)
    return F.coalesce(s.rlike(PLAIN_NUMBER) & s.rlike(r"\.\d\d\d*[1-9]\d*$"), F.lit(False))


def parse_date(c, formats=DEFAULT_DATE_FORMATS) -> Column:
    """P5: day-first text to date; the first format that parses wins, else null.
    ``31/02/2024`` and ``05/13/2024`` are null (D2: no per-column guessing)."""
    c = _c(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def month_bucket(d) -> Column:
    """Month key, or the literal ``NaT`` for a missing date."""
    return F.coalesce(F.date_format(_c(d), "yyyy-MM"), F.lit("NaT"))


def normalise_product(c, collapse_ws: bool = True) -> Column:
    """P10 (collapse inner whitespace runs) / P11 (``collapse_ws=False``: ends only)."""
    c = _c(c)
    if collapse_ws:
        return F.upper(F.trim(F.regexp_replace(c, rf"{_WS}+", " ")))
    return F.upper(strip(c))


def valid_product(c) -> Column:
    """Not null, not empty, not the text ``NAN``."""
    c = _c(c)
    return c.isNotNull() & (c != "") & (c != "NAN")


def store_number(c) -> Column:
    """The store id as an int when it is one, else null."""
    return _c(c).try_cast("int")


def brl_text(v) -> Column:
    """F7, pt-BR: ``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(_c(v), 2), ",.", ".,"))


def usd_grouped_text(v) -> Column:
    """F7, en-US grouping as the prompt prints it: ``R$ 1,234.56``."""
    return F.concat(F.lit("R$ "), F.format_number(_c(v), 2))
