"""Currency minor units, amount parsing, annual cost. Amounts are integer minor
units of their own currency and are never added across currencies."""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook.functions.binding import let
from duebook.functions.descriptors import strip

# ---- fixed values: ISO 4217 currencies without two decimals ----------------
ZERO_DECIMAL = ("BIF", "CLP", "DJF", "GNF", "JPY", "KMF", "KRW", "MGA", "PYG",
                "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF")
THREE_DECIMAL = ("BHD", "IQD", "JOD", "KWD", "LYD", "OMR", "TND")
DEFAULT_CURRENCY = "USD"
DAYS_PER_YEAR = 365.25
# ---------------------------------------------------------------------------


def minor_digits(currency: Column) -> Column:
    """Digits after the decimal point; NULL or empty counts as USD."""
    c = F.upper(currency)
    return (F.when(c.isin(*ZERO_DECIMAL), 0).when(c.isin(*THREE_DECIMAL), 3)
            .otherwise(2).cast("int"))


def minor_scale(currency: Column) -> Column:
    c = F.upper(currency)
    return (F.when(c.isin(*ZERO_DECIMAL), 1.0).when(c.isin(*THREE_DECIMAL), 1000.0)
            .otherwise(100.0))


def to_minor(amount: Column, currency: Column) -> Column:
    """Decimal as written -> integer minor units, halves to even."""
    return F.rint(amount * minor_scale(currency)).try_cast("bigint")


def whole(c: Column) -> Column:
    """Truncate towards zero, as taking the integer part of a median does."""
    return c.cast("bigint")


def format_minor(units: Column, currency: Column) -> Column:
    """1549, USD -> '15.49 USD'. Decimal arithmetic, so any size is exact."""
    d = units.cast("decimal(20,0)")
    text = (F.when(minor_digits(currency) == 0, F.format_number(d, 0))
            .when(minor_digits(currency) == 3,
                  F.format_number((d / F.lit(1000)).cast("decimal(23,3)"), 3))
            .otherwise(F.format_number((d / F.lit(100)).cast("decimal(22,2)"), 2)))
    return F.concat(text, F.lit(" "), F.upper(currency))


def annualise(minor: Column, period_days: Column) -> Column:
    """Cost per year in minor units; also the yearly effect of a price delta."""
    return F.rint(minor * F.lit(DAYS_PER_YEAR) / period_days).cast("bigint")


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    chars = [chr(i) for i in range(0x80, sys.maxunicode + 1) if chr(i).isdecimal()]
    return "".join(chars), "".join(str(int(c)) for c in chars)


def _ascii_digits(c: Column) -> Column:
    """Decimal digits of any script to 0-9; plain ASCII text is left alone."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, *_decimal_digits())).otherwise(c)


def parse_amount(raw: Column, currency: Column) -> Column:
    """Statement amount text -> signed minor units, NULL when unreadable.

    The decimal separator is found rather than assumed. With both ``.`` and ``,``
    present it is the later one. With one kind it is a decimal separator only if
    the digits after its last occurrence could be a fraction of that currency
    (1..2 for most, 1..3 for dinars, none for yen); otherwise it groups
    thousands. A currency without decimals still loses a written-out ``.00``.
    Parentheses or a ``-`` anywhere mean money out. Grouping characters other
    than the plain space (NBSP and kin) are not understood and give NULL.
    """
    digits = minor_digits(currency)

    def scaled(plain: Column, negative: Column) -> Column:
        number = F.when(plain.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), plain.try_cast("double"))
        return let(to_minor(number, currency),
                   lambda u: F.when(negative, -F.abs(u)).otherwise(u))

    def separated(kept: Column, negative: Column) -> Column:
        after = F.length(F.regexp_extract(kept, r"([^.,]*)$", 1))
        last = F.regexp_extract(kept, r"([.,])[^.,]*$", 1)
        fraction = (kept.contains(".") & kept.contains(",")) | after.between(1, digits)
        plain = (F.when(fraction & (last == ","), F.translate(kept, ",. ", "."))
                 .when(fraction & (last == "."), F.translate(kept, ", ", ""))
                 .otherwise(F.translate(kept, "., ", "")))
        return let(_ascii_digits(plain), lambda p: scaled(p, negative))

    def signed(text: Column) -> Column:
        negative = (text.startswith("(") & text.endswith(")")) | text.contains("-")
        kept = strip(F.regexp_replace(text, F.lit(r"(?U)[^\d.,\s]"), F.lit("")))
        kept = F.when(digits == 0, F.regexp_replace(
            kept, F.lit(r"(?U)(?<=[\d.,\s])[.,]\d{2}$"), F.lit(""))).otherwise(kept)
        return let(kept, lambda k: separated(k, negative))

    return let(strip(F.coalesce(raw, F.lit(""))), signed)
