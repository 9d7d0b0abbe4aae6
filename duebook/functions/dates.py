"""Statement dates and calendar arithmetic, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duebook.functions.binding import let
from duebook.functions.descriptors import strip

# ---- fixed values: the accepted layouts, as (shape, ISO rearrangement) ------
_DAY = r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])"
_MONTH = r"(1[0-2]|0[1-9]|[1-9])"
_YEAR4 = r"(\d{4})"
_YEAR2 = r"(\d{2})"
_NAME = r"([A-Za-z]{3})"
_EITHER = (
    (f"{_YEAR4}-{_MONTH}-{_DAY}", "$1-$2-$3"),
    (f"{_YEAR4}/{_MONTH}/{_DAY}", "$1-$2-$3"),
    (f"{_DAY}-{_NAME}-{_YEAR4}", "$3-$2-$1"),
    (rf"{_DAY}\s+{_NAME}\s+{_YEAR4}", "$3-$2-$1"),
    (rf"{_DAY}\.{_MONTH}\.{_YEAR4}", "$3-$2-$1"),
)
MONTH_FIRST = _EITHER + (
    (f"{_MONTH}/{_DAY}/{_YEAR4}", "$3-$1-$2"),
    (f"{_MONTH}/{_DAY}/{_YEAR2}", "$3-$1-$2"),
    (f"{_MONTH}-{_DAY}-{_YEAR4}", "$3-$1-$2"),
    (rf"{_NAME}\s+{_DAY},\s+{_YEAR4}", "$3-$1-$2"),
)
DAY_FIRST = _EITHER + (
    (f"{_DAY}/{_MONTH}/{_YEAR4}", "$3-$2-$1"),
    (f"{_DAY}/{_MONTH}/{_YEAR2}", "$3-$2-$1"),
    (f"{_DAY}-{_MONTH}-{_YEAR4}", "$3-$2-$1"),
    (rf"{_DAY}\.{_MONTH}\.{_YEAR2}", "$3-$2-$1"),
)
MONTH_NAMES = "JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC"
FIRST_1900S_YEAR = 69     # 69..99 -> 1969..1999, 00..68 -> 2000..2068
# ---------------------------------------------------------------------------


def _from_parts(ymd: Column) -> Column:
    year, month, day = ymd[0], ymd[1], F.trim(ymd[2])
    century = (F.when(F.length(year) == 4, F.lit(""))
               .when(year.cast("int") >= FIRST_1900S_YEAR, F.lit("19")).otherwise(F.lit("20")))
    number = F.when(month.rlike("[A-Za-z]"), let(
        F.instr(F.lit(MONTH_NAMES), F.upper(month)),
        lambda at: F.when(at % 3 == 1, F.floor((at + 2) / 3).cast("string")))).otherwise(month)
    full = F.concat(century, year, F.lit("-"), number, F.lit("-"), day)
    return F.when(year != "0000", full.try_cast("date"))


def _parse(text: Column, layouts) -> Column:
    """Only a text that fits a layout is rearranged; any other gives NULL."""
    fitted = F.coalesce(*(F.when(text.rlike(f"^{shape}$"), F.regexp_replace(
        text, F.lit(f"^{shape}$"), F.lit(order))) for shape, order in layouts))
    return let(fitted, lambda iso: let(F.split(iso, "-"), _from_parts))


def parse_date(raw: Column, dayfirst: Column | bool = False) -> Column:
    """Statement date text -> DATE, NULL when no layout fits or no such day."""
    def by_order(text: Column) -> Column:
        if isinstance(dayfirst, bool):
            return _parse(text, DAY_FIRST if dayfirst else MONTH_FIRST)
        return (F.when(dayfirst, _parse(text, DAY_FIRST))
                .otherwise(_parse(text, MONTH_FIRST)))

    return let(strip(F.coalesce(raw, F.lit(""))), by_order)


def days_in_month(d: Column) -> Column:
    return F.dayofmonth(F.last_day(d))


def month_day(d: Column, months: Column, anchor: Column) -> Column:
    """Day `anchor` of the month `months` after d's, clamped to its length."""
    first = F.add_months(F.trunc(d, "MM"), months.cast("int"))
    return F.date_add(first, (F.least(anchor, days_in_month(first)) - 1).cast("int"))
