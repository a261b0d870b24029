"""Small column expressions shared by operators and reports."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LabelRule, MONEY, NEW, RETURNING

# The characters Unicode counts as white space, and the separators next to them.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Fixed value: what a plain decimal or scientific number looks like.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def rounded(x: Column, digits: int) -> Column:
    """Half-even rounding of the scaled value."""
    scale = float(10 ** digits)
    return F.rint(x.cast("double") * F.lit(scale)) / F.lit(scale)


def per(n: Column, d: Column) -> Column:
    """n / d as double, with a zero denominator read as one."""
    d = d.cast("double")
    return n.cast("double") / F.when(d == 0, F.lit(1.0)).otherwise(d)


def percent(n: Column, d: Column) -> Column:
    d = d.cast("double")
    return n.cast("double") / F.when(d == 0, F.lit(1.0)).otherwise(d) * F.lit(100.0)


def delta_percent(cur: Column, prev: Column) -> Column:
    """Change against a previous value in percent of it; null if that was zero."""
    cur, prev = cur.cast("double"), prev.cast("double")
    return F.when(prev != 0, (cur - prev) / F.abs(prev) * F.lit(100.0))


def money(x: float) -> Column:
    """Literal that compares with amounts as a decimal, so the scan can use it."""
    return F.lit(Decimal(str(x)))


def amount(x: Column) -> Column:
    return x.cast("double")


def one_of(column: str, values: Iterable[str]) -> Column:
    return F.col(column).isin(*values)


def all_of(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.btrim(text, F.lit(SPACES))


def clean_text(column: str, tokens: tuple[str, ...], default: str) -> Column:
    """Stripped text with the default for null and every missing-value token."""
    text = F.col(column)
    return F.when(text.isNull() | text.isin(*tokens), F.lit(default)).otherwise(text)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often it is used.

    The optimizer copies an expression to every place that names it, and those again where
    they are nested. A variable of a higher-order function it leaves alone.
    """
    return F.transform(F.array(value), use)[0]


# Parts of a time that a cast can't read as it is: date, time of day, half of day or the rest. The
# parts are set apart by a character that texts without white space at their ends don't begin with.
_MARK = "\x1f"
_SPACE = f"[{SPACES}]"
_UNUSUAL = (rf"^(\d{{4}})(?:[-/.](\d{{1,2}})[-/.](\d{{1,2}})|(\d{{2}})(\d{{2}}))"
            rf"(?:(?:{_SPACE}+|T)([^{SPACES}]+?))?(?:{_SPACE}*([AaPp][Mm])|{_SPACE}+([^{SPACES}]+))?$")
_PARTS = f"{_MARK}$1-$2$4-$3$5 $6 $8{_MARK}$7"


def parse_time(column: str) -> Column:
    """Timestamp without zone from text, null if unreadable."""
    return read_time(strip(F.col(column)))


def read_time(plain: Column) -> Column:
    """Timestamp without zone from stripped text, null if unreadable.

    Dates may be dashed, slashed, dotted or eight digits in a row; the time of day may be
    missing, or on the twelve-hour clock with AM or PM. An offset is not applied: times are
    wall-clock times of the shop.
    """
    # Dashed text as a cast reads it, the usual form, needs no pattern. A bare number is not
    # a date here, though a cast would read it as a year.
    usual = F.when(plain.contains("-"), plain.try_cast("timestamp_ntz"))
    return F.coalesce(usual, bound(F.regexp_replace(plain, _UNUSUAL, _PARTS), _from_parts))


def _from_parts(parts: Column) -> Column:
    """Time of a text in parts; null if the pattern left the text as it was."""
    whole = F.trim(F.substring_index(F.substring(parts, F.lit(2), F.length(parts)), _MARK, 1)).try_cast("timestamp_ntz")
    half = F.upper(F.substring_index(parts, _MARK, -1))

    def on_the_clock(time: Column) -> Column:
        hour = F.hour(time)
        shift = F.when((half == "PM") & (hour < 12), 12).when((half == "AM") & (hour == 12), -12).otherwise(0)
        return F.when((half == "") | hour.between(1, 12), time + F.make_dt_interval(hours=shift))

    return F.when(F.startswith(parts, F.lit(_MARK)), bound(whole, on_the_clock))


def to_money(number: Column, strict: bool = True) -> Column:
    """Amount of a text that is a number; one that an amount can't hold is an error, or else null."""
    value = number.try_cast(MONEY)
    if not strict:
        return value
    return F.when(number.isNotNull(), F.coalesce(
        value, F.raise_error(F.concat(F.lit("amount out of range: "), number)).cast(MONEY)))


def parse_money(column: str) -> Column:
    """Amount from text in whole cents; zero if it is not a plain number."""
    return read_money(strip(F.col(column)))


def read_money(text: Column, strict: bool = True) -> Column:
    """Amount from stripped text in whole cents, rounded half up; zero if it is not a plain number.

    A number that an amount can't hold is an error, or null if not `strict`.
    """
    if not strict:
        return F.when(text.rlike(NUMBER), to_money(text, strict)).otherwise(F.lit(0).cast(MONEY))
    return F.coalesce(to_money(F.when(text.rlike(NUMBER), text)), F.lit(0).cast(MONEY))


def is_new() -> Column:
    return F.col("customer_type") == NEW


def is_returning() -> Column:
    return F.col("customer_type") == RETURNING


def qualifies(rule: LabelRule) -> Column:
    """Order that can make later orders of its user `returning`."""
    cond = one_of("order_status", rule.statuses) & (F.col("gmv") >= money(rule.min_amount))
    if rule.channels:
        cond = cond & one_of("channel_type", rule.channels)
    return cond


def whole_days(start: Column, end: Column) -> Column:
    """Full days from start to end, for end >= start."""
    return F.extract(F.lit("DAY"), end - start).cast("long")


def midnight(day: dt.date) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def first_match(value: Column, buckets, closed: str) -> Column:
    """Label of the first bucket a value falls into, the last label if none.

    `buckets` are (label, low, high) with high None for an open end. With
    closed="both" a bucket is [low, high]; with closed="right" it is (low, high],
    and a bucket that starts at zero takes everything up to its high end.
    """
    out = None
    for label, low, high in buckets:
        if high is None:
            cond = value > low if closed == "right" else value >= low
        elif closed == "right":
            cond = (value <= high) if low == 0 else (value > low) & (value <= high)
        else:
            cond = (value >= low) & (value <= high)
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(buckets[-1][0]))
