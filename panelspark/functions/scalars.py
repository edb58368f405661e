"""Scalar and aggregate expressions with the panel engine's missing-value rules.

Every function takes and returns a Column, so all of it stays inside Catalyst.
ANSI mode is assumed on: divisions and casts that may fail use the ``try_`` forms.
"""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def as_col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


# -- arithmetic ---------------------------------------------------------------


def safe_div(num: ColumnOrName, den: ColumnOrName) -> Column:
    """Ratio that is NULL where the denominator is zero or missing."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def safe_ln(value: ColumnOrName) -> Column:
    """Natural log, NULL for zero and negative input."""
    return F.ln(as_col(value).cast("double"))


def scaled_log_rate(count: ColumnOrName, population: ColumnOrName, scale: float) -> Column:
    """ln(scale * count / population)."""
    return F.ln(safe_div(F.lit(float(scale)) * as_col(count), population))


def power(value: ColumnOrName, degree: int) -> Column:
    """Integer power as repeated multiplication (exact for small degrees)."""
    base = as_col(value)
    out = base
    for _ in range(degree - 1):
        out = out * base
    return out


# -- aggregates ---------------------------------------------------------------


def sum_zero(value: ColumnOrName) -> Column:
    """Group sum in which an all-missing group gives 0."""
    total = F.sum(as_col(value))
    return F.coalesce(total, F.lit(0))


def sum_strict(value: ColumnOrName) -> Column:
    """Group sum that is NULL as soon as one value of the group is missing."""
    c = as_col(value)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def mean_strict(value: ColumnOrName) -> Column:
    c = as_col(value)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


# -- dates --------------------------------------------------------------------


def week52(date: ColumnOrName) -> Column:
    """Week of the year counted in 7-day blocks from 1 January.

    Week 52 takes the remaining days, so the result is always 1..52. This is not the
    ISO week.
    """
    day = F.dayofyear(as_col(date))
    return F.least(F.lit(52), F.floor((day - 1) / F.lit(7)).cast("int") + 1).cast("int")


def parse_date(text: ColumnOrName, pattern: str) -> Column:
    """Date from text, NULL when the text does not fit. Two-digit years mean 20YY."""
    return F.try_to_date(as_col(text), pattern)


def parse_mdy2(text: ColumnOrName) -> Column:
    """``M/D/YY`` → date in this century."""
    return parse_date(text, "M/d/yy")


def parse_ymd(text: ColumnOrName) -> Column:
    return parse_date(text, "yyyy-MM-dd")


def month_start(text: ColumnOrName, pattern: str = "yyyyMM") -> Column:
    """First day of a month written as ``YYYYMM`` or ``YYYY/MM``.

    The year and month are cut out by position and joined with day 01.
    """
    c = as_col(text)
    month_at = pattern.index("M") + 1
    iso = F.concat(F.substring(c, 1, 4), F.lit("-"), F.substring(c, month_at, 2), F.lit("-01"))
    return F.try_to_date(iso, "yyyy-MM-dd")


def clock_to_date(stamp: ColumnOrName) -> Column:
    """Calendar day of a timestamp without time zone."""
    return F.to_date(as_col(stamp))


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    return F.datediff(as_col(later), as_col(earlier))


def within_days(date: ColumnOrName, start: ColumnOrName, days: int) -> Column:
    """True where start <= date <= start + days."""
    first = as_col(start)
    return as_col(date).between(first, F.date_add(first, days))


# -- text ---------------------------------------------------------------------

# Citation marks run from [1] to [130] in the source pages (fixed range).
CITATION_MARK = r"\[([1-9]|[1-9][0-9]|1[0-2][0-9]|130)\]"


def strip_citations(text: ColumnOrName) -> Column:
    """Remove ``[1]`` … ``[130]``; other bracketed numbers stay."""
    return F.regexp_replace(as_col(text), CITATION_MARK, "")


def digits_only(text: ColumnOrName) -> Column:
    """Long made of the digits in the text; NULL if there are none."""
    return F.regexp_replace(as_col(text), "[^0-9]", "").try_cast("long")


def count_from_text(text: ColumnOrName) -> Column:
    """Count written with thousands separators and citation marks."""
    return digits_only(strip_citations(text))


def ascii_only(text: ColumnOrName) -> Column:
    """Text without its non-ASCII characters."""
    return F.regexp_replace(as_col(text), r"[^\x00-\x7F]", "")


def sentinel_to_null(value: ColumnOrName, *sentinels) -> Column:
    out = as_col(value)
    for s in sentinels:
        out = F.nullif(out, F.lit(s))
    return out


def null_to_sentinel(value: ColumnOrName, sentinel) -> Column:
    return F.coalesce(as_col(value), F.lit(sentinel))


def blank_to_null(value: ColumnOrName) -> Column:
    """The empty string is a missing string."""
    return F.nullif(as_col(value), F.lit(""))


def tolerant_cast(value: ColumnOrName, type_name: str) -> Column:
    return as_col(value).try_cast(type_name)


# -- display ------------------------------------------------------------------


def fixed_text(value: ColumnOrName, digits: int) -> Column:
    """Number with thousands separators and a fixed number of digits."""
    return F.format_number(as_col(value), digits)


def day_text(date: ColumnOrName) -> Column:
    """Date shown like 05feb2020."""
    return F.lower(F.date_format(as_col(date), "ddMMMyyyy"))


def signif(value: ColumnOrName, digits: int = 9, zero_below: float = 1e-9) -> Column:
    """Round to significant digits; values under ``zero_below`` become 0."""
    x = as_col(value).cast("double")
    size = F.lit(digits - 1) - F.floor(F.log10(F.abs(x))).cast("int")
    up = F.pow(F.lit(10.0), size.cast("double"))
    down = F.pow(F.lit(10.0), (-size).cast("double"))
    rounded = F.when(size >= 0, F.round(x * up) / up).otherwise(F.round(x / down) * down)
    return F.when(F.abs(x) < F.lit(zero_below), F.lit(0.0)).otherwise(rounded)
