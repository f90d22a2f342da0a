"""Column expressions shared by the jobs. All of them stay inside Catalyst."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from biotrace.schema import AsOf

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- numbers -----------------------------------------------------------------


def round_half_up(value: ColumnOrName, digits: int = 2) -> Column:
    """Round a double as the decimal it stands for, once, half away from zero.

    A double stands for its 15 significant digits, which drops binary noise: a mean of
    78.784999999999997 is 78.785 and goes up, and 2.0049999996 stays below 2.005.
    """
    text = F.format_string("%.14e", _col(value).cast("double"))
    plain = F.abs(_col(value)) < 1e15
    exact = F.round(F.when(plain, text).cast("decimal(38,18)"), digits).cast("double")
    # Past 15 digits before the point there is nothing to round; NaN and infinity stay.
    return F.when(plain, exact).otherwise(_col(value).cast("double"))


def round_to_int(value: ColumnOrName) -> Column:
    """Cast to int with rounding; a plain Spark cast truncates."""
    return round_half_up(value, 0).cast("int")


def whole_division(dividend: ColumnOrName, divisor: int | Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", _col(dividend), F.lit(divisor))


def number_text(value: ColumnOrName) -> Column:
    """A double as text without a trailing ``.0``."""
    return F.regexp_replace(_col(value).cast("string"), r"\.0$", "")


def hrv_score(rmssd: ColumnOrName = "rmssd_ms") -> Column:
    """Heart-rate-variability score of a group: mean RMSSD times 600."""
    return F.avg(_col(rmssd)) * 600


def outside(value: ColumnOrName, low: float, high: float) -> Column:
    return (_col(value) < low) | (_col(value) > high)


def count_where(condition: Column) -> Column:
    """Rows of a group that meet a condition; 0, never NULL."""
    return F.count(F.when(condition, 1))


def sum_flag(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


# --- dates and times ---------------------------------------------------------


def as_of_date(as_of: AsOf) -> Column:
    """Reference date of an age: today unless one is given."""
    if as_of is None:
        return F.current_date()
    if isinstance(as_of, date | str):
        return F.lit(str(as_of)).cast("date")
    return as_of


def age_months(dob: ColumnOrName, as_of: AsOf = None) -> Column:
    """Full months lived. A birth on Feb 29 completes its month on Mar 1."""
    born, today = _col(dob), as_of_date(as_of)
    months = (F.year(today) - F.year(born)) * 12 + F.month(today) - F.month(born)
    return months - F.when(F.dayofmonth(today) < F.dayofmonth(born), 1).otherwise(0)


def age_years(dob: ColumnOrName, as_of: AsOf = None) -> Column:
    return whole_division(age_months(dob, as_of), 12).cast("int")


def age_at_most(dob: ColumnOrName, years: int, as_of: AsOf = None) -> Column:
    """Age as an interval is at most ``years``: up to and on that birthday."""
    born, today = _col(dob), as_of_date(as_of)
    full = age_years(born, today)
    birthday = (F.month(born) == F.month(today)) & (F.dayofmonth(born) == F.dayofmonth(today))
    return (full < years) | ((full == years) & birthday)


def time_of_day(ts: ColumnOrName) -> Column:
    """Clock time as ``HH:mm:ss``; Spark has no usable TIME type."""
    return F.date_format(_col(ts), "HH:mm:ss")


def hour_between(ts: ColumnOrName, first: int, last: int) -> Column:
    """Hour part in ``first..last``; 20:59 is still hour 20."""
    return F.hour(_col(ts)).between(first, last)


def on_date(ts: ColumnOrName, day: str | date) -> Column:
    """Timestamp falls on a day, written as a range so that it reaches the scan."""
    start = F.lit(str(day)).cast("date")
    return (_col(ts) >= start.cast("timestamp_ntz")) & (
        _col(ts) < F.date_add(start, 1).cast("timestamp_ntz")
    )


def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Exact seconds, with microseconds, from one timestamp to another."""
    return (_col(end) - _col(start)).cast("interval second").cast("decimal(20,6)")


def exact_epoch_seconds(ts: ColumnOrName) -> Column:
    """Seconds since 1970 of the wall-clock time, in any session time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return seconds_between(origin, _col(ts).cast("timestamp_ntz"))


def epoch_seconds(ts: ColumnOrName) -> Column:
    """The same as a double, for slots and other arithmetic per row."""
    return exact_epoch_seconds(ts).cast("double")


# --- text --------------------------------------------------------------------


def word_match(text: ColumnOrName, *words: str) -> Column:
    """One of the words occurs as a whole word, in any case."""
    choice = "|".join(re.escape(word.lower()) for word in words)
    return F.lower(_col(text)).rlike(rf"(?U)\b(?:{choice})\b")


def matches_any_case(text: ColumnOrName, pattern: str) -> Column:
    return _col(text).rlike(f"(?i){pattern}")


def title_case(text: ColumnOrName) -> Column:
    """Upper-case the first letter after anything that is not a letter or digit."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def last_word_character(text: ColumnOrName) -> Column:
    """Last character when it is a letter, digit or underscore, else NULL."""
    return F.nullif(F.regexp_extract(_col(text), r"(?U)\w\z", 0), F.lit(""))


def join_text(*parts: ColumnOrName) -> Column:
    """Concatenation in which a NULL counts as empty."""
    return F.concat_ws("", *[_col(part) for part in parts])


def day_of(value: ColumnOrName, true_date: bool = False) -> Column:
    """Day of the month, as the questions group by it, or the date itself."""
    return F.to_date(_col(value)) if true_date else F.dayofmonth(_col(value))
