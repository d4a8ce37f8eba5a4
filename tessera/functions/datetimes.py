"""The datetime function library: Column in, Column out, missing stays missing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c) -> Column:
    """Microseconds since the epoch (a time without zone is read in the session's zone, UTC)."""
    return F.unix_micros(_c(c).cast("timestamp"))


year, month, day = (lambda c: F.year(_c(c))), (lambda c: F.month(_c(c))), (lambda c: F.dayofmonth(_c(c)))
hour, minute, second = (lambda c: F.hour(_c(c))), (lambda c: F.minute(_c(c))), (lambda c: F.second(_c(c)))
quarter, dayofyear = (lambda c: F.quarter(_c(c))), (lambda c: F.dayofyear(_c(c)))
day_of_year = dayofyear


def dayofweek(c) -> Column:
    """Monday is 0."""
    return F.weekday(_c(c))


day_of_week = weekday = dayofweek


def days_in_month(c) -> Column:
    return F.dayofmonth(F.last_day(_c(c)))


daysinmonth = days_in_month


def microsecond(c) -> Column:
    return F.pmod(micros(c), F.lit(1_000_000))


def nanosecond(c) -> Column:
    """Below the resolution of Spark's timestamps."""
    return F.when(_c(c).isNotNull(), F.lit(0))


def date(c) -> Column:
    return F.to_date(_c(c))


def time(c) -> Column:
    """Time of day as ``HH:mm:ss.SSSSSS``."""
    return F.date_format(_c(c), "HH:mm:ss.SSSSSS")


timetz = time


def is_month_start(c) -> Column:
    return day(c) == 1


def is_month_end(c) -> Column:
    return F.to_date(_c(c)) == F.last_day(_c(c))


def is_quarter_start(c) -> Column:
    return is_month_start(c) & (month(c) % 3 == 1)


def is_quarter_end(c) -> Column:
    return is_month_end(c) & (month(c) % 3 == 0)


def is_year_start(c) -> Column:
    return dayofyear(c) == 1


def is_year_end(c) -> Column:
    return is_month_end(c) & (month(c) == 12)


def is_leap_year(c) -> Column:
    return F.dayofyear(F.make_date(year(c), F.lit(12), F.lit(31))) == 366


def _micro_step(freq: str) -> int:
    return int(pd.Timedelta(freq if freq[0].isdigit() else f"1{freq}") / pd.Timedelta(microseconds=1))


def _like(c, value: Column) -> Column:
    """Back to a timestamp of the input's own kind."""
    return F.timestamp_micros(value)


def floor(c, freq: str) -> Column:
    step = _micro_step(freq)
    return _like(c, micros(c) - F.pmod(micros(c), F.lit(step)))


def ceil(c, freq: str) -> Column:
    step = _micro_step(freq)
    return _like(c, micros(c) + F.pmod(-micros(c), F.lit(step)))


def round(c, freq: str) -> Column:  # noqa: A001
    """Half to even multiples of ``freq``."""
    step = _micro_step(freq)
    rest = F.pmod(micros(c), F.lit(step))
    low = micros(c) - rest
    odd = F.pmod((low / step).cast("long"), F.lit(2)) == 1
    up = (rest * 2 > step) | ((rest * 2 == step) & odd)
    return _like(c, F.when(up, low + step).otherwise(low))


def normalize(c) -> Column:
    return F.date_trunc("DAY", _c(c))


#: Strftime directives and their Java patterns.
DIRECTIVES = {
    "Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "y": "yy", "j": "DDD", "B": "MMMM",
    "b": "MMM", "A": "EEEE", "a": "E", "I": "hh", "p": "a", "z": "xx", "Z": "zzz", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "%": "%",
}


def strftime(c, form: str) -> Column:
    import re

    out = []
    for directive, text in re.findall(r"%(.)|([^%]+)", form, re.DOTALL):
        if text:
            out.append("'" + text.replace("'", "''") + "'")
        elif directive in DIRECTIVES:
            out.append(DIRECTIVES[directive])
        else:
            raise ValueError(f"Unknown directive %{directive}")
    return F.date_format(_c(c), "".join(out))


def day_name(c) -> Column:
    return F.date_format(_c(c), "EEEE")


def month_name(c) -> Column:
    return F.date_format(_c(c), "MMMM")


def isocalendar(c) -> Column:
    """Struct ``year, week, day`` of the ISO calendar."""
    return F.struct(F.extract(F.lit("YEAROFWEEK"), _c(c)).alias("year"), F.weekofyear(_c(c)).alias("week"), (F.weekday(_c(c)) + 1).alias("day"))


def tz_convert(c, zone: str, source: str = "UTC") -> Column:
    """Wall time in ``zone`` of a wall time in ``source``."""
    return F.convert_timezone(F.lit(source), F.lit(zone), _c(c).cast("timestamp_ntz"))


def tz_localize(c, zone: str) -> Column:
    """The instant of a wall time in ``zone``."""
    return F.to_utc_timestamp(_c(c).cast("timestamp"), zone)


def to_period(c, freq: str) -> Column:
    """Label of the year, quarter, month, week or day."""
    c = _c(c)
    labels = {
        "Y": F.date_format(c, "yyyy"),
        "Q": F.concat(F.year(c), F.lit("Q"), F.quarter(c)),
        "M": F.date_format(c, "yyyy-MM"),
        "W": F.concat_ws("/", F.date_format(F.date_trunc("WEEK", c), "yyyy-MM-dd"), F.date_format(F.date_trunc("WEEK", c) + F.expr("interval 6 days"), "yyyy-MM-dd")),
        "D": F.date_format(c, "yyyy-MM-dd"),
    }
    return labels[freq]


def period_start(c, freq: str) -> Column:
    return F.date_trunc({"Y": "YEAR", "Q": "QUARTER", "M": "MONTH", "W": "WEEK", "D": "DAY"}[freq], _c(c))


def period_end(c, freq: str) -> Column:
    """The last microsecond of the period."""
    span = {"Y": "1 year", "Q": "3 months", "M": "1 month", "W": "7 days", "D": "1 day"}[freq]
    return period_start(c, freq) + F.expr(f"interval {span}") - F.expr("interval 1 microsecond")


def qyear(c) -> Column:
    return F.year(_c(c))


def week(c) -> Column:
    return F.weekofyear(_c(c))


weekofyear = week


def as_unit(c, unit: str) -> Column:
    """Cut to s, ms or us; ns is beyond Spark's resolution."""
    return _c(c) if unit in ("us", "ns") else F.date_trunc({"s": "SECOND", "ms": "MILLISECOND"}[unit], _c(c))


def total_seconds(interval) -> Column:
    """Seconds of a day-time interval."""
    return interval_micros(interval) / 1_000_000


def interval_micros(interval) -> Column:
    i = _c(interval)
    whole = (F.extract(F.lit("DAY"), i) * 24 + F.extract(F.lit("HOUR"), i)) * 60 + F.extract(F.lit("MINUTE"), i)
    return whole.cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), i) * 1_000_000).cast("long")


def interval_days(interval) -> Column:
    """Days, rounded down, so that the rest is never negative."""
    return F.floor(interval_micros(interval) / 86_400_000_000)


def interval_seconds(interval) -> Column:
    """Seconds of the day, 0 to 86399."""
    return F.floor(F.pmod(interval_micros(interval), F.lit(86_400_000_000)) / 1_000_000)


def interval_microseconds(interval) -> Column:
    return F.pmod(interval_micros(interval), F.lit(1_000_000))


def interval_components(interval) -> Column:
    rest, second = interval_seconds(interval), interval_microseconds(interval)
    return F.struct(
        interval_days(interval).alias("days"), F.floor(rest / 3600).alias("hours"), F.floor(rest % 3600 / 60).alias("minutes"), (rest % 60).alias("seconds"),
        F.floor(second / 1000).alias("milliseconds"), (second % 1000).alias("microseconds"), F.lit(0).alias("nanoseconds"),
    )
