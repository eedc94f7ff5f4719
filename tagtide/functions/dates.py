"""Calendar functions without a session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_floor(ts: Column) -> Column:
    """Monday of the week, as a date."""
    return F.trunc(F.to_date(ts), "week")


def delay_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down: -36 hours are -2 days."""
    gap = end.cast("timestamp_ntz") - start.cast("timestamp_ntz")
    days = F.extract(F.lit("DAY"), gap).cast("bigint")
    cut_short = gap < F.make_dt_interval(days.cast("int"))
    return F.when(cut_short, days - 1).otherwise(days)


def parse_dayfirst_date(text: Column) -> Column:
    """'5/1/2016' and '5/1/16' are the fifth of January; ISO dates are read as ISO.

    Two digits mean the years 1969 to 2068. A time after the date is dropped. A month above twelve can only be a day, so '1/13/2016' is the
    thirteenth of January. Anything else is null.
    """
    date = F.regexp_extract(text, r"^\s*([0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4})(?:[T\s].*)?$", 1)
    slashed = F.translate(date, "-.", "//")
    whole = [F.try_to_date(slashed, form) for form in ("d/M/yyyy", "yyyy/M/d", "M/d/yyyy")]
    short = F.coalesce(*[F.try_to_date(slashed, form) for form in ("d/M/yy", "M/d/yy")])
    return F.coalesce(*whole, F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short))
