"""Date buckets and buckets of equal width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("microseconds", "milliseconds", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
YEARS = {"decade": 10, "century": 100, "millennium": 1000}


def date_bucket(unit: str, c: Column) -> Column:
    """The start of the unit that holds the time. Decades begin in years divisible by 10, centuries and
    millennia in years that follow a multiple of theirs."""
    unit = unit.lower().rstrip("s") if unit.lower() not in UNITS else unit.lower()
    if unit in YEARS:
        n, one = YEARS[unit], 0 if unit == "decade" else 1
        first = (F.floor((F.year(c) - one) / n) * n + one).cast("int")
        return F.make_date(first, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    if unit not in UNITS and unit + "s" not in UNITS:
        raise ValueError(f"unknown date unit {unit!r}")
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def width_bucket(c: Column, width: float) -> Column:
    return F.floor(F.ceil(c) / F.lit(width)).cast("int")


def width_label(bucket: Column, width: float) -> Column:
    low = bucket * F.lit(width)
    return F.concat(low.cast("string"), F.lit("-"), (low + F.lit(width) - F.lit(1)).cast("string"))
