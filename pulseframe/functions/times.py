"""Naive timestamps as text and as microseconds. The session's time zone should be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_YEAR, LONG_YEAR = "yy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def parse(text: Column, *patterns: str) -> Column:
    """Text as timestamp_ntz by the first pattern that fits (both years' widths unless given), else null."""
    tries = [F.try_to_timestamp(F.trim(text), F.lit(p)) for p in patterns or (SHORT_YEAR, LONG_YEAR)]
    return F.coalesce(*tries).cast("timestamp_ntz")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def rounded_ms(us: Column) -> Column:
    """Microseconds to whole milliseconds, halves up."""
    return us + 500 - F.pmod(us + 500, F.lit(1000))


def truncated_ms(us: Column) -> Column:
    return us - F.pmod(us, F.lit(1000))


def text_ms(us: Column, short_year: bool = False) -> Column:
    """As sinks write it: milliseconds, cut off."""
    return F.date_format(from_micros(us), "yy-MM-dd HH:mm:ss.SSS" if short_year else "yyyy-MM-dd HH:mm:ss.SSS")
