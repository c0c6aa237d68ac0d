"""Guards for doubles. Spark orders NaN above all numbers, so a bare `x >= t` holds for NaN; these don't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_finite(x: Column) -> Column:
    """False for NaN, infinities and null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(INF)), F.lit(False))


def finite(x: Column) -> Column:
    """x, or null where it isn't finite."""
    return F.when(is_finite(x), x)


def number(x: Column) -> Column:
    """x, or null where it is NaN; infinities stay."""
    return F.when(~F.isnan(x), x)


def parsed(text: Column) -> Column:
    """Text as a double, null where it isn't one."""
    return F.trim(text).try_cast("double")


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def guarded(condition: Column, x: Column) -> Column:
    """condition where x is finite, else False."""
    return is_finite(x) & F.coalesce(condition, F.lit(False))


def reasons(rules: dict[str, Column]) -> Column:
    """Sorted names of the rules that hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(held, F.lit(name)) for name, held in rules.items()])))


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, however often body names it: nested uses would multiply the expression."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def event_indexes(found: Column, n: Column) -> Column:
    """Indexes of events in a series of n samples: what isn't finite goes, fractions are cut off, others outside go."""
    whole = F.transform(F.filter(found, is_finite), lambda x: x.try_cast("long"))
    return F.filter(whole, lambda i: (i >= 0) & (i < n))


def range_with_margin(low: Column, high: Column, least: Column, most: Column, margin: float = 0.1) -> Column:
    """An axis range from two quantiles, or from the extremes where these coincide: at least 1e-6 wide, with margins."""
    degenerate = ~(high > low)
    a, b = F.when(degenerate, least).otherwise(low), F.when(degenerate, most).otherwise(high)
    span = F.greatest(b - a, F.lit(1e-6))
    return F.struct((a - span * margin).alias("low"), (b + span * margin).alias("high"))
