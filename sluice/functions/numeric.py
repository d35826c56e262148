"""Numeric and formatting column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def ratio(x: Column, base: Column, otherwise: float) -> Column:
    """x / base where the base is positive, else a fixed value (infinity is one)."""
    return F.when(base > 0, x / base).otherwise(F.lit(otherwise))


def nice_step(x: Column) -> Column:
    """The nearest of 1, 2, 5 and 10 times a power of ten; 1 for values up to 0."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.when(x > 0, x).otherwise(1.0))))
    lead = x / power
    return F.when(x <= 0, 1.0).otherwise(power * F.when(lead < 1.5, 1.0).when(lead < 3.5, 2.0).when(lead < 7.5, 5.0).otherwise(10.0))


def bucket_step(mean: Column) -> Column:
    """The width of a size bucket: two hundredths of the mean, made nice, with a floor by magnitude."""
    floor = F.when(mean >= 50, 1.0).when(mean >= 5, 0.1).otherwise(0.01)
    return F.when(mean <= 0, 1.0).otherwise(F.greatest(floor, nice_step(mean * 0.02)))


def bucketed(x: Column, step: Column) -> Column:
    """x to the nearest multiple of the step, ties to even."""
    return F.rint(x / step) * step


def settled(x: Column) -> Column:
    """x to ten decimals: a quotient or product that binary noise left just below a tie is the tie again."""
    return F.round(x, 10)


def short_number(x: Column) -> Column:
    return _short(x, lambda quotient: quotient)


def short_settled(x: Column) -> Column:
    """``short_number`` of settled quotients."""
    return _short(x, settled)


def _short(x: Column, form: Callable[[Column], Column]) -> Column:
    part = lambda unit, by: F.format_string(f"%.2f{unit}", form(x / by))
    return F.when(x >= 1e9, part("B", 1e9)).when(x >= 1e6, part("M", 1e6)).when(x >= 1e3, part("K", 1e3)).otherwise(F.format_string("%.2f", x))


def ratio_text(x: Column) -> Column:
    return F.when(x == INF, "inf").otherwise(F.format_string("%.2fx", x))


def percent_text(x: Column) -> Column:
    return hundredths_text(x * 100)


def hundredths_text(x: Column) -> Column:
    """``percent_text`` of what is in hundredths already."""
    return F.format_string("%.2f%%", x)


def duration_text(seconds: Column) -> Column:
    total = F.greatest(F.floor(seconds).cast("bigint"), F.lit(0).cast("bigint"))
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(h > 0, F.format_string("%dh%02dm%02ds", h, m, s)).when(m > 0, F.format_string("%dm%02ds", m, s)).otherwise(F.format_string("%ds", s))


def window_text(seconds: Column) -> Column:
    return F.when(seconds % 3600 == 0, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h"))).when(seconds % 60 == 0, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m"))).otherwise(F.concat(seconds.cast("string"), F.lit("s")))


def bucket_text(x: Column, step: Column) -> Column:
    """A bucket with as many decimals as its step has."""
    places = F.greatest(F.lit(0), F.least(F.lit(8), F.ceil(-F.log10(step)).cast("int")))
    text = F.format_string("%.0f", x)
    for n in range(8, 0, -1):
        text = F.when(places == n, F.format_string(f"%.{n}f", x)).otherwise(text)
    return F.when(step >= 1, F.format_string("%.0f", x)).otherwise(text)
