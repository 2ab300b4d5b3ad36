"""Encodings of numbers and durations, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_cc(cc: Column) -> Column:
    """A correlation in hundredths, halves to even."""
    return F.bround(cc * 100).cast("int")


def decode_cc(cc_x100: Column) -> Column:
    return cc_x100 / 100.0


def cc_between(cc_x100: Column, cc_min: float | None, cc_max: float | None = None) -> Column:
    """Bounds on the stored hundredths, so that they reach the scan; they are rounded inward in double arithmetic."""
    found = cc_x100.isNotNull()
    if cc_min is not None:
        found &= cc_x100 >= math.ceil(cc_min * 100)
    if cc_max is not None:
        found &= cc_x100 <= math.floor(cc_max * 100)
    return found


def sampling_rate(rate: Column, lag_samples: Column, lag_sec: Column) -> Column:
    """The given rate, or the one that lags in samples and seconds imply; null without either."""
    return F.coalesce(rate, F.abs(F.try_divide(lag_samples, F.when(lag_sec != 0, lag_sec))))


def floats_differ(a: Column, b: Column, rel: float, absolute: float) -> Column:
    """Further apart than either tolerance; a null differs from a number only."""
    both = F.abs(a - b) > F.greatest(F.lit(absolute), rel * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), ~a.eqNullSafe(b)).otherwise(both)


def duration_text(years: Column) -> Column:
    """Years (of 365 days) in the unit that suits their size."""
    days = years * 365
    form = lambda value, unit: F.format_string(f"%.1f {unit}", value)
    return F.when(days >= 365, form(years, "years")).when(days >= 30, form(days / 30, "months")).when(days >= 1, form(days, "days")).when(days * 24 >= 1, form(days * 24, "hours")).otherwise(form(days * 1440, "mins"))


def seconds_of_literal(text: Column) -> Column:
    """Seconds of literals such as 15m; null if it is none."""
    unit = F.element_at(F.create_map(*(F.lit(x) for kv in {"s": 1.0, "m": 60.0, "h": 3600.0, "d": 86400.0, "M": 2592000.0, "y": 31536000.0}.items() for x in kv)), F.regexp_extract(text, r"^\s*[\d.]+\s*([smhdMy])\s*$", 1))
    return F.try_to_number(F.regexp_extract(text, r"^\s*(\d+)", 1), F.lit("999999999")).cast("double") * unit
