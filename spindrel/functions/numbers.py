"""Numeric rules of the directory queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp_arg(value: object, default: int, low: int, high: int | None = None) -> int:
    """A paging argument: what is no number, or 0, becomes the default; then it is clamped."""
    try:
        n = int(str(value).strip()) or default
    except ValueError:
        n = default
    n = max(low, n)
    return n if high is None else min(high, n)


def tolerant_int(c: Column, default: int = 0) -> Column:
    """Digits with thousands separators and blanks around; null and anything else is the default."""
    plain = F.regexp_replace(F.trim(c), ",", "")
    return F.coalesce(F.when(F.regexp_like(plain, F.lit(r"^[+-]?\d{1,9}$")), plain.cast("int")), F.lit(default))


def rounded(c: Column, digits: int = 1) -> Column:
    """Half to even."""
    return F.bround(c, digits)


def shown(metric: Column, visible: Column) -> Column:
    """A metric as readers see it: null if hidden, 0 if visible but missing; not said means visible."""
    return F.when(F.coalesce(visible, F.lit(True)), F.coalesce(metric, F.lit(0)))


def quantised(value: Column, low: Column, high: Column) -> Column:
    """A 16-bit step of the span, half to even, clamped."""
    share = F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.bround(share * 65535).cast("int")))
