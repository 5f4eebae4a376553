"""Report formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bytes import _col


def raw_pct(count, total) -> Column:
    """``count * 100 / total`` as DOUBLE, 0 when the total is 0."""
    c, t = _col(count).cast("double"), _col(total).cast("double")
    return F.when(t > 0, c * F.lit(100.0) / t).otherwise(F.lit(0.0))


def round_half_up_1(pct) -> Column:
    """One decimal, half up on the binary value: ``floor(x*10+0.5)/10``.

    Spark's ``round`` rounds the decimal text, which differs at binary
    edges, so the arithmetic form is used.
    """
    return F.floor(_col(pct) * 10.0 + 0.5).cast("double") / 10.0


def share_pct(count, total) -> Column:
    return round_half_up_1(raw_pct(count, total))


def bar(pct) -> Column:
    """``'#' * min(20, floor(pct/5 + 0.5))`` from the unrounded share."""
    n = F.least(F.lit(20), F.floor(_col(pct) / 5.0 + 0.5).cast("int"))
    return F.repeat(F.lit("#"), n)
