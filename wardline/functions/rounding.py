"""Rounding rules: half-even on the binary double, and safe ratios."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 2**27 + 1 splits a double into two halves of at most 26 bits
_SPLIT = 134217729.0


def round_half_even(x: Column, digits: int = 0) -> Column:
    """Nearest multiple of 10**-digits to the *binary* value, exact ties to even.

    Spark's ``bround`` rounds the shortest decimal text of a double, which turns
    0.15 (really 0.1499999...) into a tie. Here the scaled value is rounded, and
    only where it looks like a tie does the exact rounding error of the product
    decide, so a tie is only a real tie.
    """
    x = x.cast("double")
    scale = F.lit(float(10 ** digits))
    p = x * scale
    c = x * F.lit(_SPLIT)
    high = c - (c - x)
    error = (high * scale - p) + (x - high) * scale
    low = F.floor(p).cast("double")
    nearest = (F.when(p - low != 0.5, F.rint(p)).when(error > 0, low + 1)
               .when(error < 0, low).otherwise(F.rint(p)))
    return nearest / scale


def safe_ratio(num: Column, den: Column, default: Column | None = None) -> Column:
    """num/den, or ``default`` (null when not given) where den is zero or null."""
    ratio = F.when(den != 0, num.cast("double") / den.cast("double"))
    return ratio if default is None else F.coalesce(ratio, default)
