"""Column helpers for the null, sign and ordering contract shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: smallest double step around 1.0, used by near-zero guards.
EPSILON = 2.220446049250313e-16


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite_or_null(c: Column | str) -> Column:
    """NaN and infinities become missing, so they never match, sort first or poison a sum."""
    c = col(c)
    return F.when(F.abs(c) < F.lit(float("inf")), c)


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Bound a value; a missing input stays missing (``greatest`` alone would skip nulls)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def half_sign(c: Column | str) -> Column:
    """+1 for zero and above, -1 below: zero counts as positive."""
    return F.when(col(c) >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def or_zero(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def safe_div(numerator: Column | str, denominator: Column | str) -> Column:
    """Null when the denominator is zero or missing (ANSI mode would raise)."""
    numerator, denominator = col(numerator), col(denominator)
    return numerator / F.when(denominator != 0, denominator)


def choose(pairs, default=None) -> Column:
    """Ordered rules, first match wins: ``choose([(cond, value), ...], default)``."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def tags(pairs) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(condition, F.lit(label)) for condition, label in pairs]))


def signed(side: Column | str, amount: Column | str) -> Column:
    return F.when(col(side) == "buy", col(amount)).otherwise(-col(amount))
