"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def half_even(value: Column, digits: int) -> Column:
    """Round half to even on the scaled double, the rule array libraries use."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    bad = F.isnan(value) | value.isin(float("inf"), float("-inf"))
    return F.when(~bad, value)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation; NULL instead of an error when either side is constant."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_samp(F.when(both, x)) * F.stddev_samp(F.when(both, y))
    return F.try_divide(F.covar_samp(x, y), spread)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope of y over x; NULL when x does not vary."""
    both = x.isNotNull() & y.isNotNull()
    return F.try_divide(F.covar_samp(y, x), F.var_samp(F.when(both, x)))


def pick(levels, value: Column, position: int = 1) -> Column:
    """First text whose lower bound the value reaches; the last level is the default."""
    chosen = F.lit(levels[-1][position])
    for level in reversed(levels[:-1]):
        chosen = F.when(value >= F.lit(level[0]), F.lit(level[position])).otherwise(chosen)
    return chosen


def fixed(value: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded half to even."""
    return half_even(value, digits).cast(f"decimal(38,{digits})").cast("string")


def one_decimal(value: Column) -> Column:
    return fixed(value, 1)


def digest(*parts: Column) -> Column:
    """Hex digest of the given values: a counter-based random source that depends on the values alone."""
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def digest_uniform(hex_text: Column, slot: int = 0) -> Column:
    """Uniform number in (0, 1) from 8 hex digits of a digest; slots 0..3 are independent."""
    number = F.conv(F.substring(hex_text, 1 + 8 * slot, 8), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(4294967296.0)


def digest_normal(hex_text: Column) -> Column:
    """Standard normal number from a digest (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(digest_uniform(hex_text, 0)))
    return radius * F.cos(F.lit(6.283185307179586) * digest_uniform(hex_text, 1))
