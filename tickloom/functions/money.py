"""Rounding of amounts: to the nearest decimal of the exact binary value, ties to the even digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as a sum of two with half the digits each."""
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    return high, x - high


def round_even(value: Column | str, digits: int) -> Column:
    """``value`` at ``digits`` decimals, as exact arithmetic on its binary value gives it.

    Shifting by 10^digits rounds; the lost part of the product is recovered from half-length
    factors, so 2.675 (just below the tie) goes to 2.67 and 0.125 (a tie) to 0.12. Values too
    large to have such decimals stay as they are.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    # a one-element array binds the value: its many uses, written out, make methods too long for the JVM to compile
    return F.transform(F.array(x), lambda v: _rounded(v, digits))[0]


def _rounded(x: Column, digits: int) -> Column:
    product = x * 10.0**digits
    # the product is off by half a unit in its last place at most: only this near to a tie does the lost part matter
    near = F.abs(product - F.floor(product) - 0.5) <= F.abs(product) * 2.0**-51
    return F.when(F.abs(product) >= 4.5e15, x).when(near, _exact(x, digits)).otherwise((F.rint(product) + 0.0) / 10.0**digits)


def _exact(x: Column, digits: int) -> Column:
    scale = 10.0**digits
    wide = scale * 134217729.0
    s_high = wide - (wide - scale)
    s_low = scale - s_high
    x_high, x_low = _halves(x)
    product = x * scale
    lost = ((x_high * s_high - product) + x_high * s_low + x_low * s_high) + x_low * s_low
    down = F.floor(product).cast("double")
    side = (product - down - 0.5) + lost
    up = (side > 0) | ((side == 0) & (down % 2 != 0))
    return (down + F.when(up, 1.0).otherwise(0.0)) / scale
