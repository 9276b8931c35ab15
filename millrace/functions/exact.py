"""Sums and averages of doubles that come out the same however rows are laid out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A value is split into its floor and what is left in units of 2 ** -62, both whole numbers.
_UNITS = float(1 << 62)


def exact_sum(x: Column | str) -> Column:
    """The sum of doubles below 2 ** 62 in size, in whole numbers until its end, so in any order the same; null over no value.

    Bits below 2 ** -62 don't count. A NaN, an infinity or a larger value makes it the plain sum.
    """
    x = (F.col(x) if isinstance(x, str) else x).cast("double")
    fits = F.coalesce(F.abs(x) < _UNITS, F.lit(True))
    whole = F.when(fits, F.floor(x))
    rest = F.floor((x - whole.cast("double")) * _UNITS).cast("long")
    exact = F.sum(whole.cast("decimal(20,0)")).cast("double") + F.sum(rest.cast("decimal(20,0)")).cast("double") / _UNITS
    return F.when(F.bool_and(fits), exact).otherwise(F.sum(x))


def exact_avg(x: Column | str) -> Column:
    """The average, by exact_sum()."""
    return F.try_divide(exact_sum(x), F.count(x))
