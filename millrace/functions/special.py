"""The regularised incomplete beta function, and what follows from it, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_SHIFT = 12


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _stirling(z: Column) -> Column:
    """What Stirling's formula leaves of ln gamma, for arguments of 12 and more: coefficients B(2k) / (2k (2k - 1))."""
    x = 1 / (z * z)
    return (1 / F.lit(12.0) - x * (1 / F.lit(360.0) - x * (1 / F.lit(1260.0) - x * (1 / F.lit(1680.0) - x / F.lit(1188.0))))) / z


def ln_beta(a: Column, b: Column) -> Column:
    """ln of the beta function for positive arguments; the difference of the two large terms is taken before they are made."""
    large, small = F.greatest(a, b), F.least(a, b)
    far, low = large + _SHIFT, small + _SHIFT
    steps = [F.lit(float(i)) for i in range(_SHIFT)]
    ln_gamma = (low - 0.5) * F.ln(low) - low + 0.9189385332046727 + _stirling(low)  # 0.5 ln(2 pi)
    ratio = -(far - 0.5) * F.log1p(small / far) - small * F.ln(far + small) + small + _stirling(far) - _stirling(far + small)
    for i in steps:
        ln_gamma -= F.ln(small + i)
        ratio += F.log1p(small / (large + i))
    return ln_gamma + ratio


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function by Lentz's method, with as many terms as sqrt(max(a, b)) asks for."""
    safe = lambda v: let(v, lambda u: F.when(F.abs(u) < 1e-300, 1e-300).otherwise(u))
    terms = F.sequence(F.lit(1), (80 + 8 * F.ceil(F.sqrt(F.greatest(a, b)))).cast("int"))
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def advanced(s: Column, by: Column) -> Column:
        return let(F.struct(by.alias("by"), s.alias("s")), lambda t: let(state(safe(1 + t["by"] / t["s"]["c"]), 1 / safe(1 + t["by"] * t["s"]["d"]), t["s"]["h"]), lambda u: state(u["c"], u["d"], u["h"] * u["c"] * u["d"])))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return advanced(advanced(s, even), odd)

    start = let(1 / safe(1 - (a + b) * x / (a + 1)), lambda d: state(F.lit(1.0), d, d))
    return F.aggregate(terms, start, lambda s, m: step(s, m.cast("double")))["h"]


def beta_regularised(x: Column, a: Column, b: Column) -> Column:
    """I_x(a, b) for x in 0..1 and positive a and b: whichever of its two forms converges fast. Null for nulls."""
    left = x < (a + 1) / (a + b + 2)
    form = lambda y, p, q: F.struct(y.alias("y"), p.alias("p"), q.alias("q"), left.alias("left"))

    def value(t: Column) -> Column:
        y, p, q = t["y"], t["p"], t["q"]
        part = F.when(y <= 0, 0.0).otherwise(F.exp(p * F.ln(y) + q * F.log1p(-y) - ln_beta(p, q)) * _fraction(y, p, q) / p)
        return let(part, lambda v: F.when(t["left"], v).otherwise(1 - v))

    return F.when(F.isnotnull(x + a + b), let(F.when(left, form(x, a, b)).otherwise(form(1 - x, b, a)), value))


def correlation_p(rho: Column, n: Column) -> Column:
    """The two-sided p-value of a rank correlation over n pairs by Student's distribution; null below three pairs."""
    spare = (1 - rho) * (1 + rho)
    p = beta_regularised(F.greatest(spare, F.lit(0.0)), (n.cast("double") - 2) / 2, F.lit(0.5))
    return F.when((n >= 3) & rho.isNotNull() & ~F.isnan(rho), p)
