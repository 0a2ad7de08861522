"""Samplers: distributions evaluated from addressed uniforms."""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.draws import draw
from loomspan.functions.errors import fail
from loomspan.functions.values import once

#: Means up to which a Poisson draw is inverted step by step in the JVM.
POISSON_STEPS = 500
#: Most attempts of a draw by rejection.
TRIES = 64
#: Most uniforms that a beta draw of whole parameters takes.
BETA_DRAWS = 64


def finite(x: Column) -> Column:
    """``x``, or an error where it is not finite."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, fail("NonFiniteResult", "a sample is not finite", "double")).otherwise(x)


def choice(options: list[Column], u: Column) -> Column:
    """One option, all alike; only the option taken is evaluated."""
    if not options:
        raise ValueError("choice needs an option")
    at = F.floor(u * len(options))
    picked = F.when(at == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        picked = picked.when(at == i, option)
    return picked


def range_int(low: int, high: int, u: Column, v: Column | None = None) -> Column:
    """Integer from low to high, both included and within 64 bits.

    A draw has 52 bits; a range of more numbers takes a second one, ``v``, and
    every number in it can come up.
    """
    if low > high:
        raise ValueError("range needs low <= high")
    if low < -(1 << 63) or high >= 1 << 63:
        raise ValueError("range needs bounds of 64 bits")
    span = high - low + 1
    if span <= 1 << 52:
        return (F.lit(low) + F.floor(u * span)).cast("bigint")
    if v is None:
        raise ValueError("a range of more than 2**52 numbers needs a second draw")
    # low + floor((u * 2**52 + v) * span / 2**52), in whole numbers: no product has more than 36 digits
    size, part = F.lit(Decimal(span)).cast("decimal(20,0)"), F.lit(Decimal(1 << 52)).cast("decimal(16,0)")
    first, second = ((x * float(1 << 52)).cast("decimal(16,0)") for x in (u, v))

    def quotient(x: Column) -> Column:
        return ((x - x % part) / part).cast("decimal(37,0)")

    return (quotient((first * size + quotient(second * size)).cast("decimal(38,0)")) + F.lit(Decimal(low)).cast("decimal(20,0)")).cast("bigint")


def range_float(low: float, high: float, u: Column) -> Column:
    if low > high:
        raise ValueError("range needs low <= high")
    return finite(F.lit(float(low)) + u * (high - low))


def weighted(pairs: list[tuple[Column, float]], u: Column) -> Column:
    """Option by weight; zero weights are never taken, rounding falls to the last."""
    live = [(v, w) for v, w in pairs if w > 0]
    if not live or any(w < 0 for _, w in pairs):
        raise ValueError("weighted needs weights >= 0 and one above")
    total, reached, picked = sum(w for _, w in live), 0.0, None
    for value, weight in live[:-1]:
        reached += weight
        hit = u * total < reached
        picked = F.when(hit, value) if picked is None else picked.when(hit, value)
    return live[-1][0] if picked is None else picked.otherwise(live[-1][0])


def standard_normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def normal(mean: float, deviation: float, u: Column, v: Column) -> Column:
    if deviation < 0:
        raise ValueError("normal needs a deviation >= 0")
    return finite(mean + deviation * standard_normal(u, v))


def lognormal(median: float, sigma: float, u: Column, v: Column) -> Column:
    if median <= 0:
        raise ValueError("lognormal needs a median > 0")
    return finite(median * F.exp(sigma * standard_normal(u, v)))


def exponential(mean: float, u: Column) -> Column:
    if mean <= 0:
        raise ValueError("exponential needs a mean > 0")
    return finite(-mean * F.log(1 - u))


def pareto(least: float, shape: float, u: Column) -> Column:
    if least <= 0 or shape <= 0:
        raise ValueError("pareto needs positive parameters")
    return finite(least * F.pow(1 - u, F.lit(-1.0 / shape)))


def chance(p: float, u: Column) -> Column:
    """True with probability p; 0 and 1 are exact."""
    if not 0 <= p <= 1:
        raise ValueError("chance needs 0 <= p <= 1")
    return u < p


def _tried(seed: Column | Callable[[int | Column], Column], draws: int, attempt: Callable[..., tuple[Column, Column]], last: Column) -> Column:
    """The first accepted of at most TRIES attempts, each (value, whether accepted) of ``draws`` addressed draws.

    Once a value is accepted no more is drawn. Attempts are refused seldom, so
    ``last``, which stands in when all are, practically never does.
    """
    u = seed if callable(seed) else lambda i: draw(seed, i)

    def tried(us: Column) -> Column:
        value, accepted = attempt(*[us[i] for i in range(draws)])
        return F.when(accepted, value)

    def step(found: Column, k: Column) -> Column:
        return F.when(found.isNotNull(), found).otherwise(once(F.array(*[u(k * draws + i) for i in range(draws)]), tried))

    return F.coalesce(F.aggregate(F.sequence(F.lit(0), F.lit(TRIES - 1)), F.lit(None).cast("double"), step), last)


def poisson(mean: float, u: Column | Callable[[int | Column], Column]) -> Column:
    """Count for means below 1e15: by inversion of one draw up to POISSON_STEPS, by transformed rejection above.

    ``u`` is a draw, or gives draws by number; rejection goes on with draws
    addressed by the first.
    """
    if not 0 < mean < 1e15:
        raise ValueError("poisson needs 0 < mean < 1e15")
    if mean > POISSON_STEPS:
        return _large_poisson(mean, u)
    u = u(0) if callable(u) else u
    most = math.ceil(mean + 12 * math.sqrt(mean) + 20)
    start = F.struct(F.lit(math.exp(-mean)).alias("p"), F.lit(math.exp(-mean)).alias("sum"), F.lit(0).cast("bigint").alias("k"), u.alias("u"))  # u is drawn once

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.when(acc["u"] >= acc["sum"], k.cast("bigint")).otherwise(acc["k"]).alias("k"), acc["u"].alias("u"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["k"]


def _large_poisson(mean: float, u: Column | Callable[[int | Column], Column]) -> Column:
    """Hoermann's transformed rejection; the density is taken relative to its peak, so no digits are lost for large means."""
    b = 0.931 + 2.53 * math.sqrt(mean)
    a = -0.059 + 0.02483 * b
    inverse, squeeze = 1.1239 + 1.1328 / (b - 3.4), 0.9277 - 3.6224 / (b - 2)

    def log_density(k: Column) -> Column:
        x = (k - mean) / mean  # k log(mean / k) + k - mean is mean times x - (1 + x) log(1 + x)
        series = sum((F.pow(x, F.lit(n)) * ((-1) ** (n + 1) / (n * (n - 1))) for n in range(2, 10)), F.lit(0.0))
        rest = F.when(F.abs(x) < 0.01, series).otherwise(x - (1 + x) * F.log1p(x))
        return mean * rest - 0.5 * F.log(2 * math.pi * k) - 1 / (12 * k)

    def attempt(first: Column, second: Column) -> tuple[Column, Column]:
        shifted, v = first - 0.5, 1 - second
        us = 0.5 - F.abs(shifted)
        k = F.floor((2 * a / us + b) * shifted + mean + 0.43).cast("double")
        tail = (k < 1) | ((us < 0.013) & (v > us))
        exact = F.log(v * inverse / (a / (us * us) + b)) <= log_density(k)
        return k, F.when((us >= 0.07) & (v <= squeeze), True).when(tail | (us <= 0), False).otherwise(exact)

    return _tried(u, 2, attempt, F.lit(float(math.floor(mean)))).cast("bigint")


def _log_gamma(a: float, u: Callable[[int | Column], Column]) -> Column:
    """Logarithm of a gamma draw, by Marsaglia and Tsang's rejection; a below 1 is lifted by one and brought back."""
    d = (a if a >= 1 else a + 1) - 1 / 3
    c = 1 / math.sqrt(9 * d)

    def attempt(first: Column, second: Column, third: Column) -> tuple[Column, Column]:
        x = standard_normal(first, second)
        v = F.pow(1 + c * x, F.lit(3.0))
        fine = F.log(1 - third) < 0.5 * x * x + d - d * v + d * F.log(v)
        return F.log(d * v), F.when(v > 0, fine).otherwise(False)

    drawn = _tried(lambda i: u(i + 1), 3, attempt, F.lit(math.log(d)))
    return drawn if a >= 1 else drawn + F.log(1 - u(0)) / a


def beta(a: float, b: float, u: Callable[[int | Column], Column]) -> Column:
    """Draw in 0..1 from uniforms u(0), u(1), ...

    For whole a and b it is the a-th least of a + b - 1 uniforms, else the
    share of one gamma draw in two, taken in logarithms so that small
    parameters don't vanish.
    """
    if a <= 0 or b <= 0:
        raise ValueError("beta needs positive parameters")
    if a == int(a) and b == int(b) and a + b <= BETA_DRAWS:
        return F.element_at(F.array_sort(F.array(*map(u, range(int(a + b) - 1)))), int(a))
    first, second = _log_gamma(a, lambda i: u(2 * i)), _log_gamma(b, lambda i: u(2 * i + 1))
    return 1 / (1 + F.exp(second - first))
