"""Column helpers: clean rounding, windows over (symbol, ts, id), normal distribution."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window as W, WindowSpec, functions as F


#: Added before rounding, here and in the SQL: decimal inputs make exact ties, which engines round differently.
NUDGE = 0.0000012345


def tidy(x: Column | str, digits: int = 4) -> Column:
    """Rounded, NaN as null, no negative zero."""
    x = F.col(x) if isinstance(x, str) else x
    x = x.cast("double")
    return F.round(F.when(~F.isnan(x), x) + NUDGE, digits) + F.lit(0.0)


def at() -> Column:
    """The time as microseconds, under the name that queries give it."""
    return F.unix_micros("ts").alias("ts_us")


def over(*order: str, by: tuple[str, ...] = ("symbol",)) -> WindowSpec:
    return W.partitionBy(*by).orderBy(*(order or ("ts",)))


def running(*order: str, by: tuple[str, ...] = ("symbol",)) -> WindowSpec:
    return over(*order, by=by).rowsBetween(W.unboundedPreceding, 0)


def last(n: int, *order: str, by: tuple[str, ...] = ("symbol",)) -> WindowSpec:
    """The current row and n - 1 before it."""
    return over(*order, by=by).rowsBetween(1 - n, 0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(x: Column, y: Column, otherwise: Column | float | None = 0.0) -> Column:
    """x / y, or ``otherwise`` where y is 0."""
    return F.when(y != 0, x / y).otherwise(F.lit(otherwise))


def ieee_ratio(x: Column, y: Column) -> Column:
    """x / y, where y is 0 as IEEE 754 has it: infinite with the sign of x, NaN where x is 0 too."""
    return F.when(y == 0, x * float("inf")).otherwise(x / y)


def z_score(x: Column, w: WindowSpec, least: int = 2, flat: float = 1e-10) -> Column:
    """Distance from the mean over w in sample standard deviations; 0 before ``least`` rows or where flat."""
    std = F.stddev_samp(x).over(w)
    return F.when((F.count(x).over(w) >= least) & (std > flat), (x - F.avg(x).over(w)) / std).otherwise(0.0)


def dot(values: Column, weights: list[float]) -> Column:
    """Sum of array elements times literal weights."""
    return F.aggregate(F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function: Taylor series of erf near 0, continued fraction beyond.

    Spark has no erf; both forms are summed by a fold, to double precision.
    """
    t = F.abs(x)
    # Phi(t) - 1/2 = pdf(t) * (t + t^3/3 + t^5/15 + ...)
    near = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(t.alias("term"), t.alias("total")),
        lambda s, i: F.struct((s["term"] * t * t / (2 * i + 1)).alias("term"), (s["total"] + s["term"] * t * t / (2 * i + 1)).alias("total")),
        lambda s: s["total"],
    )
    pdf = F.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    far = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), F.lit(0.0), lambda s, i: i / (t + s), lambda s: 1 / (t + s))
    upper = F.when(t < 5, F.lit(0.5) - pdf * near).otherwise(pdf * far)
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def normal_quantile(p: float) -> float:
    """Rational approximation of the normal quantile, on the driver (its inputs are parameters)."""
    if p <= 0:
        return -10.0
    if p >= 1:
        return 10.0
    # fixed values: the published coefficients of the approximation
    c, d = (2.515517, 0.802853, 0.010328), (1.432788, 0.189269, 0.001308)
    t = math.sqrt(-2 * math.log(min(p, 1 - p)))
    z = t - (c[0] + c[1] * t + c[2] * t * t) / (1 + d[0] * t + d[1] * t * t + d[2] * t**3)
    return z if p > 0.5 else -z


def correlation(x: Column | str, y: Column | str, w: WindowSpec | None = None) -> Column:
    """Correlation as an aggregate (or over a window): null where either side is flat, which Spark's own ends in a division by 0."""
    each = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)  # rows that have both
    under = each(F.stddev_pop(x)) * each(F.stddev_pop(y))
    return F.when(under > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), each(F.covar_pop(x, y)) / under)))


def normal_sql(x: str) -> str:
    """The distribution function in SQL that has no erf: its integral by Simpson's rule in 400 steps from 0, 0 or 1 beyond 8 deviations."""
    step = f"(least(8.0, abs({x})) / 400)"
    terms = f"list_sum(list_transform(range(401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(i * {step}, 2))))"
    return f"(0.5 + sign({x}) * {terms} * {step} / 3 / sqrt(2 * pi()))"
