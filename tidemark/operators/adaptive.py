"""Stacks of indicators whose smoothing and band width are parameters that a fit may move."""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, functions as F

from tidemark.operators.recursive import Recurrence


def _share(period: float) -> float:
    return 2 / (period + 1)


def _stack(fast: float, slow: float, signal: float, rsi: float, band: float, width: float, atr: float, s, x):
    z, high, low = x
    blend = lambda old, new, a: new if old is None else a * new + (1 - a) * old
    f, w, g, gain, loss, mid, tr, last, n, mean, m2 = s or [None] * 8 + [0, 0.0, 0.0]
    f, w = blend(f, z, fast), blend(w, z, slow)
    g = blend(g, f - w, signal)
    if last is None:
        strength, range_ = 50.0, high - low
    else:
        gain, loss = blend(gain, max(z - last, 0.0), rsi), blend(loss, max(last - z, 0.0), rsi)
        strength = 100.0 if loss < 1e-10 else 100 - 100 / (1 + gain / loss)
        range_ = max(high - low, abs(high - last), abs(low - last))
    mid, tr, n = blend(mid, z, band), blend(tr, range_, atr), n + 1
    step = z - mean
    mean += step / n
    m2 += step * (z - mean)
    half = width * math.sqrt(max(m2, 0.0) / (n - 1)) if n > 1 else 0.0
    return [f, w, g, gain, loss, mid, tr, z, n, mean, m2], (f - w, g, f - w - g, strength, mid + half, mid, mid - half, tr)


def indicator_stack(fast: float = 12, slow: float = 26, signal: float = 9, rsi: float = 14, band: float = 20, multiplier: float = 2.0, atr: float = 14) -> Recurrence:
    """MACD with signal and histogram, RSI, bands around an average by the running deviation, and mean true range, in one pass over (close, high, low).

    Periods need not be whole: a fit moves them through the averages' shares, and the bands' multiplier through its logarithm.
    """
    step = partial(_stack, _share(fast), _share(slow), _share(signal), _share(rsi), _share(band), multiplier, _share(atr))
    return Recurrence(step, ("close", "high", "low"), ("macd", "macd_signal", "macd_histogram", "stack_rsi", "bb_upper", "bb_middle", "bb_lower", "atr"))


def _bands(rate: float, first: float, share: float, s, x):
    (z,) = x
    mid, logit, n, mean, m2 = s or [z, math.log(first), 0, 0.0, 0.0]
    mid = share * z + (1 - share) * mid
    n += 1
    step = z - mean
    mean += step / n
    m2 += step * (z - mean)
    std = math.sqrt(max(m2, 0.0) / (n - 1)) if n > 1 else 0.0
    width = math.exp(logit)
    # quantile-like loss: a price outside the bands widens them, one inside narrows them by the share wished outside
    outside = float(abs(z - mid) > width * std) if n > 1 else 0.05
    logit = min(math.log(6.0), max(math.log(0.5), logit + rate * (outside - 0.05)))
    return [mid, logit, n, mean, m2], (mid + width * std, mid, mid - width * std, width)


def learned_bands(price: str = "close", period: float = 20, multiplier: float = 2.0, rate: float = 0.05) -> Recurrence:
    """Bands whose multiplier is moved by gradient steps, until about 5 % of the prices lie outside."""
    return Recurrence(partial(_bands, rate, multiplier, _share(period)), (price,), ("band_upper", "band_middle", "band_lower", "band_multiplier"))


# ---- parameters learned as rows come: a state's sensitivity to each parameter is carried beside it ----
# A value is held against the next row; the error's slope by each parameter is the error times the value's sensitivity,
# which moves by the same recursion as the value (real-time recurrent learning). Each step is clamped.


def _clip(v: float, low: float, high: float) -> float:
    return min(high, max(low, v))


def _learned_jma(rate: float, n: float, phase: float, power: float, s, x):
    (z,) = x
    if s is None:
        return [z] * 4 + [0.0] * 12 + [math.log(n / 100), phase, math.log(power)], (z, float(n), phase, power)
    e0, e1, e2, j = s[:4]
    sens, theta = [s[4 + 4 * i : 8 + 4 * i] for i in range(3)], s[16:]
    miss = (j - z) / z if z else 0.0
    moved = [t - rate * _clip(miss * d[3] / z if z else 0.0, -1.0, 1.0) for t, d in zip(theta, sens)]
    u, f, v = (_clip(t, *limits) for t, limits in zip(moved, ((-2.0, 2.0), (-100.0, 100.0), (-1.0, 2.0))))
    n, power = max(2.0, 100 * math.exp(u)), max(0.5, math.exp(v))
    q, lead = 0.45 * (n - 1), f / 100 + 1.5
    beta = q / (q + 2)
    alpha = beta**power
    by_n = 0.9 / (q + 2) ** 2 * (n if n > 2 else 0.0)
    # slopes of alpha, beta and the lead by each parameter
    slopes = ((power * alpha / beta * by_n, by_n, 0.0), (0.0, 0.0, 0.01), (alpha * math.log(beta) * (power if power > 0.5 else 0.0), 0.0, 0.0))
    a0 = (1 - alpha) * z + alpha * e0
    a1 = (z - a0) * (1 - beta) + beta * e1
    gap = a0 + lead * a1 - j
    a2 = gap * (1 - alpha) ** 2 + alpha * alpha * e2
    out = []
    for (da, db, dl), (d0, d1, d2, dj) in zip(slopes, sens):
        b0 = da * (e0 - z) + alpha * d0
        b1 = db * (e1 - z + a0) - b0 * (1 - beta) + beta * d1
        b2 = (b0 + dl * a1 + lead * b1 - dj) * (1 - alpha) ** 2 - 2 * (1 - alpha) * da * gap + 2 * alpha * da * e2 + alpha * alpha * d2
        out += [b0, b1, b2, dj + b2]
    return [a0, a1, a2, j + a2, *out, u, f, v], (j + a2, n, f, power)


def learned_jma(price: str = "close", n: float = 20, phase: float = 0.0, power: float = 2.0, rate: float = 0.01) -> Recurrence:
    """Jurik average whose period, phase and power follow the slope of its error against the next price."""
    return Recurrence(partial(_learned_jma, rate, n, phase, power), (price,), ("learned_jma", "jma_period", "jma_phase", "jma_power"))


def _learned_tr(rate: float, n: float, s, x):
    (tr,) = x
    if s is None:
        return [1, tr, 0.0, 0.0, 0.0, 0.0, math.log(n / 14)], (None, float(n))
    count, last, f1, f2, d1, d2, u = s
    count += 1
    if count < 3:
        return [count, tr, f1, f2, d1, d2, u], (None, 14 * math.exp(u))
    size = max(abs(tr) + abs(f1), 1e-9)
    u = _clip(u - rate * _clip((f1 - tr) / size * d1 / size, -1.0, 1.0), -1.0, 2.0)
    n = max(2.0, 14 * math.exp(u))
    k = 1.414 * math.pi / n
    a, turn = math.exp(-k), k if n > 2 else 0.0  # turn: -dk/du
    c2, c3 = 2 * a * math.cos(k), -a * a
    s2, s3 = 2 * a * turn * (math.cos(k) + math.sin(k)), -2 * a * a * turn
    mean = (tr + last) / 2
    f = (1 - c2 - c3) * mean + c2 * f1 + c3 * f2
    d = -(s2 + s3) * mean + s2 * f1 + c2 * d1 + s3 * f2 + c3 * d2
    return [count, tr, f, f1, d, d1, u], (f, n)


def learned_tr(tr: str = "tr", n: float = 14, rate: float = 0.05) -> Recurrence:
    """Smoothed true range whose period follows the slope of its error against the next range; null for two rows."""
    return Recurrence(partial(_learned_tr, rate, n), (tr,), ("learned_tr", "tr_period"))


def position_in_bands(price: Column, lower: Column, upper: Column) -> Column:
    """0 at the lower band, 1 at the upper; 0.5 where they meet."""
    return F.when(upper - lower < 1e-10, 0.5).otherwise((price - lower) / (upper - lower))


def stacked(base: Column, raw: Column, weights: list[float], bias: float = 0.0) -> Column:
    """struct(p, agreement): logistic of the weighted base predictions and raw features (short ones padded by 0.5); agreement of the base predictions."""
    joined = F.concat(base, raw, F.array_repeat(F.lit(0.5), F.greatest(F.lit(0), F.lit(len(weights)) - F.size(base) - F.size(raw))))
    logit = F.aggregate(F.zip_with(F.slice(joined, 1, len(weights)), F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(float(bias)), lambda t, v: t + v)
    n = F.size(base)
    mean = F.aggregate(base, F.lit(0.0), lambda t, v: t + v) / n
    std = F.sqrt(F.aggregate(base, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean)) / n)
    return F.struct((1 / (1 + F.exp(-logit))).alias("p"), F.greatest(F.lit(0.0), 1 - 2 * std).alias("agreement"))


def importances(weights: list[Column]) -> list[Column]:
    """Each weight's share of the absolute weights; equal shares where all are 0."""
    total = sum((F.abs(w) for w in weights), F.lit(0.0))
    return [F.when(total < 1e-10, 1 / len(weights)).otherwise(F.abs(w) / total) for w in weights]
