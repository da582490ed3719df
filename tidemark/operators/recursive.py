"""Recursive operators: one pure step function each, shared by the batch and the streaming driver.

A step takes (state, inputs) and returns (state, outputs). State is None before the first row
and otherwise a JSON-able list, so the same function runs over ordered partitions in batch and
over keyed state in Structured Streaming. A null output means "not warmed up".
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

Step = Callable[[list | None, tuple], tuple[list, tuple]]


@dataclass(frozen=True)
class Recurrence:
    """A step with the columns that it reads and makes."""

    step: Step
    inputs: tuple[str, ...]
    outputs: tuple[str, ...]


def scan(df: DataFrame, recurrence: Recurrence, by: str = "symbol", order: Sequence[str] = ("ts",)) -> DataFrame:
    """df's key and order columns with the outputs, one row an input row."""
    return scan_all(df, [recurrence], by, order)


def scan_all(df: DataFrame, recurrences: Sequence[Recurrence], by: str = "symbol", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Several recurrences over the same groups in one shuffle.

    A key's rows are sorted by Spark, which spills, and stream through its task in Arrow batches
    with the states carried from batch to batch, so a task's memory doesn't grow with a key's
    history. Rows of one key are stepped through one after the other, as a recurrence demands.
    """
    need = list(dict.fromkeys(c for r in recurrences for c in r.inputs))
    keep = [by, *order]
    part = df.select(*keep, *[c for c in need if c not in keep])
    outputs = [o for r in recurrences for o in r.outputs]
    schema = T.StructType([part.schema[c] for c in keep] + [T.StructField(o, T.DoubleType()) for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states = None, None
        for batch in batches:
            names = batch.column(by).to_pylist()
            columns = {c: batch.column(c).to_pylist() for c in need}
            made: list[list] = [[] for _ in recurrences]
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(starts, [*starts[1:], len(names)]):
                if states is None or names[a] != key:
                    key, states = names[a], [None] * len(recurrences)
                for j, r in enumerate(recurrences):
                    state, step, out = states[j], r.step, made[j]
                    for x in zip(*(columns[c][a:b] for c in r.inputs)):
                        state, y = step(state, x)
                        out.append(y)
                    states[j] = state
            values = [pa.array([None if v is None else float(v) for v in column], pa.float64()) for part in made for column in zip(*part)]
            if names:
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *values], names=schema.names)

    return part.repartition(F.col(by)).sortWithinPartitions(*keep).mapInArrow(run, schema)


# ---- filters ----


def _kalman(q: float, r: float, s, x):
    (z,) = x
    if s is None:
        return [z, r], (z, r, 0.0)
    value, p = s
    p += q
    k = p / (p + r)
    new = value + k * (z - value)
    return [new, (1 - k) * p], (new, (1 - k) * p, z - value)


def kalman(price: str = "close", q: float = 0.01, r: float = 0.1) -> Recurrence:
    """Random-walk Kalman filter: value, its variance, innovation."""
    return Recurrence(partial(_kalman, q, r), (price,), ("kalman", "kalman_var", "innovation"))


def _adaptive_kalman(q: float, r0: float, size: int, s, x):
    (z,) = x
    if s is None:
        return [z, r0, r0, []], (z, r0)
    value, p, r, seen = s
    p += q
    innovation = z - value
    seen = [*seen, innovation][-size:]
    if len(seen) >= 5:
        mean = math.fsum(seen) / len(seen)
        spread = math.fsum((v - mean) ** 2 for v in seen) / len(seen)
        ratio = spread / (p + r)
        r = min(10.0, max(0.001, r * (1.1 if ratio > 1.5 else 0.9 if ratio < 0.5 else 1.0)))
    k = p / (p + r)
    return [value + k * innovation, (1 - k) * p, r, seen], (value + k * innovation, r)


def adaptive_kalman(price: str = "close", q: float = 0.01, r: float = 0.1, size: int = 20) -> Recurrence:
    """Kalman filter whose measurement noise follows the innovations' variance."""
    return Recurrence(partial(_adaptive_kalman, q, r, size), (price,), ("adaptive_kalman", "noise"))


def _velocity_kalman(qp: float, qv: float, r: float, s, x):
    (z,) = x
    if s is None:
        return [z, 0.0, 1.0, 0.0, 1.0], (z, 0.0)
    value, speed, a, b, c = s  # covariance [[a, b], [b, c]]
    value += speed
    a, b, c = a + 2 * b + c + qp, b + c, c + qv
    k1, k2 = a / (a + r), b / (a + r)
    gap = z - value
    return [value + k1 * gap, speed + k2 * gap, (1 - k1) * a, (1 - k1) * b, c - k2 * b], (value + k1 * gap, speed + k2 * gap)


def velocity_kalman(price: str = "close", qp: float = 0.01, qv: float = 0.001, r: float = 0.1) -> Recurrence:
    """Constant-velocity Kalman filter."""
    return Recurrence(partial(_velocity_kalman, qp, qv, r), (price,), ("velocity_kalman", "speed"))


# ---- volatility ----


def _garch(omega: float, alpha: float, beta: float, s, x):
    (r,) = x
    long_run = omega / (1 - alpha - beta)
    v = long_run if s is None else omega + alpha * s[1] ** 2 + beta * s[0]
    return [v, r], (math.sqrt(v), math.sqrt(v / long_run))


def garch(ret: str = "ret", omega: float = 1e-5, alpha: float = 0.05, beta: float = 0.94) -> Recurrence:
    """GARCH(1,1): volatility and its ratio to the long run's."""
    return Recurrence(partial(_garch, omega, alpha, beta), (ret,), ("garch", "garch_ratio"))


def _adaptive_garch(omega: float, a0: float, b0: float, s, x):
    (r,) = x
    if s is None:
        v, a, b = omega / (1 - a0 - b0), a0, b0
    else:
        v, last, a, b = s
        shock = last * last / max(v, 1e-10)
        a = min(0.2, a * 1.05) if shock > 4 else max(0.02, a * 0.99) if shock < 0.25 else a
        b = min(b, 0.98 - a)
        v = omega + a * last * last + b * v
    return [v, r, a, b], (math.sqrt(v), a)


def adaptive_garch(ret: str = "ret", omega: float = 1e-5, alpha: float = 0.05, beta: float = 0.94) -> Recurrence:
    """GARCH whose alpha grows after shocks and fades in calm."""
    return Recurrence(partial(_adaptive_garch, omega, alpha, beta), (ret,), ("adaptive_garch", "garch_alpha"))


def _egarch(omega: float, alpha: float, beta: float, gamma: float, s, x):
    (r,) = x
    if s is None:
        h = omega / (1 - beta)
    else:
        h, last = s
        z = last / math.exp(h / 2)
        h = omega + beta * h + alpha * (abs(z) - math.sqrt(2 / math.pi)) + gamma * z
    return [h, r], (math.exp(h / 2),)


def egarch(ret: str = "ret", omega: float = -0.5, alpha: float = 0.1, beta: float = 0.9, gamma: float = -0.1) -> Recurrence:
    """Log-variance recursion with size and sign of shocks."""
    return Recurrence(partial(_egarch, omega, alpha, beta, gamma), (ret,), ("egarch",))


# ---- regression ----


def _rls(forget: float, start: float, band: float, s, x):
    (z,) = x
    t, a, b, paa, pab, pbb, n, mean, m2 = s or [0.0, 0.0, 0.0, start, 0.0, start, 0, 0.0, 0.0]
    t += 1
    # regressors (1, t)
    u, w = paa + pab * t, pab + pbb * t
    k = forget + u + w * t
    gap = z - (a + b * t)
    a, b = a + u / k * gap, b + w / k * gap
    paa, pab, pbb = (paa - u * u / k) / forget, (pab - u * w / k) / forget, (pbb - w * w / k) / forget
    line = a + b * t
    residual = z - line
    n += 1
    step = residual - mean
    mean += step / n
    m2 += step * (residual - mean)
    std = math.sqrt(m2 / (n - 1)) if n > 2 else 0.01
    place = min(1.0, max(0.0, (residual + band * std) / (2 * band * std))) if std > 0 else 0.5
    return [t, a, b, paa, pab, pbb, n, mean, m2], (line, b, 1 / (1 + (paa + pbb) / 100), line + band * std, line - band * std, residual / std if std > 0 else 0.0, place)


def rls_channel(price: str = "close", forget: float = 0.99, start: float = 100.0, band: float = 2.0) -> Recurrence:
    """Recursive least squares on time: line, slope, fit, bands, z and place in the channel."""
    return Recurrence(partial(_rls, forget, start, band), (price,), ("rls", "rls_slope", "rls_fit", "rls_upper", "rls_lower", "rls_z", "rls_place"))


def trend_direction(slope: Column, least: float = 0.0001) -> Column:
    return F.when(slope > least, "up").when(slope < -least, "down").otherwise("flat")


# ---- smoothers ----


def two_pole(n: float) -> tuple[float, float]:
    """(c2, c3) of the two-pole filter of period n."""
    a = math.exp(-1.414 * math.pi / n)
    return 2 * a * math.cos(1.414 * math.pi / n), -a * a


def _super(n: int, s, x):
    (z,) = x
    c2, c3 = two_pole(n)
    count, last, f1, f2 = s or [0, z, z, z]
    y = z if count < 2 else (1 - c2 - c3) * z + c2 * f1 + c3 * f2
    return [count + 1, z, y, f1], (y,)


def super_smoother(price: str = "close", n: int = 20, name: str = "super_smoother") -> Recurrence:
    """Two-pole low-pass; passes the first two values."""
    return Recurrence(partial(_super, n), (price,), (name,))


def _ultimate(n: int, s, x):
    (z,) = x
    c2, c3 = two_pole(n)
    count, p1, p2, h1, h2 = s or [0, z, z, z, z]
    # the high-pass line starts at the price itself
    h = z if count < 2 else (1 + c2 - c3) / 4 * (z - 2 * p1 + p2) + c2 * h1 + c3 * h2
    return [count + 1, z, p1, h, h1], (z if count < 2 else z - h,)


def ultimate_smoother(price: str = "close", n: int = 20) -> Recurrence:
    """Price less a two-pole high-pass; passes the first two values."""
    return Recurrence(partial(_ultimate, n), (price,), ("ultimate_smoother",))


def _flex(n: int, s, x):
    smooth, line = s or [None, []]
    smooth, (y,) = _super(n, smooth, x)
    line = [*line, y][-n:]
    if len(line) < n:
        return [smooth, line], (0.0, 0.0)
    away = sum(v - line[0] for v in line) / n
    return [smooth, line], ((y - line[0]) / n, away / (abs(away) + 0.0001))


def reflex_trendflex(price: str = "close", n: int = 20) -> Recurrence:
    """Slope of the smoothed price over n rows, and its mean distance from the oldest of them by its size; 0 while short."""
    return Recurrence(partial(_flex, n), (price,), ("reflex", "trendflex"))


def _position(most: int, s, x):
    values, weights = s or [[], []]
    (z,) = x
    if z is None or z != z:
        return [values, weights], (None,)
    at = bisect_right(values, z)
    if at and values[at - 1] == z:
        weights[at - 1] += 1
        at -= 1
    else:
        values.insert(at, z)
        weights.insert(at, 1)
    below, total = sum(weights[: at + 1]), sum(weights)
    if len(values) > 2 * most:  # neighbours merge, so a share is known to about 1 / most
        pairs = range(0, len(values) - 1, 2)
        values = [(values[i] * weights[i] + values[i + 1] * weights[i + 1]) / (weights[i] + weights[i + 1]) for i in pairs] + values[len(values) // 2 * 2 :]
        weights = [weights[i] + weights[i + 1] for i in pairs] + weights[len(weights) // 2 * 2 :]
    return [values, weights], (below / total,)


def relative_position(x: str = "close", most: int = 2048, name: str = "position") -> Recurrence:
    """Share of the values so far, this one included, that are no greater: exact for the first 2 * ``most`` distinct ones, then by merged neighbours."""
    return Recurrence(partial(_position, most), (x,), (name,))


def _ema(alpha: float, s, x):
    (z,) = x
    y = z if s is None else alpha * z + (1 - alpha) * s[0]
    return [y], (y,)


def ema(x: str, alpha: float, name: str) -> Recurrence:
    return Recurrence(partial(_ema, alpha), (x,), (name,))


def _decayed(keep: int, s, x):
    value, leaving, rate = x
    total, weight = s or [0.0, 0.0]
    gone = 0.0 if leaving is None or leaving != leaving else rate**keep
    total, weight = total * rate + value - gone * (leaving if gone else 0.0), weight * rate + 1 - gone
    return [total, weight], (total / weight,)


def decayed_mean(x: str, leaving: str, rate: str, keep: int) -> Recurrence:
    """Mean of the last ``keep`` values with weights rate ** age; ``leaving`` is the value keep rows back."""
    return Recurrence(partial(_decayed, keep), (x, leaving, rate), ("decayed",))


def _jma_core(n: float, phase: float, power: float, s, z):
    beta = 0.45 * (n - 1) / (0.45 * (n - 1) + 2)
    alpha, ratio = beta**power, min(2.5, max(0.5, phase / 100 + 1.5))
    if s is None:
        return [1, z, z, z, z]
    count, e0, e1, e2, j = s
    e0 = (1 - alpha) * z + alpha * e0
    e1 = (z - e0) * (1 - beta) + beta * e1
    e2 = (e0 + ratio * e1 - j) * (1 - alpha) ** 2 + alpha * alpha * e2
    return [count + 1, e0, e1, e2, j + e2]


def _jma(n: int, phase: float, power: float, warm: bool, s, x):
    s = _jma_core(n, phase, power, s, x[0])
    return s, (s[4] if not warm or (s[0] >= n and s[0] > 1) else None,)


def jma(price: str = "close", n: int = 10, phase: float = 0.0, power: float = 2.0, warm: bool = True, name: str = "jma") -> Recurrence:
    """Adaptive moving average of three stages; with ``warm`` null for the first n - 1 rows."""
    return Recurrence(partial(_jma, n, phase, power, warm), (price,), (name,))


def _kama(n: int, fast: int, slow: int, s, x):
    (z,) = x
    seen, k = s or [[], None]
    seen = [*seen, z][-(n + 1) :]
    if len(seen) <= n:
        return [seen, None], (None,)
    path = sum(abs(b - a) for a, b in zip(seen, seen[1:]))
    er = abs(seen[-1] - seen[0]) / path if path else 0.0
    f, w = 2 / (fast + 1), 2 / (slow + 1)
    k = z if k is None else k + (er * (f - w) + w) ** 2 * (z - k)
    return [seen, k], (k,)


def kama(price: str = "close", n: int = 10, fast: int = 2, slow: int = 30) -> Recurrence:
    """Efficiency-ratio moving average, seeded at the price of the first full row."""
    return Recurrence(partial(_kama, n, fast, slow), (price,), ("kama",))


# ---- oscillators on windowed inputs: the window part is made before by columns ----


def _fisher(s, x):
    (rsi,) = x
    if rsi is None or rsi != rsi:
        return s or [0.0], (None, None)
    before = (s or [0.0])[0]
    v = max(-0.999, min(0.999, 0.1 * (rsi - 50) / 50))
    now = 0.5 * math.log((1 + v) / (1 - v)) + 0.5 * before
    return [now], (now, before)


def fisher(rsi: str = "rsi") -> Recurrence:
    """Fisher transform of RSI plus half the last value; the signal is the last value."""
    return Recurrence(_fisher, (rsi,), ("fisher_rsi", "fisher_signal"))


def _smoothed_tr(n: int, s, x):
    (tr,) = x
    c2, c3 = two_pole(n)
    count, last, f1, f2 = s or [0, 0.0, 0.0, 0.0]
    count += 1
    if count < 3:
        return [count, tr, f1, f2], (None,)
    y = (1 - c2 - c3) * (tr + last) / 2 + c2 * f1 + c3 * f2
    return [count, tr, y, f1], (y if count >= n else None,)


def smoothed_tr(tr: str = "tr", n: int = 14) -> Recurrence:
    """True range through the two-pole filter."""
    return Recurrence(partial(_smoothed_tr, n), (tr,), ("smoothed_tr",))


def _stochastic(n: int, s, x):
    (raw,) = x
    if raw is None or raw != raw:
        return s or [0.0, 0.0], (None, None)
    c2, c3 = two_pole(n)
    f1, f2 = s or [0.0, 0.0]
    y = (1 - c2 - c3) * raw + c2 * f1 + c3 * f2
    return [y, f1], (100 * y, 50 * (y + f1))


def stochastic(raw: str = "stoch_raw", n: int = 14) -> Recurrence:
    """Smoothed stochastic and its signal, by 100."""
    return Recurrence(partial(_stochastic, n), (raw,), ("stoch_k", "stoch_d"))


def _roofing(hp: int, lp: int, s, x):
    (z,) = x
    angle = 2 * math.pi / hp
    a = (math.cos(angle) + math.sin(angle) - 1) / math.cos(angle)
    c2, c3 = two_pole(lp)
    p1, p2, h1, h2, f1, f2 = s or [0.0] * 6
    h = (1 - a / 2) ** 2 * (z - 2 * p1 + p2) + 2 * (1 - a) * h1 - (1 - a) ** 2 * h2
    f = (1 - c2 - c3) * (h + h1) / 2 + c2 * f1 + c3 * f2
    return [z, p1, h, h1, f, f1], (f, f - f1, math.copysign(abs(f) ** 0.5, f) if f else 0.0)


def roofing(price: str = "close", hp: int = 48, lp: int = 10) -> Recurrence:
    """High-pass then low-pass: value, acceleration, signed root."""
    return Recurrence(partial(_roofing, hp, lp), (price,), ("roofing", "roofing_acceleration", "roofing_momentum"))


def _dema_cci(n: int, s, x):
    (tp,) = x
    a = 2 / (n + 1)
    e1, e2, seen = s or [None, None, []]
    e1 = tp if e1 is None else a * tp + (1 - a) * e1
    e2 = e1 if e2 is None else a * e1 + (1 - a) * e2
    seen = [*seen, tp][-n:]
    d = 2 * e1 - e2
    if len(seen) < n:
        return [e1, e2, seen], (None,)
    away = sum(abs(v - d) for v in seen) / n
    return [e1, e2, seen], ((tp - d) / (0.015 * away) if away else 0.0,)


def dema_cci(typical: str = "typical", n: int = 20) -> Recurrence:
    """CCI around the double exponential mean of the typical price."""
    return Recurrence(partial(_dema_cci, n), (typical,), ("dema_cci",))


#: Weights of the Hilbert transform at 0, 2, 4 and 6 rows back.
_HILBERT = ((0, 0.0962), (2, 0.5769), (4, -0.5769), (6, -0.0962))


def _hilbert(newest_first: list[float]) -> float:
    return sum(w * newest_first[i] for i, w in _HILBERT)


def _push(line: list[float], v: float) -> list[float]:
    return [v, *line[:6]]


def _cycle(s, z):
    """Prices, smoothed price, detrender, quadrature and in-phase lines, newest first."""
    prices, smooth, detrend, quad, phase = s
    prices = [z, *prices[:6]]
    if len(prices) < 7:
        return [prices, smooth, detrend, quad, phase], False
    smooth = _push(smooth, (4 * z + 3 * prices[1] + 2 * prices[2] + prices[3]) / 10)
    detrend = _push(detrend, _hilbert(smooth))
    quad, phase = _push(quad, _hilbert(detrend)), _push(phase, detrend[3])
    return [prices, smooth, detrend, quad, phase], True


_EMPTY = [[], [0.0] * 7, [0.0] * 7, [0.0] * 7, [0.0] * 7]


def _mesa(fast: float, slow: float, s, x):
    lines, rest = s or [_EMPTY, [0.0] * 9]
    lines, ready = _cycle(lines, x[0])
    if not ready:
        return [lines, rest], (None, None, None)
    _, _, _, q, i = lines
    i2, q2, re, im, period, smooth, mama, fama, angle = rest
    seen_first = rest == [0.0] * 9
    i2, q2 = 0.2 * (i[0] - _hilbert(q)) + 0.8 * i2, 0.2 * (q[0] + _hilbert(i)) + 0.8 * q2
    re, im = 0.2 * (i2 * i[1] + q2 * q[1]) + 0.8 * re, 0.2 * (i2 * q[1] - q2 * i[1]) + 0.8 * im
    if im and re:
        period = 2 * math.pi / math.atan(im / re)
    period = min(50.0, max(6.0, max(0.67 * smooth, min(1.5 * smooth, period))))
    smooth = 0.33 * period + 0.67 * smooth
    if i[0]:
        angle = math.degrees(math.atan(q[0] / i[0]))
    alpha = max(slow, fast / max(1.0, 0.0 if seen_first else angle))
    m, f = alpha * x[0] + (1 - alpha) * mama, 0.0
    f = 0.5 * alpha * m + (1 - 0.5 * alpha) * fama
    signal = 0.5 * (m - f) + 0.5 * (mama - fama)
    return [lines, [i2, q2, re, im, period, smooth, m, f, angle]], (m - f, signal, m - f - signal)


def mesa_macd(price: str = "close", fast: float = 0.5, slow: float = 0.05) -> Recurrence:
    """Cycle-adaptive averages: their difference, its signal, histogram; null for the first six rows."""
    return Recurrence(partial(_mesa, fast, slow), (price,), ("mesa_macd", "mesa_signal", "mesa_histogram"))


def _trendline(s, x):
    lines, it, line = s or [_EMPTY, 0.0, 0.0]
    lines, ready = _cycle(lines, x[0])
    if not ready:
        return [lines, it, line], (None, None, None)
    smooth = lines[1]
    it = 0.33 * (smooth[0] + 0.5 * (smooth[0] - smooth[1])) + 0.67 * it
    new = 0.07 * (2 * it - smooth[1]) + 0.93 * line
    strength = min(100.0, abs(new - line) / (abs(x[0]) * 1e-4 + 1e-10) * 100)
    return [lines, it, new], (new, strength, 1.0 if new > line else -1.0)


def trendline(price: str = "close") -> Recurrence:
    """Instantaneous trend line with strength and direction; null for the first six rows."""
    return Recurrence(_trendline, (price,), ("trendline", "trend_strength", "trend_direction"))


# ---- relations and regimes ----


def _ew_relation(half: float, s, x):
    a, b = x
    k = 1 - math.exp(-math.log(2) / half)
    if s is None:
        return [a, b, 0.0, 0.0, 0.0], (0.0, 0.0)
    ma, mb, va, vb, c = s
    da, db = a - ma, b - mb
    ma, mb = ma + k * da, mb + k * db
    na, nb = a - ma, b - mb  # distances from the moved means
    va, vb, c = (1 - k) * va + k * da * na, (1 - k) * vb + k * db * nb, (1 - k) * c + k * da * nb
    under = math.sqrt(va * vb)
    corr = c / under if under >= 1e-10 else 0.0
    return [ma, mb, va, vb, c], (c, max(-1.0, min(1.0, corr)))


def ew_relation(x: str, y: str, half: float = 20) -> Recurrence:
    """Exponentially weighted covariance and correlation."""
    return Recurrence(partial(_ew_relation, half), (x, y), ("ew_cov", "ew_corr"))


# fixed values: transitions, means and deviations of the three regimes bull, bear, range
TRANSITIONS = ((0.95, 0.03, 0.02), (0.03, 0.92, 0.05), (0.08, 0.07, 0.85))
MEANS, STDS = (0.001, -0.001, 0.0), (0.015, 0.025, 0.008)


def _forward(trans, means, stds, s, x):
    p = s or [1 / 3] * 3
    (r,) = x
    prior = [sum(p[i] * trans[i][j] for i in range(3)) for j in range(3)]
    logs = [-0.5 * ((r - m) / d) ** 2 - math.log(d) for m, d in zip(means, stds)]
    top = max(logs)
    joint = [q * math.exp(v - top) for q, v in zip(prior, logs)]
    total = sum(joint)
    p = [max(v / total, 1e-10) for v in joint] if total > 0 else [1 / 3] * 3
    total = sum(p)
    p = [v / total for v in p]
    entropy = -sum(v * math.log(v) for v in p)
    return p, (*p, float(p.index(max(p))), entropy, p[0] - p[1])


def regime_forward(ret: str = "ret", trans=TRANSITIONS, means=MEANS, stds=STDS) -> Recurrence:
    """Forward filter of a three-state Gaussian model: probabilities, state, entropy, signal."""
    return Recurrence(partial(_forward, trans, means, stds), (ret,), ("p_bull", "p_bear", "p_range", "state", "entropy", "regime_signal"))


def _driven(trans, means, stds, weights, s, x):
    r, *inputs = x
    moved = [[t * math.exp(sum(w * v for w, v in zip(weights[i][j], inputs))) for j, t in enumerate(row)] for i, row in enumerate(trans)]
    moved = [[v / sum(row) for v in row] for row in moved]
    p = s or [1 / 3] * 3
    prior = [sum(p[i] * moved[i][j] for i in range(3)) for j in range(3)]
    joint = [q * math.exp(-0.5 * ((r - m) / d) ** 2) / (d * math.sqrt(2 * math.pi)) for q, m, d in zip(prior, means, stds)]
    total = sum(joint)
    p = [v / total for v in joint] if total > 1e-10 else [1 / 3] * 3
    return p, (*p, float(p.index(max(p))), max(p))


def driven_regimes(inputs: tuple[str, ...], weights, ret: str = "ret", trans=TRANSITIONS, means=MEANS, stds=STDS) -> Recurrence:
    """Forward filter whose transitions follow side inputs: each is scaled by exp(weights[i][j] . inputs) and its row set to sum 1."""
    return Recurrence(partial(_driven, trans, means, stds, weights), (ret, *inputs), ("d_bull", "d_bear", "d_range", "d_state", "d_confidence"))


def _guard(confirm: int, s, x):
    score, speed = x
    (count,) = s or [0]
    if score is None or score != score:
        return [count], (count, 0.5)
    if score > 0.9 or (speed is not None and speed == speed and speed > 0.001):
        return [count + 1], (count + 1, 0.0)
    count = max(0, count - 1)
    return [count], (count, 0.0 if score > 0.7 else 0.5 if score > 0.5 else 1.0)


def guardian(score: str = "score", velocity: str = "velocity", confirm: int = 3) -> Recurrence:
    """Running count of critical rows (it halts at ``confirm``) and the position multiplier; missing data halves it."""
    return Recurrence(partial(_guard, confirm), (score, velocity), ("critical_count", "multiplier"))


def _smooth_weights(rate: float, cap: float, s, x):
    if s is None:
        return list(x), tuple(x)
    moved = [a + max(-cap, min(cap, rate * (b - a))) for a, b in zip(s, x)]
    total = sum(moved)
    moved = [v / total for v in moved] if total > 0 else moved
    return moved, tuple(moved)


def smoothed_weights(columns: tuple[str, ...], rate: float = 0.1, cap: float = 0.15) -> Recurrence:
    """Weights that follow their targets by a capped share each row and keep the sum 1."""
    return Recurrence(partial(_smooth_weights, rate, cap), columns, tuple(f"{c}_smooth" for c in columns))


# ---- windows that need loops ----


#: Lengths of the periods that the rescaled range is taken over.
HURST_PERIODS = (10, 15, 20, 25, 30, 40, 50)


def rescaled_range(part: Sequence[float]) -> float:
    """Range of the running deviations from the mean by the sample deviation; 0 where flat."""
    n = len(part)
    mean = sum(part) / n
    std = math.sqrt(sum((v - mean) ** 2 for v in part) / (n - 1))
    if std < 1e-10:
        return 0.0
    total, line = 0.0, []
    for v in part:
        total += v - mean
        line.append(total)
    return (max(line) - min(line)) / std


def hurst_of(prices: Sequence[float]) -> float:
    """Slope of ln(mean rescaled range) on ln(period), within [0, 1]; 0.5 where fewer than three periods fit."""
    r = [math.log(b / a) for a, b in zip(prices, prices[1:])]
    points = []
    for n in HURST_PERIODS:
        if len(r) >= 20 and n <= len(r) // 2:
            found = [rescaled_range(r[i : i + n]) for i in range(0, len(r) // n * n, n)]
            if (mean := sum(found) / len(found)) > 0:
                points.append((math.log(n), math.log(mean)))
    if len(points) < 3:
        return 0.5
    mx, my = (sum(v) / len(points) for v in zip(*points))
    return min(1.0, max(0.0, sum((x - mx) * (y - my) for x, y in points) / sum((x - mx) ** 2 for x, _ in points)))


def _hurst(size: int, every: int, s, x):
    seen, count, h = s or [[], 0, 0.5]
    seen, count = [*seen, float(x[0])][-size:], count + 1
    if len(seen) == size and count % every == 0:
        h = hurst_of(seen)
    return [seen, count, h], (h, min(1.0, max(0.0, 2 * (h - 0.5))))


def moving_hurst(price: str = "close", size: int = 100, every: int = 10) -> Recurrence:
    return Recurrence(partial(_hurst, size, every), (price,), ("hurst", "momentum_weight"))


def hurst_regime(h: Column) -> Column:
    return F.when(h > 0.55, "trending").when(h < 0.45, "mean_reverting").otherwise("random_walk")


def momentum_weight(h: Column) -> Column:
    """0 at a Hurst exponent of 0.5 and below, 1 at 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - 0.5) * 2))


def reversion_weight(h: Column) -> Column:
    """1 at a Hurst exponent of 0, 0 at 0.5 and above."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.5 - h) * 2))


def complexity_regime(entropy: Column) -> Column:
    return F.when(entropy < 0.5, "low_complexity").when(entropy > 1.5, "high_complexity").otherwise("normal_complexity")


def entropy_confidence(entropy: Column) -> Column:
    """1 at entropy 0, falling to 0.3 at 2."""
    return F.greatest(F.lit(0.3), F.least(F.lit(1.0), 1 - 0.35 * entropy))


def garch_regime(ratio: Column) -> Column:
    """Of the ratio of volatility to the long run's."""
    return F.when(ratio < 0.7, "low").when(ratio > 1.5, "high").otherwise("normal")


def regime_decisions(p_range: Column) -> dict[str, Column]:
    """Whether momentum and mean reversion should be used, each with its probability."""
    return {"use_momentum": 1 - p_range > 0.6, "trend_probability": 1 - p_range, "use_mean_reversion": p_range > 0.5, "range_probability": p_range}


def sample_entropy(x: Sequence[float], m: int = 2, share: float = 0.2) -> float:
    """-ln(A / B) of matches of length m + 1 and m within share * population deviation."""
    import numpy as np

    v = np.asarray(x, float)
    r = share * v.std()
    n = len(v) - m
    if n < 2 or r == 0:
        return 0.0
    near = np.abs(v[:, None] - v[None, :]) < r
    pair = np.triu(np.ones((n, n), bool), 1)
    b = near[:n, :n] & near[1 : n + 1, 1 : n + 1] & pair
    a = b & near[2 : n + 2, 2 : n + 2]
    return float(-math.log(a.sum() / b.sum())) if a.sum() and b.sum() else 0.0


def _entropy(size: int, every: int, s, x):
    seen, count, h = s or [[], 0, 0.0]
    seen, count = [*seen, float(x[0])][-size:], count + 1
    if len(seen) == size and count % every == 0:
        h = sample_entropy(seen)
    return [seen, count, h], (h, min(1.0, max(0.3, 1 - 0.35 * h)))


def moving_entropy(x: str = "ret", size: int = 100, every: int = 10) -> Recurrence:
    return Recurrence(partial(_entropy, size, every), (x,), ("sample_entropy", "confidence"))
