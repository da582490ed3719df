"""Queries of the recursive operators; their SQL steps row by row in a recursive CTE."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.columns import at, over, running, tidy, z_score
from tidemark.operators import chunked as ch, indicators as ind, microstructure as ms, recursive as re_
from tidemark.plans.collect import collector
from tidemark.plans.risk import RISK, _REGIME as RISK_REGIME, _SCORE as RISK_SCORE
from tidemark.plans.statistics import RETURNS
from tidemark.sources.fixtures import BOOKS, bars, books, snapshots

QUERIES, ORACLES, query = collector()


def recursion(source: str, first: dict[str, str], step: dict[str, str], shown: dict[str, str], *more: str) -> str:
    """SQL that numbers ``source`` (symbol, ts, ...) and steps through it; p is the state before, x the row."""
    return f"""WITH RECURSIVE {source},
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM src),
r AS (
  SELECT symbol, ts, n, {', '.join(f'({e})::DOUBLE AS {c}' for c, e in first.items())} FROM num x WHERE n = 1
  UNION ALL
  SELECT x.symbol, x.ts, x.n, {', '.join(f'({e})::DOUBLE' for e in step.values())} FROM r p JOIN num x ON x.symbol = p.symbol AND x.n = p.n + 1)
SELECT symbol, epoch_us(ts) AS ts_us, {', '.join([*(f'round({e}, 4) + 0.0 AS {c}' for c, e in shown.items()), *more])} FROM r"""


SRC = f"{RETURNS}, src AS (SELECT symbol, ts, close AS z, ret, volume FROM rets)"


def _b(spark, sf):
    return ch.log_return(bars(spark, sf))


def _out(df, *names):
    return df.select("symbol", at(), *[tidy(n).alias(n) for n in names])


# each value of a step is written with the state before it, so the gain is spelled out
_K = "((p.v + 0.01) / (p.v + 0.01 + 0.1))"


@query("kalman", recursion(SRC, {"k": "z", "v": "0.1", "i": "0"}, {"k": f"p.k + {_K} * (x.z - p.k)", "v": f"(1 - {_K}) * (p.v + 0.01)", "i": "x.z - p.k"}, {"kalman": "k", "kalman_var": "v", "innovation": "i"}))
def _kalman(spark, sf):
    return _out(ch.scan_chunks(_b(spark, sf), [ch.kalman()]), "kalman", "kalman_var", "innovation")


_A, _B, _C = "(p.a + 2 * p.b + p.c + 0.01)", "(p.b + p.c)", "(p.c + 0.001)"
_G1, _G2 = f"({_A} / ({_A} + 0.1))", f"({_B} / ({_A} + 0.1))"


@query("velocity_kalman", recursion(SRC, {"k": "z", "s": "0", "a": "1", "b": "0", "c": "1"}, {
    "k": f"p.k + p.s + {_G1} * (x.z - p.k - p.s)", "s": f"p.s + {_G2} * (x.z - p.k - p.s)", "a": f"(1 - {_G1}) * {_A}", "b": f"(1 - {_G1}) * {_B}", "c": f"{_C} - {_G2} * {_B}"}, {"velocity_kalman": "k", "speed": "s", "ahead_5": "k + 5 * s"}))
def _velocity(spark, sf):
    out = ch.scan_chunks(_b(spark, sf), [ch.velocity_kalman()]).withColumn("ahead_5", F.col("velocity_kalman") + 5 * F.col("speed"))
    return _out(out, "velocity_kalman", "speed", "ahead_5")


_LR = 1e-5 / (1 - 0.05 - 0.94)


@query("garch", recursion(SRC, {"v": f"{_LR!r}", "r": "ret"}, {"v": "1e-5 + 0.05 * p.r * p.r + 0.94 * p.v", "r": "x.ret"}, {
    "garch": "sqrt(v)", "garch_ratio": f"sqrt(v / {_LR!r})", "scalar": "least(3.0, 0.01 / sqrt(v))", "value_at_risk": "2.326348 * sqrt(v)", "forecast_10": f"sqrt({_LR!r} + pow(0.99, 10) * (v - {_LR!r}))"}))
def _garch(spark, sf):
    """Volatility with regime ratio, position scalar, 99 % value at risk and the 10-step forecast as expressions on it."""
    g = ch.scan_chunks(_b(spark, sf), [ch.garch()])
    v = F.col("garch")
    g = g.select("*", F.least(F.lit(3.0), 0.01 / v).alias("scalar"), (2.326348 * v).alias("value_at_risk"), F.sqrt(_LR + math.pow(0.99, 10) * (v * v - _LR)).alias("forecast_10"))
    return _out(g, "garch", "garch_ratio", "scalar", "value_at_risk", "forecast_10")


_AA = "(CASE WHEN p.r * p.r / greatest(p.v, 1e-10) > 4 THEN least(0.2, p.a * 1.05) WHEN p.r * p.r / greatest(p.v, 1e-10) < 0.25 THEN greatest(0.02, p.a * 0.99) ELSE p.a END)"
_AB = f"least(p.b, 0.98 - {_AA})"


@query("adaptive_garch", recursion(SRC, {"v": f"{_LR!r}", "r": "ret", "a": "0.05", "b": "0.94"}, {"v": f"1e-5 + {_AA} * p.r * p.r + {_AB} * p.v", "r": "x.ret", "a": _AA, "b": _AB}, {"adaptive_garch": "sqrt(v)", "garch_alpha": "a"}))
def _agarch(spark, sf):
    return _out(re_.scan(_b(spark, sf), re_.adaptive_garch()), "adaptive_garch", "garch_alpha")


@query("egarch", recursion(f"{RETURNS}, src AS (SELECT symbol, ts, ret / 100 AS ret FROM rets)", {"h": "-5.0", "r": "ret"}, {"h": "-0.5 + 0.9 * p.h + 0.1 * (abs(p.r / exp(p.h / 2)) - sqrt(2 / pi())) - 0.1 * p.r / exp(p.h / 2)", "r": "x.ret"}, {"egarch": "exp(h / 2)"}))
def _egarch(spark, sf):
    b = _b(spark, sf).withColumn("ret", F.col("ret") / 100)
    return _out(re_.scan(b, re_.egarch()), "egarch")


_c2, _c3 = re_.two_pole(20)


@query("smoothers", recursion(SRC, {"p1": "z", "p2": "z", "f1": "z", "f2": "z", "h1": "z", "h2": "z"}, {
    "p1": "x.z", "p2": "p.p1", "f1": f"CASE WHEN x.n <= 2 THEN x.z ELSE {1 - _c2 - _c3!r} * x.z + {_c2!r} * p.f1 + {_c3!r} * p.f2 END", "f2": "p.f1",
    "h1": f"CASE WHEN x.n <= 2 THEN x.z ELSE {(1 + _c2 - _c3) / 4!r} * (x.z - 2 * p.p1 + p.p2) + {_c2!r} * p.h1 + {_c3!r} * p.h2 END", "h2": "p.h1"},
    {"super_smoother": "f1", "ultimate_smoother": "CASE WHEN n <= 2 THEN p1 ELSE p1 - h1 END"}))
def _smooth(spark, sf):
    return _out(ch.scan_chunks(_b(spark, sf), [ch.super_smoother(), ch.ultimate_smoother()]), "super_smoother", "ultimate_smoother")


_be = 0.45 * 9 / (0.45 * 9 + 2)
_al = _be * _be
_e0 = f"({1 - _al!r} * x.z + {_al!r} * p.e0)"
_e1 = f"((x.z - {_e0}) * {1 - _be!r} + {_be!r} * p.e1)"
_e2 = f"(({_e0} + 1.5 * {_e1} - p.j) * {(1 - _al) ** 2!r} + {_al * _al!r} * p.e2)"


@query("jurik", recursion(SRC, {"e0": "z", "e1": "z", "e2": "z", "j": "z"}, {"e0": _e0, "e1": _e1, "e2": _e2, "j": f"p.j + {_e2}"}, {"jma": "CASE WHEN n >= 10 THEN j END", "jma_raw": "j"}))
def _jma(spark, sf):
    return _out(ch.scan_chunks(_b(spark, sf), [ch.jma(), ch.jma(warm=False, name="jma_raw")]), "jma", "jma_raw")


@query("exponential_means", recursion(SRC, {"f": "z", "s": "z"}, {"f": "2.0 / 13 * x.z + (1 - 2.0 / 13) * p.f", "s": "2.0 / 27 * x.z + (1 - 2.0 / 27) * p.s"}, {"ema_12": "f", "ema_26": "s", "macd": "f - s"}))
def _ema(spark, sf):
    out = ch.scan_chunks(_b(spark, sf), [ch.ema("close", 2 / 13, "ema_12"), ch.ema("close", 2 / 27, "ema_26")])
    return _out(out.withColumn("macd", F.col("ema_12") - F.col("ema_26")), "ema_12", "ema_26", "macd")


_KSRC = f"""{RETURNS}, d AS (SELECT *, abs(close - lag(close) OVER w) AS s, abs(close - lag(close, 10) OVER w) AS ch FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
src AS (SELECT symbol, ts, close AS z, pow(coalesce(ch / nullif(sum(s) OVER (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING), 0), 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2) AS sc FROM d)"""


@query("kama", recursion(_KSRC, {"k": "CAST(NULL AS DOUBLE)"}, {"k": "CASE WHEN x.n < 11 THEN NULL WHEN x.n = 11 THEN x.z ELSE p.k + x.sc * (x.z - p.k) END"}, {"kama": "k"}))
def _kama(spark, sf):
    return _out(re_.scan(_b(spark, sf), re_.kama()), "kama")


_w = 2 * math.pi / 48
_ra = (math.cos(_w) + math.sin(_w) - 1) / math.cos(_w)
_r2, _r3 = re_.two_pole(10)
_h = f"({(1 - _ra / 2) ** 2!r} * (x.z - 2 * p.p1 + p.p2) + {2 * (1 - _ra)!r} * p.h1 - {(1 - _ra) ** 2!r} * p.h2)"


@query("roofing", recursion(SRC, {"p1": "z", "p2": "0", "h1": f"{(1 - _ra / 2) ** 2!r} * z", "h2": "0", "f1": f"{(1 - _r2 - _r3) / 2!r} * {(1 - _ra / 2) ** 2!r} * z", "f2": "0"}, {
    "p1": "x.z", "p2": "p.p1", "h1": _h, "h2": "p.h1", "f1": f"{(1 - _r2 - _r3) / 2!r} * ({_h} + p.h1) + {_r2!r} * p.f1 + {_r3!r} * p.f2", "f2": "p.f1"},
    {"roofing": "f1", "roofing_acceleration": "f1 - f2", "roofing_momentum": "sign(f1) * sqrt(abs(f1))"}))
def _roof(spark, sf):
    return _out(ch.scan_chunks(_b(spark, sf), [ch.roofing()]), "roofing", "roofing_acceleration", "roofing_momentum")


_OSRC = f"""{RETURNS}, d AS (SELECT *, lag(close) OVER w AS pc, close - lag(close) OVER w AS d FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
w AS (
  SELECT symbol, ts, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, count(*) OVER v AS cnt, count(d) OVER v AS nd,
    CASE WHEN -sum(least(d, 0.0)) OVER v = 0 THEN 100.0 ELSE 100 - 100 / (1 + sum(greatest(d, 0.0)) OVER v / -sum(least(d, 0.0)) OVER v) END AS rsi,
    CASE WHEN max(high) OVER v <> min(low) OVER v THEN (close - min(low) OVER v) / (max(high) OVER v - min(low) OVER v) ELSE 0.5 END AS raw
  FROM d WINDOW v AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)),
src AS (SELECT symbol, ts, tr, CASE WHEN nd = 14 THEN greatest(-0.999, least(0.999, 0.1 * (rsi - 50) / 50)) END AS v, CASE WHEN cnt = 14 THEN raw END AS raw FROM w)"""
_s2, _s3 = re_.two_pole(14)


@query("oscillators", recursion(_OSRC, {"fi": "0", "fp": "0", "k1": "0", "k2": "0", "t": "tr", "s1": "0", "s2": "0", "ok": "0", "okf": "0"}, {
    "fi": "CASE WHEN x.v IS NULL THEN p.fi ELSE 0.5 * ln((1 + x.v) / (1 - x.v)) + 0.5 * p.fi END", "fp": "p.fi",
    "k1": f"CASE WHEN x.raw IS NULL THEN p.k1 ELSE {1 - _s2 - _s3!r} * x.raw + {_s2!r} * p.k1 + {_s3!r} * p.k2 END", "k2": "CASE WHEN x.raw IS NULL THEN p.k2 ELSE p.k1 END", "t": "x.tr",
    "s1": f"CASE WHEN x.n < 3 THEN 0 ELSE {(1 - _s2 - _s3) / 2!r} * (x.tr + p.t) + {_s2!r} * p.s1 + {_s3!r} * p.s2 END", "s2": "p.s1", "ok": "(x.raw IS NOT NULL)::INT", "okf": "(x.v IS NOT NULL)::INT"},
    {"fisher_rsi": "CASE WHEN okf = 1 THEN fi END", "fisher_signal": "CASE WHEN okf = 1 THEN fp END", "stoch_k": "CASE WHEN ok = 1 THEN 100 * k1 END", "stoch_d": "CASE WHEN ok = 1 THEN 50 * (k1 + k2) END", "smoothed_tr": "CASE WHEN n >= 14 THEN s1 END"}))
def _osc(spark, sf):
    b = ind.true_range(ind.raw_stochastic(ind.simple_rsi(bars(spark, sf))))
    return _out(ch.scan_chunks(b, [ch.fisher(), ch.stochastic(), ch.smoothed_tr()]), "fisher_rsi", "fisher_signal", "stoch_k", "stoch_d", "smoothed_tr")


_k = 1 - math.exp(-math.log(2) / 20)
_ma, _mb = f"(p.a + {_k!r} * (x.z - p.a))", f"(p.b + {_k!r} * (x.volume - p.b))"


@query("ew_covariance", recursion(SRC, {"a": "z", "b": "volume", "va": "0", "vb": "0", "c": "0"}, {
    "a": _ma, "b": _mb, "va": f"{1 - _k!r} * p.va + {_k!r} * (x.z - p.a) * (x.z - {_ma})", "vb": f"{1 - _k!r} * p.vb + {_k!r} * (x.volume - p.b) * (x.volume - {_mb})",
    "c": f"{1 - _k!r} * p.c + {_k!r} * (x.z - p.a) * (x.volume - {_mb})"}, {"ew_cov": "c", "ew_corr": "CASE WHEN sqrt(va * vb) >= 1e-10 THEN greatest(-1.0, least(1.0, c / sqrt(va * vb))) ELSE 0.0 END"}))
def _ew(spark, sf):
    return _out(ch.scan_chunks(_b(spark, sf), [ch.ew_relation("close", "volume")]), "ew_cov", "ew_corr")


def staged(source: str, types: dict[str, str], first: dict[str, str], stages: list[dict[str, str]], shown: str, also: str = "") -> str:
    """Like ``recursion`` with states of any type, whose step is worked out in stages: each may read the columns of those before it.

    A stage's row has the state before as p_ and the row's values as x_.
    """
    row = ", ".join([f"p.{c} AS p_{c}" for c in types] + [f"x.{c} AS x_{c}" for c in also.split()] + ["x.symbol, x.ts, x.n"])
    inner = f"SELECT {row} FROM r p JOIN num x ON x.symbol = p.symbol AND x.n = p.n + 1"
    for stage in stages:
        inner = f"SELECT *, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM ({inner})"
    made = ", ".join(f"CAST({c} AS {t})" for c, t in types.items())
    return f"""WITH RECURSIVE {source},
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM src),
r AS (
  SELECT symbol, ts, n, {', '.join(f'CAST({first[c]} AS {t}) AS {c}' for c, t in types.items())} FROM num WHERE n = 1
  UNION ALL
  SELECT symbol, ts, n, {made} FROM ({inner}))
SELECT symbol, epoch_us(ts) AS ts_us, {shown} FROM r"""


def _r(e: str, name: str) -> str:
    return f"round({e}, 4) + 0.0 AS {name}"


_RLS_COLUMNS = ("rls", "rls_slope", "rls_upper", "rls_lower", "rls_z", "rls_place")
_RLS_STEP = [
    {"t": "p_t + 1"}, {"u": "p_paa + p_pab * t", "w": "p_pab + p_pbb * t"}, {"k": "0.99 + u + w * t", "gap": "x_z - (p_a + p_b * t)"},
    {"a": "p_a + u / k * gap", "b": "p_b + w / k * gap", "paa": "(p_paa - u * u / k) / 0.99", "pab": "(p_pab - u * w / k) / 0.99", "pbb": "(p_pbb - w * w / k) / 0.99"},
    {"line": "a + b * t"}, {"res": "x_z - line"}, {"mean": "p_mean + (res - p_mean) / t"}, {"m2": "p_m2 + (res - p_mean) * (res - mean)"}, {"sd": "CASE WHEN t > 2 THEN sqrt(m2 / (t - 1)) ELSE 0.01 END"},
]
_RLS_TYPES = {c: "DOUBLE" for c in ("t", "a", "b", "paa", "pab", "pbb", "mean", "m2", "line", "res", "sd")}


@query("rls_channel", staged(f"""{RETURNS}, src AS (SELECT symbol, ts, close AS z,
    1.0 AS t, 100.0 / 200.99 * close AS a, 100.0 / 200.99 * close AS b, (100 - 10000 / 200.99) / 0.99 AS paa, -10000 / 200.99 / 0.99 AS pab FROM rets)""", _RLS_TYPES, {
    "t": "1", "a": "a", "b": "b", "paa": "paa", "pab": "pab", "pbb": "paa", "line": "a + b", "res": "z - a - b", "mean": "z - a - b", "m2": "0", "sd": "0.01"}, _RLS_STEP,
    ", ".join([_r("line", "rls"), _r("b", "rls_slope"), _r("line + 2 * sd", "rls_upper"), _r("line - 2 * sd", "rls_lower"), _r("CASE WHEN sd > 0 THEN res / sd ELSE 0 END", "rls_z"),
               _r("CASE WHEN sd > 0 THEN least(1.0, greatest(0.0, (res + 2 * sd) / (4 * sd))) ELSE 0.5 END", "rls_place"), "CASE WHEN b > 0.0001 THEN 'up' WHEN b < -0.0001 THEN 'down' ELSE 'flat' END AS trend"]), "z"))
def _rls(spark, sf):
    """Two-parameter recursive least squares on time with its channel and the direction of its slope."""
    out = re_.scan(_b(spark, sf), re_.rls_channel())
    return out.select("symbol", at(), *[tidy(n).alias(n) for n in _RLS_COLUMNS], re_.trend_direction(F.col("rls_slope")).alias("trend"))


_AK_STEP = [
    {"pp": "p_v + 0.01", "inn": "x_z - p_k"}, {"seen": "list_concat(p_seen, [inn])[-20:]"},
    {"ratio": "CASE WHEN len(seen) >= 5 THEN list_var_pop(seen) / (pp + p_noise) END"},
    {"noise": "CASE WHEN ratio IS NULL THEN p_noise ELSE least(10.0, greatest(0.001, p_noise * CASE WHEN ratio > 1.5 THEN 1.1 WHEN ratio < 0.5 THEN 0.9 ELSE 1.0 END)) END"},
    {"k": "p_k + pp / (pp + noise) * inn", "v": "(1 - pp / (pp + noise)) * pp"},
]


@query("adaptive_kalman", staged(SRC, {"k": "DOUBLE", "v": "DOUBLE", "noise": "DOUBLE", "seen": "DOUBLE[]"}, {"k": "z", "v": "0.1", "noise": "0.1", "seen": "[]"}, _AK_STEP, _r("k", "adaptive_kalman") + ", " + _r("noise", "noise"), "z"))
def _ak(spark, sf):
    return _out(re_.scan(_b(spark, sf), re_.adaptive_kalman()), "adaptive_kalman", "noise")


@query("kalman_band", recursion(SRC, {"k": "z", "v": "0.1"}, {"k": f"p.k + {_K} * (x.z - p.k)", "v": f"(1 - {_K}) * (p.v + 0.01)"}, {"lower": "k - 2 * sqrt(v)", "upper": "k + 2 * sqrt(v)"}))
def _band(spark, sf):
    """Two standard deviations of the estimate around it."""
    out = ch.scan_chunks(_b(spark, sf), [ch.kalman()])
    margin = 2 * F.sqrt("kalman_var")
    return _out(out.select("*", (F.col("kalman") - margin).alias("lower"), (F.col("kalman") + margin).alias("upper")), "lower", "upper")


_FLEX = [{"f1": f"CASE WHEN n <= 2 THEN x_z ELSE {1 - _c2 - _c3!r} * x_z + {_c2!r} * p_f1 + {_c3!r} * p_f2 END", "f2": "p_f1"}, {"line": "list_concat(p_line, [f1])[-20:]"}]
_AWAY = "(list_sum(list_transform(line, lambda v: v - line[1])) / 20)"


@query("reflex_trendflex", staged(SRC, {"f1": "DOUBLE", "f2": "DOUBLE", "line": "DOUBLE[]"}, {"f1": "z", "f2": "z", "line": "[z]"}, _FLEX,
    _r("CASE WHEN len(line) = 20 THEN (f1 - line[1]) / 20 ELSE 0.0 END", "reflex") + ", " + _r(f"CASE WHEN len(line) = 20 THEN {_AWAY} / (abs({_AWAY}) + 0.0001) ELSE 0.0 END", "trendflex"), "z"))
def _flex(spark, sf):
    return _out(re_.scan(_b(spark, sf), re_.reflex_trendflex()), "reflex", "trendflex")


@query("relative_position", f"""WITH {RETURNS}, num AS (SELECT symbol, ts, close, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM rets)
SELECT a.symbol, epoch_us(a.ts) AS ts_us, round(count(*) FILTER (b.close <= a.close) / count(*), 4) + 0.0 AS position
FROM num a JOIN num b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY a.symbol, a.ts""")
def _pos(spark, sf):
    """Where each close lies among the closes so far."""
    return _out(ch.running_rank(bars(spark, sf), "close"), "position")


_HIL = lambda v: f"(0.0962 * {v}[1] + 0.5769 * {v}[3] - 0.5769 * {v}[5] - 0.0962 * {v}[7])"
_PUSH = lambda v, e: f"CASE WHEN ready THEN list_concat([{e}], p_{v})[1:7] ELSE p_{v} END"
_KEEP = lambda c, e: {c: f"CASE WHEN ready THEN {e} ELSE p_{c} END"}
_CYCLE = [
    {"prices": "list_concat([x_z], p_prices)[1:7]", "e1": "2.0 / 21 * x_tp + 19.0 / 21 * p_e1", "seen": "list_concat(p_seen, [x_tp])[-20:]"}, {"ready": "len(prices) = 7", "e2": "2.0 / 21 * e1 + 19.0 / 21 * p_e2", "tp": "x_tp"},
    {"smooth": _PUSH("smooth", "(4 * x_z + 3 * prices[2] + 2 * prices[3] + prices[4]) / 10")}, {"det": _PUSH("det", _HIL("smooth"))}, {"qd": _PUSH("qd", _HIL("det")), "ph": _PUSH("ph", "det[4]")},
    _KEEP("i2", f"0.2 * (ph[1] - {_HIL('qd')}) + 0.8 * p_i2") | _KEEP("q2", f"0.2 * (qd[1] + {_HIL('ph')}) + 0.8 * p_q2"),
    _KEEP("re", "0.2 * (i2 * ph[2] + q2 * qd[2]) + 0.8 * p_re") | _KEEP("im", "0.2 * (i2 * qd[2] - q2 * ph[2]) + 0.8 * p_im"),
    {"raw": "CASE WHEN im <> 0 AND re <> 0 THEN 2 * pi() / atan(im / re) ELSE p_period END"},
    _KEEP("period", "least(50.0, greatest(6.0, greatest(0.67 * p_sp, least(1.5 * p_sp, raw))))"), _KEEP("sp", "0.33 * period + 0.67 * p_sp") | _KEEP("angle", "CASE WHEN ph[1] <> 0 THEN degrees(atan(qd[1] / ph[1])) ELSE p_angle END"),
    {"alpha": "greatest(0.05, 0.5 / greatest(1.0, CASE WHEN p_go = 0 THEN 0.0 ELSE angle END))"}, _KEEP("m", "alpha * x_z + (1 - alpha) * p_m"), _KEEP("f", "0.5 * alpha * m + (1 - 0.5 * alpha) * p_f"),
    _KEEP("sig", "0.5 * (m - f) + 0.5 * (p_m - p_f)") | _KEEP("it", "0.33 * (smooth[1] + 0.5 * (smooth[1] - smooth[2])) + 0.67 * p_it"), _KEEP("line", "0.07 * (2 * it - smooth[2]) + 0.93 * p_line"),
    {"strength": "least(100.0, abs(line - p_line) / (abs(x_z) * 1e-4 + 1e-10) * 100)", "dir": "CASE WHEN line > p_line THEN 1.0 ELSE -1.0 END", "go": "ready::INT"},
]
_CYCLE_TYPES = {c: "DOUBLE[]" for c in ("prices", "smooth", "det", "qd", "ph", "seen")} | {c: "DOUBLE" for c in "i2 q2 re im period sp angle m f sig it line strength dir go e1 e2 tp".split()}
_CYCLE_FIRST = {c: "[0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]" for c in ("smooth", "det", "qd", "ph")} | {"prices": "[z]", "seen": "[tp]", "e1": "tp", "e2": "tp", "tp": "tp"} | {c: "0" for c in "i2 q2 re im period sp angle m f sig it line strength dir go".split()}
_READY = lambda e, name: _r(f"CASE WHEN go = 1 THEN {e} END", name)
_DEMA = "(2 * e1 - e2)"
_AWAYS = f"(list_sum(list_transform(seen, lambda v: abs(v - {_DEMA}))) / 20)"


@query("cycle_indicators", staged(f"{RETURNS}, src AS (SELECT symbol, ts, close AS z, (high + low + close) / 3 AS tp FROM rets)", _CYCLE_TYPES, _CYCLE_FIRST, _CYCLE,
    ", ".join([_READY("m - f", "mesa_macd"), _READY("sig", "mesa_signal"), _READY("m - f - sig", "mesa_histogram"), _READY("line", "trendline"), _READY("strength", "trend_strength"), _READY("dir", "trend_direction"),
               _r(f"CASE WHEN len(seen) = 20 THEN CASE WHEN {_AWAYS} > 0 THEN (tp - {_DEMA}) / (0.015 * {_AWAYS}) ELSE 0.0 END END", "dema_cci")]), "z tp"))
def _cycles(spark, sf):
    """MESA averages, instantaneous trend line and DEMA CCI."""
    b = _b(spark, sf).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = re_.scan_all(b, [re_.mesa_macd(), re_.trendline(), re_.dema_cci()])
    return _out(out, "mesa_macd", "mesa_signal", "mesa_histogram", "trendline", "trend_strength", "trend_direction", "dema_cci")


_kb = 0.45 * 19 / (0.45 * 19 + 2)
_ka = _kb * _kb
_k2, _k3 = re_.two_pole(20)
_KELT = [
    {"e0": f"{1 - _ka!r} * x_tp + {_ka!r} * p_e0", "s1": f"CASE WHEN n < 3 THEN 0 ELSE {(1 - _k2 - _k3) / 2!r} * (x_tr + p_t) + {_k2!r} * p_s1 + {_k3!r} * p_s2 END", "s2": "p_s1", "t": "x_tr"},
    {"e1": f"(x_tp - e0) * {1 - _kb!r} + {_kb!r} * p_e1"}, {"e2": f"(e0 + 1.5 * e1 - p_j) * {(1 - _ka) ** 2!r} + {_ka * _ka!r} * p_e2"}, {"j": "p_j + e2"},
]


@query("keltner", staged(f"""{RETURNS}, d AS (SELECT symbol, ts, high, low, (high + low + close) / 3 AS tp, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM rets),
  src AS (SELECT symbol, ts, tp, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM d)""", {c: "DOUBLE" for c in ("e0", "e1", "e2", "j", "s1", "s2", "t")},
    {"e0": "tp", "e1": "tp", "e2": "tp", "j": "tp", "s1": "0", "s2": "0", "t": "tr"}, _KELT,
    ", ".join([_r("CASE WHEN n >= 20 THEN j END", "middle"), _r("CASE WHEN n >= 20 THEN j + 2 * s1 END", "upper"), _r("CASE WHEN n >= 20 THEN j - 2 * s1 END", "lower")]), "tp tr"))
def _keltner(spark, sf):
    """JMA of the typical price with bands of the smoothed true range."""
    b = ind.true_range(bars(spark, sf)).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = ch.scan_chunks(b, [ch.jma("typical", 20, name="middle"), ch.smoothed_tr(n=20)])
    band = 2.0 * F.col("smoothed_tr")
    return _out(out.select("*", (F.col("middle") + band).alias("upper"), (F.col("middle") - band).alias("lower")), "middle", "upper", "lower")


_T, _M, _S = re_.TRANSITIONS, re_.MEANS, re_.STDS


def _lik(j: int) -> str:
    prior = " + ".join(f"p.p{i} * {_T[i][j]}" for i in range(3))
    return f"(({prior}) * (exp(-0.5 * pow((x.ret - {_M[j]}) / {_S[j]}, 2)) / {_S[j]}))"


def _first(j: int) -> str:
    return f"({sum(_T[i][j] for i in range(3)) / 3!r} * (exp(-0.5 * pow((ret - {_M[j]}) / {_S[j]}, 2)) / {_S[j]}))"


_total, _total1 = " + ".join(_lik(j) for j in range(3)), " + ".join(_first(j) for j in range(3))
_floor = lambda e, t: f"greatest({e} / ({t}), 1e-10)"


@query("regime_forward", recursion(f"{RETURNS}, src AS (SELECT symbol, ts, ret / 100 AS ret FROM rets)", {f"p{j}": _floor(_first(j), _total1) for j in range(3)}, {f"p{j}": _floor(_lik(j), _total) for j in range(3)}, {
    "p_bull": "p0 / (p0 + p1 + p2)", "p_bear": "p1 / (p0 + p1 + p2)", "p_range": "p2 / (p0 + p1 + p2)", "state": "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END", "regime_signal": "(p0 - p1) / (p0 + p1 + p2)"}))
def _forward(spark, sf):
    b = _b(spark, sf).withColumn("ret", F.col("ret") / 100)
    return _out(ch.scan_chunks(b, [ch.regime_forward()]), "p_bull", "p_bear", "p_range", "state", "regime_signal")


_PSUM = "(p0 + p1 + p2)"


@query("regime_decisions", recursion(f"{RETURNS}, src AS (SELECT symbol, ts, ret / 100 AS ret FROM rets)", {f"p{j}": _floor(_first(j), _total1) for j in range(3)}, {f"p{j}": _floor(_lik(j), _total) for j in range(3)}, {
    "entropy": f"-(p0 / {_PSUM} * ln(p0 / {_PSUM}) + p1 / {_PSUM} * ln(p1 / {_PSUM}) + p2 / {_PSUM} * ln(p2 / {_PSUM}))", "trend_probability": f"1 - p2 / {_PSUM}", "range_probability": f"p2 / {_PSUM}"},
    f"1 - p2 / {_PSUM} > 0.6 AS use_momentum", f"p2 / {_PSUM} > 0.5 AS use_mean_reversion"))
def _decide(spark, sf):
    """Which strategies suit the regime, with the entropy of its probabilities."""
    out = ch.scan_chunks(_b(spark, sf).withColumn("ret", F.col("ret") / 100), [ch.regime_forward()])
    d = re_.regime_decisions(F.col("p_range"))
    return out.select("symbol", at(), tidy("entropy").alias("entropy"), *[tidy(d[c]).alias(c) for c in ("trend_probability", "range_probability")], *[d[c].alias(c) for c in ("use_momentum", "use_mean_reversion")])


#: Side inputs raise the odds of the bear state: weights[i][j] by input.
_DRIVES = (((0.0,), (0.5,), (0.1,)),) * 3
_T2 = lambda i, j: f"{_T[i][j]} * exp({_DRIVES[i][j][0]!r} * x_v)"
_DR = [
    {f"m{i}{j}": f"{_T2(i, j)} / ({' + '.join(_T2(i, k) for k in range(3))})" for i in range(3) for j in range(3)},
    {f"q{j}": f"({' + '.join(f'p_p{i} * m{i}{j}' for i in range(3))}) * exp(-0.5 * pow((x_ret - {_M[j]}) / {_S[j]}, 2)) / {_S[j]}" for j in range(3)},
    {f"p{j}": f"CASE WHEN (q0 + q1 + q2) / sqrt(2 * pi()) > 1e-10 THEN q{j} / (q0 + q1 + q2) ELSE 1.0 / 3 END" for j in range(3)},
]
_D1 = lambda j: f"((p0 * {_T2(0, j)} / ({' + '.join(_T2(0, k) for k in range(3))}) + p1 * {_T2(1, j)} / ({' + '.join(_T2(1, k) for k in range(3))}) + p2 * {_T2(2, j)} / ({' + '.join(_T2(2, k) for k in range(3))})) * exp(-0.5 * pow((x_ret - {_M[j]}) / {_S[j]}, 2)) / {_S[j]})"
_DRSRC = f"""{RETURNS}, v AS (SELECT symbol, ts, ret / 100 AS ret, CASE WHEN count(*) OVER w >= 2 AND stddev_samp(volume) OVER w > 1e-10 THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0.0 END AS v,
    1.0 / 3 AS p0, 1.0 / 3 AS p1, 1.0 / 3 AS p2 FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  f AS (SELECT *, ret AS x_ret, v AS x_v FROM v), g AS (SELECT *, {', '.join(f'{_D1(j)} AS d{j}' for j in range(3))} FROM f),
  src AS (SELECT symbol, ts, ret, v, {', '.join(f'CASE WHEN (d0 + d1 + d2) / sqrt(2 * pi()) > 1e-10 THEN d{j} / (d0 + d1 + d2) ELSE 1.0 / 3 END AS f{j}' for j in range(3))} FROM g)"""


@query("driven_regimes", staged(_DRSRC, {f"p{j}": "DOUBLE" for j in range(3)}, {f"p{j}": f"f{j}" for j in range(3)}, _DR,
    ", ".join([_r("p0", "d_bull"), _r("p1", "d_bear"), _r("p2", "d_range"), "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END::DOUBLE AS d_state", _r("greatest(p0, p1, p2)", "d_confidence")]), "ret v"))
def _driven(spark, sf):
    """Transitions that follow the volume's z-score: high volume raises the odds of the bear state."""
    b = _b(spark, sf).select("symbol", "ts", (F.col("ret") / 100).alias("ret"), z_score(F.col("volume"), running()).alias("v"))
    return _out(re_.scan(b, re_.driven_regimes(("v",), _DRIVES)), "d_bull", "d_bear", "d_range", "d_state", "d_confidence")


@query("entropy_of_windows", f"""WITH {RETURNS},
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM rets),
h AS (SELECT symbol, ts, n, list(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING) AS v FROM num),
w AS (SELECT symbol, ts, v, 0.2 * list_stddev_pop(v) AS r FROM h WHERE n >= 100 AND n % 10 = 0),
ij AS (SELECT symbol, ts, v, r, i, unnest(range(i + 1, 99)) AS j FROM (SELECT symbol, ts, v, r, unnest(range(1, 98)) AS i FROM w)),
m AS (
  SELECT symbol, ts, any_value(r) AS r, count(*) FILTER (abs(v[i] - v[j]) < r AND abs(v[i + 1] - v[j + 1]) < r) AS b,
    count(*) FILTER (abs(v[i] - v[j]) < r AND abs(v[i + 1] - v[j + 1]) < r AND abs(v[i + 2] - v[j + 2]) < r) AS a FROM ij GROUP BY symbol, ts),
e AS (SELECT symbol, ts, CASE WHEN r > 0 AND a > 0 AND b > 0 THEN -ln(a / b) ELSE 0.0 END AS e FROM m)
SELECT symbol, epoch_us(ts) AS ts_us, round(e, 4) + 0.0 AS sample_entropy, CASE WHEN e < 0.5 THEN 'low_complexity' WHEN e > 1.5 THEN 'high_complexity' ELSE 'normal_complexity' END AS complexity_regime,
  round(greatest(0.3, least(1.0, 1 - 0.35 * e)), 4) + 0.0 AS confidence FROM e""")
def _entropies(spark, sf):
    """The rows at which the entropy is taken anew, with regime and confidence."""
    out = re_.scan(_b(spark, sf), re_.moving_entropy()).withColumn("n", F.row_number().over(over()))
    e = F.col("sample_entropy")
    return out.where("n >= 100 and n % 10 = 0").select("symbol", at(), tidy(e).alias("sample_entropy"), re_.complexity_regime(e).alias("complexity_regime"), tidy(re_.entropy_confidence(e)).alias("confidence"))


_HP = ", ".join(str(n) for n in re_.HURST_PERIODS)


@query("hurst_of_windows", f"""WITH {RETURNS},
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM rets),
h AS (SELECT symbol, ts, n, list(ln(close)) OVER (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING) AS v FROM num),
c AS (SELECT symbol, ts, v, p, unnest(range(0, 99 // p)) AS k FROM (SELECT *, unnest([{_HP}]) AS p FROM h WHERE n >= 100 AND n % 10 = 0) WHERE p <= 49),
i AS (SELECT symbol, ts, p, k, j, v[k * p + j + 1] - v[k * p + j] AS r FROM (SELECT *, unnest(range(1, p + 1)) AS j FROM c)),
m AS (SELECT *, avg(r) OVER g AS mu, stddev_samp(r) OVER g AS sd FROM i WINDOW g AS (PARTITION BY symbol, ts, p, k)),
l AS (SELECT *, sum(r - mu) OVER (PARTITION BY symbol, ts, p, k ORDER BY j) AS line FROM m),
rs AS (SELECT symbol, ts, p, k, CASE WHEN any_value(sd) < 1e-10 THEN 0 ELSE (max(line) - min(line)) / any_value(sd) END AS rs FROM l GROUP BY 1, 2, 3, 4),
pt AS (SELECT symbol, ts, ln(p) AS x, ln(avg(rs)) AS y FROM rs GROUP BY symbol, ts, p HAVING avg(rs) > 0),
e AS (SELECT symbol, ts, CASE WHEN count(*) < 3 THEN 0.5 ELSE greatest(0.0, least(1.0, regr_slope(y, x))) END AS h FROM pt GROUP BY symbol, ts)
SELECT symbol, epoch_us(ts) AS ts_us, round(h, 4) + 0.0 AS hurst, CASE WHEN h > 0.55 THEN 'trending' WHEN h < 0.45 THEN 'mean_reverting' ELSE 'random_walk' END AS hurst_regime,
  round(greatest(0.0, least(1.0, (h - 0.5) * 2)), 4) + 0.0 AS momentum_weight, round(greatest(0.0, least(1.0, (0.5 - h) * 2)), 4) + 0.0 AS reversion_weight FROM e""")
def _hursts(spark, sf):
    """The rows at which the exponent is taken anew, with regime and weights."""
    out = re_.scan(_b(spark, sf), re_.moving_hurst()).withColumn("n", F.row_number().over(over()))
    h = F.col("hurst")
    return out.where("n >= 100 and n % 10 = 0").select("symbol", at(), tidy(h).alias("hurst"), re_.hurst_regime(h).alias("hurst_regime"), tidy(re_.momentum_weight(h)).alias("momentum_weight"), tidy(re_.reversion_weight(h)).alias("reversion_weight"))


_HE = f"""WITH {RETURNS}, b AS (SELECT symbol, epoch_us(ts) AS ts_us FROM rets),
j AS (SELECT symbol, ts_us, last_value(hurst IGNORE NULLS) OVER w AS h, last_value(sample_entropy IGNORE NULLS) OVER w AS e
  FROM b LEFT JOIN ({ORACLES['hurst_of_windows']}) USING (symbol, ts_us) LEFT JOIN (SELECT symbol, ts_us, sample_entropy FROM ({ORACLES['entropy_of_windows']})) USING (symbol, ts_us) WINDOW w AS (PARTITION BY symbol ORDER BY ts_us)),
v AS (SELECT symbol, ts_us, coalesce(h, 0.5) AS h, coalesce(e, 0) AS e FROM j)
SELECT symbol, ts_us, h AS hurst, CASE WHEN h > 0.55 THEN 'trending' WHEN h < 0.45 THEN 'mean_reverting' ELSE 'random_walk' END AS hurst_regime, round(greatest(0.0, least(1.0, (h - 0.5) * 2)), 4) + 0.0 AS momentum_weight,
  round(greatest(0.0, least(1.0, (0.5 - h) * 2)), 4) + 0.0 AS reversion_weight, e AS sample_entropy, CASE WHEN e < 0.5 THEN 'low_complexity' WHEN e > 1.5 THEN 'high_complexity' ELSE 'normal_complexity' END AS complexity_regime, round(greatest(0.3, least(1.0, 1 - 0.35 * e)), 4) + 0.0 AS confidence FROM v"""


@query("hurst_and_entropy", _HE)
def _hurst(spark, sf):
    """Exponent and entropy with their regimes, weights and confidence."""
    out = re_.scan_all(_b(spark, sf), [re_.moving_hurst(), re_.moving_entropy()])
    out = out.select("symbol", at(), tidy("hurst").alias("h"), tidy("sample_entropy").alias("e"))
    h, e = F.col("h"), F.col("e")
    return out.select(
        "symbol", "ts_us", h.alias("hurst"), re_.hurst_regime(h).alias("hurst_regime"), tidy(re_.momentum_weight(h)).alias("momentum_weight"), tidy(re_.reversion_weight(h)).alias("reversion_weight"),
        e.alias("sample_entropy"), re_.complexity_regime(e).alias("complexity_regime"), tidy(re_.entropy_confidence(e)).alias("confidence"),
    )


@query("garch_regime", recursion(SRC, {"v": f"{_LR!r}", "r": "ret"}, {"v": "1e-5 + 0.05 * p.r * p.r + 0.94 * p.v", "r": "x.ret"}, {"garch": "sqrt(v)"},
    f"CASE WHEN sqrt(v / {_LR!r}) < 0.7 THEN 'low' WHEN sqrt(v / {_LR!r}) > 1.5 THEN 'high' ELSE 'normal' END AS regime"))
def _gregime(spark, sf):
    out = ch.scan_chunks(_b(spark, sf), [ch.garch()])
    return out.select("symbol", at(), tidy("garch").alias("garch"), re_.garch_regime(F.col("garch_ratio")).alias("regime"))


_CRIT = "(x.s > 0.9 OR coalesce(x.v > 0.001, false))"
_CRIT1 = "(s > 0.9 OR coalesce(v > 0.001, false))"
_MUL = "CASE WHEN {c} THEN 0.0 WHEN {s} > 0.7 THEN 0.0 WHEN {s} > 0.5 THEN 0.5 ELSE 1.0 END"


@query("guardian", recursion(f"""{RISK}, {RISK_REGIME}, {RISK_SCORE},
  vv AS (SELECT symbol, ts, score, first(score) OVER w AS s0, epoch(ts) - epoch(first(ts) OVER w) AS span, count(*) OVER w AS k FROM ss WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)),
  src AS (SELECT symbol, ts, score * 1.6 AS s, CASE WHEN k >= 2 AND span >= 5 THEN (score - s0) / span END AS v FROM vv)""",
    {"c": f"{_CRIT1}::INT", "m": _MUL.format(c=_CRIT1, s="s")}, {"c": f"CASE WHEN {_CRIT} THEN p.c + 1 ELSE greatest(0, p.c - 1) END", "m": _MUL.format(c=_CRIT, s="x.s")}, {"critical_count": "c", "multiplier": "m"}))
def _guard(spark, sf):
    """Confirmed halts: counts of critical rows and position multipliers."""
    from tidemark.operators.risk import velocity
    from tidemark.plans.risk import scored

    s = velocity(scored(spark, sf), 6 * 3600).select("symbol", "ts", (F.col("score") * 1.6).alias("score"), "velocity")
    return _out(re_.scan(s, re_.guardian()), "critical_count", "multiplier")


_WA, _WB = "(p.a + greatest(-0.15, least(0.15, 0.1 * (x.a - p.a))))", "(p.b + greatest(-0.15, least(0.15, 0.1 * (x.b - p.b))))"


@query("smoothed_weights", recursion(f"{RETURNS}, src AS (SELECT symbol, ts, close / (close + open) AS a, open / (close + open) AS b FROM rets)", {"a": "a", "b": "b"}, {
    "a": f"{_WA} / ({_WA} + {_WB})", "b": f"{_WB} / ({_WA} + {_WB})"}, {"a_smooth": "a", "b_smooth": "b"}))
def _weights(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", (F.col("close") / (F.col("close") + F.col("open"))).alias("a"), (F.col("open") / (F.col("close") + F.col("open"))).alias("b"))
    return _out(re_.scan(b, re_.smoothed_weights(("a", "b"))), "a_smooth", "b_smooth")


def _jurik(n: int, x: str, p: str = "p_") -> list[dict[str, str]]:
    """Stages of a Jurik average of x, whose state columns begin with ``p``."""
    b = 0.45 * (n - 1) / (0.45 * (n - 1) + 2)
    a, c = b * b, p.removeprefix("p_")
    return [
        {f"{c}e0": f"{1 - a!r} * {x} + {a!r} * {p}e0"}, {f"{c}e1": f"({x} - {c}e0) * {1 - b!r} + {b!r} * {p}e1"},
        {f"{c}e2": f"({c}e0 + 1.5 * {c}e1 - {p}j) * {(1 - a) ** 2!r} + {a * a!r} * {p}e2"}, {f"{c}j": f"{p}j + {c}e2"},
    ]


_TWO = [{**a, **b} for a, b in zip(_jurik(20, "x_delta", "p_d"), _jurik(10, "x_pressure", "p_q"))]
_TWO_TYPES = {f"{c}{k}": "DOUBLE" for c in "dq" for k in ("e0", "e1", "e2", "j")}


@query("volume_trend", staged(f"""{RETURNS}, src AS (SELECT symbol, ts, CASE WHEN high > low THEN volume * (2 * (close - low) - (high - low)) / (high - low) ELSE 0.0 END AS delta, CASE WHEN high > low THEN 2 * (close - low) / (high - low) - 1 ELSE 0.0 END AS pressure,
    close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS change FROM rets)""", _TWO_TYPES | {"change": "DOUBLE"}, {c: "delta" if c[0] == "d" else "pressure" for c in _TWO_TYPES} | {"change": "change"}, [*_TWO, {"change": "x_change"}],
    ", ".join([_r("dj", "delta_trend"), _r("qj", "pressure_trend"), "CASE WHEN qj > 0.2 THEN 'buying' WHEN qj < -0.2 THEN 'selling' ELSE 'neutral' END AS direction",
               "CASE WHEN abs(change) >= 1e-10 AND sign(change) * sign(dj) < 0 THEN -sign(change)::DOUBLE ELSE 0.0 END AS divergence"]), "delta pressure change"))
def _vtrend(spark, sf):
    """Trends of the bars' delta and pressure, and where price goes against the delta's."""
    out = ind.volume_trend(bars(spark, sf))
    return out.select("symbol", at(), tidy("delta_trend").alias("delta_trend"), tidy("pressure_trend").alias("pressure_trend"), "direction", "divergence")


_BOOK_SRC = f"""{BOOKS}, names AS (SELECT DISTINCT book_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(book_id % 5 + 1 AS INT)] AS symbol, TIMESTAMP '2024-01-01' + to_hours(CAST(book_id // 5 % 720 AS INT)) AS ts FROM levels),
k AS (SELECT book_id, sum(qty) FILTER (side = 'O' AND lvl <= 5) AS b5, sum(qty) FILTER (side = 'F' AND lvl <= 5) AS a5 FROM ranked GROUP BY 1),
v AS (SELECT symbol, ts, book_id, CASE WHEN coalesce(b5, 0) + coalesce(a5, 0) > 0 THEN (coalesce(b5, 0) - coalesce(a5, 0)) / (coalesce(b5, 0) + coalesce(a5, 0)) ELSE 0 END::DOUBLE AS obi, (best_ask - best_bid) AS spread FROM names JOIN k USING (book_id) JOIN tops USING (book_id))"""
_ZED = lambda c: f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER w >= 2 AND stddev_samp({c}) OVER w > 1e-10 THEN ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w WHEN {c} IS NULL AND count({c}) OVER w >= 2 AND stddev_samp({c}) OVER w > 1e-10 THEN NULL ELSE 0.0 END"
_OBI = [{"ema": "2.0 / 21 * x_obi + 19.0 / 21 * p_ema", "oz": "x_oz", "sz": "x_sz", "book": "x_book_id"}, *_jurik(20, "x_obi", "p_o")]


@query("book_trend", staged(f"""{_BOOK_SRC}, s AS (SELECT *, {_ZED('obi')} AS oz, {_ZED('spread')} AS sz FROM v WINDOW w AS (PARTITION BY symbol ORDER BY ts, book_id ROWS UNBOUNDED PRECEDING)),
    src AS (SELECT symbol, ts + to_microseconds(row_number() OVER (PARTITION BY symbol, ts ORDER BY book_id)) AS ts, book_id, obi, oz, sz FROM s)""",
    {"ema": "DOUBLE", "oz": "DOUBLE", "sz": "DOUBLE", "book": "BIGINT", "oe0": "DOUBLE", "oe1": "DOUBLE", "oe2": "DOUBLE", "oj": "DOUBLE"}, {"ema": "obi", "oz": "oz", "sz": "sz", "book": "book_id", **{c: "obi" for c in ("oe0", "oe1", "oe2", "oj")}}, _OBI,
    ", ".join(["book AS book_id", _r("oz", "obi_z"), _r("sz", "spread_z"), _r("ema", "obi_ema"), _r("oj", "obi_jma")]), "obi oz sz book_id").replace("SELECT symbol, epoch_us(ts) AS ts_us,", "SELECT"))
def _btrend(spark, sf):
    """A symbol's books in order of time: running z of imbalance and spread, and two averages of the imbalance."""
    b = ms.book_features(books(spark, sf)).join(snapshots(spark, sf), "book_id")
    out = ms.book_trend(b)
    return out.select("book_id", *[tidy(c).alias(c) for c in ("obi_z", "spread_z", "obi_ema", "obi_jma")])
