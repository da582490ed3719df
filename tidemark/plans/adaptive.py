"""Queries of the indicator stacks, learned bands, stacking and importances."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import at, over, tidy
from tidemark.operators import adaptive as ad, fusion as fu, indicators as ind, learning as le, recursive as re_
from tidemark.plans.collect import collector
from tidemark.plans.recursions import ORACLES as RECURSIONS, _r, staged
from tidemark.plans.statistics import RETURNS
from tidemark.sources.fixtures import BARS, bars

QUERIES, ORACLES, query = collector()

_E = lambda c, new, n: f"{2 / (n + 1)!r} * {new} + {1 - 2 / (n + 1)!r} * {c}"
_TYPES = {c: "DOUBLE" for c in ("f", "w", "g", "gain", "loss", "mid", "tr", "last", "cnt", "mean", "m2", "rsi")}
_STACK = [
    {"f": _E("p_f", "x_z", 12), "w": _E("p_w", "x_z", 26), "mid": _E("p_mid", "x_z", 20), "up": "greatest(x_z - p_last, 0)", "down": "greatest(p_last - x_z, 0)", "cnt": "p_cnt + 1", "last": "x_z",
     "tr": _E("p_tr", "greatest(x_high - x_low, abs(x_high - p_last), abs(x_low - p_last))", 14)},
    {"g": _E("p_g", "(f - w)", 9), "gain": f"CASE WHEN n = 2 THEN up ELSE {_E('p_gain', 'up', 14)} END", "loss": f"CASE WHEN n = 2 THEN down ELSE {_E('p_loss', 'down', 14)} END", "mean": "p_mean + (x_z - p_mean) / cnt"},
    {"m2": "p_m2 + (x_z - p_mean) * (x_z - mean)", "rsi": "CASE WHEN loss < 1e-10 THEN 100.0 ELSE 100 - 100 / (1 + gain / loss) END"},
]
_HALF = "(CASE WHEN n > 1 THEN 2 * sqrt(greatest(m2, 0) / (n - 1)) ELSE 0.0 END)"
_STACK_SRC = f"{RETURNS}, src AS (SELECT symbol, ts, close AS z, high, low FROM rets)"


@query("indicator_stack", staged(_STACK_SRC, _TYPES, {"f": "z", "w": "z", "g": "0", "gain": "0", "loss": "0", "mid": "z", "tr": "high - low", "last": "z", "cnt": "1", "mean": "z", "m2": "0", "rsi": "50"}, _STACK,
    ", ".join([_r("f - w", "macd"), _r("g", "macd_signal"), _r("f - w - g", "macd_histogram"), _r("rsi", "rsi"), _r(f"mid + {_HALF}", "bb_upper"), _r("mid", "bb_middle"), _r(f"mid - {_HALF}", "bb_lower"),
               _r(f"CASE WHEN 2 * {_HALF} < 1e-10 THEN 0.5 ELSE (last - mid + {_HALF}) / (2 * {_HALF}) END", "bb_position"), _r("tr", "atr")]), "z high low"))
def _stack(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", "close", "high", "low")
    out = re_.scan_all(b.withColumn("price", F.col("close")), [ad.indicator_stack(), re_.ema("price", 1.0, "price")])
    out = out.withColumn("bb_position", ad.position_in_bands(F.col("price"), F.col("bb_lower"), F.col("bb_upper"))).withColumnRenamed("stack_rsi", "rsi")
    return out.select("symbol", at(), *[tidy(c).alias(c) for c in ("macd", "macd_signal", "macd_histogram", "rsi", "bb_upper", "bb_middle", "bb_lower", "bb_position", "atr")])


_BAND = [
    {"mid": _E("p_mid", "x_z", 20), "cnt": "p_cnt + 1", "mean": "p_mean + (x_z - p_mean) / (p_cnt + 1)", "width": "exp(p_logit)"},
    {"m2": "p_m2 + (x_z - p_mean) * (x_z - mean)"}, {"sd": "sqrt(greatest(m2, 0) / (cnt - 1))"},
    {"logit": "least(ln(6.0), greatest(ln(0.5), p_logit + 0.05 * (CASE WHEN abs(x_z - mid) > width * sd THEN 1.0 ELSE 0.0 END - 0.05)))"},
]


@query("learned_bands", staged(_STACK_SRC, {c: "DOUBLE" for c in ("mid", "logit", "cnt", "mean", "m2", "sd", "width")}, {"mid": "z", "logit": "ln(2.0)", "cnt": "1", "mean": "z", "m2": "0", "sd": "0", "width": "2"}, _BAND,
    ", ".join([_r("mid + width * sd", "band_upper"), _r("mid", "band_middle"), _r("mid - width * sd", "band_lower"), _r("width", "band_multiplier")]), "z"))
def _bands(spark, sf):
    out = re_.scan(bars(spark, sf), ad.learned_bands())
    return out.select("symbol", at(), *[tidy(c).alias(c) for c in ("band_upper", "band_middle", "band_lower", "band_multiplier")])


@query("dsp_stack", f"""SELECT c.symbol, c.ts_us, mesa_macd AS macd, mesa_signal AS macd_signal, mesa_histogram AS macd_histogram, fisher_rsi AS rsi, upper AS bb_upper, middle AS bb_middle, lower AS bb_lower, smoothed_tr AS atr
FROM ({RECURSIONS['cycle_indicators']}) c JOIN ({RECURSIONS['oscillators']}) o USING (symbol, ts_us) JOIN ({RECURSIONS['keltner']}) k USING (symbol, ts_us)""" if "cycle_indicators" in RECURSIONS else None)
def _dsp(spark, sf):
    """The stack's low-lag forms under the same names."""
    b = ind.true_range(ind.simple_rsi(bars(spark, sf))).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("tr2", F.col("tr"))
    steps = [re_.mesa_macd(), re_.fisher(), re_.jma("typical", 20, name="middle"), re_.smoothed_tr(n=14)]
    band = re_.smoothed_tr("tr2", 20)
    out = re_.scan_all(b, [*steps, re_.Recurrence(band.step, band.inputs, ("band",))])
    wide = 2 * F.col("band")
    out = out.select("symbol", at(), tidy("mesa_macd").alias("macd"), tidy("mesa_signal").alias("macd_signal"), tidy("mesa_histogram").alias("macd_histogram"), tidy("fisher_rsi").alias("rsi"), tidy(F.col("middle") + wide).alias("bb_upper"), tidy("middle").alias("bb_middle"), tidy(F.col("middle") - wide).alias("bb_lower"), tidy("smoothed_tr").alias("atr"))
    return out


_W = (0.8, -0.5, 1.2, 0.3, 0.6, -0.4)


@query("stacking", f"""WITH {BARS}, x AS (
  SELECT symbol, ts, [(close - low) / (high - low + 1), least(1.0, trades / 20.0), least(1.0, volume / 1000)] AS b, [open / (open + close), 0.25] AS r FROM bars),
j AS (SELECT *, list_concat(b, r, [0.5]) AS v, list_avg(b) AS m FROM x)
SELECT symbol, epoch_us(ts) AS ts_us, round(1 / (1 + exp(-(0.1 + {' + '.join(f'v[{i + 1}] * {w}' for i, w in enumerate(_W))}))), 4) + 0.0 AS p, round(greatest(0.0, 1 - 2 * list_stddev_pop(b)), 4) + 0.0 AS agreement FROM j""")
def _stacking(spark, sf):
    b = bars(spark, sf)
    base = F.array((F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1), F.least(F.lit(1.0), F.col("trades") / 20), F.least(F.lit(1.0), F.col("volume") / 1000))
    raw = F.array(F.col("open") / (F.col("open") + F.col("close")), F.lit(0.25))
    out = b.select("symbol", "ts", ad.stacked(base, raw, list(_W), 0.1).alias("s"))
    return out.select("symbol", at(), tidy("s.p").alias("p"), tidy("s.agreement").alias("agreement"))


_P = "(close - low) / (high - low + 1)"


@query("prediction_stability", f"""WITH {BARS}, x AS (SELECT symbol, ts, {_P} AS p, [least(1.0, trades / 20.0), open / (open + close)] AS o FROM bars)
SELECT symbol, epoch_us(ts) AS ts_us, round(stddev_pop(p) OVER (PARTITION BY symbol ORDER BY ts ROWS 99 PRECEDING), 4) + 0.0 AS volatility, round(greatest(0.0, 1 - 2 * list_stddev_pop(list_concat([p], o))), 4) + 0.0 AS agreement FROM x""")
def _stability(spark, sf):
    """Deviation of a prediction over 100 bars, and its agreement with two others."""
    b = bars(spark, sf)
    x = b.select("symbol", "ts", ((F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1)).alias("p"), F.array(F.least(F.lit(1.0), F.col("trades") / 20), F.col("open") / (F.col("open") + F.col("close"))).alias("o"))
    out = fu.prediction_volatility(x, "p", ("ts",))
    return out.select("symbol", at(), tidy("volatility").alias("volatility"), tidy(fu.agreement_score(F.col("p"), F.col("o"))).alias("agreement"))


_P3 = "ufv"  # period, phase and power
_DJ = [
    {"miss": "CASE WHEN x_z <> 0 THEN (p_j - x_z) / x_z ELSE 0 END"},
    {c: f"least({hi}, greatest({lo}, p_{c} - 0.01 * CASE WHEN x_z <> 0 THEN least(1.0, greatest(-1.0, miss * p_dj{c} / x_z)) ELSE 0 END))" for c, lo, hi in (("u", "-2.0", "2.0"), ("f", "-100.0", "100.0"), ("v", "-1.0", "2.0"))},
    {"per": "greatest(2.0, 100 * exp(u))", "pw": "greatest(0.5, exp(v))", "lead": "f / 100 + 1.5"}, {"q": "0.45 * (per - 1)"}, {"be": "q / (q + 2)", "byn": "0.9 / pow(q + 2, 2) * CASE WHEN per > 2 THEN per ELSE 0 END"}, {"al": "pow(be, pw)"},
    {"dau": "pw * al / be * byn", "daf": "0.0", "dav": "al * ln(be) * CASE WHEN pw > 0.5 THEN pw ELSE 0 END", "dbu": "byn", "dbf": "0.0", "dbv": "0.0", "dlu": "0.0", "dlf": "0.01", "dlv": "0.0"},
    {"e0": "(1 - al) * x_z + al * p_e0"} | {f"d0{c}": f"da{c} * (p_e0 - x_z) + al * p_d0{c}" for c in _P3},
    {"e1": "(x_z - e0) * (1 - be) + be * p_e1"} | {f"d1{c}": f"db{c} * (p_e1 - x_z + e0) - d0{c} * (1 - be) + be * p_d1{c}" for c in _P3}, {"gap": "e0 + lead * e1 - p_j"},
    {"e2": "gap * pow(1 - al, 2) + al * al * p_e2"} | {f"d2{c}": f"(d0{c} + dl{c} * e1 + lead * d1{c} - p_dj{c}) * pow(1 - al, 2) - 2 * (1 - al) * da{c} * gap + 2 * al * da{c} * p_e2 + al * al * p_d2{c}" for c in _P3},
    {"j": "p_j + e2"} | {f"dj{c}": f"p_dj{c} + d2{c}" for c in _P3},
]
_DJ_TYPES = {c: "DOUBLE" for c in ("e0", "e1", "e2", "j", "u", "f", "v", "per", "pw", *(f"{d}{c}" for d in ("d0", "d1", "d2", "dj") for c in _P3))}
_DJ_FIRST = {c: "0" for c in _DJ_TYPES} | {c: "z" for c in ("e0", "e1", "e2", "j")} | {"u": "ln(0.2)", "v": "ln(2.0)", "per": "20", "pw": "2"}


@query("learned_jma", staged(_STACK_SRC, _DJ_TYPES, _DJ_FIRST, _DJ, ", ".join([_r("j", "learned_jma"), _r("per", "jma_period"), _r("f", "jma_phase"), _r("pw", "jma_power")]), "z"))
def _ljma(spark, sf):
    """Jurik average with learned period, phase and power."""
    out = re_.scan(bars(spark, sf), ad.learned_jma())
    return out.select("symbol", at(), *[tidy(c).alias(c) for c in ("learned_jma", "jma_period", "jma_phase", "jma_power")])


_DT = [
    {"size": "greatest(abs(x_tr) + abs(p_f1), 1e-9)"}, {"u": "CASE WHEN n < 3 THEN p_u ELSE least(2.0, greatest(-1.0, p_u - 0.05 * least(1.0, greatest(-1.0, (p_f1 - x_tr) / size * p_d1 / size)))) END"},
    {"per": "greatest(2.0, 14 * exp(u))"}, {"k": "1.414 * pi() / per"}, {"a": "exp(-k)", "turn": "CASE WHEN per > 2 THEN k ELSE 0 END", "mean": "(x_tr + p_t) / 2"},
    {"c2": "2 * a * cos(k)", "c3": "-a * a", "s2": "2 * a * turn * (cos(k) + sin(k))", "s3": "-2 * a * a * turn"},
    {"f1": "CASE WHEN n < 3 THEN 0 ELSE (1 - c2 - c3) * mean + c2 * p_f1 + c3 * p_f2 END", "d1": "CASE WHEN n < 3 THEN 0 ELSE -(s2 + s3) * mean + s2 * p_f1 + c2 * p_d1 + s3 * p_f2 + c3 * p_d2 END", "f2": "p_f1", "d2": "p_d1", "t": "x_tr"},
]


@query("learned_range", staged(f"""{RETURNS}, d AS (SELECT symbol, ts, high, low, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM rets),
  src AS (SELECT symbol, ts, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM d)""", {c: "DOUBLE" for c in ("u", "per", "f1", "f2", "d1", "d2", "t")},
    {"u": "0", "per": "14", "f1": "0", "f2": "0", "d1": "0", "d2": "0", "t": "tr"}, _DT, ", ".join([_r("CASE WHEN n >= 3 THEN f1 END", "learned_tr"), _r("per", "tr_period")]), "tr"))
def _lrange(spark, sf):
    """Smoothed true range with a learned period."""
    out = re_.scan(ind.true_range(bars(spark, sf)), ad.learned_tr())
    return out.select("symbol", at(), tidy("learned_tr").alias("learned_tr"), tidy("tr_period").alias("tr_period"))
