"""Queries of the learning recurrences."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import at, over, tidy
from tidemark.operators import adaptive as ad, features as fe, learning as le, recursive as re_
from tidemark.operators.statistics import log_return
from tidemark.plans.collect import collector
from tidemark.plans.market import _gauss, _ramp, _wma
from tidemark.plans.recursions import RETURNS, _r, recursion, staged
from tidemark.sources.fixtures import BARS, BOOKS, TICKS, bars, books, snapshots, ticks

QUERIES, ORACLES, query = collector()


def _b(spark, sf):
    b = log_return(bars(spark, sf)).withColumn("ret", F.col("ret") / 100)
    up = F.coalesce((F.lead("close").over(over()) > F.col("close")).cast("double"), F.lit(0.0))
    pa = (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1)
    return b.select("*", up.alias("up"), pa.alias("pa"), F.least(F.lit(1.0), F.col("volume") / 1000).alias("pb"))


def _out(df, *names):
    return df.select("symbol", at(), *[tidy(n).alias(n) for n in names])


def _dens(x: str, m: str, d: str) -> str:
    return f"(exp(-0.5 * pow(({x} - {m}) / {d}, 2)) / ({d} * sqrt(2 * pi())))"


_LN, _AD = le.LEARNING, le.STICKY
_LR = [
    {f"j{j}": f"({' + '.join(f'p_a{i} * {_AD[i][j]}' for i in range(3))}) * greatest({_dens('x_ret', f'p_am{j}', f'p_as{j}')}, 1e-10)" for j in range(3)}
    | {f"t{i}{j}": f"(p_l{i} + ln({_LN[i][j]}))" for i in range(3) for j in range(3)} | {"seen": "list_concat(p_seen, [x_ret])[-200:]", "cnt": "p_cnt + 1"},
    {f"a{j}": f"CASE WHEN j0 + j1 + j2 > 1e-10 THEN j{j} / (j0 + j1 + j2) ELSE 1.0 / 3 END" for j in range(3)} | {f"g{j}": f"greatest(t0{j}, t1{j}, t2{j})" for j in range(3)}
    | {"refit": "cnt % 50 = 0 AND len(seen) >= 200", "sorted": "CASE WHEN cnt % 50 = 0 AND len(seen) >= 200 THEN list_sort(seen) END"},
    {"st": "CASE WHEN a0 >= a1 AND a0 >= a2 THEN 0 WHEN a1 >= a2 THEN 1 ELSE 2 END"} | {f"u{j}": f"g{j} + ln(exp(t0{j} - g{j}) + exp(t1{j} - g{j}) + exp(t2{j} - g{j})) - 0.5 * pow((x_ret - p_lm{j}) / p_ls{j}, 2) - ln(p_ls{j}) - 0.5 * ln(2 * pi())" for j in range(3)}
    | {f"part{j}": ("sorted[121:200]", "sorted[1:80]", "sorted[81:120]")[j] for j in range(3)},
    {"changes": "p_changes + (st <> p_st)::INT", "top": "greatest(u0, u1, u2)"} | {f"am{j}": f"CASE WHEN refit THEN list_avg(part{j}) ELSE p_am{j} END" for j in range(3)} | {f"as{j}": f"CASE WHEN refit THEN greatest(list_stddev_pop(part{j}), 0.001) ELSE p_as{j} END" for j in range(3)},
    {f"l{j}": f"u{j} - (top + ln(exp(u0 - top) + exp(u1 - top) + exp(u2 - top)))" for j in range(3)},
    {f"q{j}": f"exp(l{j}) / (exp(l0) + exp(l1) + exp(l2))" for j in range(3)},
    {f"lm{j}": f"(1 - 0.01 * q{j}) * p_lm{j} + 0.01 * q{j} * x_ret" for j in range(3)},
    {f"ls{j}": f"sqrt(greatest((1 - 0.01 * q{j}) * p_ls{j} * p_ls{j} + 0.01 * q{j} * (x_ret - lm{j}) * (x_ret - lm{j}), 1e-6))" for j in range(3)},
]
_LTYPES = {f"{c}{j}": "DOUBLE" for c in ("a", "am", "as", "l", "lm", "ls", "q") for j in range(3)} | {"st": "DOUBLE", "changes": "DOUBLE", "cnt": "BIGINT", "seen": "DOUBLE[]"}


def _from_before(expression: str) -> str:
    """A step's expression on the constants that hold before the first row."""
    before = {f"p_a{i}": "(1.0 / 3)" for i in range(3)} | {f"p_l{i}": "ln(1.0 / 3)" for i in range(3)}
    for j in range(3):
        before |= {f"p_am{j}": str(le.FIRST[0][j]), f"p_as{j}": str(le.FIRST[1][j]), f"p_lm{j}": str(le.LEARNING_FIRST[0][j]), f"p_ls{j}": str(le.LEARNING_FIRST[1][j])}
    before |= {"p_seen": "CAST([] AS DOUBLE[])", "p_cnt": "0", "p_changes": "0", "p_st": "st"}
    for name in sorted(before, key=len, reverse=True):
        expression = expression.replace(name, before[name])
    return expression


_LINNER = "SELECT symbol, ts, ret, ret AS x_ret FROM (SELECT symbol, ts, ret / 100 AS ret FROM rets)"
for _stage in _LR:
    _LINNER = f"SELECT *, {', '.join(f'{_from_before(e)} AS {c}' for c, e in _stage.items())} FROM ({_LINNER})"
_LSRC = f"{RETURNS}, src AS (SELECT symbol, ts, ret, {', '.join(f'{c} AS f_{c}' for c in _LTYPES)} FROM ({_LINNER}))"
_LSHOWN = [_r(f"a{j}", n) for j, n in enumerate(("a_bull", "a_bear", "a_range"))] + [_r("st", "a_state"), _r("greatest(a0, a1, a2)", "a_confidence"), _r("changes", "a_changes")]
_LSHOWN += [_r(f"q{j}", n) for j, n in enumerate(("l_bull", "l_bear", "l_range"))] + [_r("CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END", "l_state"), _r("(greatest(q0, q1, q2) - 1.0 / 3) / (2.0 / 3)", "l_stability")]
_LSHOWN += [_r(" + ".join(f"q{i} * {_LN[i][j]}" for i in range(3)), n) for j, n in enumerate(("l_next_bull", "l_next_bear", "l_next_range"))]


@query("learning_regimes", staged(_LSRC, _LTYPES, {c: f"f_{c}" for c in _LTYPES}, _LR, ", ".join(_LSHOWN), "ret"))
def _regimes(spark, sf):
    r = [le.adaptive_regimes(), le.learned_regimes()]
    return _out(re_.scan_all(_b(spark, sf), r), *[o for x in r for o in x.outputs])


@query("kernel_regression")
def _krls(spark, sf):
    r = le.kernel_regression(("pa", "pb"), "ret", most=60, adapt=0.01)
    return _out(re_.scan(_b(spark, sf), r), *r.outputs)


_MC = [
    {f"d{i}": f"(p_a{i} - x_a) * (p_a{i} - x_a) + (p_b{i} - x_b) * (p_b{i} - x_b)" for i in range(3)}, {"nearest": "CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END"},
    {f"{c}{i}": f"CASE WHEN nearest = {i} THEN p_{c}{i} + (x_{c} - p_{c}{i}) / (1 + p_c{i} * 0.01) ELSE p_{c}{i} END" for i in range(3) for c in "ab"} | {f"c{i}": f"p_c{i} + (nearest = {i})::INT" for i in range(3)}
    | {"dist": "CASE nearest WHEN 0 THEN d0 WHEN 1 THEN d1 ELSE d2 END"},
]
_MCF = [(0.1, 0.1), (0.5, 0.2), (0.9, 0.5)]
_MCD = [f"((a - {x}) * (a - {x}) + (b - {y}) * (b - {y}))" for x, y in _MCF]
_MCAT = f"(CASE WHEN {_MCD[0]} <= {_MCD[1]} AND {_MCD[0]} <= {_MCD[2]} THEN 0 WHEN {_MCD[1]} <= {_MCD[2]} THEN 1 ELSE 2 END)"


@query("moving_centroids", staged(f"""{RETURNS}, src AS (SELECT symbol, ts, (close - low) / (high - low + 1) AS a, least(1.0, volume / 1000) AS b FROM rets)""",
    {f"{c}{i}": "DOUBLE" for c in "abc" for i in range(3)} | {"nearest": "DOUBLE", "dist": "DOUBLE"},
    {f"a{i}": f"CASE WHEN {_MCAT} = {i} THEN a ELSE {_MCF[i][0]} END" for i in range(3)} | {f"b{i}": f"CASE WHEN {_MCAT} = {i} THEN b ELSE {_MCF[i][1]} END" for i in range(3)} | {f"c{i}": f"({_MCAT} = {i})::INT" for i in range(3)}
    | {"nearest": _MCAT, "dist": f"least({_MCD[0]}, {_MCD[1]}, {_MCD[2]})"}, _MC, ", ".join([_r("nearest", "centroid"), _r("dist", "centroid_distance")]).replace("at,", "\"at\","), "a b").replace(" at ", ' "nearest" '))
def _centroids(spark, sf):
    r = le.moving_centroids(("pa", "pb"), "up", [[0.1, 0.1], [0.5, 0.2], [0.9, 0.5]], [0, 1, 0])
    return _out(re_.scan(_b(spark, sf), r), *r.outputs)


_L = lambda c: f"ln(greatest(0.01, least(0.99, {c})) / (1 - greatest(0.01, least(0.99, {c}))))"
_SRC = f"""{RETURNS}, src AS (
  SELECT symbol, ts, (close - low) / (high - low + 1) AS a, least(1.0, volume / 1000) AS b, coalesce((lead(close) OVER (PARTITION BY symbol ORDER BY ts) > close)::INT, 0) AS up FROM rets)"""
_FIRST = f"(1 / (1 + exp(-({_L('a')} + {_L('b')}))))"
_NEXT = f"(1 / (1 + exp(-(p.wa * {_L('x.a')} + p.wb * {_L('x.b')} + p.c))))"
_CLIP = lambda e, m: f"greatest(-{m}, least({m}, {e}))"


@query("learned_ensemble", recursion(_SRC, {
    "o": _FIRST, "e": f"{_FIRST} - up", "wa": _CLIP(f"1 - 0.01 * ({_FIRST} - up) * a", 5), "wb": _CLIP(f"1 - 0.01 * ({_FIRST} - up) * b", 5), "c": _CLIP(f"-0.01 * ({_FIRST} - up)", 2)}, {
    "o": _NEXT, "e": f"{_NEXT} - x.up", "wa": _CLIP(f"p.wa - 0.01 * ({_NEXT} - x.up) * x.a", 5), "wb": _CLIP(f"p.wb - 0.01 * ({_NEXT} - x.up) * x.b", 5), "c": _CLIP(f"p.c - 0.01 * ({_NEXT} - x.up)", 2)},
    {"pooled": "o", "pooled_error": "e"}))
def _ensemble(spark, sf):
    return _out(re_.scan(_b(spark, sf), le.learned_ensemble(("pa", "pb"), "up")), "pooled", "pooled_error")


_OLD = [f"(CASE WHEN p_m{i} * 0.9 >= 0.001 THEN p_m{i} * 0.9 ELSE 0.0 END)" for i in range(1, 7)]
_CELL = lambda k: " + ".join(f"o{i} * n{j}" for i in range(1, 8) for j in (1, 2, 7) if i & j == k) or "0.0"
_EVID = [
    {f"o{i}": _OLD[i - 1] for i in range(1, 7)} | {"n1": "x_a", "n2": "x_b", "n7": "greatest(0.0, 1 - x_a - x_b)"}, {"o7": "1 - (o1 + o2 + o3 + o4 + o5 + o6)"}, {f"c{k}": _CELL(k) for k in range(8)},
    {f"m{k}": f"CASE WHEN c0 < 1 - 1e-12 THEN c{k} / (1 - c0) ELSE {1.0 if k == 7 else 0.0} END" for k in range(1, 8)} | {"conflict": "c0"},
]


@query("fading_evidence", staged(f"""{RETURNS}, src AS (SELECT symbol, ts, (close - low) / (high - low + 1) * 0.6 AS a, (1 - (close - low) / (high - low + 1)) * 0.3 AS b FROM rets)""",
    {f"m{k}": "DOUBLE" for k in range(1, 8)} | {"conflict": "DOUBLE"}, {f"m{k}": "0" for k in range(3, 7)} | {"m1": "a", "m2": "b", "m7": "greatest(0.0, 1 - a - b)", "conflict": "0"}, _EVID,
    ", ".join([_r("m1", "bel_bull"), _r("m2", "bel_bear"), _r("conflict", "evidence_conflict")]), "a b"))
def _evidence(spark, sf):
    b = _b(spark, sf).select("symbol", "ts", (F.col("pa") * 0.6).alias("bull"), ((1 - F.col("pa")) * 0.3).alias("bear"))
    r = le.fading_evidence("bull", "bear")
    return _out(re_.scan(b, r), *r.outputs)


@query("ensemble_importances", ORACLES["learned_ensemble"].rsplit("SELECT", 1)[0] + "SELECT symbol, epoch_us(ts) AS ts_us, round(CASE WHEN abs(wa) + abs(wb) < 1e-10 THEN 0.5 ELSE abs(wa) / (abs(wa) + abs(wb)) END, 4) + 0.0 AS share_a, round(CASE WHEN abs(wa) + abs(wb) < 1e-10 THEN 0.5 ELSE abs(wb) / (abs(wa) + abs(wb)) END, 4) + 0.0 AS share_b FROM r")
def _importance(spark, sf):
    """Each model's share of the weights after the row."""
    out = re_.scan(_b(spark, sf), le.ensemble_weights(("pa", "pb"), "up"))
    shares = ad.importances([F.col("weight_1"), F.col("weight_2")])
    return out.select("symbol", at(), tidy(shares[0]).alias("share_a"), tidy(shares[1]).alias("share_b"))


@query("learnable_ema", recursion(f"{RETURNS}, src AS (SELECT symbol, ts, ret / 100 AS z FROM rets)", {"y": "z", "l": "ln((2.0 / 21) / (1 - 2.0 / 21))", "al": "2.0 / 21"}, {
    "y": "p.y + 1 / (1 + exp(-p.l)) * (x.z - p.y)", "l": "greatest(-4.0, least(4.0, p.l + 0.01 * (x.z - p.y) * (x.z - p.y) * 1 / (1 + exp(-p.l)) * (1 - 1 / (1 + exp(-p.l)))))", "al": "1 / (1 + exp(-p.l))"},
    {"learned_ema": "y", "learned_alpha": "al"}))
def _ema(spark, sf):
    return _out(re_.scan(_b(spark, sf), le.learnable_ema("ret")), "learned_ema", "learned_alpha")


def _vectors(spark, sf):
    """All slots of each bar, with the order flow of its trades and books."""
    book = books(spark, sf).join(snapshots(spark, sf), "book_id")
    return fe.with_flow(fe.assemble(bars(spark, sf), "click"), fe.flow_slots(ticks(spark, sf), book))


@query("feature_vector")
def _features(spark, sf):
    """All 60 slots of each bar; those that windows make are held against SQL by ``feature_windows``."""
    return _out(_vectors(spark, sf), *fe.SLOTS)


_REL = lambda e: f"CASE WHEN close <> 0 THEN tanh(({e} - close) / close * 10) ELSE 0.0 END"


@query("feature_windows", f"""WITH {BARS}, {TICKS}, {BOOKS},
r AS (SELECT *, coalesce(ln(close / lag(close) OVER w), 0) AS ret, CASE WHEN high > low THEN volume * (2 * (close - low) - (high - low)) / (high - low) ELSE 0.0 END AS delta,
  CASE WHEN high > low THEN 2 * (close - low) / (high - low) - 1 ELSE 0.0 END AS pressure, row_number() OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
h AS (SELECT *, 2 * {_wma('close', _ramp(10), 'w')} - {_wma('close', _ramp(21), 'w')} AS h21, {_wma('close', _gauss, 'w')} AS alma FROM r WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
x AS (
  SELECT *, {_wma('h21', _ramp(4), 'w')} AS hma, sum(delta) OVER u AS cvd, CASE WHEN count(*) OVER v = 14 THEN CASE WHEN max(high) OVER v <> min(low) OVER v THEN -100 * (max(high) OVER v - close) / (max(high) OVER v - min(low) OVER v) ELSE -50.0 END END AS wr,
    CASE WHEN count(*) OVER m >= 2 AND stddev_samp(volume) OVER m > 1e-10 THEN (volume - avg(volume) OVER m) / stddev_samp(volume) OVER m ELSE 0.0 END AS rz
  FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts), u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING),
    m AS (PARTITION BY symbol, hour(ts) * 60 + minute(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING)),
pos AS (SELECT a.symbol, a.ts, count(*) FILTER (b.close <= a.close) / count(*) AS pos FROM r a JOIN r b ON a.symbol = b.symbol AND b.n <= a.n GROUP BY 1, 2),
bt AS (SELECT a.symbol, a.ts, a.ret AS y, b.ret AS x FROM r a JOIN r b ON b.symbol = 'click' AND b.ts = a.ts),
co AS (SELECT symbol, ts, CASE WHEN stddev_pop(x) OVER w > 1e-12 AND stddev_pop(y) OVER w > 1e-12 THEN greatest(-1.0, least(1.0, corr(x, y) OVER w)) ELSE 0.0 END AS corr FROM bt WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
tc AS (SELECT symbol, ts, event_id, is_buyer_maker, quantity, CASE WHEN is_buyer_maker THEN -quantity ELSE quantity END AS net FROM ticks),
tr AS (SELECT symbol, ts, event_id, abs(sum(net) OVER v) / sum(quantity) OVER v AS vpin, avg((NOT is_buyer_maker)::INT) OVER u AS aggr
  FROM tc WINDOW u AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY symbol ORDER BY ts, event_id ROWS 49 PRECEDING)),
tb AS (SELECT symbol, date_trunc('hour', ts) AS ts, arg_max(vpin, (ts, event_id)) AS vpin, arg_max(aggr, (ts, event_id)) AS aggr FROM tr GROUP BY 1, 2),
bk AS (SELECT book_id, coalesce(sum(qty) FILTER (side = 'O' AND lvl <= 5), 0) AS b, coalesce(sum(qty) FILTER (side = 'F' AND lvl <= 5), 0) AS a FROM ranked GROUP BY book_id),
sn AS (SELECT book_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(book_id % 5 + 1 AS INT)] AS symbol, TIMESTAMP '2024-01-01' + to_hours(CAST(book_id // 5 % 720 AS INT)) AS ts, CASE WHEN a + b > 0 THEN (b - a) / (b + a) ELSE 0.0 END AS obi FROM bk),
sb AS (SELECT symbol, ts, arg_max(obi, book_id) AS obi FROM sn GROUP BY 1, 2)
SELECT x.symbol, epoch_us(x.ts) AS ts_us, round(coalesce({_REL('hma')}, 0), 4) + 0.0 AS hma_value, round(coalesce({_REL('alma')}, 0.5), 4) + 0.0 AS alma_trend_quality, round(coalesce((wr + 50) / 50, 0.5), 4) + 0.0 AS williams_r,
  round(tanh(delta / (volume + 1)), 4) + 0.0 AS volume_delta, round(tanh(cvd / 1e6), 4) + 0.0 AS cvd_normalized, round(tanh(rz / 3), 4) + 0.0 AS rvol_zscore, round(pressure, 4) + 0.0 AS obi_imbalance,
  (tanh(rz / 3) > 0.5)::INT::DOUBLE AS volume_breakout_score, round(greatest(0, pressure), 4) + 0.0 AS buying_pressure, round(greatest(0, -pressure), 4) + 0.0 AS selling_pressure, round(2 * pos - 1, 4) + 0.0 AS price_percentile,
  round(coalesce(corr, 0), 4) + 0.0 AS correlation_btc, round(coalesce(abs(corr), 0), 4) + 0.0 AS correlation_strength, round(coalesce(vpin, 0), 4) + 0.0 AS flow_vpin, round(coalesce(aggr, 0.5), 4) + 0.0 AS flow_aggressive_ratio, round(coalesce(obi, 0), 4) + 0.0 AS flow_obi_current
FROM x JOIN pos USING (symbol, ts) LEFT JOIN co USING (symbol, ts) LEFT JOIN tb USING (symbol, ts) LEFT JOIN sb USING (symbol, ts)""")
def _windows(spark, sf):
    """The slots of the feature vector that no recursion feeds."""
    return _out(_vectors(spark, sf), *_WINDOWED)


_WINDOWED = (
    "hma_value", "alma_trend_quality", "williams_r", "volume_delta", "cvd_normalized", "rvol_zscore", "obi_imbalance", "volume_breakout_score", "buying_pressure", "selling_pressure", "price_percentile",
    "correlation_btc", "correlation_strength", "flow_vpin", "flow_aggressive_ratio", "flow_obi_current",
)


@query("feature_report")
def _report(spark, sf):
    """Summary and faults of the vectors."""
    r = fe.vector_report(_vectors(spark, sf))
    return r.select("symbol", at(), "nonzero", *[tidy(c).alias(c) for c in ("mean", "std", "least", "most")], "faults")


@query("normalise_price", f"""WITH {BARS} SELECT symbol, epoch_us(ts) AS ts_us, round(CASE WHEN close <> 0 THEN tanh((open - close) / close * 10) ELSE 0.0 END, 4) + 0.0 AS relative FROM bars""")
def _normalised(spark, sf):
    """The open relative to the close."""
    b = bars(spark, sf)
    return b.select("symbol", at(), tidy(fe.relative(F.col("open"), F.col("close"))).alias("relative"))
