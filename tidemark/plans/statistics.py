"""Queries of the statistics and bar-quality operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.columns import normal_sql, tidy
from tidemark.plans.collect import collector
from tidemark.operators import bars as quality, stationarity as st_, statistics as st
from tidemark.sources.fixtures import BARS, TICKS, bars, ticks

RETURNS = f"""{BARS},
rets AS (
  SELECT *, coalesce(ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)), 0.0) AS ret FROM bars)"""

QUERIES, ORACLES, query = collector()


@query("bars", f"WITH {BARS} SELECT symbol, epoch_us(ts) AS ts_us, open, high, low, close, round(volume, 4) + 0.0 AS volume, trades FROM bars")
def _bars(spark, sf):
    return bars(spark, sf).select("symbol", F.unix_micros("ts").alias("ts_us"), "open", "high", "low", "close", tidy("volume").alias("volume"), "trades")


_Z = "CASE WHEN count({x}) OVER w >= {n} AND stddev_samp({x}) OVER w > 1e-10 THEN ({x} - avg({x}) OVER w) / stddev_samp({x}) OVER w ELSE 0.0 END"


@query("welford_running", f"""WITH {RETURNS}
SELECT symbol, epoch_us(ts) AS ts_us, count(ret) OVER w AS n,
  CASE WHEN count(ret) OVER w >= 20 THEN round(avg(ret) OVER w, 4) + 0.0 END AS mean,
  CASE WHEN count(ret) OVER w >= 20 THEN round(coalesce(var_samp(ret) OVER w, 0), 4) + 0.0 END AS var_samp,
  CASE WHEN count(ret) OVER w >= 20 THEN round(var_pop(ret) OVER w, 4) + 0.0 END AS var_pop,
  CASE WHEN count(ret) OVER w >= 20 THEN round({_Z.format(x='ret', n=2)}, 4) + 0.0 END AS z
FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _running(spark, sf):
    out = st.running_moments(st.log_return(bars(spark, sf)), "ret", 20)
    return out.select("symbol", F.unix_micros("ts").alias("ts_us"), "n", *[tidy(c).alias(c) for c in ("mean", "var_samp", "var_pop", "z")])


@query("welford_sliding", f"""WITH {BARS}
SELECT symbol, epoch_us(ts) AS ts_us, count(close) OVER w AS n, round(avg(close) OVER w, 4) + 0.0 AS mean,
  round(coalesce(var_samp(close) OVER w, 0), 4) + 0.0 AS var_samp, round(var_pop(close) OVER w, 4) + 0.0 AS var_pop
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)""")
def _sliding(spark, sf):
    out = st.sliding_moments(bars(spark, sf), "close", 50)
    return out.select("symbol", F.unix_micros("ts").alias("ts_us"), "n", *[tidy(c).alias(c) for c in ("mean", "var_samp", "var_pop")])


@query("covariance_running", f"""WITH {BARS},
m AS (
  SELECT symbol, ts, covar_samp(volume, close) OVER w AS cs, covar_pop(volume, close) OVER w AS cp, corr(volume, close) OVER w AS c,
    var_pop(volume) OVER w AS vx, var_pop(close) OVER w AS vy, avg(volume) OVER w AS mx, avg(close) OVER w AS my
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
k AS (
  SELECT *, CASE WHEN sqrt(vx) > 1e-12 AND sqrt(vy) > 1e-12 THEN greatest(-1.0, least(1.0, c)) ELSE 0.0 END AS co,
    CASE WHEN vx <> 0 THEN cp / vx ELSE 0.0 END AS be FROM m)
SELECT symbol, epoch_us(ts) AS ts_us, round(coalesce(cs, 0), 4) + 0.0 AS cov_samp, round(cp, 4) + 0.0 AS cov_pop, round(co, 4) + 0.0 AS corr,
  round(be, 4) + 0.0 AS beta, round(my - be * mx, 4) + 0.0 AS alpha, round(co * co, 4) + 0.0 AS r2,
  CASE WHEN co > 0.7 THEN 'strong_positive' WHEN co > 0.3 THEN 'moderate_positive' WHEN co > -0.3 THEN 'uncorrelated'
       WHEN co > -0.7 THEN 'moderate_negative' ELSE 'strong_negative' END AS regime
FROM k""")
def _relation(spark, sf):
    out = st.running_relation(bars(spark, sf), "volume", "close")
    return out.select("symbol", F.unix_micros("ts").alias("ts_us"), *[tidy(c).alias(c) for c in ("cov_samp", "cov_pop", "corr", "beta", "alpha", "r2")], "regime")


@query("correlation_matrix", f"""WITH {RETURNS},
p AS (
  SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, round(corr(x.ret, y.ret), 4) + 0.0 AS corr
  FROM rets x JOIN rets y ON x.ts = y.ts AND x.symbol < y.symbol GROUP BY 1, 2)
SELECT a, b, n, corr FROM p UNION ALL SELECT b, a, n, corr FROM p
UNION ALL SELECT symbol, symbol, count(*), 1.0 FROM rets GROUP BY symbol""")
def _matrix(spark, sf):
    return st.correlation_matrix(st.log_return(bars(spark, sf)), "ret").select("a", "b", "n", tidy("corr").alias("corr"))


@query("quantiles", """WITH q AS (
  SELECT event_type AS symbol, quantile_cont(value, [0.05, 0.15, 0.25, 0.5, 0.75, 0.85, 0.95]) AS p, min(value) AS least, max(value) AS most
  FROM events GROUP BY 1)
SELECT symbol, round(p[1], 4) + 0.0 AS p5, round(p[3], 4) + 0.0 AS p25, round(p[4], 4) + 0.0 AS median, round(p[5], 4) + 0.0 AS p75,
  round(p[7], 4) + 0.0 AS p95, round(p[2], 4) + 0.0 AS area_low, round(p[6], 4) + 0.0 AS area_high,
  round((p[5] - p[3]) / 1.35, 4) + 0.0 AS mad, round(p[4], 4) + 0.0 AS point_of_control, least, most FROM q""")
def _quantiles(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), "value")
    out = st.quantile_summary(e, "value", exact=True)
    names = [c for c in out.columns if c not in ("symbol", "least", "most")]
    return out.select("symbol", *[tidy(c).alias(c) for c in names], "least", "most")


@query("volume_profile", f"""WITH {TICKS},
l AS (SELECT symbol, price, sum(quantity) AS v FROM ticks GROUP BY 1, 2),
u AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY price) AS upto, sum(v) OVER (PARTITION BY symbol) AS total FROM l)
SELECT symbol, min(price) FILTER (upto >= 0.15 * total) AS area_low, min(price) FILTER (upto >= 0.5 * total) AS control,
  min(price) FILTER (upto >= 0.85 * total) AS area_high FROM u GROUP BY symbol""")
def _profile(spark, sf):
    return st.volume_nodes(ticks(spark, sf), "price", "quantity")


@query("high_volume_nodes", f"""WITH {TICKS},
l AS (SELECT symbol, price, sum(quantity) AS v FROM ticks GROUP BY 1, 2),
u AS (SELECT *, sum(v) OVER (PARTITION BY symbol ORDER BY price) AS upto, sum(v) OVER (PARTITION BY symbol) AS total FROM l),
n(node, place, share) AS (VALUES (0, 0.15, 0.15), (1, 0.5, 0.35), (2, 0.85, 0.15))
SELECT symbol, node, min(price) FILTER (upto >= place * total) AS price, any_value(share)::DOUBLE AS share FROM u, n GROUP BY symbol, node""")
def _nodes(spark, sf):
    return st.high_volume_nodes(st.volume_nodes(ticks(spark, sf), "price", "quantity"))


_MOM = ", ".join(f"close / lag(close, {h}) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS m{h}" for h in st.HORIZONS)
_MOMZ = ", ".join(
    f"CASE WHEN m{h} IS NOT NULL THEN round({_Z.format(x=f'm{h}', n=min(20, h))}, 4) + 0.0 END AS mom_{h}_z, round(m{h}, 4) + 0.0 AS mom_{h}" for h in st.HORIZONS
)


@query("momentum_composite", f"""WITH {BARS}, m AS (SELECT symbol, ts, {_MOM} FROM bars),
k AS (SELECT *, list_filter([m5, m10, m21, m63], lambda x: x IS NOT NULL) AS kn FROM m)
SELECT symbol, epoch_us(ts) AS ts_us, {_MOMZ},
  CASE WHEN len(kn) >= 2 THEN round(len(list_filter(kn, lambda x: sign(x) = sign(kn[-1]))) / len(kn), 4) + 0.0 END AS alignment,
  CASE WHEN len(kn) >= 2 THEN round(kn[1] - kn[-1], 4) + 0.0 END AS divergence,
  CASE WHEN len(kn) >= 2 THEN round(list_sum(list_transform(kn, lambda x: abs(x))) / len(kn), 4) + 0.0 END AS strength
FROM k WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _momentum(spark, sf):
    out = st.momentum_features(st.horizon_momentum(bars(spark, sf)))
    names = [f"mom_{h}{s}" for h in st.HORIZONS for s in ("", "_z")] + ["alignment", "divergence", "strength"]
    return out.select("symbol", F.unix_micros("ts").alias("ts_us"), *[tidy(c).alias(c) for c in names])


@query("normalise_bars", """WITH raw AS (
  SELECT c_name AS s, CASE WHEN c_custkey % 3 = 0 THEN 'xbt/' WHEN c_custkey % 3 = 1 THEN 'XXBT-' ELSE 'XETH/' END || 'usdt' AS symbol_raw,
    CASE WHEN c_custkey % 2 = 0 THEN CAST(c_acctbal AS VARCHAR) END AS close_raw, c_acctbal AS price, c_custkey AS k FROM customer),
n AS (
  SELECT k, replace(replace(upper(symbol_raw), '/', ''), '-', '') AS s1, coalesce(TRY_CAST(close_raw AS DOUBLE), price, 0.0) AS close FROM raw),
m AS (
  SELECT k, close, CASE WHEN starts_with(s1, 'XBT') THEN 'BTC' || substr(s1, 4) WHEN starts_with(s1, 'XXBT') THEN 'BTC' || substr(s1, 5)
    WHEN starts_with(s1, 'XETH') THEN 'ETH' || substr(s1, 5) ELSE s1 END AS symbol FROM n)
SELECT k, symbol, round(close, 4) + 0.0 AS close FROM m WHERE close > 0""")
def _normalise(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    raw = c.select(
        F.col("c_custkey").alias("k"),
        F.concat(F.when(F.col("c_custkey") % 3 == 0, "xbt/").when(F.col("c_custkey") % 3 == 1, "XXBT-").otherwise("XETH/"), F.lit("usdt")).alias("symbol"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal").cast("string")).alias("close"),
        F.col("c_acctbal").alias("price"),
        F.lit(0.0).alias("volume"),
        F.lit(1).cast("long").alias("timestamp"),
        F.lit("x").alias("exchange"),
    )
    return quality.normalise(raw).select("k", "symbol", tidy("close").alias("close"))


@query("bar_quality_level1", f"""WITH {BARS}, b AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS prev FROM bars)
SELECT symbol, count(*) AS n, count(*) FILTER (close IS NULL OR open IS NULL OR high IS NULL OR low IS NULL OR volume IS NULL) AS nulls,
  count(*) FILTER (high < low) AS high_below_low, count(*) FILTER (high < open OR high < close) AS high_below, count(*) FILTER (low > open OR low > close) AS low_above,
  count(*) - count(DISTINCT ts) AS duplicate_ts, count(*) FILTER (volume < 0) AS negative_volume,
  count(*) FILTER (open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS non_positive, count(*) FILTER (abs(close / prev - 1) > 10) AS jumps,
  CAST(0 AS BIGINT) AS out_of_order, count(*) FILTER (abs(close / prev - 1) > 10) = 0 AS passed
FROM b GROUP BY symbol""")
def _level1(spark, sf):
    return quality.level1(bars(spark, sf).withColumn("seq", F.unix_micros("ts")))


def _solved(name: str, n: int, last: int) -> str:
    """Elimination of the matrices m (n x n) of table ``name``, column after column up to ``last``: k columns are done."""
    row, col = f"m[(q // {n}) * {n} + k + 1]", f"m[k * {n} + q % {n} + 1]"
    pivot = f"m[k * {n} + k + 1]"
    return f"""{name}e AS (SELECT *, 0 AS k FROM {name} UNION ALL
  SELECT * EXCLUDE (m, k), CASE WHEN {pivot} > 1e-300 THEN list_transform(range({n * n}), lambda q: m[q + 1] - {row} * {col} / {pivot}) ELSE m END AS m, k + 1 AS k FROM {name}e WHERE k <= {last})"""


def _tests_sql(most: int = 10) -> str:
    n = most + 3
    e = lambda i, j, size=n: f"m[{i * size + j + 1}]"
    sums = lambda size: ", ".join(f"sum(v[{i + 1}] * v[{j + 1}])" for i in range(size) for j in range(size))
    lx, dy = most + 1, most + 2
    ssr = f"({e(dy, dy)} - {e(lx, dy)} * {e(lx, dy)} / {e(lx, lx)})"
    p = lambda c: " + ".join(f"{a!r} * pow(t, {i})" for i, a in enumerate(c))
    half = " + ".join(f"pow(lm / 2, {k}) / {math.factorial(k)}" for k in range(most // 2))
    return f"""
zr AS (SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) AS r FROM bars),
zl AS (SELECT symbol, r, [{', '.join(f'lag(r, {i}) OVER w' for i in range(1, most + 2))}] AS l, [{', '.join(f'lag(r * r, {i}) OVER w' for i in range(1, most + 1))}] AS q FROM zr WHERE r IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
zc AS (SELECT symbol, len(list_filter(l, lambda x: x IS NOT NULL)) AS known, [1.0::DOUBLE, {', '.join(f'coalesce(l[{i}] - l[{i + 1}], 0)' for i in range(1, most + 1))}, coalesce(l[1], 0), coalesce(r - l[1], 0)] AS v FROM zl),
zs AS (SELECT symbol, v, unnest(range(known)) AS lags FROM zc),
za AS (SELECT symbol, lags, count(*) AS rows, [{sums(n)}] AS m FROM zs GROUP BY 1, 2),
{_solved('za', n, most)},
zf AS (SELECT symbol, lags AS sample, k - 1 AS lags, rows * ln({ssr} / rows) + 2 * (k + 1) AS aic, {e(lx, dy)} / {e(lx, lx)} / sqrt({ssr} / (rows - k - 1) / {e(lx, lx)}) AS t FROM zae WHERE k > 0 AND {e(lx, lx)} > 1e-300 AND {ssr} > 0 AND rows > k + 1),
zb AS (SELECT symbol, arg_min(lags, (aic, lags)) AS lags FROM zf WHERE sample = {most} GROUP BY symbol),
zt AS (SELECT symbol, zb.lags AS adf_lags, t FROM zb JOIN zf USING (symbol, lags) WHERE zf.sample = zb.lags),
zp AS (SELECT symbol, adf_lags, t AS adf_statistic, CASE WHEN t > {st_.TAU_MOST} THEN 1.0 WHEN t < {st_.TAU_LEAST} THEN 0.0 WHEN t <= {st_.TAU_MIDDLE} THEN {normal_sql('(' + p(st_.TAU_SMALL) + ')')} ELSE {normal_sql('(' + p(st_.TAU_LARGE) + ')')} END AS adf_p FROM zt),
zq AS (SELECT symbol, list_concat(list_concat([1.0::DOUBLE], q), [r * r]) AS v FROM zl WHERE q[{most}] IS NOT NULL),
zh AS (SELECT symbol, count(*) AS rows, [{sums(most + 2)}] AS m FROM zq GROUP BY 1),
{_solved('zh', most + 2, most)},
zm AS (SELECT a.symbol, a.rows * (1 - b.m[{(most + 2) ** 2}] / a.m[{(most + 2) ** 2}]) AS lm FROM zhe a JOIN zhe b ON a.symbol = b.symbol AND a.k = 1 AND b.k = {most + 1} AND a.m[{(most + 2) ** 2}] > 0),
zz AS (SELECT symbol, adf_lags, adf_statistic, adf_p, lm AS arch_lm, exp(-lm / 2) * ({half}) AS arch_p FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN zp USING (symbol) LEFT JOIN zm USING (symbol))"""


_TESTS = ("adf_statistic", "adf_p", "arch_lm", "arch_p")


@query("bar_quality_level2", f"""WITH RECURSIVE {RETURNS}, {_tests_sql()},
r AS (
  SELECT symbol, ts, ret, lag(ret, 1) OVER w AS r1, lag(ret, 5) OVER w AS r5, epoch(ts) - lag(epoch(ts)) OVER w AS gap
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
f AS (SELECT symbol, mode(gap) AS step FROM r GROUP BY symbol),
m AS (SELECT symbol, avg(ret) AS mu, stddev_pop(ret) AS sd FROM r GROUP BY symbol)
SELECT r.symbol, count(*) AS n, round(avg(((ret - mu) / sd) ** 3), 4) + 0.0 AS skew, round(avg(((ret - mu) / sd) ** 4) - 3, 4) + 0.0 AS kurtosis,
  round(corr(ret, r1), 4) + 0.0 AS auto1, round(corr(ret, r5), 4) + 0.0 AS auto5,
  round(count(*) FILTER (gap > step) / count(gap), 4) + 0.0 AS gap_ratio, round(avg(ret) / stddev_samp(ret) * sqrt(525600), 4) + 0.0 AS sharpe,
  any_value(adf_lags)::INT AS adf_lags, {', '.join(f'round(any_value({c}), 4) + 0.0 AS {c}' for c in _TESTS)}
FROM r JOIN f USING (symbol) JOIN m USING (symbol) JOIN zz USING (symbol) GROUP BY r.symbol""")
def _level2(spark, sf):
    """Shape of returns with the Dickey-Fuller and ARCH-LM tests."""
    b = bars(spark, sf)
    out = quality.level2(st.log_return(b)).join(quality.level2_tests(b), "symbol")
    return out.select("symbol", "n", *[tidy(c).alias(c) for c in ("skew", "kurtosis", "auto1", "auto5", "gap_ratio", "sharpe")], "adf_lags", *[tidy(c).alias(c) for c in _TESTS])


@query("bar_quality_full", f"""WITH a AS ({ORACLES['bar_quality_level1']}), b AS ({ORACLES['bar_quality_level2']}),
c AS (
  SELECT a.symbol, a.n, a.passed AS level1_passed, concat_ws(',', {', '.join(f"CASE WHEN a.{c} > 0 THEN '{c}' END" for c in ("nulls", "high_below_low", "high_below", "low_above", "duplicate_ts", "negative_volume", "non_positive", "jumps", "out_of_order"))}) AS faults,
    concat_ws(',', CASE WHEN NOT a.passed THEN 'level1_failed' END, CASE WHEN a.passed AND a.n < 100 THEN 'insufficient_data' END, CASE WHEN a.passed AND a.n >= 100 AND gap_ratio > 0.05 THEN 'excessive_gaps' END) AS issues,
    CASE WHEN a.passed AND a.n >= 100 THEN concat_ws(',', CASE WHEN abs(skew) > 5 THEN 'extreme_skew' END, CASE WHEN kurtosis > 20 THEN 'heavy_tails' WHEN kurtosis < 0 THEN 'light_tails' END, CASE WHEN abs(auto1) < 0.01 AND a.n > 1001 THEN 'no_autocorrelation' END,
      CASE WHEN adf_p > 0.05 THEN 'not_stationary' END, CASE WHEN arch_p > 0.10 THEN 'no_arch_effects' END, CASE WHEN gap_ratio > 0.01 THEN 'gaps' END) ELSE '' END AS warnings
  FROM a JOIN b USING (symbol))
SELECT *, issues = '' AS overall_passed FROM c""")
def _full(spark, sf):
    """Both levels; the second is worked out only for symbols that pass the first."""
    return quality.full(st.log_return(bars(spark, sf)).withColumn("seq", F.unix_micros("ts")))
