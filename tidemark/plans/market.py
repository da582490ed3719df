"""Queries of the windowed indicators, order-book and trade-flow operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions.columns import at, normal_cdf, normal_sql, tidy
from tidemark.operators import indicators as ind, microstructure as ms
from tidemark.plans.collect import collector
from tidemark.sources.fixtures import BARS, BOOKS, TICKS, bars, books, ticks

QUERIES, ORACLES, query = collector()


def shown(df, *names, first=None):
    return df.select(*(first or ("symbol", at())), *[tidy(n).alias(n) for n in names])


def _wma(x: str, weights: list[float], w: str) -> str:
    return "(" + " + ".join(f"lag({x}, {len(weights) - 1 - i}) OVER {w} * {v!r}" for i, v in enumerate(weights)) + f") / {sum(weights)!r}"


_ramp = lambda n: [float(i + 1) for i in range(n)]
_gauss = [math.exp(-((i - 17.0) ** 2) / (2 * 3.5**2)) for i in range(21)]


@query("hull_and_alma", f"""WITH {BARS},
h AS (SELECT symbol, ts, close, {', '.join(f"2 * {_wma('close', _ramp(n // 2), 'w')} - {_wma('close', _ramp(n), 'w')} AS h{n}" for n in (9, 21))}
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, epoch_us(ts) AS ts_us, round({_wma('h9', _ramp(3), 'w')}, 4) + 0.0 AS hma_9, round({_wma('h21', _ramp(4), 'w')}, 4) + 0.0 AS hma_21,
  round({_wma('close', _gauss, 'w')}, 4) + 0.0 AS alma FROM h WINDOW w AS (PARTITION BY symbol ORDER BY ts)""")
def _hull(spark, sf):
    df = bars(spark, sf)
    for n in (9, 21):
        df = ind.hull(df, "close", n, f"hma_{n}")
    return shown(ind.alma(df, "close"), "hma_9", "hma_21", "alma")


@query("range_indicators", f"""WITH {BARS},
d AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS pc, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM bars),
x AS (
  SELECT symbol, ts, close, max(high) OVER w AS hh, min(low) OVER w AS ll, count(*) OVER w AS n, count(d) OVER w AS nd,
    sum(greatest(d, 0.0)) OVER w AS g, -sum(least(d, 0.0)) OVER w AS l,
    greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
    abs(close - lag(close, 10) OVER (PARTITION BY symbol ORDER BY ts)) AS ch, sum(abs(d)) OVER w10 AS path
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY ts ROWS 9 PRECEDING))
SELECT symbol, epoch_us(ts) AS ts_us,
  CASE WHEN n = 14 THEN round(CASE WHEN hh <> ll THEN -100 * (hh - close) / (hh - ll) ELSE -50.0 END, 4) + 0.0 END AS williams_r,
  CASE WHEN n = 14 THEN round(CASE WHEN hh <> ll THEN (close - ll) / (hh - ll) ELSE 0.5 END, 4) + 0.0 END AS stoch_raw,
  CASE WHEN nd = 14 THEN round(CASE WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END, 4) + 0.0 END AS rsi,
  round(tr, 4) + 0.0 AS tr,
  CASE WHEN ch IS NOT NULL THEN round(CASE WHEN path <> 0 THEN ch / path ELSE 0.0 END, 4) + 0.0 END AS efficiency
FROM x""")
def _ranges(spark, sf):
    df = ind.efficiency_ratio(ind.true_range(ind.simple_rsi(ind.raw_stochastic(ind.williams_r(bars(spark, sf))))))
    return shown(df, "williams_r", "stoch_raw", "rsi", "tr", "efficiency")


@query("volume_delta", f"""WITH {BARS},
d AS (SELECT *, CASE WHEN high > low THEN volume * (2 * (close - low) - (high - low)) / (high - low) ELSE 0.0 END AS delta FROM bars)
SELECT symbol, epoch_us(ts) AS ts_us, round(delta, 4) + 0.0 AS delta,
  round(sum(delta) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS cvd,
  round(CASE WHEN high > low THEN 2 * (close - low) / (high - low) - 1 ELSE 0.0 END, 4) + 0.0 AS pressure FROM d""")
def _delta(spark, sf):
    return shown(ind.volume_delta(bars(spark, sf)), "delta", "cvd", "pressure")


@query("relative_volume", f"""WITH {BARS},
z AS (
  SELECT symbol, ts, CASE WHEN count(*) OVER w >= 2 AND stddev_samp(volume) OVER w > 1e-10
    THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0.0 END AS z
  FROM bars WINDOW w AS (PARTITION BY symbol, hour(ts) * 60 + minute(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, epoch_us(ts) AS ts_us, round(z, 4) + 0.0 AS rvol_z, abs(z) > 2 AS unusual,
  CASE WHEN z > 3 THEN 'extreme_high' WHEN z > 2 THEN 'very_high' WHEN z > 1 THEN 'high' WHEN z > -1 THEN 'normal' WHEN z > -2 THEN 'low' ELSE 'very_low' END AS rvol_label
FROM z""")
def _rvol(spark, sf):
    out = ind.relative_volume(bars(spark, sf))
    return out.select("symbol", at(), tidy("rvol_z").alias("rvol_z"), "unusual", "rvol_label")


@query("relative_volume_percentile", f"""WITH {BARS},
z AS (
  SELECT symbol, ts, CASE WHEN count(*) OVER w >= 2 AND stddev_samp(volume) OVER w > 1e-10
    THEN (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w ELSE 0.0 END AS z
  FROM bars WINDOW w AS (PARTITION BY symbol, hour(ts) * 60 + minute(ts) ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, epoch_us(ts) AS ts_us, round(100 * {normal_sql('z')}, 4) + 0.0 AS percentile FROM z""")
def _rvol_percentile(spark, sf):
    """The z-score as a share of the normal distribution."""
    out = ind.relative_volume(bars(spark, sf))
    return out.select("symbol", at(), tidy(100 * normal_cdf(F.col("rvol_z"))).alias("percentile"))


@query("order_book", f"""WITH {BOOKS},
s AS (
  SELECT r.book_id, any_value(best_bid) AS bb, any_value(best_ask) AS ba, any_value((best_bid + best_ask) / 2) AS mid,
    max(qty) FILTER (side = 'O' AND lvl = 1) AS bq, max(qty) FILTER (side = 'F' AND lvl = 1) AS aq,
    coalesce(sum(qty) FILTER (side = 'O' AND lvl <= 5), 0) AS b5, coalesce(sum(qty) FILTER (side = 'F' AND lvl <= 5), 0) AS a5,
    coalesce(sum(qty) FILTER (side = 'O' AND lvl <= 10), 0) AS b10, coalesce(sum(qty) FILTER (side = 'F' AND lvl <= 10), 0) AS a10,
    coalesce(sum(qty) FILTER (side = 'O' AND lvl <= 5 AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.01), 0) AS nb,
    coalesce(sum(qty) FILTER (side = 'F' AND lvl <= 5 AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.01), 0) AS na,
    coalesce(sum(qty) FILTER (side = 'O' AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.01), 0) AS db,
    coalesce(sum(qty) FILTER (side = 'F' AND abs(price - (best_bid + best_ask) / 2) <= (best_bid + best_ask) / 2 * 0.01), 0) AS da
  FROM ranked r JOIN tops USING (book_id) GROUP BY r.book_id)
SELECT book_id, round(bb, 4) + 0.0 AS best_bid, round(ba, 4) + 0.0 AS best_ask, round(mid, 4) + 0.0 AS mid, round(ba - bb, 4) + 0.0 AS spread,
  round((ba - bb) / mid * 100, 4) + 0.0 AS spread_pct,
  round(CASE WHEN b5 + a5 > 0 THEN (b5 - a5) / (b5 + a5) ELSE 0 END, 4) + 0.0 AS obi,
  round(CASE WHEN b10 + a10 > 0 THEN (b10 - a10) / (b10 + a10) ELSE 0 END, 4) + 0.0 AS lob_imbalance,
  round(CASE WHEN mid IS NOT NULL AND nb + na > 0 THEN (nb - na) / (nb + na) ELSE 0 END, 4) + 0.0 AS obi_band,
  round(CASE WHEN mid IS NOT NULL AND na > 0 THEN nb / na ELSE 1.0 END, 4) + 0.0 AS depth_ratio,
  round(db, 4) + 0.0 AS bid_depth_1pct, round(da, 4) + 0.0 AS ask_depth_1pct,
  round(CASE WHEN ba - bb > 0 AND mid > 0 THEN ((bb * aq + ba * bq) / (bq + aq) - mid) / (ba - bb) ELSE 0 END, 4) + 0.0 AS micro_dev
FROM s""")
def _book(spark, sf):
    names = ("best_bid", "best_ask", "mid", "spread", "spread_pct", "obi", "lob_imbalance", "obi_band", "depth_ratio", "bid_depth_1pct", "ask_depth_1pct", "micro_dev")
    return shown(ms.book_features(books(spark, sf)), *names, first=("book_id",))


_TRADES = f"""{TICKS},
t AS (SELECT *, CASE WHEN is_buyer_maker THEN 0.0 ELSE quantity END AS b, CASE WHEN is_buyer_maker THEN quantity ELSE 0.0 END AS s FROM ticks),
m AS (
  SELECT *, sum(b) OVER r AS buy_volume, sum(s) OVER r AS sell_volume, sum(b - s) OVER r AS cvd, sum(price * quantity) OVER w / sum(quantity) OVER w AS vwap,
    sum(b - s) OVER w / sum(quantity) OVER w AS flow, avg(quantity) OVER w AS mean_size,
    CASE WHEN count(*) OVER w >= 2 AND epoch_us(ts) > min(epoch_us(ts)) OVER w THEN count(*) OVER w / ((epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6) ELSE 0.0 END AS velocity
  FROM t WINDOW r AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), w AS (PARTITION BY symbol ORDER BY ts, event_id ROWS 99 PRECEDING))"""


@query("trade_metrics", f"""WITH {_TRADES}
SELECT event_id, round(buy_volume, 4) + 0.0 AS buy_volume, round(sell_volume, 4) + 0.0 AS sell_volume, round(cvd, 4) + 0.0 AS cvd, round(vwap, 4) + 0.0 AS vwap,
  round(flow, 4) + 0.0 AS flow_imbalance, round(velocity, 4) + 0.0 AS velocity, round(mean_size, 4) + 0.0 AS mean_size FROM m""")
def _trades(spark, sf):
    return shown(ms.trade_metrics(ticks(spark, sf)), "buy_volume", "sell_volume", "cvd", "vwap", "flow_imbalance", "velocity", "mean_size", first=("event_id",))


@query("order_flow", f"""WITH {_TRADES},
f AS (
  SELECT *, price - first(price) OVER w20 AS ps, max(price) OVER w20 - min(price) OVER w20 AS pw, cvd - first(cvd) OVER w20 AS cs, max(cvd) OVER w20 - min(cvd) OVER w20 AS cw,
    count(*) OVER w20 = 20 AS f20, abs(sum(b - s) OVER w50) / sum(quantity) OVER w50 AS vpin,
    CASE WHEN count(*) OVER r >= 2 AND stddev_samp(cvd) OVER r > 1e-10 THEN (cvd - avg(cvd) OVER r) / stddev_samp(cvd) OVER r ELSE 0.0 END AS cz,
    CASE WHEN count(*) OVER r >= 2 AND stddev_samp(velocity) OVER r > 1e-10 THEN (velocity - avg(velocity) OVER r) / stddev_samp(velocity) OVER r ELSE 0.0 END AS iz,
    avg(CASE WHEN is_buyer_maker THEN 0.0 ELSE 1.0 END) OVER r AS ag
  FROM m WINDOW r AS (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), w20 AS (PARTITION BY symbol ORDER BY ts, event_id ROWS 19 PRECEDING),
    w50 AS (PARTITION BY symbol ORDER BY ts, event_id ROWS 49 PRECEDING)),
g AS (SELECT *, CASE WHEN pw <> 0 THEN ps / pw ELSE 0 END AS pn, CASE WHEN cw <> 0 THEN cs / cw ELSE cs END AS cn FROM f)
SELECT event_id, round(greatest(-5.0, least(5.0, cz)), 4) + 0.0 AS cvd_z,
  CASE WHEN f20 AND cn > 0.3 AND pn < -0.3 THEN 1.0 WHEN f20 AND cn < -0.3 AND pn > 0.3 THEN -1.0 ELSE 0.0 END AS divergence,
  round(vpin, 4) + 0.0 AS vpin, round(greatest(-5.0, least(5.0, iz)), 4) + 0.0 AS intensity_z, round(ag, 4) + 0.0 AS aggressive FROM g""")
def _flow(spark, sf):
    out = ms.order_flow(ticks(spark, sf))
    return out.select("event_id", tidy("cvd_z").alias("cvd_z"), "divergence", *[tidy(c).alias(c) for c in ("vpin", "intensity_z", "aggressive")])


@query("sampled_trades", f"""WITH {TICKS}
SELECT symbol, event_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS seq FROM ticks) WHERE seq % 10 = 0""")
def _sampled(spark, sf):
    return ms.sampled_trades(ticks(spark, sf)).select("symbol", "event_id", F.col("seq").cast("long").alias("seq"))
