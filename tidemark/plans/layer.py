"""Query of the integrated signal layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import at, tidy
from tidemark.operators import fusion as fu, layer
from tidemark.operators.microstructure import book_features
from tidemark.plans.collect import collector
from tidemark.plans.recursions import ORACLES as RECURSIONS
from tidemark.sources.fixtures import BARS, bars, books, snapshots

QUERIES, ORACLES, query = collector()


def _side(spark, sf):
    """Imbalance of each bar's last book; a sentiment and a risk score that follow from the bar."""
    flow = snapshots(spark, sf).groupBy("symbol", "ts").agg(F.max("book_id").alias("book_id"))
    flow = flow.join(book_features(books(spark, sf)).select("book_id", "obi"), "book_id").select("symbol", "ts", F.col("obi").alias("obi_normalized"))
    b = bars(spark, sf)
    sentiment = b.where("trades % 3 <> 0").select("symbol", "ts", (F.col("trades") % 5 / 2 - 1).alias("sentiment_current"))
    risks = b.where("trades % 2 = 0").select("symbol", "ts", (F.col("volume") % 1000 / 1000).alias("score"))
    return flow, sentiment, risks


_W = lambda c, i: f"(CASE WHEN {c} IS NULL THEN 0.0 ELSE {layer.COMPONENTS[c][1]} * " + ("CASE WHEN trusted THEN CASE regime " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in fu.MULTIPLIERS.items()) + " END ELSE 1.0 END" if i is not None else "1.0") + " END)"
_USED = ("momentum_5", "momentum_21", "momentum_63", "obi_normalized", "rsi_signal", "sentiment_current")
_INDEX = {c: fu.CATEGORIES.index(layer.COMPONENTS[c][0]) if layer.COMPONENTS[c][0] in fu.CATEGORIES else None for c in _USED}
_TOP = " + ".join(f"coalesce(greatest(-1.0, least(1.0, {c})), 0) * {_W(c, _INDEX[c])}" for c in _USED)
_UNDER = " + ".join(_W(c, _INDEX[c]) for c in _USED)
_Z = lambda h: f"CASE WHEN m{h} IS NULL THEN NULL WHEN count(m{h}) OVER w >= {min(20, h)} AND stddev_samp(m{h}) OVER w > 1e-10 THEN (m{h} - avg(m{h}) OVER w) / stddev_samp(m{h}) OVER w ELSE 0.0 END AS momentum_{h}"


@query("integrated_signal", f"""WITH {BARS},
rg AS (SELECT symbol, ts_us, state, greatest(p_bull, p_bear, p_range) AS conf FROM ({RECURSIONS['regime_forward']})),
rs AS (SELECT *, ['Bull', 'Bear', 'Range'][state::INT + 1] AS regime, coalesce((state <> lag(state) OVER (PARTITION BY symbol ORDER BY ts_us))::INT, 1) AS ch FROM rg),
rr AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts_us) AS run FROM rs),
rd AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts_us) AS duration FROM rr),
d AS (SELECT *, close - lag(close) OVER v AS d, {', '.join(f'close / lag(close, {h}) OVER v - 1 AS m{h}' for h in (5, 21, 63))} FROM bars WINDOW v AS (PARTITION BY symbol ORDER BY ts)),
z AS (SELECT *, {', '.join(_Z(h) for h in (5, 21, 63))}, count(d) OVER u AS nd, sum(greatest(d, 0.0)) OVER u AS up, -sum(least(d, 0.0)) OVER u AS down
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING)),
y AS (SELECT *, CASE WHEN nd = 14 THEN CASE WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / down) END END AS rsi FROM z),
lv AS (SELECT l_orderkey AS book_id, l_linestatus AS side, l_quantity AS q, row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_quantity) AS lvl FROM lineitem WHERE l_linestatus IN ('O', 'F')),
ob AS (SELECT book_id, coalesce(sum(q) FILTER (side = 'O' AND lvl <= 5), 0) AS b, coalesce(sum(q) FILTER (side = 'F' AND lvl <= 5), 0) AS a FROM lv GROUP BY book_id),
sn AS (SELECT symbol, ts, max(book_id) AS book_id FROM (
    SELECT DISTINCT l_orderkey AS book_id, ['click', 'error', 'purchase', 'signup', 'view'][CAST(l_orderkey % 5 + 1 AS INT)] AS symbol, TIMESTAMP '2024-01-01' + to_hours(CAST(l_orderkey // 5 % 720 AS INT)) AS ts FROM lineitem WHERE l_linestatus IN ('O', 'F')) GROUP BY 1, 2),
c AS (
  SELECT y.symbol, y.ts, y.momentum_5, y.momentum_21, y.momentum_63, CASE WHEN rsi < 30 THEN (30 - rsi) / 30 WHEN rsi > 70 THEN (70 - rsi) / 30 WHEN rsi IS NOT NULL THEN 0.0 END AS rsi_signal,
    CASE WHEN a + b > 0 THEN (b - a) / (b + a) WHEN a IS NOT NULL THEN 0.0 END AS obi_normalized, CASE WHEN trades % 3 <> 0 THEN trades % 5 / 2.0 - 1 END AS sentiment_current,
    CASE WHEN trades % 2 = 0 THEN volume % 1000 / 1000 ELSE 0.0 END AS score, regime, conf, duration, conf >= 0.7 AND duration >= 5 AS trusted
  FROM y JOIN rd ON rd.symbol = y.symbol AND rd.ts_us = epoch_us(y.ts) LEFT JOIN sn ON sn.symbol = y.symbol AND sn.ts = y.ts LEFT JOIN ob USING (book_id))
SELECT symbol, epoch_us(ts) AS ts_us, regime, duration, round(CASE WHEN {_UNDER} > 0 THEN ({_TOP}) / ({_UNDER}) ELSE 0.0 END, 4) + 0.0 AS composite, round(score, 4) + 0.0 AS risk_score,
  CASE WHEN score >= 0.7 THEN 0.0 WHEN score >= 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE AS position_multiplier, CASE WHEN score >= 0.9 THEN 'HALT' WHEN score >= 0.7 THEN 'CLOSE_ONLY' WHEN score >= 0.5 THEN 'REDUCE' ELSE 'NORMAL' END AS risk_action FROM c""")
def _integrated(spark, sf):
    flow, sentiment, risks = _side(spark, sf)
    out = layer.integrate(layer.components(bars(spark, sf), flow, sentiment), risks)
    return out.select("symbol", at(), "regime", F.col("duration").cast("long").alias("duration"), tidy("composite").alias("composite"), tidy("risk_score").alias("risk_score"), "position_multiplier", "risk_action")
