"""Queries of the dynamic sentiment weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import at, last, running, tidy, z_score
from tidemark.operators import indicators as ind, recursive as re_, weights as we
from tidemark.operators.statistics import log_return
from tidemark.plans.collect import collector
from tidemark.plans.recursions import _r, staged
from tidemark.plans.statistics import RETURNS
from tidemark.sources.fixtures import SCORED, bars, scored_posts

QUERIES, ORACLES, query = collector()

_VALUES = ", ".join(f"({i}, {a}, {b}, {c})" for i, (a, b, c) in enumerate(we.TABLE[v, e][m] for v in we.VOLATILITIES for e in we.ENGAGEMENTS for m in range(3)))
_CLASS = lambda x, borders: f"CASE WHEN {x} < {borders[0]} THEN 'low' WHEN {x} > {borders[1]} THEN 'high' ELSE 'normal' END"
_INDEX = lambda x: f"CASE {x} WHEN 'low' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END"
#: Classes of each bar: the true range of 14 bars to the price, the volume's z-score, the sign of 12 bars' return.
CLASSES = f"""{RETURNS}, d AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
x AS (
  SELECT symbol, ts, avg(tr) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) / close / 100 AS atr, sum(ret) OVER (PARTITION BY symbol ORDER BY ts ROWS 11 PRECEDING) AS r12,
    CASE WHEN count(*) OVER u >= 2 AND stddev_samp(volume) OVER u > 1e-10 THEN (volume - avg(volume) OVER u) / stddev_samp(volume) OVER u ELSE 0.0 END AS z
  FROM d WINDOW u AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, {_CLASS('atr', we.VOLATILITY)} AS volatility, {_CLASS('z', we.ENGAGEMENT)} AS engagement, CASE WHEN r12 > 0.5 THEN 'Bull' WHEN r12 < -0.5 THEN 'Bear' ELSE 'Range' END AS market FROM x),
k AS (SELECT *, {_INDEX('volatility')} * 9 + {_INDEX('engagement')} * 3 + CASE market WHEN 'Bull' THEN 0 WHEN 'Bear' THEN 1 ELSE 2 END AS key FROM c),
tab(key, t1, t2, t3) AS (VALUES {_VALUES})"""


def classes(spark, sf):
    b = ind.true_range(log_return(bars(spark, sf)))
    r12 = F.sum("ret").over(last(12))
    b = b.select("symbol", "ts", (F.avg("tr").over(last(14)) / F.col("close") / 100).alias("atr"), z_score(F.col("volume"), running()).alias("z"), r12.alias("r12"))
    market = F.when(F.col("r12") > 0.5, "Bull").when(F.col("r12") < -0.5, "Bear").otherwise("Range")
    b = b.select("symbol", "ts", we.volatility_class(F.col("atr")).alias("volatility"), we.engagement_class(F.col("z")).alias("engagement"), market.alias("market"))
    b = b.withColumn("key", we.place(F.col("volatility"), F.col("engagement"), F.col("market")))
    return b.select("*", *[we.target(F.col("key"))[i].alias(f"t{i + 1}") for i in range(3)])


@query("sentiment_regimes", f"""WITH {CLASSES} SELECT symbol, epoch_us(ts) AS ts_us, volatility, engagement, market, key, t1::DOUBLE AS t1, t2::DOUBLE AS t2, t3::DOUBLE AS t3 FROM k JOIN tab USING (key)""")
def _classes(spark, sf):
    return classes(spark, sf).select("symbol", at(), "volatility", "engagement", "market", "key", "t1", "t2", "t3")


_MOVE = lambda w, t: f"p_{w} + greatest(-0.15, least(0.15, 0.1 * (x_{t} - p_{w})))"


@query("dynamic_weights", staged(f"{CLASSES}, src AS (SELECT symbol, ts, key, t1, t2, t3 FROM k JOIN tab USING (key))", {"k": "DOUBLE", "d": "DOUBLE", "a": "DOUBLE", "b": "DOUBLE", "c": "DOUBLE"},
    {"k": "key", "d": "0", "a": "0.35", "b": "0.65", "c": "0.0"}, [
        {"k": "x_key", "d": "CASE WHEN x_key = p_k THEN p_d + 1 ELSE 0 END", "na": _MOVE("a", "t1"), "nb": _MOVE("b", "t2"), "nc": _MOVE("c", "t3")},
        {"a": "CASE WHEN d >= 5 THEN na / (na + nb + nc) ELSE p_a END", "b": "CASE WHEN d >= 5 THEN nb / (na + nb + nc) ELSE p_b END", "c": "CASE WHEN d >= 5 THEN nc / (na + nb + nc) ELSE p_c END"}],
    ", ".join([_r("a", "w_lexicon"), _r("b", "w_model"), _r("c", "w_social"), "d AS lasted"]), "key t1 t2 t3"))
def _weights(spark, sf):
    """Weights along the regimes: held for five rows after a change, then moving by a capped share."""
    out = re_.scan(classes(spark, sf), we.followed_weights("key", ("t1", "t2", "t3")))
    return out.select("symbol", at(), *[tidy(c).alias(c) for c in ("w_lexicon", "w_model", "w_social")], "lasted")


_MULT = " ".join(f"WHEN market = '{m}' AND source = '{s}' THEN {v}" for m, by in we.MULTIPLIERS.items() for s, v in by.items())


@query("session_weights", f"""WITH {SCORED}, m AS (SELECT *, ['Bull', 'Bear', 'Range'][CAST(id % 3 + 1 AS INT)] AS market FROM posts)
SELECT id, ([{', '.join(map(str, we.HOURS))}][CAST(hour(ts) + 1 AS INT)])::DOUBLE AS hour_weight, (CASE {_MULT} ELSE 1.0 END)::DOUBLE AS multiplier,
  round(score * [{', '.join(map(str, we.HOURS))}][CAST(hour(ts) + 1 AS INT)] * CASE {_MULT} ELSE 1.0 END, 4) + 0.0 AS weighted FROM m""")
def _sessions(spark, sf):
    """A post's score by the hour of the day and by how much its source counts in the market."""
    market = F.element_at(F.array(F.lit("Bull"), F.lit("Bear"), F.lit("Range")), (F.col("id") % 3 + 1).cast("int"))
    p = scored_posts(spark, sf).select("id", "score", we.hour_weight(F.col("ts")).alias("hour_weight"), we.regime_multiplier(market, F.col("source")).alias("multiplier"))
    return p.select("id", "hour_weight", "multiplier", tidy(F.col("score") * F.col("hour_weight") * F.col("multiplier")).alias("weighted"))


@query("confidence_weighted", f"""WITH {SCORED}, c AS (
  SELECT symbol, score, 0.4 + (id % 7) / 10.0 AS conf, CASE WHEN source = 'news' THEN 0.65 WHEN source = 'twitter' AND id % 3 = 0 THEN 0.35 ELSE 0.2 END AS base FROM posts)
SELECT symbol, round(sum(score * base * conf * conf) / sum(base * conf * conf), 4) + 0.0 AS score FROM c GROUP BY symbol""")
def _confident(spark, sf):
    p = scored_posts(spark, sf)
    source = F.when((F.col("source") == "twitter") & (F.col("id") % 3 == 0), "vader").otherwise(F.col("source"))
    p = p.select("symbol", source.alias("source"), "score", (0.4 + (F.col("id") % 7) / 10).alias("confidence"), F.lit(0.35).alias("w_lexicon"), F.lit(0.65).alias("w_model"), F.lit(0.2).alias("w_social"))
    return we.confidence_weighted(p, "symbol").select("symbol", tidy("score").alias("score"))
