"""Queries of the systemic-risk operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import at, tidy
from tidemark.operators import risk
from tidemark.plans.collect import collector
from tidemark.sources.fixtures import BARS, bars, table

QUERIES, ORACLES, query = collector()

#: Six signals in [0, 1] from each bar, as integers by 100 so that both engines see the same doubles.
_CENTS = "CAST(round(close * 100) AS BIGINT)"
_MIX = {"fsi": 7, "lei": 11, "ods": 13, "scsi": 17, "lci": 19, "caci": 23}
RISK = f"""{BARS},
sig AS (SELECT symbol, ts, {', '.join(f"(({_CENTS} * {m}) % 101) / 100.0 * ((trades * {m}) % 7) / 6.0 AS {c}" for c, m in _MIX.items())} FROM bars)"""


def signals(spark, sf):
    cents = F.round(F.col("close") * 100).cast("long")
    return bars(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), *[((cents * m) % 101 / 100.0 * ((F.col("trades") * m) % 7) / 6.0).alias(c) for c, m in _MIX.items()])


_REGIME = """reg AS (
  SELECT *, count(*) OVER w AS seen, max(fsi) OVER w AS mf, max(ods) OVER w AS mo, max(scsi) OVER w AS ms, max(lci) OVER w AS ml, max(caci) OVER w AS mc
  FROM sig WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW)),
rg AS (
  SELECT *, CASE WHEN seen < 10 THEN 'normal' WHEN mo > 0.3 OR ms > 0.4 THEN 'oracle_failure' WHEN mc > 0.5 THEN 'tradfi_contagion'
    WHEN mf > 0.6 OR ml > 0.6 THEN 'leverage_saturation' ELSE 'normal' END AS regime FROM reg)"""


def regimes(spark, sf):
    return risk.risk_regime(signals(spark, sf), 12 * 3600)


@query("risk_regime", f"""WITH {RISK}, {_REGIME}
SELECT symbol, epoch_us(ts) AS ts_us, seen, regime, CASE regime
  WHEN 'oracle_failure' THEN concat_ws(',', CASE WHEN mo > 0.3 THEN 'ods' END, CASE WHEN ms > 0.4 THEN 'scsi' END)
  WHEN 'tradfi_contagion' THEN concat_ws(',', CASE WHEN mc > 0.5 THEN 'caci' END)
  WHEN 'leverage_saturation' THEN concat_ws(',', CASE WHEN mf > 0.6 THEN 'fsi' END, CASE WHEN ml > 0.6 THEN 'lci' END) ELSE '' END AS triggers FROM rg""")
def _regime(spark, sf):
    return regimes(spark, sf).select("symbol", at(), "seen", "regime", "triggers")


_W = lambda i: "CASE regime " + " ".join(f"WHEN '{r}' THEN {w[i]}" for r, w in risk.WEIGHTS.items()) + " END"
_SCORE = f"""sc AS (
  SELECT *, {', '.join(f"{_W(i)} * {c} AS c_{c}" for i, c in enumerate(risk.SIGNALS))},
    {' + '.join(f"({c} > 0.5)::INT" for c in risk.SIGNALS)} AS elevated, {' + '.join(f"({c} > 0.7)::INT" for c in risk.SIGNALS)} AS high FROM rg),
sf AS (
  SELECT *, CASE WHEN elevated >= 4 THEN 1.3 WHEN high >= 3 THEN 1.2 ELSE 1.0 END AS factor, {' + '.join(f'c_{c}' for c in risk.SIGNALS)} AS raw FROM sc),
ss AS (SELECT *, greatest(0.0, least(1.0, raw * factor))::DOUBLE AS score FROM sf)"""


def scored(spark, sf):
    return risk.composite(regimes(spark, sf))


@query("risk_composite", f"""WITH {RISK}, {_REGIME}, {_SCORE},
best AS (SELECT *, greatest({', '.join(f'c_{c}' for c in risk.SIGNALS)}) AS top FROM ss)
SELECT symbol, epoch_us(ts) AS ts_us, round(score, 4) + 0.0 AS score, factor > 1 AS amplified, elevated, high,
  CASE {' '.join(f"WHEN c_{c} = top THEN '{c}'" for c in risk.SIGNALS)} END AS dominant,
  CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.5 THEN 'ELEVATED' ELSE 'LOW' END AS level,
  CASE WHEN score >= 0.7 THEN 0.0 WHEN score >= 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE AS gate,
  round(CASE WHEN score >= 0.7 THEN 0.0 WHEN score >= 0.5 THEN 1 - 0.5 * (score - 0.5) / 0.2 ELSE 1.0 END, 4) + 0.0 AS gate_ramp
FROM best""")
def _composite(spark, sf):
    s = scored(spark, sf)
    return s.select("symbol", at(), tidy("score").alias("score"), "amplified", "elevated", "high", "dominant", "level", risk.gate(F.col("score")).alias("gate"), tidy(risk.gate(F.col("score"), True)).alias("gate_ramp"))


@query("risk_velocity", f"""WITH {RISK}, {_REGIME}, {_SCORE},
v AS (
  SELECT symbol, ts, score, first(score) OVER w AS s0, epoch(ts) - epoch(first(ts) OVER w) AS span, count(*) OVER w AS n
  FROM ss WINDOW w AS (PARTITION BY symbol ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW))
SELECT symbol, epoch_us(ts) AS ts_us, CASE WHEN n >= 2 AND span >= 5 THEN round((score - s0) / span * 1e4, 4) + 0.0 END AS velocity FROM v""")
def _velocity(spark, sf):
    return risk.velocity(scored(spark, sf), 6 * 3600).select("symbol", at(), tidy(F.col("velocity") * 1e4).alias("velocity"))


@query("risk_latest", f"""WITH {RISK}, {_REGIME}, {_SCORE}
SELECT symbol, epoch_us(max(ts)) AS ts_us, round(arg_max(score, ts), 4) + 0.0 AS score, arg_max(regime, ts) AS regime FROM ss
GROUP BY symbol HAVING max(ts) >= (SELECT max(ts) FROM ss) - INTERVAL 6 HOUR""")
def _latest(spark, sf):
    s = scored(spark, sf).select("symbol", "ts", "score", "regime")
    now = s.agg(F.max(F.unix_seconds("ts")).alias("now"))
    out = risk.latest(s.join(F.broadcast(now)), ttl_seconds=6 * 3600, now=F.col("now"))
    return out.select("symbol", at(), tidy("score").alias("score"), "regime")


@query("risk_history", f"""WITH {RISK}, {_REGIME}, {_SCORE}
SELECT symbol, epoch_us(ts) AS ts_us, round(score, 4) + 0.0 AS score, regime FROM ss WHERE ts > (SELECT max(ts) FROM ss) - INTERVAL 24 HOUR""")
def _history(spark, sf):
    """Each symbol's rows of the last 24 hours."""
    s = scored(spark, sf).select("symbol", "ts", "score", "regime")
    now = s.agg(F.max(F.unix_seconds("ts")).alias("now"))
    return s.join(F.broadcast(now)).where(F.unix_seconds("ts") > F.col("now") - 24 * 3600).select("symbol", at(), tidy("score").alias("score"), "regime")


@query("risk_alerts", f"""WITH {RISK}, {_REGIME}, {_SCORE}
SELECT symbol, epoch_us(ts) AS ts_us, rank FROM (
  SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS rank FROM ss WHERE score >= 0.5) WHERE rank <= 100""")
def _alerts(spark, sf):
    return risk.newest(scored(spark, sf).where("score >= 0.5").select("symbol", "ts", "score"), 100).select("symbol", at(), F.col("rank").cast("long").alias("rank"))


@query("exit_intents", f"""WITH {RISK}, {_REGIME}, {_SCORE},
p AS (SELECT symbol, arg_max(fsi - lei, ts) AS quantity FROM ss GROUP BY symbol),
h AS (SELECT DISTINCT symbol FROM ss WHERE score > 0.5)
SELECT symbol, CASE WHEN quantity > 0 THEN 'SELL' ELSE 'BUY' END AS side, round(abs(quantity), 4) + 0.0 AS quantity, true AS reduce_only, true AS dry_run
FROM p WHERE quantity <> 0 AND symbol IN (SELECT symbol FROM h)""")
def _exits(spark, sf):
    s = scored(spark, sf)
    positions = s.groupBy("symbol").agg(F.max_by(F.col("fsi") - F.col("lei"), "ts").alias("quantity"))
    return risk.exit_intents(positions, s.where("score > 0.5")).withColumn("quantity", tidy("quantity"))


@query("funding_saturation", f"""WITH {BARS},
r AS (
  SELECT symbol, ts, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY ts)) / 1000 AS rate,
    CASE trades % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS regime FROM bars),
q AS (SELECT *, list(rate) OVER (PARTITION BY symbol ORDER BY ts ROWS 62 PRECEDING) AS l FROM r WHERE rate IS NOT NULL),
e AS (
  SELECT *, len(l) AS n, list_reverse(l) AS h, list_sum(list_transform(list_reverse(l), lambda x, i: x * pow(1 - 2.0 / 7, i - 1))) / list_sum(list_transform(l, lambda x, i: pow(1 - 2.0 / 7, i - 1))) AS m FROM q),
s AS (SELECT *, ((h[1] - h[2]) + (h[1] - h[3]) / 2 + (h[2] - h[3])) / 3 AS slope, CASE regime WHEN 'LOW' THEN 0.0010 WHEN 'HIGH' THEN 0.0015 ELSE 0.00125 END AS lim FROM e)
SELECT symbol, epoch_us(ts) AS ts_us, CASE WHEN n >= 6 THEN round(m * 1e4, 4) + 0.0 END AS ema_rate,
  CASE WHEN n >= 6 THEN round(least(1.0, least(1.0, abs(m) / lim) + CASE WHEN slope > 1e-4 THEN 0.2 ELSE 0.0 END), 4) + 0.0 ELSE 0.0 END AS fsi,
  CASE WHEN n < 6 THEN 'insufficient_data' WHEN m > 0 THEN 'LONG_HEAVY' WHEN m < 0 THEN 'SHORT_HEAVY' ELSE 'NEUTRAL' END AS direction FROM s""")
def _funding(spark, sf):
    from tidemark.operators.statistics import log_return

    regime = F.element_at(F.array(F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")), (F.col("trades") % 3 + 1).cast("int"))
    from tidemark.functions.columns import over

    r = bars(spark, sf).select("symbol", "ts", (F.ln(F.col("close") / F.lag("close").over(over())) / 1000).alias("rate"), regime.alias("regime")).where("rate is not null")
    return risk.funding_saturation(r).select("symbol", at(), tidy(F.col("ema_rate") * 1e4).alias("ema_rate"), tidy("fsi").alias("fsi"), "direction")


@query("liquidity_evaporation", f"""WITH {BARS},
d AS (SELECT symbol, ts, volume AS depth, volume / lag(volume) OVER (PARTITION BY symbol ORDER BY ts) - 1 AS step FROM bars),
b AS (
  SELECT *, avg(depth) OVER w * CASE WHEN isodow(ts) >= 6 THEN 0.7 ELSE 1.0 END AS base, count(*) OVER w AS n,
    avg(step) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS speed
  FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 167 PRECEDING))
SELECT symbol, epoch_us(ts) AS ts_us, CASE WHEN n >= 48 THEN round(least(1.0, CASE WHEN base > 0 THEN greatest(0.0, least(1.0, 1 - depth / base)) ELSE 1.0 END
  + CASE WHEN speed < -0.05 THEN 0.3 ELSE 0.0 END), 4) + 0.0 ELSE 0.0 END AS lei FROM b""")
def _evaporation(spark, sf):
    d = bars(spark, sf).select("symbol", F.col("ts").cast("timestamp").alias("ts"), F.col("volume").alias("depth"))
    return risk.liquidity_evaporation(d, keep=168, least=48).select("symbol", at(), tidy("lei").alias("lei"))


_VENUE = """vp AS (SELECT l_partkey AS symbol, l_suppkey AS venue, avg(l_extendedprice / l_quantity) AS price FROM lineitem GROUP BY 1, 2)"""


def _venue_prices(spark, sf):
    line = table(spark, sf, "lineitem")
    return line.groupBy(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("venue")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


@query("venue_divergence", f"""WITH {_VENUE},
m AS (SELECT symbol, avg(price) AS mean, count(*) AS venues, max(price) - min(price) AS width FROM vp GROUP BY 1),
a AS (SELECT symbol, max(abs(price - mean)) AS away, any_value(mean) AS mean, any_value(venues) AS venues, any_value(width) AS width FROM vp JOIN m USING (symbol) GROUP BY 1)
SELECT symbol, venues, CASE WHEN venues >= 2 THEN round(greatest(0.0, least(1.0, greatest(away, width) / mean / 0.05)), 4) + 0.0 ELSE 0.0 END AS ods FROM a""")
def _divergence(spark, sf):
    return risk.venue_divergence(_venue_prices(spark, sf)).select("symbol", "venues", tidy("ods").alias("ods"))


@query("stablecoin_stress", """WITH p AS (
  SELECT 'C' || CAST(p_size % 5 AS VARCHAR) AS coin, p_brand AS venue, avg(1.0 + (p_retailprice - 1400) / 100000) AS price FROM part GROUP BY 1, 2),
c AS (
  SELECT coin, least(1.0, abs(avg(price) - 1) / 0.05) AS pr, CASE WHEN count(*) >= 2 THEN least(1.0, (max(price) - min(price)) / 0.02) ELSE 0.0 END AS ve FROM p GROUP BY coin)
SELECT count(*) AS coins, round(max(pr), 4) + 0.0 AS protocol, round(max(ve), 4) + 0.0 AS venue, round(greatest(max(pr), max(ve)), 4) + 0.0 AS scsi,
  CASE WHEN max(pr) > max(ve) AND max(pr) > 0.3 THEN 'PROTOCOL_LEVEL' WHEN max(ve) > max(pr) AND max(ve) > 0.3 THEN 'VENUE_SPECIFIC' ELSE 'NONE' END AS failure FROM c""")
def _stable(spark, sf):
    p = table(spark, sf, "part").groupBy(F.concat(F.lit("C"), (F.col("p_size") % 5).cast("string")).alias("coin"), F.col("p_brand").alias("venue")).agg(F.avg(1.0 + (F.col("p_retailprice") - 1400) / 100000).alias("price"))
    return risk.stablecoin_stress(p).select("coins", tidy("protocol").alias("protocol"), tidy("venue").alias("venue"), tidy("scsi").alias("scsi"), "failure")


@query("leverage_concentration", """WITH o AS (
  SELECT r_name AS symbol, n_name AS venue, sum(o_totalprice) AS oi FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
t AS (SELECT *, oi / sum(oi) OVER (PARTITION BY symbol) * 100 AS share, count(*) OVER (PARTITION BY symbol) AS venues FROM o),
h AS (SELECT symbol, any_value(venues) AS venues, sum(share * share) AS hhi, arg_max(venue, share) AS dominant, max(share) AS ds FROM t GROUP BY symbol)
SELECT symbol, venues, round(hhi, 4) + 0.0 AS hhi, dominant, round(ds, 4) + 0.0 AS dominant_share,
  round(CASE WHEN hhi >= 5000 THEN 1.0 WHEN hhi >= 2500 THEN 0.5 + 0.5 * (hhi - 2500) / 2500 ELSE 0.5 * hhi / 2500 END, 4) + 0.0 AS lci,
  CASE WHEN hhi > 5000 THEN 'CRITICAL' WHEN hhi > 2500 THEN 'HIGH' WHEN hhi > 1500 THEN 'MODERATE' ELSE 'LOW' END AS level FROM h""")
def _leverage(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    oi = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    oi = oi.groupBy(F.col("r_name").alias("symbol"), F.col("n_name").alias("venue")).agg(F.sum("o_totalprice").alias("oi"))
    return risk.leverage_concentration(oi).select("symbol", "venues", tidy("hhi").alias("hhi"), "dominant", tidy("dominant_share").alias("dominant_share"), tidy("lci").alias("lci"), "level")


@query("contagion_index", f"""WITH {BARS},
d AS (
  SELECT symbol, date_trunc('day', ts) AS ts, CAST(CAST(round(max(volume)) AS BIGINT) % 50 AS DOUBLE) AS vix, 150 + CAST(count(*) AS DOUBLE) / 4 AS usdjpy, 4000 + avg(close) AS spx FROM bars GROUP BY 1, 2),
w AS (SELECT *, lag(usdjpy) OVER (PARTITION BY symbol ORDER BY ts) AS y, max(spx) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) AS hi FROM d),
s AS (
  SELECT symbol, ts, CASE WHEN vix >= 40 THEN 1.0 WHEN vix >= 25 THEN (vix - 25) / 15 ELSE 0.0 END AS sv,
    CASE WHEN abs(usdjpy - y) / y >= 0.02 THEN least(1.0, abs(usdjpy - y) / y / 0.04) ELSE 0.0 END AS sj,
    CASE WHEN (hi - spx) / hi >= 0.03 THEN least(1.0, (hi - spx) / hi / 0.06) ELSE 0.0 END AS sx FROM w)
SELECT symbol, epoch_us(ts) AS ts_us, round(0.5 * sv + 0.3 * sj + 0.2 * sx, 4) + 0.0 AS caci FROM s""")
def _contagion(spark, sf):
    d = bars(spark, sf).groupBy("symbol", F.date_trunc("day", "ts").alias("ts")).agg(
        (F.round(F.max("volume")).cast("long") % 50).cast("double").alias("vix"), (150 + F.count(F.lit(1)).cast("double") / 4).alias("usdjpy"), (4000 + F.avg("close")).alias("spx")
    )
    return risk.contagion(d).select("symbol", at(), tidy("caci").alias("caci"))


@query("cascade_risk", f"""WITH {BARS},
d AS (
  SELECT symbol, ts, (close - open) / 50000 AS funding, close / open - 1 AS oi_change, volume / 200 AS vol_ratio, (high - low) / 500 AS netflow,
    (close - low) / 100 AS netflow_z, trades AS large_tx FROM bars),
r AS (
  SELECT *, least(1.0, (abs(funding) > 0.003)::INT * 0.20 + (oi_change < -0.10)::INT * 0.25 + (vol_ratio > 5)::INT * 0.15 + (netflow > 0.7)::INT * 0.20
    + (abs(netflow_z) > 2)::INT * 0.15 + (large_tx >= 5)::INT * 0.05)::DOUBLE AS risk,
    (abs(funding) > 0.003)::INT + (oi_change < -0.10)::INT + (vol_ratio > 5)::INT + (netflow > 0.7)::INT + (abs(netflow_z) > 2)::INT + (large_tx >= 5)::INT AS n_alerts FROM d)
SELECT symbol, epoch_us(ts) AS ts_us, round(risk, 4) + 0.0 AS risk, n_alerts FROM r""")
def _cascade(spark, sf):
    d = bars(spark, sf).select(
        "symbol", "ts", ((F.col("close") - F.col("open")) / 50000).alias("funding"), (F.col("close") / F.col("open") - 1).alias("oi_change"), (F.col("volume") / 200).alias("vol_ratio"),
        ((F.col("high") - F.col("low")) / 500).alias("netflow"), ((F.col("close") - F.col("low")) / 100).alias("netflow_z"), F.col("trades").alias("large_tx"),
    )
    return risk.cascade_risk(d).select("symbol", at(), tidy("risk").alias("risk"), "n_alerts")
