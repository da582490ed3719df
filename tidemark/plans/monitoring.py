"""Queries of production health, rollout, leakage and required Sharpe ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import normal_quantile, over, tidy
from tidemark.operators import monitoring as mo, validation as va
from tidemark.operators.statistics import log_return
from tidemark.plans.collect import collector
from tidemark.plans.statistics import RETURNS
from tidemark.sources.fixtures import bars, table

QUERIES, ORACLES, query = collector()

_HEALTH = f"""{RETURNS}, h AS (
  SELECT symbol, ts, ret, (close - low) / (high - low + 1) AS signal, lead(ret) OVER (PARTITION BY symbol ORDER BY ts) AS nxt, (volume % 7) / 7 AS sentiment,
    CASE WHEN ret > 0.3 THEN 'Bull' WHEN ret < -0.3 THEN 'Bear' ELSE 'Range' END AS regime FROM rets)"""


def _health(spark, sf):
    b = log_return(bars(spark, sf))
    regime = F.when(F.col("ret") > 0.3, "Bull").when(F.col("ret") < -0.3, "Bear").otherwise("Range")
    return b.select("symbol", "ts", ((F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1)).alias("signal"), F.lead("ret").over(over()).alias("ret"), (F.col("volume") % 7 / 7).alias("sentiment"), regime.alias("regime"))


@query("accuracy_proxies", f"""WITH {_HEALTH}, k AS (SELECT * FROM h WHERE nxt IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 1000)
SELECT symbol, count(*) AS n, round(CASE WHEN count(*) >= 100 THEN corr(signal, nxt) END, 4) + 0.0 AS signal_return_corr,
  round(CASE WHEN count(*) >= 100 THEN (avg(sentiment ** 3) - 3 * avg(sentiment) * var_pop(sentiment) - avg(sentiment) ** 3) / stddev_pop(sentiment) ** 3 END, 4) + 0.0 AS sentiment_skew FROM k GROUP BY symbol""")
def _proxies(spark, sf):
    out = mo.accuracy_proxies(_health(spark, sf).where("ret is not null"))
    return out.select("symbol", "n", tidy("signal_return_corr").alias("signal_return_corr"), tidy("sentiment_skew").alias("sentiment_skew"))


@query("regime_transitions", f"""WITH {_HEALTH}, c AS (SELECT symbol, ts, coalesce((regime <> lag(regime) OVER (PARTITION BY symbol ORDER BY ts))::INT, 0) AS c FROM h)
SELECT symbol, CAST(sum(c) AS BIGINT) AS changes, round(sum(c) / ((epoch(max(ts)) - epoch(min(ts))) / 3600), 4) + 0.0 AS per_hour FROM c GROUP BY symbol""")
def _transitions(spark, sf):
    rows = _health(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    return mo.transition_rate(rows).select("symbol", "changes", tidy("per_hour").alias("per_hour"))


_PAIRS = """p AS (
  SELECT 'phase_' || CAST(o_custkey % 4 + 1 AS VARCHAR) AS phase, o_orderdate AS ts, o_totalprice / 500000 AS old, (o_totalprice + o_orderkey % 97 * 1500) / 500000 AS new,
    o_orderkey % 10 = 0 AS moved, (o_orderkey % 13)::DOUBLE AS latency_ms, o_orderkey % 211 = 0 AS failed FROM orders)"""


@query("rollout_criteria", f"""WITH {_PAIRS}, m AS (
  SELECT phase, (epoch(max(ts)) - epoch(min(ts))) / 3600 AS hours, count(*) AS n, avg(abs(old - new)) AS d, avg((NOT moved)::INT) AS mt, avg(latency_ms) AS l,
    count(*) FILTER (failed) / count(*) AS e, count(*) FILTER (abs(old - new) > 0.3) / count(*) AS x FROM p GROUP BY phase),
i AS (SELECT *, concat_ws(',', CASE WHEN hours < 24 THEN 'duration' END, CASE WHEN n < 1000 THEN 'comparisons' END, CASE WHEN d > 0.15 THEN 'signal_diff' END, CASE WHEN mt < 0.85 THEN 'regime_match' END,
  CASE WHEN l > 10 THEN 'latency' END, CASE WHEN e > 0.01 THEN 'error_rate' END, CASE WHEN x > 0.05 THEN 'discrepancy_rate' END) AS issues FROM m)
SELECT phase, n AS comparisons, round(d, 4) + 0.0 AS mean_diff, round(x, 4) + 0.0 AS discrepancy_rate, issues, issues = '' AS passed,
  CASE WHEN issues <> '' THEN phase WHEN phase = 'phase_4' THEN 'completed' ELSE 'phase_' || CAST(CAST(right(phase, 1) AS INT) + 1 AS VARCHAR) END AS next FROM i""")
def _rollout(spark, sf):
    o = table(spark, sf, "orders")
    p = o.select(
        F.concat(F.lit("phase_"), (F.col("o_custkey") % 4 + 1).cast("string")).alias("phase"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_totalprice") / 500000).alias("old"),
        ((F.col("o_totalprice") + F.col("o_orderkey") % 97 * 1500) / 500000).alias("new"), F.lit("r").alias("old_regime"), F.when(F.col("o_orderkey") % 10 == 0, "s").otherwise("r").alias("new_regime"),
        (F.col("o_orderkey") % 13).cast("double").alias("latency_ms"), (F.col("o_orderkey") % 211 == 0).alias("failed"),
    )
    out = mo.check_criteria(mo.rollout_metrics(p))
    return out.select("phase", "comparisons", tidy("mean_diff").alias("mean_diff"), tidy("discrepancy_rate").alias("discrepancy_rate"), "issues", "passed", mo.next_phase(F.col("phase"), F.col("passed")).alias("next"))


@query("latency_accepted", """WITH l AS (SELECT l_returnflag AS mode, quantile_cont(l_quantity, 0.99) AS before, quantile_cont(l_quantity * (1 + l_suppkey % 10 / 20.0), 0.99) AS after FROM lineitem GROUP BY 1)
SELECT mode, round(after / before, 4) + 0.0 AS ratio, after / before <= 1.2 AS accepted FROM l""")
def _accepted(spark, sf):
    """Tail latencies of two variants, from the quantities of the return flags."""
    from tidemark.operators.statistics import exact_quantiles

    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_quantity").cast("double").alias("before"), (F.col("l_quantity") * (1 + F.col("l_suppkey") % 10 / 20)).cast("double").alias("after"))
    tails = [exact_quantiles(rows, c, [0.99], "mode").select("mode", F.col("p")[0].alias(c)) for c in ("before", "after")]
    out = tails[0].join(tails[1], "mode")
    return out.select("mode", tidy(F.col("after") / F.col("before")).alias("ratio"), mo.latency_accepted(F.col("before"), F.col("after")).alias("accepted"))


@query("health_states", """WITH s AS (SELECT o_orderpriority AS service, CASE WHEN o_orderkey % 50 = 0 AND o_orderstatus = 'P' THEN 2 WHEN o_orderkey % 7 = 0 AND o_custkey % 3 = 0 AND left(o_orderpriority, 1) < '4' THEN 1 ELSE 0 END AS r FROM orders)
SELECT service, ['healthy', 'degraded', 'unhealthy'][max(r) + 1] AS state, count(*) AS checks FROM s GROUP BY service""")
def _worst(spark, sf):
    o = table(spark, sf, "orders")
    state = F.when((F.col("o_orderkey") % 50 == 0) & (F.col("o_orderstatus") == "P"), "unhealthy").when((F.col("o_orderkey") % 7 == 0) & (F.col("o_custkey") % 3 == 0) & (F.left("o_orderpriority", F.lit(1)) < "4"), "degraded").otherwise("healthy")
    return mo.worst_state(o.select(F.col("o_orderpriority").alias("service"), state.alias("state")), "service")


@query("required_sharpe", f"""SELECT n_name AS name, round(({normal_quantile(1 - 1 / 50)!r} + {normal_quantile(0.95)!r}) / sqrt((n_nationkey + 1) * 252 / 4.0), 4) + 0.0 AS required FROM nation""")
def _required(spark, sf):
    n = table(spark, sf, "nation")
    return n.select(F.col("n_name").alias("name"), tidy(mo.required_sharpe(50, (F.col("n_nationkey") + 1) / 4)).alias("required"))


@query("shuffle_test", f"""WITH {_HEALTH}, r AS (SELECT symbol, ts, signal, sentiment, (nxt > 0)::INT AS y FROM h WHERE nxt IS NOT NULL),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r),
d AS (SELECT symbol, signal, sentiment, i, n, trial, CASE WHEN trial = 0 THEN i ELSE (i * CASE WHEN n % 7919 = 0 THEN 7907 ELSE 7919 END + trial * 104729) % n END AS j FROM num, range(11) t(trial)),
x AS (SELECT d.*, g.y, d.i >= floor(d.n * 0.7 + 1e-9) AS test FROM d JOIN num g ON g.symbol = d.symbol AND g.i = d.j),
m AS (SELECT symbol, trial, avg(signal) FILTER (y = 0) AS a0, avg(signal) FILTER (y = 1) AS a1, avg(sentiment) FILTER (y = 0) AS b0, avg(sentiment) FILTER (y = 1) AS b1 FROM x WHERE NOT test GROUP BY 1, 2),
s AS (
  SELECT symbol, trial, avg((CASE WHEN (signal - a1) ** 2 + (sentiment - b1) ** 2 < (signal - a0) ** 2 + (sentiment - b0) ** 2 THEN 1 ELSE 0 END = y)::INT) AS acc FROM x JOIN m USING (symbol, trial) WHERE test GROUP BY 1, 2)
SELECT symbol, round(max(acc) FILTER (trial = 0), 4) + 0.0 AS real_accuracy, round(avg(acc) FILTER (trial > 0), 4) + 0.0 AS shuffled_accuracy, avg(acc) FILTER (trial > 0) > 0.55 AS leakage_suspected FROM s GROUP BY symbol""")
def _shuffled(spark, sf):
    rows = _health(spark, sf).where("ret is not null").select("symbol", "ts", "signal", "sentiment", (F.col("ret") > 0).cast("int").alias("y"))
    out = mo.shuffle_test(rows, ["signal", "sentiment"], "y")
    return out.select("symbol", tidy("real_accuracy").alias("real_accuracy"), tidy("shuffled_accuracy").alias("shuffled_accuracy"), "leakage_suspected")


@query("rollback_tiers", """SELECT o_orderkey, CASE WHEN e > 0.05 OR l > 50 OR d > 0.50 THEN 'critical' WHEN e > 0.01 OR l > 25 OR d > 0.20 THEN 'warning' ELSE 'none' END AS tier
FROM (SELECT o_orderkey, o_orderkey % 9 / 100.0 AS e, o_custkey % 70 AS l, o_orderkey % 61 / 100.0 AS d FROM orders)""")
def _rollback(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", va.rollback_tier(F.col("o_orderkey") % 9 / 100, F.col("o_custkey") % 70, F.col("o_orderkey") % 61 / 100).alias("tier"))


@query("maker_breakeven", "SELECT l_orderkey, l_linenumber, round(l_quantity / 5 / 0.5 * 60, 4) + 0.0 AS seconds FROM lineitem")
def _breakeven(spark, sf):
    """Seconds that a resting order may wait before crossing the spread (in points) is as good."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", tidy(va.breakeven_seconds(F.col("l_quantity").cast("double"))).alias("seconds"))
