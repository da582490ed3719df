"""The integrated signal layer: bars, books, sentiment and risk in one plan to a gated composite signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import indicators as ind, recursive as rec, risk
from tidemark.operators.fusion import regime_fusion, regime_runs
from tidemark.operators.statistics import horizon_momentum, log_return

# ---- fixed values: category and base weight of each component ----
COMPONENTS = {
    "momentum_5": ("momentum", 1.0),
    "momentum_21": ("trend_following", 1.2),
    "momentum_63": ("trend_following", 1.5),
    "obi_normalized": ("volume", 1.5),
    "rsi_signal": ("mean_reversion", 1.0),
    "sentiment_current": ("sentiment", 1.0),
    "news_lag_30m": ("sentiment", 0.8),
    "news_lag_60m": ("sentiment", 0.7),
    "news_lag_90m": ("sentiment", 0.6),
    "news_lag_120m": ("sentiment", 0.5),
    "news_lag_180m": ("sentiment", 0.4),
    "sentiment_acceleration": ("sentiment", 0.9),
}
STATES = ("Bull", "Bear", "Range")


def rsi_signal(rsi: Column) -> Column:
    """Oversold is positive, overbought negative, between them 0."""
    return F.when(rsi < 30, (30 - rsi) / 30).when(rsi > 70, (70 - rsi) / 30).when(rsi.isNotNull(), 0.0)


def action(score: Column) -> Column:
    return F.when(score >= 0.9, "HALT").when(score >= 0.7, "CLOSE_ONLY").when(score >= 0.5, "REDUCE").otherwise("NORMAL")


def components(bars: DataFrame, flow: DataFrame | None = None, sentiment: DataFrame | None = None) -> DataFrame:
    """symbol, ts and the components of each bar, with the regime, its confidence and duration.

    flow (symbol, ts, obi_normalized) and sentiment (symbol, ts, sentiment_current and lags) have
    one row a bar; a bar that they lack has null components, which carry no weight.
    """
    b = horizon_momentum(ind.simple_rsi(log_return(bars)))
    b = b.select("symbol", "ts", "ret", rsi_signal(F.col("rsi")).alias("rsi_signal"), *[F.col(f"mom_{h}_z").alias(f"momentum_{h}") for h in (5, 21, 63)])
    p = rec.scan(b.select("symbol", "ts", (F.col("ret") / 100).alias("ret")), rec.regime_forward())
    state = F.element_at(F.array(*[F.lit(s) for s in STATES]), F.col("state").cast("int") + 1)
    p = regime_runs(p.select("symbol", "ts", state.alias("regime"), F.greatest("p_bull", "p_bear", "p_range").alias("confidence")))
    out = b.drop("ret").join(p, ["symbol", "ts"])
    for side in (flow, sentiment):
        if side is not None:
            out = out.join(side, ["symbol", "ts"], "left")
    return out


def integrate(parts: DataFrame, risks: DataFrame | None = None, sure: float = 0.7, least: int = 5) -> DataFrame:
    """The composite of ``components`` under the regime's weights, gated by the risk score of (symbol, ts, score); without one the score is 0."""
    known = {c: w for c, w in COMPONENTS.items() if c in parts.columns}
    out = regime_fusion(parts, known, sure, least)
    out = out.join(risks.select("symbol", "ts", F.col("score").alias("risk_score")), ["symbol", "ts"], "left") if risks is not None else out.withColumn("risk_score", F.lit(None).cast("double"))
    out = out.withColumn("risk_score", F.coalesce("risk_score", F.lit(0.0)))
    return out.select("*", risk.gate(F.col("risk_score")).alias("position_multiplier"), action(F.col("risk_score")).alias("risk_action")).withColumnRenamed("fused", "composite")
