"""The 60-slot feature vector: one projection over windowed and recursive operators, and its checks.

Priority per slot: the indicator's value, else a plain fallback, else a constant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import clip, running, z_score
from tidemark.operators import indicators as ind, recursive as rec
from tidemark.operators.fusion import dempster_shafer
from tidemark.operators.microstructure import book_features, order_flow
from tidemark.operators.statistics import log_return, running_relation

# ---- fixed values: the slots' names, in order ----
SLOTS = (
    "jma_smoothed_price", "jma_velocity", "hma_value", "ehlers_trend_strength", "hurst_exponent", "kama_adaptive_value", "ehlers_trend_direction", "alma_trend_quality",
    "fisher_rsi", "fisher_rsi_signal", "mesa_macd", "mesa_macd_histogram", "ehlers_stoch_k", "ehlers_roofing", "dema_cci", "williams_r",
    "garch_volatility", "garch_regime", "hmm_bull_prob", "hmm_bear_prob", "hmm_range_prob", "ehlers_atr_pct", "keltner_pct_b", "volatility_trend",
    "volume_delta", "cvd_normalized", "cvd_divergence", "rvol_zscore", "obi_imbalance", "obi_trend", "volume_momentum", "volume_breakout_score", "buying_pressure", "selling_pressure",
    "price_percentile", "realized_vol_vs_garch", "skewness_realized", "kurtosis_realized", "correlation_btc", "correlation_strength", "mean_reversion_score", "autocorrelation",
    "dempster_shafer_confidence", "signal_conflict_level", "drawdown_forecast", "regime_stability",
    "liquidity_score", "spread_normalized", "impact_estimate", "execution_risk",
    "flow_obi_current", "flow_obi_ema", "flow_cvd_normalized", "flow_cvd_divergence", "flow_microprice_dev", "flow_vpin", "flow_spread_zscore", "flow_lob_imbalance", "flow_trade_intensity", "flow_aggressive_ratio",
)


def relative(v: Column, price: Column) -> Column:
    """tanh of ten times the distance from the price, by the price."""
    return F.when(price != 0, F.tanh((v - price) / price * 10)).otherwise(0.0)


def base_relation(bars: DataFrame, base: str) -> DataFrame:
    """symbol, ts and the running correlation (corr) of each symbol's returns with those of ``base`` at the same times."""
    r = log_return(bars).select("symbol", "ts", "ret")
    met = r.join(r.where(F.col("symbol") == base).select("ts", F.col("ret").alias("base_ret")), "ts")
    return running_relation(met, "base_ret", "ret").select("symbol", "ts", "corr")


def flow_slots(trades: DataFrame, books: DataFrame, unit: str = "hour") -> DataFrame:
    """symbol, ts (begin of the bar) and the order-flow slots as they stand at the bar's end.

    trades are those of ``order_flow``; books have symbol, ts, book_id, bids and asks.
    """
    ts = F.date_trunc(unit, "ts").alias("bar")
    t = order_flow(trades).select("symbol", ts, F.struct("ts", "event_id").alias("at"), *[F.col(c).alias(f"flow_{s}") for c, s in (("cvd_z", "cvd_normalized"), ("divergence", "cvd_divergence"), ("vpin", "vpin"), ("intensity_z", "trade_intensity"), ("aggressive", "aggressive_ratio"))])
    b = book_features(books).withColumn("spread_z", clip(z_score(F.col("spread"), running("ts", "book_id")), -5, 5))
    smooth = rec.scan(b.select("symbol", "ts", "book_id", "obi"), rec.ema("obi", 2 / 21, "obi_ema"), order=("ts", "book_id"))
    b = b.join(smooth, ["symbol", "ts", "book_id"]).select("symbol", ts, F.struct("ts", "book_id").alias("at"), *[F.col(c).alias(f"flow_{s}") for c, s in (("obi", "obi_current"), ("obi_ema", "obi_ema"), ("micro_dev", "microprice_dev"), ("spread_z", "spread_zscore"), ("lob_imbalance", "lob_imbalance"))])
    last = lambda df: df.groupBy("symbol", "bar").agg(*[F.max_by(c, "at").alias(c) for c in df.columns if c.startswith("flow_")])
    return last(t).join(last(b), ["symbol", "bar"], "full").withColumnRenamed("bar", "ts")


def assemble(bars: DataFrame, base: str | None = None) -> DataFrame:
    """symbol, ts and the 60 slots of each bar, none of which reads a later bar.

    Order-flow slots hold their defaults until joined by ``with_flow``; the correlation slots
    are 0 without a ``base`` symbol or where it has no bar. Slots that stand for measures not
    defined here (volatility trend, CVD divergence of bars, volume momentum, skewness, kurtosis,
    autocorrelation, drawdown forecast, spread, impact, execution) are 0 by definition.
    """
    b = log_return(bars).withColumn("typical", (F.col("high") + F.col("low") + F.col("close")) / 3)
    b = ind.relative_volume(ind.volume_delta(ind.true_range(ind.simple_rsi(ind.raw_stochastic(ind.williams_r(b))))))
    b = ind.alma(ind.hull(b, "close", 21, "hma_21"), "close")
    steps = [
        rec.jma(n=21, name="jma_21"), rec.jma(n=5, name="jma_5"), rec.jma(n=10, name="jma_10"), rec.jma("pressure", 10, warm=False, name="pressure_jma"), rec.kama(), rec.kalman(),
        rec.trendline(), rec.moving_hurst(), rec.fisher(), rec.mesa_macd(), rec.stochastic(), rec.roofing(), rec.dema_cci(), rec.garch(), rec.regime_forward(), rec.smoothed_tr(),
        rec.jma("typical", 20, name="keltner_mid"), rec.relative_position(name="rank"),
    ]
    r = rec.scan_all(b, steps)
    x = b.join(r, ["symbol", "ts"])
    x = x.join(base_relation(bars, base), ["symbol", "ts"], "left") if base is not None else x.withColumn("corr", F.lit(None).cast("double"))
    # evidence of the momentum slot alone, combined with a vacuous frame
    fisher = F.coalesce(F.tanh("fisher_rsi"), 2 * F.col("p_bull") - 1)
    x = dempster_shafer(x.withColumn("_fisher", fisher), [{1: F.col("_fisher") / 2 + 0.5, 2: (1 - F.col("_fisher")) / 2}])
    p, c = F.col("close"), F.col
    or_ = lambda v, other: F.coalesce(v, other if isinstance(other, Column) else F.lit(float(other)))
    band = 2 * c("smoothed_tr")
    bullish = 2 * c("p_bull") - 1
    values = {
        "jma_smoothed_price": or_(relative(c("jma_21"), p), relative(c("kalman"), p)),
        "jma_velocity": or_((c("jma_5") - c("jma_10")) / (0.01 * p), 0),
        "hma_value": or_(relative(c("hma_21"), p), 0),
        "ehlers_trend_strength": or_(F.least(F.lit(1.0), c("trend_strength") / 50), 0.5),
        "hurst_exponent": 2 * c("hurst") - 1,
        "kama_adaptive_value": or_(relative(c("kama"), p), 0),
        "ehlers_trend_direction": or_(c("trend_direction"), F.signum(c("ret"))),
        "alma_trend_quality": or_(relative(c("alma"), p), 0.5),
        "fisher_rsi": or_(F.tanh(c("fisher_rsi")), bullish),
        "fisher_rsi_signal": or_(F.tanh(c("fisher_signal")), 0),
        "mesa_macd": or_(F.tanh(c("mesa_macd") / (0.01 * p)), 0),
        "mesa_macd_histogram": or_(F.tanh(c("mesa_histogram") / (0.001 * p)), 0),
        "ehlers_stoch_k": or_((c("stoch_k") - 50) / 50, 0),
        "ehlers_roofing": or_(F.tanh(100 * c("roofing")), c("ret") / 0.01),
        "dema_cci": or_(F.tanh(c("dema_cci") / 200), F.tanh(100 * c("ret"))),
        "williams_r": or_((c("williams_r") + 50) / 50, 0.5),
        "garch_volatility": F.least(F.lit(1.0), c("garch") / 0.05),
        "garch_regime": F.when(c("garch_ratio") < 0.7, -1.0).when(c("garch_ratio") > 1.5, 1.0).otherwise(0.0),
        "hmm_bull_prob": c("p_bull"),
        "hmm_bear_prob": c("p_bear"),
        "hmm_range_prob": c("p_range"),
        "ehlers_atr_pct": or_(F.least(F.lit(1.0), c("smoothed_tr") / p * 100 / 5), 0),
        "keltner_pct_b": or_(F.when(band > 0, 2 * (p - c("keltner_mid") + band) / (2 * band) - 1), 0),
        "volume_delta": F.tanh(c("delta") / (c("volume") + 1)),
        "cvd_normalized": F.tanh(c("cvd") / 1e6),
        "rvol_zscore": F.tanh(c("rvol_z") / 3),
        "obi_imbalance": c("pressure"),
        "obi_trend": c("pressure_jma"),
        "volume_breakout_score": (F.tanh(c("rvol_z") / 3) > 0.5).cast("double"),
        "buying_pressure": F.greatest(F.lit(0.0), c("pressure")),
        "selling_pressure": F.greatest(F.lit(0.0), -c("pressure")),
        "price_percentile": 2 * c("rank") - 1,
        "mean_reversion_score": -or_(c("trend_direction"), F.signum(c("ret"))),
        "correlation_btc": or_(c("corr"), 0),
        "correlation_strength": or_(F.abs(c("corr")), 0),
        "dempster_shafer_confidence": 1 - c("uncertainty"),
        "signal_conflict_level": c("conflict"),
        "regime_stability": F.abs(c("p_bull") - c("p_bear")),
        "liquidity_score": F.lit(0.5),
        "flow_aggressive_ratio": F.lit(0.5),
    }
    return x.select("symbol", "ts", *[values.get(s, F.lit(0.0)).cast("double").alias(s) for s in SLOTS])


def with_flow(vectors: DataFrame, flow: DataFrame) -> DataFrame:
    """Order-flow slots from flow (symbol, ts and any of the flow_* columns) where a row is there."""
    have = [c for c in flow.columns if c in SLOTS]
    f = flow.select("symbol", "ts", *[F.col(c).alias(f"_{c}") for c in have])
    joined = vectors.join(f, ["symbol", "ts"], "left")
    return joined.select("symbol", "ts", *[F.coalesce(F.col(f"_{s}"), F.col(s)).alias(s) if s in have else F.col(s) for s in SLOTS])


def vector_report(vectors: DataFrame) -> DataFrame:
    """symbol, ts and of each vector: nonzero slots, mean, population deviation, extremes, and what is wrong with it."""
    v = F.array(*SLOTS)
    x = vectors.select("symbol", "ts", v.alias("v"))
    n = len(SLOTS)
    clean = F.transform("v", lambda e: F.coalesce(F.when(F.isnan(e), None).otherwise(e), F.lit(0.0)))
    mean = F.aggregate(clean, F.lit(0.0), lambda t, e: t + e) / n
    x = x.select("*", clean.alias("c")).withColumn("mean", mean)
    std = F.sqrt(F.aggregate("c", F.lit(0.0), lambda t, e: t + (e - F.col("mean")) * (e - F.col("mean"))) / n)
    zeros = F.size(F.filter("c", lambda e: e == 0))
    faults = F.array_compact(
        F.array(
            F.when(F.exists("v", lambda e: e.isNull() | F.isnan(e)), F.lit("nan")), F.when(F.exists("c", lambda e: F.abs(e) == float("inf")), F.lit("inf")),
            F.when(F.exists("c", lambda e: F.abs(e) > 10), F.lit("large")), F.when(zeros > 30, F.lit("sparse")),
        )
    )
    return x.select("symbol", "ts", (n - zeros).alias("nonzero"), "mean", std.alias("std"), F.array_min("c").alias("least"), F.array_max("c").alias("most"), F.array_join(faults, ",").alias("faults"))
