"""Sentiment weights that follow the market's regime: classes, the table of weights, smoothing, confidence and session weights."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.recursive import Recurrence

# ---- fixed values: class borders, the default weights and the table (lexicon, model, social) ----
VOLATILITY = (0.015, 0.040)
ENGAGEMENT = (-1.0, 1.0)
DEFAULT = (0.35, 0.65, 0.0)
VOLATILITIES, ENGAGEMENTS, MARKETS = ("low", "normal", "high"), ("low", "normal", "high"), ("Bull", "Bear", "Range")
#: By (volatility, engagement): weights in Bull, Bear and Range markets.
TABLE = {
    ("low", "low"): ((0.50, 0.50, 0.00), (0.50, 0.50, 0.00), (0.50, 0.50, 0.00)),
    ("low", "normal"): ((0.40, 0.60, 0.00), (0.40, 0.60, 0.00), (0.40, 0.60, 0.00)),
    ("low", "high"): ((0.25, 0.50, 0.25), (0.25, 0.50, 0.25), (0.30, 0.50, 0.20)),
    ("normal", "low"): ((0.40, 0.60, 0.00), (0.40, 0.60, 0.00), (0.40, 0.60, 0.00)),
    ("normal", "normal"): ((0.35, 0.65, 0.00), (0.35, 0.65, 0.00), (0.35, 0.65, 0.00)),
    ("normal", "high"): ((0.25, 0.55, 0.20), (0.25, 0.55, 0.20), (0.30, 0.50, 0.20)),
    ("high", "low"): ((0.30, 0.70, 0.00), (0.30, 0.70, 0.00), (0.30, 0.70, 0.00)),
    ("high", "normal"): ((0.25, 0.60, 0.15), (0.25, 0.60, 0.15), (0.30, 0.55, 0.15)),
    ("high", "high"): ((0.20, 0.50, 0.30), (0.25, 0.45, 0.30), (0.20, 0.50, 0.30)),
}
#: How much a source's sentiment counts, by market.
MULTIPLIERS = {
    "Bull": {"news": 0.8, "social": 1.2, "finbert": 0.9, "twitter": 1.3},
    "Bear": {"news": 1.3, "social": 0.7, "finbert": 1.2, "twitter": 0.6},
    "Range": {"news": 1.0, "social": 1.0, "finbert": 1.0, "twitter": 1.0},
}
#: Weight of each hour of the day (UTC), by trading session.
HOURS = (0.6, 0.5, 0.5, 0.5, 0.6, 0.7, 0.8, 0.9, 1.1, 1.2, 1.3, 1.3, 1.5, 1.5, 1.4, 1.4, 1.3, 1.2, 1.1, 1.0, 0.9, 0.8, 0.7, 0.6)


def _class(x: Column, borders: tuple[float, float]) -> Column:
    return F.when(x < borders[0], "low").when(x > borders[1], "high").otherwise("normal")


def volatility_class(atr: Column) -> Column:
    """Of the average true range as a share of the price."""
    return _class(atr, VOLATILITY)


def engagement_class(z: Column) -> Column:
    """Of the z-score of social volume."""
    return _class(z, ENGAGEMENT)


def place(volatility: Column, engagement: Column, market: Column) -> Column:
    """Number of a combination of classes, from 0 to 26."""
    index = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), c) - 1
    return (index(volatility, VOLATILITIES) * 9 + index(engagement, ENGAGEMENTS) * 3 + index(market, MARKETS)).cast("int")


def target(place_: Column) -> Column:
    """Array of the three weights of a combination; the default where it is none of the table's."""
    rows = F.array(*[F.array(*[F.lit(w) for w in TABLE[v, e][m]]) for v in VOLATILITIES for e in ENGAGEMENTS for m in range(3)])
    return F.coalesce(F.get(rows, place_), F.array(*[F.lit(w) for w in DEFAULT]))


def _follow(least: int, rate: float, cap: float, s, x):
    key, *goal = x
    held, lasted, weights, moves = s or [None, 0, list(DEFAULT), 0]
    lasted = lasted + 1 if key == held else 0
    if lasted >= least:
        new = [w + max(-cap, min(cap, rate * (g - w))) for w, g in zip(weights, goal)]
        total = sum(new)
        new = [v / total for v in new] if total > 0 else new
        moves += new != weights
        weights = new
    return [key, lasted, weights, moves], (*weights, float(lasted), float(moves))


def followed_weights(key: str, goals: tuple[str, str, str], least: int = 5, rate: float = 0.1, cap: float = 0.15) -> Recurrence:
    """Weights that move to the combination's by a capped share a row, once it has lasted ``least`` rows; they keep the sum 1."""
    return Recurrence(partial(_follow, least, rate, cap), (key, *goals), ("w_lexicon", "w_model", "w_social", "lasted", "moves"))


def regime_multiplier(market: Column, source: Column) -> Column:
    """1 for a market or source that the table lacks."""
    out = F.lit(1.0)
    for m, by_source in MULTIPLIERS.items():
        for name, value in by_source.items():
            out = F.when((market == m) & (source == name), F.lit(value)).otherwise(out)
    return out


def hour_weight(ts: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in HOURS]), F.hour(ts))


def confidence_weighted(rows: DataFrame, by: str) -> DataFrame:
    """Score by ``by`` with weights (of the source's kind) * confidence ** 2; rows have source, score, confidence, w_lexicon, w_model, w_social."""
    base = F.when(F.col("source") == "vader", F.col("w_lexicon")).when(F.col("source").isin("news", "finbert", "bloomberg", "reuters"), F.col("w_model")).otherwise(F.col("w_social"))
    w = base * F.col("confidence") * F.col("confidence")
    out = rows.withColumn("_w", w).groupBy(by).agg(F.sum(F.col("score") * F.col("_w")).alias("_s"), F.sum("_w").alias("_t"))
    return out.select(by, F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(0.0).alias("score"))
