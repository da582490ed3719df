"""Evidence and signal fusion: Dempster-Shafer masses, fuzzy rules, ensembles, nearest centroids, regime weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import clip, last, over

#: Subsets of the frame as bit masks: 1 bullish, 2 bearish, 4 neutral; 7 is the whole frame.
MASKS = range(1, 8)
NAMES = {1: "bullish", 2: "bearish", 4: "neutral"}


def vacuous() -> list[Column]:
    """Mass by mask, all of it on the frame."""
    return [F.lit(0.0)] * 6 + [F.lit(1.0)]


def evidence(masses: dict[int, Column]) -> list[Column]:
    """Masses by mask; what is left goes to the frame."""
    rest = F.lit(1.0)
    for m in masses.values():
        rest = rest - m
    return [masses.get(m, F.lit(0.0)) for m in range(1, 7)] + [masses.get(7, F.lit(0.0)) + F.greatest(F.lit(0.0), rest)]


def combine(a: Column, b: Column) -> Column:
    """Dempster's rule on two arrays of seven masses: struct(m, conflict). Total conflict resets to the frame."""
    cells = {m: F.lit(0.0) for m in range(8)}
    for x in MASKS:
        for y in MASKS:
            cells[x & y] = cells[x & y] + F.get(a, x - 1) * F.get(b, y - 1)
    conflict = cells[0]
    m = F.array(*[F.when(conflict < 1 - 1e-12, cells[k] / (1 - conflict)).otherwise(1.0 if k == 7 else 0.0) for k in MASKS])
    return F.struct(m.alias("m"), conflict.alias("conflict"))


def beliefs(m: Column) -> dict[str, Column]:
    """Belief and plausibility of each single outcome."""
    out = {}
    for bit, name in NAMES.items():
        out[f"bel_{name}"] = F.get(m, bit - 1)
        held = F.lit(0.0)
        for k in MASKS:
            if k & bit:
                held = held + F.get(m, k - 1)
        out[f"pl_{name}"] = held
    return out


def dempster_shafer(df: DataFrame, sources: list[dict[int, Column]], least: float = 0.4, most_doubt: float = 0.5) -> DataFrame:
    """Combine the sources' masses row by row: beliefs, plausibilities, decision (ties in the order bullish, bearish, neutral), gate and signal."""
    out = df.withColumn("_m", F.array(*evidence(sources[0]))).withColumn("conflict", F.lit(0.0))
    for s in sources[1:]:
        out = out.withColumn("_e", F.array(*evidence(s))).withColumn("_c", combine(F.col("_m"), F.col("_e")))
        out = out.withColumns({"_m": F.col("_c.m"), "conflict": F.col("_c.conflict")})
    out = out.withColumns(beliefs(F.col("_m"))).drop("_e", "_c", "_m")
    bel = [F.col(f"bel_{n}") for n in NAMES.values()]
    top = F.greatest(*bel)
    decision = F.when(bel[0] == top, "bullish").when(bel[1] == top, "bearish").otherwise("neutral")
    doubt = {n: F.col(f"pl_{n}") - F.col(f"bel_{n}") for n in NAMES.values()}
    of = F.when(decision == "bullish", doubt["bullish"]).when(decision == "bearish", doubt["bearish"]).otherwise(doubt["neutral"])
    reason = F.when(decision == "neutral", "neutral").when(of > most_doubt, "uncertain").when(top < least, "weak").when(F.col("conflict") > 0.5, "conflict").otherwise("trade")
    return out.select("*", decision.alias("decision"), of.alias("uncertainty"), reason.alias("gate"), ((bel[0] - bel[1]) * (1 - F.greatest(doubt["bullish"], doubt["bearish"]))).alias("signal"))


# ---- fuzzy logic ----
# fixed values: the sets of each variable, the rules and the centres of the output sets
SETS = {
    "rsi": {"oversold": (0, 0, 25, 35), "neutral": (25, 50, 75), "overbought": (65, 75, 100, 100)},
    "momentum": {"negative": (-2, -2, -1, 0), "neutral": (-0.5, 0, 0.5), "positive": (0, 1, 2, 2)},
    "volatility": {"low": (0, 0, 0.01, 0.02), "medium": (0.01, 0.03, 0.05), "high": (0.04, 0.06, 0.1, 0.1)},
    "trend": {"down": (-1, -1, -0.5, 0), "flat": (-0.3, 0, 0.3), "up": (0, 0.5, 1, 1)},
}
RULES = (
    ("strong_buy", 1.0, (("rsi", "oversold"), ("momentum", "positive"))),
    ("strong_buy", 0.8, (("trend", "up"), ("momentum", "positive"), ("volatility", "low"))),
    ("buy", 0.6, (("momentum", "positive"), ("volatility", "medium"))),
    ("buy", 0.5, (("rsi", "neutral"), ("trend", "up"))),
    ("neutral", 0.7, (("volatility", "high"),)),
    ("neutral", 0.8, (("trend", "flat"), ("momentum", "neutral"))),
    ("sell", 0.6, (("momentum", "negative"), ("volatility", "medium"))),
    ("sell", 0.5, (("rsi", "neutral"), ("trend", "down"))),
    ("strong_sell", 1.0, (("rsi", "overbought"), ("momentum", "negative"))),
    ("strong_sell", 0.8, (("trend", "down"), ("momentum", "negative"), ("volatility", "low"))),
)
CENTRES = {"strong_sell": -0.875, "sell": -0.5, "neutral": 0.0, "buy": 0.5, "strong_buy": 0.875}


def triangle(x: Column, a: float, b: float, c: float) -> Column:
    up = (x - a) / (b - a) if b != a else F.lit(1.0)
    down = (c - x) / (c - b) if c != b else F.lit(1.0)
    return F.when((x <= a) | (x >= c), 0.0).when(x <= b, up).otherwise(down)


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    up = (x - a) / (b - a) if b != a else F.lit(1.0)
    down = (d - x) / (d - c) if d != c else F.lit(1.0)
    return F.when((x < a) | (x > d), 0.0).when(x < b, up).when(x <= c, 1.0).otherwise(down)


def gaussian(x: Column, centre: float, width: float) -> Column:
    return F.exp(-((x - centre) * (x - centre)) / (2 * width * width))


def sigmoid(x: Column, slope: float = 1.0, centre: float = 0.0) -> Column:
    return 1 / (1 + F.exp(-slope * (x - centre)))


def memberships(inputs: dict[str, Column]) -> dict[tuple[str, str], Column]:
    """Membership of every set of the given inputs; a null or missing input belongs to none."""
    shape = lambda x, p: triangle(x, *p) if len(p) == 3 else trapezoid(x, *p)
    return {(v, s): F.coalesce(shape(inputs[v], p), F.lit(0.0)) for v, sets in SETS.items() if v in inputs for s, p in sets.items()}


def fuzzy_signal(inputs: dict[str, Column]) -> Column:
    """Least membership of each rule times its weight, greatest by output set, weighted centre."""
    m = memberships(inputs)
    fired: dict[str, list[Column]] = {}
    for out, weight, parts in RULES:
        values = [m.get(p, F.lit(0.0)) for p in parts]
        fired.setdefault(out, []).append((F.least(*values) if len(values) > 1 else values[0]) * weight)
    strength = {k: F.greatest(*v) if len(v) > 1 else v[0] for k, v in fired.items()}
    over_, under = F.lit(0.0), F.lit(0.0)
    for k, v in strength.items():
        over_, under = over_ + v * CENTRES[k], under + v
    return F.when(under < 1e-10, 0.0).otherwise(over_ / under)


# ---- ensembles ----


def ensemble(p: Column, weights: list[float] | None = None, bias: float = 0.0) -> Column:
    """struct(p, agreement, direction, strength, voting share): logistic pooling of an array of probabilities."""
    w = F.transform(p, lambda x: F.lit(1.0)) if weights is None else F.array(*[F.lit(float(x)) for x in weights])
    logit = F.transform(p, lambda x: F.ln(clip(x, 0.01, 0.99) / (1 - clip(x, 0.01, 0.99))))
    pooled = sigmoid(F.aggregate(F.zip_with(logit, w, lambda a, b: a * b), F.lit(bias), lambda t, x: t + x))
    n = F.size(p)
    mean = F.aggregate(p, F.lit(0.0), lambda t, x: t + x) / n
    std = F.sqrt(F.aggregate(p, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / n)
    votes = F.size(F.filter(p, lambda x: x > 0.5)) / n
    return F.struct(
        pooled.alias("p"), F.greatest(F.lit(0.0), 1 - 2 * std).alias("agreement"), F.when(pooled > 0.5, "bullish").otherwise("bearish").alias("direction"),
        (F.abs(pooled - 0.5) * 2).alias("strength"), votes.alias("votes"), (2 * F.abs(votes - 0.5)).alias("vote_agreement"),
    )


def lorentzian(x: Column, y: Column) -> Column:
    """Sum of ln(1 + |difference|)."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.log1p(F.abs(a - b))), F.lit(0.0), lambda t, v: t + v)


def centroid_vote(points: DataFrame, centroids: DataFrame, k: int = 20) -> DataFrame:
    """Bullish probability from the k nearest centroids (a bounded parameter table) by Lorentzian distance.

    points: id, x (array); centroids: cid, c (array), label. Weights are 1 / (1 + distance).
    """
    table = F.broadcast(centroids.agg(F.sort_array(F.collect_list(F.struct("cid", "c", "label"))).alias("cs")))
    d = points.join(table).select("id", F.slice(F.array_sort(F.transform("cs", lambda c: F.struct(lorentzian(F.col("x"), c["c"]).alias("d"), c["cid"].alias("cid"), c["label"].alias("label")))), 1, k).alias("near"))
    total = F.aggregate("near", F.lit(0.0), lambda t, n: t + 1 / (1 + n["d"]))
    up = F.aggregate("near", F.lit(0.0), lambda t, n: t + F.when(n["label"] == 1, 1 / (1 + n["d"])).otherwise(0.0))
    return d.select("id", (up / total).alias("p_bullish"), F.get("near", 0)["d"].alias("nearest"))


def prediction_volatility(df: DataFrame, x: str, order: tuple[str, ...], n: int = 100) -> DataFrame:
    return df.withColumn("volatility", F.stddev_pop(x).over(last(n, *order)))


def agreement_score(own: Column, others: Column) -> Column:
    """1 where a prediction and an array of others agree, less twice their deviation, 0 at least."""
    every = F.concat(F.array(own), others)
    mean = F.aggregate(every, F.lit(0.0), lambda t, x: t + x) / F.size(every)
    std = F.sqrt(F.aggregate(every, F.lit(0.0), lambda t, x: t + (x - mean) * (x - mean)) / F.size(every))
    return F.greatest(F.lit(0.0), 1 - 2 * std)


# ---- regime-aware weights ----
# fixed values: multipliers by regime, in the order of CATEGORIES
CATEGORIES = ("momentum", "mean_reversion", "trend_following", "breakout", "volume")
MULTIPLIERS = {"Bull": (1.5, 0.4, 1.3, 1.4, 1.2), "Bear": (1.2, 0.6, 1.1, 0.8, 1.0), "Range": (0.3, 1.8, 0.2, 0.5, 0.7)}


def regime_runs(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Length of the current run of equal regimes: gaps and islands."""
    changed = F.coalesce((F.col(regime) != F.lag(regime).over(over())).cast("int"), F.lit(1))
    runs = df.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(over()))
    return runs.withColumn("duration", F.row_number().over(over(by=("symbol", "_run")))).drop("_c", "_run")


def regime_fusion(df: DataFrame, signals: dict[str, tuple[str, float]], sure: float = 0.7, least: int = 5) -> DataFrame:
    """Clipped signals weighted by base weight times the regime's multiplier for their category.

    Multipliers count only in a regime of confidence ``sure`` that has lasted ``least`` rows; a null signal has no weight.
    """
    trusted = (F.col("confidence") >= sure) & (F.col("duration") >= least)

    def multiplier(category: str) -> Column:
        if category not in CATEGORIES:
            return F.lit(1.0)
        m = F.lit(1.0)
        for regime, values in MULTIPLIERS.items():
            m = F.when(F.col("regime") == regime, F.lit(values[CATEGORIES.index(category)])).otherwise(m)
        return F.when(trusted, m).otherwise(1.0)

    top, under = F.lit(0.0), F.lit(0.0)
    for name, (category, base) in signals.items():
        w = F.when(F.col(name).isNotNull(), base * multiplier(category)).otherwise(0.0)
        top, under = top + F.coalesce(clip(F.col(name), -1, 1), F.lit(0.0)) * w, under + w
    return df.withColumn("fused", F.when(under > 0, top / under).otherwise(0.0)).withColumn("tradable", trusted)
