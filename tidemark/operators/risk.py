"""Systemic-risk signals, their composite and the decisions that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.columns import clip, last, over, ratio, running

SIGNALS = ("fsi", "lei", "ods", "scsi", "lci", "caci")
# ---- fixed values: weights of the six signals by regime, in the order of SIGNALS ----
WEIGHTS = {
    "normal": (0.25, 0.30, 0.15, 0.15, 0.10, 0.05),
    "leverage_saturation": (0.35, 0.30, 0.10, 0.10, 0.10, 0.05),
    "oracle_failure": (0.10, 0.20, 0.35, 0.25, 0.05, 0.05),
    "tradfi_contagion": (0.25, 0.20, 0.10, 0.10, 0.05, 0.30),
}
# ---- fixed values: funding thresholds by volatility regime ----
FUNDING = {"LOW": 0.0010, "MEDIUM": 0.00125, "HIGH": 0.0015}


def volatility_regime(vix: Column) -> Column:
    return F.when(vix < 20, "LOW").when(vix > 30, "HIGH").otherwise("MEDIUM")


def funding_saturation(rates: DataFrame, keep: int = 63, span: int = 6) -> DataFrame:
    """fsi of funding rates (symbol, ts, rate, regime): adjusted exponential mean by the regime's threshold, plus a penalty for rising rates."""
    frame = F.collect_list("rate").over(last(keep))
    decay = 1 - 2 / (span + 1)
    r = rates.withColumn("h", F.reverse(frame))
    # weights decay**i from the newest on, divided by their sum
    sums = F.aggregate(
        "h",
        F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(1.0).alias("f")),
        lambda s, x: F.struct((s["w"] + s["f"]).alias("w"), (s["x"] + s["f"] * x).alias("x"), (s["f"] * decay).alias("f")),
    )
    mean = sums["x"] / sums["w"]
    limit = F.lit(FUNDING["MEDIUM"])
    for name, value in FUNDING.items():
        limit = F.when(F.col("regime") == name, F.lit(value)).otherwise(limit)
    # mean gradient of the last three: its ends are one-sided, so it is the mean of both steps
    a, b, c = F.get("h", 0), F.get("h", 1), F.get("h", 2)
    slope = ((a - b) + (a - c) / 2 + (b - c)) / 3
    score = F.least(F.lit(1.0), clip(F.abs(mean) / limit, 0, 1) + F.when(slope > 1e-4, 0.2).otherwise(0.0))
    enough = F.size("h") >= 6
    return r.select("*", F.when(enough, mean).alias("ema_rate"), F.when(enough, score).otherwise(0.0).alias("fsi"), F.when(~enough, "insufficient_data").when(mean > 0, "LONG_HEAVY").when(mean < 0, "SHORT_HEAVY").otherwise("NEUTRAL").alias("direction")).drop("h")


def liquidity_evaporation(depths: DataFrame, keep: int = 10_080, least: int = 1440, weekend: float = 0.7) -> DataFrame:
    """lei of depth observations (symbol, ts, depth): share gone of the long mean, plus a penalty for a fast fall by the hour."""
    # the long mean is a difference of running sums: its work doesn't grow with ``keep``
    w = over()
    depths = depths.select("*", F.sum("depth").over(running()).alias("_sum"), F.count("depth").over(running()).alias("_count"), F.row_number().over(w).alias("_row"))
    held = lambda c: F.col(c) - F.coalesce(F.lag(c, keep).over(w), F.lit(0))
    depths = depths.withColumn("_mean", held("_sum") / held("_count")).withColumn("_seen", F.least(F.col("_row"), F.lit(keep)))
    base = F.col("_mean") * F.when(F.weekday("ts") >= 5, weekend).otherwise(1.0)
    gone = F.when(base > 0, clip(1 - F.col("depth") / base, 0, 1)).otherwise(1.0)
    step = F.col("depth") / F.lag("depth").over(over()) - 1
    d = depths.withColumn("step", step)
    speed = F.avg("step").over(last(5))
    enough = F.col("_seen") >= least
    return d.select("*", F.when(enough, F.least(F.lit(1.0), gone + F.when(speed < -0.05, 0.3).otherwise(0.0))).otherwise(0.0).alias("lei")).drop("step", "_sum", "_count", "_row", "_mean", "_seen")


def venue_divergence(prices: DataFrame, by: str = "symbol") -> DataFrame:
    """ods of venue prices: the larger of the greatest deviation and the range, by the mean; needs two venues."""
    p = prices.where("price is not null")
    mean = p.groupBy(by).agg(F.avg("price").alias("mean"), F.count(F.lit(1)).alias("venues"), (F.max("price") - F.min("price")).alias("width"))
    d = p.join(mean, by).withColumn("away", F.abs(F.col("price") - F.col("mean")))
    out = d.groupBy(by, "mean", "venues", "width").agg(F.max("away").alias("away"), F.max_by("venue", F.struct("away", (-F.col("venue")).alias("v"))).alias("worst"))
    score = F.when(F.col("venues") >= 2, clip(F.greatest("away", "width") / F.col("mean") / 0.05, 0, 1)).otherwise(0.0)
    return out.select(by, "venues", score.alias("ods"), F.when(F.col("venues") >= 2, F.col("worst")).alias("worst"))


def stablecoin_stress(prices: DataFrame) -> DataFrame:
    """scsi over all coins of venue prices (coin, venue, price): worst depeg or venue spread and the kind of failure."""
    coins = prices.where("price is not null").groupBy("coin").agg(
        F.least(F.lit(1.0), F.abs(F.avg("price") - 1) / 0.05).alias("protocol"),
        F.when(F.count(F.lit(1)) >= 2, F.least(F.lit(1.0), (F.max("price") - F.min("price")) / 0.02)).otherwise(0.0).alias("venue"),
    )
    worst = lambda c: F.max_by("coin", c)
    out = coins.agg(F.max("protocol").alias("p"), F.max("venue").alias("v"), worst("protocol").alias("worst_p"), worst("venue").alias("worst_v"), F.count(F.lit(1)).alias("coins"))
    p, v = F.col("p"), F.col("v")
    kind = F.when((p > v) & (p > 0.3), "PROTOCOL_LEVEL").when((v > p) & (v > 0.3), "VENUE_SPECIFIC").otherwise("NONE")
    return out.select("coins", p.alias("protocol"), v.alias("venue"), F.coalesce(F.greatest(p, v), F.lit(0.0)).alias("scsi"), kind.alias("failure"), F.when(kind == "VENUE_SPECIFIC", F.col("worst_v")).otherwise(F.col("worst_p")).alias("worst"))


def leverage_concentration(oi: DataFrame) -> DataFrame:
    """lci of open interest (symbol, venue, oi): Herfindahl index of venue shares, piecewise to 0..1."""
    total = oi.groupBy("symbol").agg(F.sum("oi").alias("total"), F.count(F.lit(1)).alias("venues"))
    share = oi.join(total, "symbol").withColumn("share", ratio(F.col("oi"), F.col("total")) * 100)
    out = share.groupBy("symbol", "venues").agg(F.sum(F.col("share") * F.col("share")).alias("hhi"), F.max_by("venue", "share").alias("dominant"), F.max("share").alias("dominant_share"))
    h = F.col("hhi")
    score = F.when(h >= 5000, 1.0).when(h >= 2500, 0.5 + 0.5 * (h - 2500) / 2500).otherwise(0.5 * h / 2500)
    level = F.when(h > 5000, "CRITICAL").when(h > 2500, "HIGH").when(h > 1500, "MODERATE").otherwise("LOW")
    return out.select("*", F.when(F.col("venues") >= 2, score).otherwise(0.0).alias("lci"), level.alias("level"))


def impute_venues(oi: DataFrame) -> DataFrame:
    """Where one venue only is known, the five venues' fixed shares of the implied total stand in."""
    # ---- fixed values: venue shares ----
    shares = (("binance", 0.45), ("bybit", 0.22), ("okx", 0.18), ("bitget", 0.10), ("other", 0.05))
    n = oi.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    known = oi.join(n, "symbol")
    table = F.array(*[F.struct(F.lit(v).alias("venue"), F.lit(s).alias("share")) for v, s in shares])
    single = known.where("n = 1").select("symbol", F.explode(table).alias("x"), "oi").select("symbol", F.col("x.venue").alias("venue"), (F.col("oi") * F.col("x.share") / 0.45).alias("oi"))
    return known.where("n > 1").select("symbol", F.col("venue").cast("string").alias("venue"), "oi").unionByName(single)


def contagion(days: DataFrame, vix: tuple[float, float] = (25, 40), move: float = 0.02, fall: float = 0.03) -> DataFrame:
    """caci of daily closes (symbol, ts, vix, usdjpy, spx; nulls are missing)."""
    w5 = last(5)
    v = F.when(F.col("vix") >= vix[1], 1.0).when(F.col("vix") >= vix[0], (F.col("vix") - vix[0]) / (vix[1] - vix[0])).otherwise(0.0)
    yesterday = F.lag("usdjpy").over(over())
    moved = F.abs(F.col("usdjpy") - yesterday) / yesterday
    high = F.max("spx").over(w5)
    down = (high - F.col("spx")) / high
    d = days.select("*", v.alias("s_vix"), F.when(moved >= move, F.least(F.lit(1.0), moved / (2 * move))).otherwise(0.0).alias("s_jpy"), F.when(down >= fall, F.least(F.lit(1.0), down / (2 * fall))).otherwise(0.0).alias("s_spx"))
    c = d.withColumn("caci", 0.5 * F.col("s_vix") + 0.3 * F.col("s_jpy") + 0.2 * F.col("s_spx"))
    x = F.col("caci")
    return c.withColumn("stress", F.when(x >= 0.7, "CRISIS").when(x >= 0.5, "HIGH").when(x >= 0.3, "ELEVATED").otherwise("LOW"))


def risk_regime(signals: DataFrame, seconds: int = 3600, least: int = 10) -> DataFrame:
    """Regime from the greatest signals of the trailing hour, with what triggered it; normal below ``least`` rows."""
    w = over("epoch").rangeBetween(-seconds, 0)
    s = signals.withColumn("epoch", F.unix_seconds("ts"))
    s = s.select("*", *[F.max(c).over(w).alias(f"max_{c}") for c in SIGNALS], F.count(F.lit(1)).over(w).alias("seen"))
    m = {c: F.col(f"max_{c}") for c in SIGNALS}
    regime = (
        F.when(F.col("seen") < least, "normal")
        .when((m["ods"] > 0.3) | (m["scsi"] > 0.4), "oracle_failure")
        .when(m["caci"] > 0.5, "tradfi_contagion")
        .when((m["fsi"] > 0.6) | (m["lci"] > 0.6), "leverage_saturation")
        .otherwise("normal")
    )
    s = s.withColumn("regime", regime)
    breached = {"oracle_failure": {"ods": 0.3, "scsi": 0.4}, "tradfi_contagion": {"caci": 0.5}, "leverage_saturation": {"fsi": 0.6, "lci": 0.6}}
    names = [F.when((F.col("regime") == r) & (m[c] > t), F.lit(c)) for r, cs in breached.items() for c, t in cs.items()]
    return s.withColumn("triggers", F.array_join(F.array_compact(F.array(*names)), ",")).drop("epoch", *[f"max_{c}" for c in SIGNALS])


def composite(signals: DataFrame) -> DataFrame:
    """Weighted score of the six signals under the row's regime, amplified when several are high; level and dominant signal."""
    s = signals.withColumns({c: clip(F.coalesce(F.col(c), F.lit(0.0)), 0, 1) for c in SIGNALS})

    def weight(i: int) -> Column:
        w = F.lit(WEIGHTS["normal"][i])
        for name, values in WEIGHTS.items():
            w = F.when(F.col("regime") == name, F.lit(values[i])).otherwise(w)
        return w

    parts = F.array(*[F.struct((weight(i) * F.col(c)).alias("x"), F.lit(-i).alias("order"), F.lit(c).alias("name")) for i, c in enumerate(SIGNALS)])
    s = s.withColumn("parts", parts)
    over_ = lambda t: F.size(F.filter(F.array(*SIGNALS), lambda x: x > t))
    s = s.select("*", over_(0.5).alias("elevated"), over_(0.7).alias("high"), F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["x"]).alias("raw"))
    factor = F.when(F.col("elevated") >= 4, 1.3).when(F.col("high") >= 3, 1.2).otherwise(1.0)
    s = s.select("*", clip(F.col("raw") * factor, 0, 1).alias("score"), (factor > 1).alias("amplified"), F.array_max("parts")["name"].alias("dominant")).drop("parts", "raw")
    return s.withColumn("level", risk_level(F.col("score")))


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.9, "CRITICAL").when(score >= 0.7, "HIGH").when(score >= 0.5, "ELEVATED").otherwise("LOW")


def velocity(scores: DataFrame, seconds: int = 300) -> DataFrame:
    """Change a second over the trailing window; null below two rows or five seconds."""
    s = scores.withColumn("epoch", F.unix_seconds("ts"))
    w = over("epoch").rangeBetween(-seconds, 0)
    span = F.col("epoch") - F.first("epoch").over(w)
    return s.withColumn("velocity", F.when((F.count(F.lit(1)).over(w) >= 2) & (span >= 5), (F.col("score") - F.first("score").over(w)) / span)).drop("epoch")


def gate(score: Column, ramp: bool = False) -> Column:
    """Position multiplier: 0 from 0.7 on, half (or a ramp from 1 to half) from 0.5 on."""
    middle = 1 - 0.5 * (score - 0.5) / 0.2 if ramp else F.lit(0.5)
    return F.when(score >= 0.7, 0.0).when(score >= 0.5, middle).otherwise(1.0)


def cascade_risk(df: DataFrame) -> DataFrame:
    """Additive cascade risk of funding, oi_change, vol_ratio, netflow, netflow_z, large_tx; action and multiplier."""
    flag = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    flags = [
        ("high_funding", F.abs("funding") > 0.003, 0.20),
        ("oi_drop", F.col("oi_change") < -0.10, 0.25),
        ("volume_spike", F.col("vol_ratio") > 5.0, 0.15),
        ("whale_inflow", F.col("netflow") > 0.7, 0.20),
        ("netflow_anomaly", F.abs("netflow_z") > 2.0, 0.15),
        ("large_transactions", F.col("large_tx") >= 5, 0.05),
    ]
    total = F.lit(0.0)
    for _, c, v in flags:
        total = total + flag(c, v)
    out = df.select("*", F.least(F.lit(1.0), total).alias("risk"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c, _ in flags])).alias("alerts"))
    r = F.col("risk")
    action = F.when(r > 0.8, "EXIT_ALL").when(r > 0.6, "REDUCE_75%").when(r > 0.4, "REDUCE_50%").when(r > 0.2, "TIGHTEN_STOPS").otherwise("NORMAL")
    size = F.when(r > 0.8, 0.0).when(r > 0.6, 0.25).when(r > 0.4, 0.5).when(r > 0.2, 0.8).otherwise(1.0)
    return out.select("*", action.alias("action"), size.alias("multiplier"), F.size("alerts").alias("n_alerts"))


def latest(df: DataFrame, by: str = "symbol", at: str = "ts", ttl_seconds: int | None = None, now: Column | None = None) -> DataFrame:
    """The last row of each key; with a ttl only rows no older than that at ``now`` (the table's last time)."""
    row = F.struct(at, *[c for c in df.columns if c not in (by, at)])
    out = df.groupBy(by).agg(F.max_by(row, F.col(at)).alias("r")).select(by, "r.*")
    if ttl_seconds is not None:
        out = out.where(F.unix_seconds(at) >= now - ttl_seconds)
    return out


def newest(df: DataFrame, n: int, by: str = "symbol", at: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The n newest rows of each key with their rank."""
    w = W.partitionBy(by).orderBy(*[F.desc(c) for c in at])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def exit_intents(positions: DataFrame, halted: DataFrame) -> DataFrame:
    """Orders that would close the open positions of halted symbols: the side is turned, nothing is sent."""
    closing = positions.where("quantity <> 0").join(halted.select("symbol").distinct(), "symbol", "left_semi")
    return closing.select("symbol", F.when(F.col("quantity") > 0, "SELL").otherwise("BUY").alias("side"), F.abs("quantity").alias("quantity"), F.lit(True).alias("reduce_only"), F.lit(True).alias("dry_run"))
