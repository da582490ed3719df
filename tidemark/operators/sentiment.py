"""Sentiment: lexicon scoring, spam filter, trailing aggregates, lags, weights and contagion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.functions.columns import clip, last, over, ratio
from tidemark.operators.recursive import decayed_mean, scan

# ---- fixed values: lag horizons (rows), half-lives and source weights ----
LAGS = {"news": (30, 60, 90, 120, 180), "twitter": (15, 30, 45, 60, 120), "reddit": (180, 240, 270, 300, 360)}
HALF_LIVES = {"news": 120.0, "twitter": 60.0, "reddit": 240.0}
SOURCE_WEIGHTS = {"news": 1.0, "twitter": 0.7, "reddit": 0.5}


def label(score: Column, limit: float = 0.3) -> Column:
    return F.when(score > limit, "bullish").when(score < -limit, "bearish").otherwise("neutral")


def passes_spam_filter() -> Column:
    """Length of 10 or more, few emoji a word, enough engagement by source."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")))
    emoji = F.regexp_count(text, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"))
    least = F.when(F.col("source") == "twitter", 5.0).when(F.col("source") == "reddit", 3.0).otherwise(0.0)
    return (F.length(text) >= 10) & (emoji / words <= 0.3) & (F.col("engagement") >= least)


def trailing_sentiment(posts: DataFrame, minutes: int, limit: float = 0.3) -> DataFrame:
    """Per post: engagement-weighted mean (plain if none), volume, and bullish less bearish share of the trailing window."""
    p = posts.withColumn("epoch", F.unix_seconds("ts"))
    w = W.partitionBy("symbol", "source").orderBy("epoch").rangeBetween(-minutes * 60, 0)
    s, e = F.col("score"), F.col("engagement")
    weight = F.sum("engagement").over(w)
    mean = F.when(weight > 0, F.sum(s * e).over(w) / weight).otherwise(F.avg("score").over(w))
    n = F.count(F.lit(1)).over(w)
    net = (F.sum((s > limit).cast("int")).over(w) - F.sum((s < -limit).cast("int")).over(w)) / n
    return p.select("*", mean.alias("mean_score"), n.alias("volume"), net.alias("net_share")).drop("epoch")


def windowed_sentiment(posts: DataFrame, minutes: int, limit: float = 0.3) -> DataFrame:
    """The same over tumbling windows, with the median; this form also runs on a stream."""
    s, e = F.col("score"), F.col("engagement")
    return posts.groupBy("symbol", "source", F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.when(F.sum(e) > 0, F.sum(s * e) / F.sum(e)).otherwise(F.avg(s)).alias("mean_score"), F.median(s).alias("median_score"), F.count(F.lit(1)).alias("volume"),
        ((F.count_if(s > limit) - F.count_if(s < -limit)) / F.count(F.lit(1))).alias("net_share"),
    )


def lag_features(posts: DataFrame, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Score k - 1 rows back for each horizon of the source (0 before), acceleration, momentum sum, sign changes.

    Horizon k reads the k-th newest value, the current one included; acceleration reads 30 rows back.
    """
    by = ("symbol", "source")
    w = over(*order, by=by)
    n = F.row_number().over(w)
    lag = lambda k: F.coalesce(F.lag("score", k - 1).over(w), F.lit(0.0))
    p = posts.withColumn("seen", n)
    for i in range(5):
        value = F.lit(0.0)
        for source, ks in LAGS.items():
            value = F.when(F.col("source") == source, lag(ks[i])).otherwise(value)
        p = p.withColumn(f"lag_{i + 1}", value)
    flip = F.when(F.signum("score") * F.signum(F.lag("score").over(w)) < 0, 1).otherwise(0)
    p = p.withColumn("_flip", flip)
    return p.select(
        "*",
        F.coalesce((F.col("score") - F.lag("score", 30).over(w)) / 30, F.lit(0.0)).alias("acceleration"),
        F.sum("score").over(last(180, *order, by=by)).alias("momentum"),
        F.sum("_flip").over(last(59, *order, by=by)).alias("flips"),
    ).drop("_flip")


def decayed_sentiment(posts: DataFrame, keep: int = 361, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """id and the half-life weighted mean of the newest ``keep`` rows of a symbol and source, a row a minute.

    A recurrence: each step ages the sums, adds the new value and takes off the one that leaves.
    """
    rate = F.lit(0.5 ** (1 / 120.0))
    for source, half in HALF_LIVES.items():
        rate = F.when(F.col("source") == source, F.lit(0.5 ** (1 / half))).otherwise(rate)
    leaving = F.lag("score", keep).over(over(*order, by=("symbol", "source")))
    p = posts.select("symbol", F.concat_ws("\x1f", "symbol", "source").alias("series"), *order, "score", leaving.alias("leaving"), rate.alias("rate"))
    return scan(p, decayed_mean("score", "leaving", "rate", keep), by="series", order=order)


def sentiment_momentum(posts: DataFrame, rows: int = 60, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Change, rate and half-split acceleration over the last rows; zeros while short."""
    by = ("symbol", "source")
    w = over(*order, by=by)
    now, mid, old = F.col("score"), F.lag("score", rows // 2).over(w), F.lag("score", rows - 1).over(w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return posts.select("*", zero(now - old).alias("velocity"), zero((now - old) / rows).alias("rate"), zero(F.when(old.isNotNull(), (now - mid) - (mid - old))).alias("turn"))


def cross_source(posts: DataFrame, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Latest score of each source of a symbol, weighted."""
    newest = posts.groupBy("symbol", "source").agg(F.max_by("score", F.struct(*order)).alias("score"))
    weight = F.lit(0.5)
    for source, value in SOURCE_WEIGHTS.items():
        weight = F.when(F.col("source") == source, F.lit(value)).otherwise(weight)
    return newest.groupBy("symbol").agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("weighted"), F.count(F.lit(1)).alias("sources"))


def producer_signal(posts: DataFrame, limit: float = 0.3) -> DataFrame:
    """Per symbol: source means weighted by kind and volume, and the signal."""
    by_source = posts.groupBy("symbol", "source").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    weight = F.when(F.col("source") == "news", 0.6 * F.least(n, F.lit(5))).when(F.col("source") == "telegram", 0.4 * F.least(n / 10, F.lit(1.0))).otherwise(0.5)
    out = by_source.groupBy("symbol").agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("score"), F.sum("n").alias("n"))
    return out.withColumn("signal", label(F.col("score"), limit))


def follower_weighted(posts: DataFrame, followers: Column, cap: float = 10.0) -> DataFrame:
    """Mean score by symbol with weight 1 + min(followers / 1000, cap)."""
    w = 1 + F.least(followers / 1000, F.lit(cap))
    return posts.withColumn("_w", w).groupBy("symbol").agg((F.sum(F.col("score") * F.col("_w")) / F.sum("_w")).alias("score"), F.count(F.lit(1)).alias("n")).withColumn("signal", label(F.col("score")))


def vote_balance(up: Column, down: Column) -> Column:
    """Share of votes for less share against; null without votes."""
    return F.when(up + down > 0, (up - down) / (up + down))


def blended(score: Column, vote: Column, share: float = 0.3) -> Column:
    """Text score with ``share`` of the votes' balance; the score alone where there are no votes."""
    return F.when(vote.isNull(), score).otherwise((1 - share) * score + share * vote)


def discussion_score(posts: DataFrame) -> DataFrame:
    """Mean of (2 * ratio - 1) * (1 + engagement / 100), clipped, with counts and sums."""
    s = (2 * F.col("ratio") - 1) * (1 + F.col("engagement") / 100)
    return posts.groupBy("symbol").agg(clip(F.avg(s), -1, 1).alias("score"), F.count(F.lit(1)).alias("mentions"), F.sum("engagement").alias("engagement"), F.avg("ratio").alias("mean_ratio"))


def summary(posts: DataFrame, limit: float = 0.3, move: float = 0.1, by: str = "symbol") -> DataFrame:
    """Mean score of ``by``'s posts, how many are bullish, bearish and neutral, and the signal."""
    s = F.col("score")
    out = posts.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("score"), F.count_if(s > limit).alias("bullish"), F.count_if(s < -limit).alias("bearish"), F.count_if((s >= -limit) & (s <= limit)).alias("neutral"))
    return out.withColumn("signal", F.when(F.col("score") > move, "BULLISH").when(F.col("score") < -move, "BEARISH").otherwise("NEUTRAL"))


def recent(posts: DataFrame, hours: float) -> DataFrame:
    """The posts of the last hours before the newest one."""
    newest = posts.agg(F.max("ts").alias("_now"))  # one row
    return posts.join(newest).where(F.unix_micros("ts") >= F.unix_micros("_now") - F.lit(int(hours * 3_600_000_000))).drop("_now")


def vote_score(up: Column, liked: Column, down: Column, disliked: Column) -> Column:
    return ratio(up + liked - down - disliked, up + liked + down + disliked)


def credibility(outcomes: DataFrame, prior: float = 5.0, floor: float = 0.1) -> DataFrame:
    """Per source: hits and misses on a Beta prior, credibility, and weights that sum to 1."""
    step = F.greatest(F.lit(floor), F.col("confidence"))
    hit = F.col("predicted") == F.col("actual")
    c = outcomes.groupBy("source").agg((prior + F.sum(F.when(hit, step).otherwise(0.0))).alias("hits"), (prior + F.sum(F.when(~hit, step).otherwise(0.0))).alias("misses"))
    c = c.withColumn("credibility", F.col("hits") / (F.col("hits") + F.col("misses")))
    return c.withColumn("weight", F.col("credibility") / F.sum("credibility").over(W.partitionBy()))


def decay_credibility(c: DataFrame, factor: float = 0.95, prior: float = 5.0) -> DataFrame:
    return c.withColumns({x: F.greatest(F.lit(prior), F.col(x) * factor) for x in ("hits", "misses")})


def disagreement(fast: Column, accurate: Column, confidence: Column) -> Column:
    """struct(gap, kind, confidence) of two scores."""
    gap = F.abs(fast - accurate)
    kind = F.when(gap > 1, "severe").when(gap > 0.5, "high").when(gap > 0.3, "moderate").otherwise("low")
    return F.struct(gap.alias("gap"), kind.alias("kind"), (confidence * (1 - gap / 2)).alias("confidence"))


def volume_divergence(change: Column, volume_ratio: Column, limit: float = 0.3) -> Column:
    """Kinds of sentiment moves against volume."""
    return (
        F.when((change > limit) & (volume_ratio < 0.8), "weak_rise").when((change < -limit) & (volume_ratio < 0.8), "weak_fall")
        .when((change > limit) & (volume_ratio > 1.2), "confirmed_rise").when((change < -limit) & (volume_ratio > 1.2), "confirmed_fall").otherwise("none")
    )


# fixed values: spill-over coefficients and lags (minutes) of the targets; any other target has the default
SPILLOVER = {"BTCUSDT": (1.0, 15), "ETHUSDT": (0.75, 5), "SOLUSDT": (0.60, 10), "BNBUSDT": (0.55, 15), "XRPUSDT": (0.50, 20), "ADAUSDT": (0.45, 20), "DOGEUSDT": (0.70, 8)}
SPILLOVER_DEFAULT = (0.5, 15)


def as_of(left: DataFrame, right: DataFrame, value: str, by: str = "key", at: str = "at", span: int = 86_400) -> DataFrame:
    """left with the value of the last row of right at or before ``at`` (seconds), else the oldest of its key.

    Both sides meet in spans of ``span`` seconds, so a key's history is spread over tasks. A
    row that finds nothing in its span takes what the spans before it ended with; those are one
    row a key and span. right: by, at, value and sid, which breaks ties.
    """
    span_of = F.floor(F.col(at) / span).alias("span")
    ends = right.groupBy(by, span_of).agg(F.max_by(value, F.struct(at, "sid")).alias("end"), F.min_by(value, F.struct(at, "sid")).alias("begin"))
    both = ends.select(by, "span", "end", "begin").unionByName(left.select(by, span_of).distinct(), allowMissingColumns=True).groupBy(by, "span").agg(F.first("end", ignorenulls=True).alias("end"), F.first("begin", ignorenulls=True).alias("begin"))
    w = W.partitionBy(by).orderBy("span")
    before = F.last("end", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    oldest = F.first("begin", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    carried = both.select(by, "span", F.coalesce(before, oldest).alias("carried"))
    rows = left.withColumn("_kind", F.lit(1)).withColumn("span", span_of)
    u = rows.unionByName(right.select(by, at, value, "sid", F.lit(0).alias("_kind")).withColumn("span", span_of), allowMissingColumns=True)
    within = W.partitionBy(by, "span").orderBy(at, "_kind", "sid")
    u = u.withColumn("_seen", F.last(value, ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, 0))).where("_kind = 1")
    return u.join(carried, [by, "span"]).select(*[c for c in left.columns], F.coalesce("_seen", "carried").alias(value))


def spillover(targets: DataFrame, source: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """As-of join: the source's score ``lag`` minutes before the target's time (else its oldest), times the coefficient; worse if negative.

    targets: target, id, ts; source: id, ts, score. table (target, coef, lag) stands for SPILLOVER; targets that it
    lacks have the default. Gives target, id, coef, lag, source_score and spill.
    """
    if table is None:
        table = targets.sparkSession.createDataFrame([(k, c, m) for k, (c, m) in SPILLOVER.items()], "target string, coef double, lag int")
    coef, lag = SPILLOVER_DEFAULT
    t = targets.join(table, "target", "left").fillna({"coef": coef, "lag": lag})
    t = t.select("target", "id", "coef", "lag", F.lit(0).alias("key"), (F.unix_seconds("ts") - F.col("lag") * 60).alias("at"))
    s = source.select(F.lit(0).alias("key"), F.unix_seconds("ts").alias("at"), "score", F.col("id").alias("sid"))
    effect = F.col("score") * F.col("coef")
    return as_of(t, s, "score").select("target", "id", "coef", "lag", F.col("score").alias("source_score"), F.when(effect < 0, effect * 1.3).otherwise(effect).alias("spill"))


def majority(predictions: DataFrame) -> DataFrame:
    """Per document: the label most models give (ties by the first model), agreement, confidence-weighted score and action.

    predictions: id, model (order), label, score, confidence. They are read once: the votes carry their part of the score.
    """
    votes = predictions.where("id is not null").groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("model").alias("first"), F.sum(F.col("score") * F.col("confidence")).alias("weighed"), F.sum("confidence").alias("weight"))
    best = votes.groupBy("id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"), F.max("n").alias("top"), F.sum("n").alias("models"), (F.sum("weighed") / F.sum("weight")).alias("score"))
    out = best.withColumn("agreement", F.col("top") / F.col("models"))
    a = F.col("agreement")
    return out.select("id", "label", "agreement", "score", F.when(a >= 0.99, "FULL").when(a >= 0.6, "REDUCED").otherwise("HOLD").alias("action"))


def netflow(flows: DataFrame) -> DataFrame:
    """On-chain flows (symbol, ts, inflow, outflow): clipped share, running z / 3 clipped, and tanh of buys less sells."""
    from tidemark.functions.columns import running, z_score

    f = flows.withColumn("net", clip(ratio(F.col("inflow") - F.col("outflow"), F.col("inflow") + F.col("outflow")), -1, 1))
    return f.select("*", clip(z_score(F.col("net"), running()) / 3, -1, 1).alias("net_z"), F.tanh((F.col("buys") - F.col("sells")) / 5).alias("whale"))


def network_health(stats: DataFrame) -> DataFrame:
    """Activity z / 3 after 10 rows, hash rate to the first, fee pressure, conviction, and their weighted health."""
    from tidemark.functions.columns import running, z_score

    w = over()
    s = stats.withColumn("activity", F.when(F.row_number().over(w) > 10, clip(z_score(F.col("addresses"), running()) / 3, -1, 1)).otherwise(0.0))
    s = s.withColumn("hash_ratio", ratio(F.col("hashrate"), F.first("hashrate").over(running()), 1.0)).withColumn("fee_pressure", clip((F.col("gas") - 20) / 80, 0, 1)).withColumn("conviction", 1 / (1 + F.col("turnover")))
    return s.withColumn("health", 0.3 * (F.col("activity") + 1) / 2 + 0.4 * F.least(F.lit(1.0), F.col("hash_ratio")) + 0.3 * F.col("conviction"))
