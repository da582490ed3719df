"""Running, sliding and pairwise statistics of ordered series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.functions.columns import correlation, last, over, ratio, running, z_score
from tidemark.operators import chunked

#: Horizons of momentum in bars.
HORIZONS = (5, 10, 21, 63)


def log_return(df: DataFrame, price: str = "close") -> DataFrame:
    """Adds ret: ln of price over the previous price, 0 on a symbol's first row."""
    return df.withColumn("ret", F.coalesce(F.ln(F.col(price) / F.lag(price).over(over())), F.lit(0.0)))


def running_moments(df: DataFrame, x: str, least: int = 1, span: float = chunked.SPAN) -> DataFrame:
    """Count, mean, sample and population variance so far; null before ``least`` rows, variance 0 of one row. Chunks of time side by side."""
    m = chunked.running_moments(df, [(x, x)], span=span)
    n, mean, about = (F.col(f"{x}_{x}_{c}") for c in ("n", "mean_x", "mxx"))
    var_samp = F.when(n > 1, about / (n - 1)).otherwise(0.0)
    ready = n >= least
    return m.select(
        *df.columns,
        n.alias("n"),
        F.when(ready, mean).alias("mean"),
        F.when(ready, var_samp).alias("var_samp"),
        F.when(ready, about / n).alias("var_pop"),
        F.when(ready, F.when((n >= 2) & (F.sqrt(var_samp) > 1e-10), (F.col(x) - mean) / F.sqrt(var_samp)).otherwise(0.0)).alias("z"),
    )


def sliding_moments(df: DataFrame, x: str, size: int) -> DataFrame:
    """Mean and variances of the last ``size`` rows."""
    w, v = last(size), F.col(x)
    return df.select(
        "*", F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("mean"), F.coalesce(F.var_samp(v).over(w), F.lit(0.0)).alias("var_samp"), F.var_pop(v).over(w).alias("var_pop")
    )


def running_relation(df: DataFrame, x: str, y: str, span: float = chunked.SPAN) -> DataFrame:
    """Running covariances, correlation (clamped), regression of y on x and the correlation's regime. Chunks of time side by side."""
    m = chunked.running_moments(df, [(x, y)], span=span)
    n, mx, my, xx, yy, xy = (F.col(f"{x}_{y}_{c}") for c in ("n", "mean_x", "mean_y", "mxx", "myy", "mxy"))
    beta = ratio(xy, xx)
    spread = (F.sqrt(xx / n) > 1e-12) & (F.sqrt(yy / n) > 1e-12)
    corr = F.when(spread, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), xy / F.sqrt(xx * yy)))).otherwise(0.0)
    out = m.select(
        *df.columns,
        F.when(n > 1, xy / (n - 1)).otherwise(0.0).alias("cov_samp"),
        (xy / n).alias("cov_pop"),
        corr.alias("corr"),
        beta.alias("beta"),
        (my - beta * mx).alias("alpha"),
    )
    return out.withColumn("r2", F.col("corr") * F.col("corr")).withColumn("regime", correlation_regime(F.col("corr")))


def correlation_regime(c):
    return (
        F.when(c > 0.7, "strong_positive").when(c > 0.3, "moderate_positive").when(c > -0.3, "uncorrelated").when(c > -0.7, "moderate_negative").otherwise("strong_negative")
    )


def correlation_matrix(df: DataFrame, value: str, on: str = "ts", by: str = "symbol") -> DataFrame:
    """Correlation of every pair of symbols over the times that both have; mirrored, diagonal 1.

    The self-join is on time, so it grows with rows a time step, not with the square of the table.
    """
    a = df.select(F.col(by).alias("a"), on, F.col(value).alias("x"))
    b = df.select(F.col(by).alias("b"), on, F.col(value).alias("y"))
    pairs = a.join(b, on).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), correlation("x", "y").alias("corr"))
    flipped = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "corr")
    own = df.groupBy(F.col(by).alias("a")).agg(F.count(F.lit(1)).alias("n")).select("a", F.col("a").alias("b"), "n", F.lit(1.0).alias("corr"))
    return pairs.unionByName(flipped).unionByName(own)


def quantile_summary(df: DataFrame, x: str, by: str = "symbol", exact: bool = False) -> DataFrame:
    """Seven percentiles, bands, value area, MAD and point of control by group.

    By default from the mergeable sketch of approx_percentile (within 1 / 10,000 of the ranks), whose size
    doesn't grow with a group; ``exact`` takes a second pass over the values that the sketch brackets.
    """
    shares = [0.05, 0.15, 0.25, 0.5, 0.75, 0.85, 0.95]
    out = df.groupBy(by).agg(F.percentile_approx(x, shares, 10_000).alias("p"), F.min(x).alias("least"), F.max(x).alias("most"))
    if exact:
        out = out.drop("p").join(exact_quantiles(df, x, shares, by), by)
    at = lambda i: F.col("p")[i]
    return out.select(
        by, at(0).alias("p5"), at(2).alias("p25"), at(3).alias("median"), at(4).alias("p75"), at(6).alias("p95"), at(1).alias("area_low"), at(5).alias("area_high"),
        ((at(4) - at(2)) / 1.35).alias("mad"), at(3).alias("point_of_control"), "least", "most",
    )


def exact_quantiles(df: DataFrame, x: str, shares: list[float], by: str = "symbol", width: float = 1e-3) -> DataFrame:
    """by and p, an array of interpolated quantiles.

    A sketch brackets each quantile between ranks ``width`` apart on either side; the second
    pass counts the values below each bracket and keeps those inside, a small share of a group,
    which alone are put in order.
    """
    rows = df.select(by, F.col(x).cast("double").alias("x")).where("x is not null")
    ends = [min(1.0, max(0.0, s + d)) for s in shares for d in (-width, width)]
    sketch = rows.groupBy(by).agg(F.percentile_approx("x", ends, 10_000).alias("e"), F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    brackets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("share"), (F.col("least") if s <= width else F.col("e")[2 * i]).alias("low"), (F.col("most") if s >= 1 - width else F.col("e")[2 * i + 1]).alias("high")) for i, s in enumerate(shares)])
    met = rows.join(sketch.select(by, "n", brackets.alias("b")), by)
    # the values next to each bracket: a rank may lie one row outside of it
    sides = [f(F.when(test(i), F.col("x"))).alias(f"{name}{i}") for i in range(len(shares)) for name, f, test in (("below", F.max, lambda i: F.col("x") < F.col("b")[i]["low"]), ("above", F.min, lambda i: F.col("x") > F.col("b")[i]["high"]))]
    beside = met.groupBy(by).agg(*sides)
    beside = beside.select(by, F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"below{i}").alias("below"), F.col(f"above{i}").alias("above")) for i in range(len(shares))])))
    # one row a value and bracket that it lies in, and one for the count of all values below
    seen = met.select(by, "n", "x", F.explode(F.filter("b", lambda b: F.col("x") <= b["high"])).alias("b"))
    counted = seen.groupBy(by, "n", "b.i", "b.share", F.when(F.col("x") >= F.col("b.low"), F.col("x")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = over(F.asc_nulls_first("v"), by=(by, "i"))
    ranked = counted.withColumn("upto", F.sum("c").over(w.rowsBetween(W.unboundedPreceding, 0))).join(beside, [by, "i"])
    place = (F.col("n") - 1) * F.col("share")
    under = F.coalesce(F.max(F.when(F.col("v").isNull(), F.col("upto"))), F.lit(0))
    inside = lambda rank: F.min(F.when((F.col("upto") > rank) & F.col("v").isNotNull(), F.col("v")))
    at = lambda rank: F.when(F.first(rank) < under, F.first("below")).otherwise(F.coalesce(inside(rank), F.first("above")))
    found = ranked.groupBy(by, "i").agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("z"), F.first(place - F.floor(place)).alias("part"))
    return found.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", (F.col("a") + F.col("part") * (F.col("z") - F.col("a"))).alias("q")))), lambda s: s["q"]).alias("p"))


def high_volume_nodes(nodes: DataFrame, by: str = "symbol") -> DataFrame:
    """The three prices where volume is dense and their shares, from ``volume_nodes``: a row a node."""
    # fixed values: shares of the value area's ends and of the point of control
    parts = F.array(*[F.struct(F.lit(i).alias("node"), F.col(c).alias("price"), F.lit(share).alias("share")) for i, (c, share) in enumerate((("area_low", 0.15), ("control", 0.35), ("area_high", 0.15)))])
    return nodes.select(by, F.inline(parts))


def volume_nodes(df: DataFrame, price: str, volume: str, by: str = "symbol") -> DataFrame:
    """Volume-weighted percentiles of price: low and high of the value area and the point of control.

    A weighted percentile is the least price at which the running volume reaches its share.
    """
    w = over(price, by=(by,))
    levels = df.groupBy(by, price).agg(F.sum(volume).alias("v"))
    total = levels.groupBy(by).agg(F.sum("v").alias("total"))
    run = levels.withColumn("upto", F.sum("v").over(w)).join(total, by)
    pick = lambda share: F.min(F.when(F.col("upto") >= share * F.col("total"), F.col(price)))
    return run.groupBy(by).agg(pick(0.15).alias("area_low"), pick(0.5).alias("control"), pick(0.85).alias("area_high"))


def horizon_momentum(df: DataFrame, price: str = "close", horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """price / price h rows ago - 1 for each horizon, and its running z-score from min(20, h) values on."""
    p = F.col(price)
    out = df.select("*", *[(p / F.lag(price, h).over(over()) - 1).alias(f"mom_{h}") for h in horizons])
    return out.select("*", *[F.when(F.col(f"mom_{h}").isNotNull(), z_score(F.col(f"mom_{h}"), running(), min(20, h))).alias(f"mom_{h}_z") for h in horizons])


def momentum_features(df: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Alignment with the longest horizon's sign, shortest less longest, mean size; null below two horizons."""
    known = F.filter(F.array(*[F.col(f"mom_{h}") for h in horizons]), lambda x: x.isNotNull())
    out = df.withColumn("known", known)
    k, n = F.col("known"), F.size("known")
    longest = F.element_at(k, -1)
    same = F.size(F.filter(k, lambda x: F.signum(x) == F.signum(F.element_at(F.col("known"), -1))))
    mean = F.aggregate(k, F.lit(0.0), lambda t, x: t + F.abs(x)) / n
    when = lambda c: F.when(n >= 2, c)
    return out.select("*", when(same / n).alias("alignment"), when(F.element_at(k, 1) - longest).alias("divergence"), when(mean).alias("strength")).drop("known")
