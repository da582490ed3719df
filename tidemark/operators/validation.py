"""Strategy validation: cross-validation folds, Sharpe statistics, multiple testing, costs, latency."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidemark.operators import chunked
from tidemark.functions.columns import last, normal_cdf, normal_quantile, over, ratio, running


# ---- folds: ranges joined to numbered rows, so a split is a table and never an index list ----


def numbered(rows: DataFrame, by: str = "symbol") -> DataFrame:
    """rows with i, the place (from 0) in its series' order of time, and n, the series' length."""
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("i", (F.row_number().over(over(by=(by,))) - 1).cast("long")).join(n, by)


def _fold(n: Column, folds: int, fold: int) -> tuple[Column, Column]:
    """Half-open range of a fold; all are of equal size and the last runs to the end."""
    size = F.floor(n / folds)
    return size * fold, n if fold == folds - 1 else size * (fold + 1)


def _paths(lengths: DataFrame, by: str, rows: list[list[Column]]) -> DataFrame:
    """One row a series and path, with the structs of its test folds."""
    tests = F.array(*[F.struct(F.lit(p).alias("path"), F.array(*folds).alias("tests")) for p, folds in enumerate(rows)])
    return lengths.select(by, F.inline(tests))


def _test(start: Column, stop: Column, purge_from: Column, embargo_to: Column) -> Column:
    return F.struct(*[c.cast("long").alias(name) for c, name in ((start, "start"), (stop, "stop"), (purge_from, "purge_from"), (embargo_to, "embargo_to"))])


def combinatorial_paths(lengths: DataFrame, folds: int = 6, tests: int = 2, purge: int = 5, embargo: float = 0.02, by: str = "symbol") -> DataFrame:
    """Paths of series lengths (by, n): each combination of folds is tested, with rows purged before and embargoed behind each."""
    n = F.col("n")
    bounds, hold = [_fold(n, folds, f) for f in range(folds)], F.floor(n * embargo)
    one = lambda a, b: _test(a, b, F.greatest(F.lit(0), a - purge), F.least(n, b + hold))
    return _paths(lengths, by, [[one(*bounds[f]) for f in chosen] for chosen in combinations(range(folds), tests)])


def span_paths(lengths: DataFrame, folds: int = 5, tests: int = 2, purge: float = 0.01, embargo: float = 0.01, by: str = "symbol") -> DataFrame:
    """Paths whose purge and embargo lie around the whole span of their test folds."""
    n = F.col("n")
    bounds, before, after = [_fold(n, folds, f) for f in range(folds)], F.floor(n * purge), F.floor(n * embargo)
    rows = []
    for chosen in combinations(range(folds), tests):
        low, high = F.greatest(F.lit(0), bounds[chosen[0]][0] - before), F.least(n, bounds[chosen[-1]][1] + after)
        rows.append([_test(*bounds[f], low if f == chosen[0] else bounds[f][0], high if f == chosen[-1] else bounds[f][1]) for f in chosen])
    return _paths(lengths, by, rows)


def adjacent_folds(lengths: DataFrame, folds: int = 5, purge: int = 10, embargo: int = 5, by: str = "symbol") -> DataFrame:
    """Plain k-fold: each path tests one fold, the rows next to it are held."""
    n = F.col("n")
    bounds = [_fold(n, folds, f) for f in range(folds)]
    return _paths(lengths, by, [[_test(a, b, F.greatest(F.lit(0), a - purge), F.least(n, b + embargo))] for a, b in bounds])


def assign_paths(rows: DataFrame, paths: DataFrame, index: str = "i", by: str = "symbol") -> DataFrame:
    """Every row, or interval by its first row, with its role on each path of its series: test, held (purged or embargoed) or train."""
    met = rows.join(paths, by)
    i = F.col(index)
    is_test = F.exists("tests", lambda t: (i >= t["start"]) & (i < t["stop"]))
    is_held = F.exists("tests", lambda t: ((i >= t["purge_from"]) & (i < t["start"])) | ((i >= t["stop"]) & (i < t["embargo_to"])))
    return met.withColumn("role", F.when(is_test, "test").when(is_held, "held").otherwise("train")).drop("tests")


def interval_moments(rows: DataFrame, paths: DataFrame, x: str = "x", index: str = "i", by: str = "symbol") -> DataFrame:
    """One row a series and interval between neighbouring bounds of its paths: first (least row), n, and sums of rows, x, x * x and wins.

    All that folds ask of rows is summed in one pass: a row lies in one interval, however many paths there are.
    """
    t = F.explode("tests")
    bounds = paths.select(by, t.alias("t")).select(by, F.explode(F.array("t.start", "t.stop", "t.purge_from", "t.embargo_to")).alias("bound"))
    edges = bounds.groupBy(by).agg(F.array_sort(F.collect_set("bound")).alias("edges"))  # a few bounds a fold
    placed = rows.join(edges, by).withColumn("interval", F.size(F.filter("edges", lambda e: e <= F.col(index))))
    v = F.col(x)
    return placed.groupBy(by, "interval").agg(F.min(index).alias("first"), F.count(F.lit(1)).alias("n"), F.sum(index).alias("rows"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count_if(v > 0).alias("wins"))


def role_moments(intervals: DataFrame, paths: DataFrame, by: str = "symbol") -> DataFrame:
    """by, path, role (test, held or train) and the sums of its intervals with mean, std_samp and std_pop; no role lies across an interval."""
    parts = assign_paths(intervals, paths, "first", by).groupBy(by, "path", "role").agg(*[F.sum(c).alias(c) for c in ("n", "rows", "s", "q", "wins")])
    n, about = F.col("n"), F.greatest(F.lit(0.0), F.col("q") - F.col("s") * F.col("s") / F.col("n"))
    return parts.select("*", (F.col("s") / n).alias("mean"), F.when(n > 1, F.sqrt(about / (n - 1))).alias("std_samp"), F.sqrt(about / n).alias("std_pop"))


def sharpe_of(mean: Column, std: Column, year: float, least: float = 1e-10) -> Column:
    return F.when(std > least, mean / std * math.sqrt(year)).otherwise(0.0)


def span_summary(moments: DataFrame, by: str = "symbol") -> DataFrame:
    """Sharpe ratios (population deviation) of the test folds of each series' paths: number, mean, spread, extremes, share above 0; mean win rate."""
    tested = moments.where("role = 'test'").select(by, sharpe_of(F.col("mean"), F.col("std_pop"), 252, 0.0).alias("sharpe"), (F.col("wins") / F.col("n")).alias("win_rate"))
    s = F.col("sharpe")
    return tested.groupBy(by).agg(F.count(s).alias("n_folds"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"), F.avg((s > 0).cast("double")).alias("consistency"), F.avg("win_rate").alias("win_rate"))


def walk_forward(rows: DataFrame, periods: int = 5, train: float = 0.7, gap: int = 5) -> DataFrame:
    """Rows (i, n) with their period and role: train, gap or test; a period too short for a test has none."""
    size = F.floor(F.col("n") / periods)
    p = F.least(F.floor(F.col("i") / F.greatest(size, F.lit(1))), F.lit(periods - 1))
    x = rows.withColumn("period", p.cast("long")).withColumn("_a", F.col("period") * size)
    x = x.withColumn("_b", F.when(F.col("period") == periods - 1, F.col("n")).otherwise(F.col("_a") + size))
    cut = F.col("_a") + F.floor((F.col("_b") - F.col("_a")) * train + 1e-9)
    i = F.col("i")
    return x.where(cut + gap < F.col("_b")).withColumn("role", F.when(i < cut, "train").when(i < cut + gap, "gap").otherwise("test")).drop("_a", "_b")


def sharpe(x: Column, year: float, sample: bool = True) -> Column:
    std = F.stddev_samp(x) if sample else F.stddev_pop(x)
    return F.when(std > 1e-10, F.avg(x) / std * math.sqrt(year)).otherwise(0.0)


def path_summary(scores: DataFrame, least: float = 0.5, most_spread: float = 0.5, by: str = "symbol") -> DataFrame:
    """Mean, spread, extremes and pass rule of the Sharpe ratios (column sharpe) of each series' paths."""
    s = F.col("sharpe")
    out = scores.groupBy(by).agg(F.count(s).alias("n_paths"), F.avg(s).alias("mean"), F.stddev_samp(s).alias("std"), F.min(s).alias("least"), F.max(s).alias("most"), (F.avg((s > 0).cast("double")) * 100).alias("pct_positive"))
    spread = F.when(F.abs("mean") > 0.01, F.col("std") / F.abs("mean"))
    return out.withColumn("consistency", spread).withColumn("passed", (F.col("mean") >= least) & F.coalesce(F.col("consistency") <= most_spread, F.lit(False)))


def overfitting_probability(pairs: DataFrame, by: str = "symbol") -> DataFrame:
    """Share of a series' paths whose rank out of sample is above (worse than) that in sample; ranks from 0 in ascending order."""
    rank = lambda c: F.row_number().over(over(c, "path", by=(by,)))
    ranked = pairs.select(by, "path", rank("in_sample").alias("a"), rank("out_sample").alias("b"))
    return ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("b") > F.col("a")).cast("double")).alias("pbo"))


def equity_curve(returns: DataFrame, x: str = "ret", year: float = 252) -> DataFrame:
    """Per symbol: annual return, Sharpe, greatest drawdown and the smell tests that fire."""
    eq = returns.withColumn("equity", F.exp(F.sum(F.log1p(x)).over(running())))
    eq = eq.withColumn("drawdown", F.col("equity") / F.max("equity").over(running()) - 1).withColumn("step", F.col("equity") - F.lag("equity").over(over()))
    out = eq.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("equity", "ts").alias("final"), F.min("drawdown").alias("max_drawdown"), F.stddev_pop(x).alias("std"), F.stddev_pop("step").alias("step_std"), F.avg(x).alias("mean")
    )
    out = out.select("*", (F.pow("final", year / F.col("n")) - 1).alias("annual_return"), F.when(F.col("std") > 0, F.col("mean") / F.col("std") * math.sqrt(year)).otherwise(0.0).alias("sharpe"))
    smells = F.array_compact(
        F.array(
            F.when(F.col("annual_return") > 0.12, F.lit("high_annual_return")),
            F.when(F.col("sharpe") > 1.5, F.lit("high_sharpe")),
            F.when(F.col("max_drawdown") > -0.05, F.lit("suspiciously_low_drawdown")),
            F.when(F.col("step_std") < F.col("std") * 0.3, F.lit("exponentially_smooth_equity")),
        )
    )
    return out.select("symbol", "n", "annual_return", "sharpe", "max_drawdown", F.array_join(smells, ",").alias("warnings"), (F.size(smells) >= 2).alias("leakage_likely"))


def fold_metrics(df: DataFrame, x: str, by: tuple[str, ...], year: float = 252 * 24) -> DataFrame:
    """Sharpe (population), win rate, greatest drawdown, total return and profit factor by group, in order of ts."""
    w = running("ts", by=by)
    eq = df.withColumn("equity", F.exp(F.sum(F.log1p(x)).over(w)))
    eq = eq.withColumn("drawdown", 1 - F.col("equity") / F.max("equity").over(w))
    v = F.col(x)
    gain, loss = F.sum(F.greatest(v, F.lit(0.0))), F.sum(F.greatest(-v, F.lit(0.0)))
    return eq.groupBy(*by).agg(
        F.count(v).alias("n"), sharpe(v, year, sample=False).alias("sharpe"), F.avg((v > 0).cast("double")).alias("win_rate"), F.max("drawdown").alias("max_drawdown"),
        (F.max_by("equity", "ts") - 1).alias("total_return"), F.when(loss > 0, gain / loss).alias("profit_factor"),
    )


# ---- Sharpe ratios under selection ----


def return_moments(df: DataFrame, x: str = "ret", by: str = "symbol", year: float = 252) -> DataFrame:
    """n, Sharpe, skew and kurtosis, all with the sample deviation as divisor."""
    m = df.groupBy(by).agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd"))
    z = (F.col(x) - F.col("mu")) / F.col("sd")
    return df.join(m, by).groupBy(by).agg(F.count(x).alias("n"), sharpe(F.col(x), year).alias("sharpe"), F.avg(z * z * z).alias("skew"), F.avg(z * z * z * z).alias("kurtosis"))


def expected_max_by_gumbel(trials: int, variance: float = 1.0) -> float:
    """Expected greatest Sharpe of independent trials without skill."""
    g = 0.5772156649  # fixed value: Euler-Mascheroni
    if trials <= 1:
        return 0.0
    return math.sqrt(variance) * ((1 - g) * normal_quantile(1 - 1 / trials) + g * normal_quantile(1 - 1 / (trials * math.e)))


def deflated_sharpe(df: DataFrame, trials: int, hurdle: float = 3.0, sure: float = 0.95) -> DataFrame:
    """Three deflated Sharpe ratios of (sharpe, n, skew, kurtosis): by quantile, by Gumbel, by the plain bound."""
    sr, n, sk, ku = (F.col(c) for c in ("sharpe", "n", "skew", "kurtosis"))
    top = normal_quantile(min(1 - 1 / trials, 0.9999)) / F.sqrt(n) if trials > 1 else F.lit(0.0)
    sd = F.sqrt(F.greatest(F.lit(0.0), (1 + 0.5 * sk * sr - (ku - 3) / 4 * sr * sr) / n))
    prob = F.when(sd < 1e-10, (sr > top).cast("double")).otherwise(normal_cdf((sr - top) / sd))
    se = F.sqrt(F.greatest(F.lit(1e-12), (1 - sk * sr + (ku - 1) / 4 * sr * sr) / (n - 1)))
    gumbel = expected_max_by_gumbel(trials)
    return df.select(
        "*", top.alias("expected_max"), prob.alias("probability"), normal_cdf((sr - gumbel / F.sqrt(n)) / se).alias("probability_gumbel"),
        F.greatest(F.lit(0.0), sr - math.sqrt(2 * math.log(trials)) / F.sqrt(n)).alias("deflated"), ((sr >= hurdle) & (prob >= sure)).alias("passed"),
    )


# ---- bootstrap: draws come from integer arithmetic on (replicate, block), the same everywhere ----
# All strategies share one time line and the same blocks of it, so the greatest statistic of a replicate is that of one
# history. A block's sums are differences of running sums at its two ends: what is joined is the ends, not the rows.


def time_line(excess: DataFrame, span: float = chunked.SPAN) -> DataFrame:
    """ts and i, the number of times up to it, from 1."""
    times = excess.select("ts").distinct().withColumn("chunk", chunked.chunk_of(span)).repartition("chunk")
    sizes = times.groupBy("chunk").agg(F.count(F.lit(1)).alias("c"))  # a row a chunk
    sizes = sizes.select(F.col("chunk").alias("of"), F.coalesce(F.sum("c").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    met = times.join(sizes, times["chunk"].eqNullSafe(sizes["of"]))
    return met.select("ts", (F.col("before") + F.row_number().over(W.partitionBy("chunk").orderBy("ts"))).alias("i"))


def running_sums(excess: DataFrame, span: float = chunked.SPAN) -> DataFrame:
    """strategy, i and k, s, q: count, sum and sum of squares of x over the first i times of the time line."""
    each = excess.agg(F.array_sort(F.collect_set("strategy")).alias("names"))  # the strategies under test
    line = time_line(excess, span).join(each).select("ts", "i", F.explode("names").alias("strategy"))
    rows = line.join(excess.select("ts", "strategy", "x"), ["ts", "strategy"], "left").withColumn("chunk", chunked.chunk_of(span))
    parts = {"k": F.count("x"), "s": F.coalesce(F.sum("x"), F.lit(0.0)), "q": F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))}
    earlier = W.partitionBy("strategy").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("strategy", "chunk").agg(*[e.alias(c) for c, e in parts.items()])
    totals = totals.select(F.col("strategy").alias("of"), F.col("chunk").alias("at"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in parts])
    w = W.partitionBy("strategy", "chunk").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    met = rows.join(totals, (F.col("strategy") == F.col("of")) & F.col("chunk").eqNullSafe(F.col("at")))
    upto = {"k": F.count("x").over(w), "s": F.coalesce(F.sum("x").over(w), F.lit(0.0)), "q": F.coalesce(F.sum(F.col("x") * F.col("x")).over(w), F.lit(0.0))}
    return met.select("strategy", "i", *[(F.col(f"{c}0") + e).alias(c) for c, e in upto.items()])


def shared_blocks(length: DataFrame, replicates: int) -> DataFrame:
    """rep, start and stop of blocks of about sqrt(n) times, n // block of them a replicate, from one row (n)."""
    d = length.where("n > 0").withColumn("block", F.greatest(F.lit(1), F.floor(F.sqrt("n"))))
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<long>"))).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / F.col("block")) - 1)))
    start = (F.col("rep") * 48271 + F.col("b") * 69621 + 12345 + F.col("rep") * F.col("b") * 7919) % (F.col("n") - F.col("block") + 1)
    return d.select("rep", start.alias("start"), (start + F.col("block")).alias("stop"))


def geometric_blocks(length: DataFrame, replicates: int, mean_block: int = 10) -> DataFrame:
    """rep, start and stop: the stationary bootstrap, whose blocks begin anew with chance 1 / mean_block and wrap around.

    A place begins a block where a hash of (rep, place) says so; the same hash names the block's first time. Only
    places that begin a block leave their task. A block that wraps is two.
    """
    span = 1 << 13
    d = length.where("n > 0").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)).cast("array<long>")))
    d = d.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / span))))
    d = d.withColumn("place", F.explode(F.sequence(F.col("part") * span, F.least(F.col("n"), (F.col("part") + 1) * span) - 1)))
    h = (F.col("rep") * 48271 + F.col("place") * 69621 + F.col("rep") * F.col("place") * 7919 + 12345) % 1_000_003
    d = d.withColumn("h", h).where((F.col("place") == 0) | (F.col("h") % mean_block == 0))
    size = F.coalesce(F.lead("place").over(W.partitionBy("rep").orderBy("place")), F.col("n")) - F.col("place")
    d = d.select("rep", "n", (F.col("h") % F.col("n")).alias("start"), size.alias("size"))
    # a block of more than n times can't be: places are n in all
    end = F.col("start") + F.col("size")
    pieces = F.array(F.struct(F.col("start").alias("start"), F.least("n", end).alias("stop")), F.struct(F.lit(0).cast("long").alias("start"), (end - F.col("n")).alias("stop")))
    return d.select("rep", F.inline(F.filter(pieces, lambda p: p["stop"] > p["start"])))


def bootstrap_test(sums: DataFrame, blocks: DataFrame) -> DataFrame:
    """p-values of the best mean excess return: plain, recentred on each sample, and recentred on the observed mean.

    sums are ``running_sums`` of returns in excess of a benchmark, blocks rep, start and stop on their time line.
    """
    t = lambda m, s, k: F.when(s > 0, m / (s / F.sqrt(k))).otherwise(0.0)
    moments = lambda k, s, q: (s / k, F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), (q - s * s / k) / (k - 1)))).otherwise(0.0))
    k, s, q = (F.col(c) for c in "ksq")
    mean, std = moments(k, s, q)
    seen = sums.groupBy("strategy").agg(F.max_by(F.struct("k", "s", "q"), "i").alias("whole")).select("strategy", "whole.*").where("k > 0").select("strategy", mean.alias("mean"), t(mean, std, k).alias("stat"))
    ends = blocks.select("rep", F.inline(F.array(F.struct(F.col("start").alias("i"), F.lit(-1).alias("sign")), F.struct(F.col("stop").alias("i"), F.lit(1).alias("sign")))))
    ends = ends.groupBy("rep", "i").agg(F.sum("sign").alias("times")).where("i > 0 and times != 0")
    boot = ends.join(sums, "i").groupBy("strategy", "rep").agg(*[F.sum(F.col("times") * F.col(c)).alias(c) for c in "ksq"]).where("k > 0")
    boot = boot.join(seen, "strategy").select("strategy", "rep", "stat", "mean", t(mean, std, k).alias("plain"), t(mean - F.col("mean"), std, k).alias("centred"))
    own = boot.groupBy("strategy").agg(F.first("stat").alias("stat"), F.avg((F.col("plain") >= F.col("stat")).cast("double")).alias("p_white"), F.avg((F.lit(0.0) >= F.col("stat")).cast("double")).alias("p_spa"), F.avg((F.col("centred") >= F.col("stat")).cast("double")).alias("p_centred"))
    top = boot.groupBy("rep").agg(F.max("centred").alias("top"))
    every = own.agg(F.max("stat").alias("best")).join(top).agg(F.avg((F.col("top") >= F.col("best")).cast("double")).alias("p_best"))
    return own.join(every)


def family_wise(p_values: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Bonferroni, Holm step-down and Benjamini-Hochberg verdicts of (name, p)."""
    every = over("p", "name", by=("all",))
    p = p_values.withColumn("all", F.lit(0))
    p = p.select("*", F.row_number().over(every).alias("rank"), F.count(F.lit(1)).over(W.partitionBy("all")).alias("n"))
    holds = (F.col("p") < alpha / (F.col("n") - F.col("rank") + 1)).cast("int")
    below = F.when(F.col("p") <= F.col("rank") * alpha / F.col("n"), F.col("rank")).otherwise(0)
    p = p.withColumn("holm", F.min(holds).over(running("p", "name", by=("all",))) == 1).withColumn("k", F.max(below).over(W.partitionBy("all")))
    return p.select("name", "p", (F.col("p") < alpha / F.col("n")).alias("bonferroni"), "holm", (F.col("rank") <= F.col("k")).alias("benjamini_hochberg"))


# ---- costs ----
# fixed values: commission, spread (bps), slippage (bps) by asset class
COSTS = {"crypto": (0.001, 5.0, 10.0), "equity": (0.0001, 1.0, 5.0), "futures": (0.0002, 0.5, 3.0)}


def trade_cost_bps(size: Column, volatility: Column, taker: Column, asset: str = "crypto") -> Column:
    commission, spread, slippage = COSTS[asset]
    return commission * 20000 + F.when(taker, spread).otherwise(0.0) + slippage * F.greatest(F.lit(1.0), volatility / 0.02) + F.sqrt(size / 10000)


def net_sharpe(gross: Column, bps: Column, turnover: Column, volatility: float = 0.15) -> Column:
    """What a year's costs of ``turnover`` round trips leave of a gross Sharpe ratio."""
    return gross - bps / 10000 * turnover / volatility


def order_pieces(size: Column, daily_volume: Column, participation: float = 0.1) -> Column:
    """Number of orders that keeps each within its share of the day's volume."""
    return F.greatest(F.lit(1), F.ceil(size / (daily_volume * participation))).cast("long")


def breakeven_seconds(spread_bps: Column, improvement: float = 0.5) -> Column:
    return spread_bps / 5 / (1 - improvement) * 60


# ---- latency and monitoring ----


def latency_stats(df: DataFrame, by: str = "component", x: str = "ms", keep: int = 10_000, at: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """p50, p95, p99 and mean of each component's newest rows."""
    newest = df.withColumn("age", F.row_number().over(W.partitionBy(by).orderBy(*[F.desc(c) for c in at]))).where(F.col("age") <= keep)
    p = F.percentile(x, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    return newest.groupBy(by).agg(p.alias("p"), F.avg(x).alias("mean"), F.count(x).alias("n")).select(by, "n", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"))


def sla_breaches(stats: DataFrame, limits: DataFrame, by: str = "component") -> DataFrame:
    """Percentiles beyond their limits, one row each."""
    met = stats.join(limits, by)
    cases = F.array_compact(F.array(*[F.when(F.col(q) > F.col(f"max_{q}"), F.struct(F.lit(q).alias("percentile"), F.col(q).alias("value"), F.col(f"max_{q}").alias("limit"))) for q in ("p50", "p95", "p99")]))
    return met.select(by, F.inline(cases))


def breach_states(df: DataFrame, limit: Column, by: str = "component", least: int = 3) -> DataFrame:
    """Running number of breaches of each component; disabled from the third on."""
    w = running("ts", "event_id", by=(by,))
    b = df.withColumn("breaches", F.sum((F.col("ms") > limit).cast("long")).over(w))
    return b.withColumn("disabled", F.col("breaches") >= least)


def bottlenecks(stats: DataFrame, share: float = 0.2, by: str = "component") -> DataFrame:
    """Components that take at least ``share`` of the summed means."""
    total = stats.agg(F.sum("mean").alias("total"))
    return stats.join(F.broadcast(total)).withColumn("share", ratio(F.col("mean"), F.col("total"))).where(F.col("share") >= share).select(by, "mean", "share")


def shadow_comparison(legacy: DataFrame, enhanced: DataFrame, on: list[str], flat: Column | float = 1.0) -> DataFrame:
    """Signal difference, regime match, latency ratio (``flat`` where the old latency is 0) and alerts of each pair; running mismatch rate."""
    a = legacy.select(*on, F.col("signal").alias("legacy_signal"), F.col("regime").alias("legacy_regime"), F.col("latency").alias("legacy_latency"))
    j = a.join(enhanced, on)
    j = j.select("*", F.abs(F.col("signal") - F.col("legacy_signal")).alias("diff"), (F.col("regime") == F.col("legacy_regime")).alias("match"), ratio(F.col("latency"), F.col("legacy_latency"), flat).alias("latency_ratio"))
    n, miss = F.count(F.lit(1)).over(running()), F.avg((~F.col("match")).cast("double")).over(running())
    alerts = F.array_compact(F.array(F.when(F.col("diff") > 0.1, F.lit("signal_diff")), F.when(F.col("latency_ratio") > 2, F.lit("latency")), F.when((n >= 100) & (miss > 0.05), F.lit("regime_mismatch"))))
    return j.withColumn("mismatch", miss).withColumn("alerts", F.array_join(alerts, ","))


def shadow_report(compared: DataFrame) -> DataFrame:
    out = compared.agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean_diff"), F.stddev_pop("diff").alias("std_diff"), F.avg(F.col("match").cast("double")).alias("match_rate"), F.avg("latency_ratio").alias("latency_ratio"))
    return out.withColumn("ready", (F.col("match_rate") >= 0.9) & (F.col("mean_diff") <= 0.15) & (F.col("latency_ratio") <= 3))


def rollback_tier(error_rate: Column, latency_ms: Column, divergence: Column) -> Column:
    """critical, warning or none from three health measures."""
    return (
        F.when((error_rate > 0.05) | (latency_ms > 50) | (divergence > 0.5), "critical").when((error_rate > 0.01) | (latency_ms > 25) | (divergence > 0.2), "warning").otherwise("none")
    )


def ab_summary(tests: DataFrame) -> DataFrame:
    """Accuracy, latency percentiles, agreement and wins of models a and b: overall and by source.

    A test is won by who is right alone, else by a confidence gap of 0.1, else by 10 ms.
    """
    a_ok, b_ok = F.col("label_a") == F.col("expected"), F.col("label_b") == F.col("expected")
    won = (
        F.when(a_ok & ~b_ok, "a").when(b_ok & ~a_ok, "b")
        .when(F.abs(F.col("conf_a") - F.col("conf_b")) > 0.1, F.when(F.col("conf_a") > F.col("conf_b"), "a").otherwise("b"))
        .when(F.abs(F.col("ms_a") - F.col("ms_b")) > 10, F.when(F.col("ms_a") < F.col("ms_b"), "a").otherwise("b"))
        .otherwise("tie")
    )
    t = tests.select("*", a_ok.alias("ok_a"), b_ok.alias("ok_b"), won.alias("won"))
    mean = lambda c: F.avg(c.cast("double"))
    return t.rollup("source").agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("ok_a")).alias("accuracy_a"), mean(F.col("ok_b")).alias("accuracy_b"), mean(F.col("label_a") == F.col("label_b")).alias("agreement"),
        F.percentile("ms_a", F.lit(0.5)).alias("p50_a"), F.percentile("ms_b", F.lit(0.5)).alias("p50_b"), F.percentile("ms_a", F.lit(0.95)).alias("p95_a"), F.percentile("ms_b", F.lit(0.95)).alias("p95_b"),
        F.count_if(F.col("won") == "a").alias("wins_a"), F.count_if(F.col("won") == "b").alias("wins_b"), F.count_if(F.col("won") == "tie").alias("ties"),
    ).select(F.coalesce("source", F.lit("all")).alias("source"), *["n", "accuracy_a", "accuracy_b", "agreement", "p50_a", "p50_b", "p95_a", "p95_b", "wins_a", "wins_b", "ties"])


def baseline_strategy(bars: DataFrame, n: int = 14) -> DataFrame:
    """Long below RSI 30, short above 70, by plain averages; earns the next bar's return."""
    d = bars.withColumn("d", F.col("close") - F.lag("close").over(over()))
    w = last(n)
    up, down = F.avg(F.greatest("d", F.lit(0.0))).over(w), -F.avg(F.least("d", F.lit(0.0))).over(w)
    rsi = F.when(F.count("d").over(w) == n, F.when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down)))
    d = d.withColumn("rsi", rsi).withColumn("side", F.when(F.col("rsi") < 30, 1.0).when(F.col("rsi") > 70, -1.0).otherwise(0.0))
    return d.withColumn("earned", F.col("side") * (F.lead("close").over(over()) / F.col("close") - 1))
