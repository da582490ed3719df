"""Health of signals in production without labels, rollout criteria, leakage and latency checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import correlation, normal_quantile, over

# ---- fixed values: what a rollout phase must reach ----
CRITERIA = (
    ("duration", "hours", 24.0, "least"),
    ("comparisons", "comparisons", 1000.0, "least"),
    ("signal_diff", "mean_diff", 0.15, "most"),
    ("regime_match", "match_rate", 0.85, "least"),
    ("latency", "mean_latency_ms", 10.0, "most"),
    ("error_rate", "error_rate", 0.01, "most"),
    ("discrepancy_rate", "discrepancy_rate", 0.05, "most"),
)
#: Phases in order, and the symbols that each adds.
PHASES = ("phase_1", "phase_2", "phase_3", "phase_4", "completed")


def accuracy_proxies(rows: DataFrame, by: str = "symbol", keep: int = 1000, least: int = 100) -> DataFrame:
    """Per ``by`` over its newest ``keep`` rows of (ts, signal, ret, sentiment): signal-return correlation and sentiment skew, null below ``least`` rows, 0 where flat."""
    newest = rows.withColumn("_back", F.row_number().over(over(F.desc("ts"), by=(by,)))).where(F.col("_back") <= keep)
    n = F.count(F.lit(1))
    out = newest.groupBy(by).agg(n.alias("n"), F.when(n >= least, F.coalesce(correlation("signal", "ret"), F.lit(0.0))).alias("signal_return_corr"), F.when(n >= least, F.skewness("sentiment")).alias("sentiment_skew"))
    return out


def transition_rate(rows: DataFrame, by: str = "symbol", regime: str = "regime") -> DataFrame:
    """Regime changes and changes an hour of ``by``'s whole span; 0 an hour where it has no length."""
    changed = F.coalesce((F.col(regime) != F.lag(regime).over(over(by=(by,)))).cast("int"), F.lit(0))
    out = rows.withColumn("_c", changed).groupBy(by).agg(F.sum("_c").alias("changes"), ((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 3600).alias("hours"))
    return out.withColumn("per_hour", F.when(F.col("hours") > 0, F.col("changes") / F.col("hours")).otherwise(0.0))


def check_criteria(metrics: DataFrame) -> DataFrame:
    """metrics (hours, comparisons, mean_diff, match_rate, mean_latency_ms, error_rate, discrepancy_rate) with the criteria that they miss and whether they pass."""
    issues = F.array_compact(F.array(*[F.when(F.col(c) < limit if side == "least" else F.col(c) > limit, F.lit(name)) for name, c, limit, side in CRITERIA]))
    return metrics.select("*", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("passed"))


def next_phase(phase: Column, passed: Column) -> Column:
    """The phase after this one where it has passed, else the same."""
    later = phase
    for a, b in zip(PHASES, PHASES[1:]):
        later = F.when(phase == a, F.lit(b)).otherwise(later)
    return F.when(passed, later).otherwise(phase)


def latency_accepted(before: Column, after: Column, tolerance: float = 1.2) -> Column:
    """Whether a changed model's p99 is at most ``tolerance`` times what it was; never where that was 0."""
    return F.coalesce((before > 0) & (after / before <= tolerance), F.lit(False))


def worst_state(states: DataFrame, by: str, state: str = "state") -> DataFrame:
    """The worst state of each group, of healthy < degraded < unhealthy."""
    rank = F.when(F.col(state) == "unhealthy", 2).when(F.col(state) == "degraded", 1).otherwise(0)
    out = states.groupBy(by).agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("checks"))
    return out.select(by, F.element_at(F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy")), F.col("rank") + 1).alias("state"), "checks")


def required_sharpe(trials: int, years: Column, confidence: float = 0.95) -> Column:
    """Least observed Sharpe ratio that passes the deflated test after ``years`` of daily returns."""
    t = years * 252
    top = normal_quantile(min(1 - 1 / trials, 0.9999)) if trials > 1 else 0.0
    return (top + normal_quantile(confidence)) / F.sqrt(t)


def shuffle_test(rows: DataFrame, features: list[str], label: str, trials: int = 10, test_share: float = 0.3, by: str = "symbol", limit: float = 0.55) -> DataFrame:
    """Per ``by``: accuracy of a nearest-mean classifier on true labels and, on average, on shuffled ones.

    Rows (by, ts, features, label 0/1) are split in order of time. A trial deals labels out anew:
    row i gets that of the row i * step + trial places on, modulo the number of rows, with a
    step without a common divisor, so a shuffle is an equi-join on the row's number. Shuffled
    labels that can be told better than ``limit`` suggest features that hold the future.
    """
    numbered = rows.select(by, "ts", *features, label).withColumn("i", F.row_number().over(over("ts", by=(by,))) - 1)
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    base = numbered.join(n, by)
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials)))
    # trial 0 keeps the labels; 7919 is prime, so it shuffles any number of rows that it doesn't divide
    step = F.when(F.col("n") % 7919 == 0, F.lit(7907)).otherwise(F.lit(7919))
    dealt = base.withColumn("trial", trial).withColumn("j", F.when(F.col("trial") == 0, F.col("i")).otherwise((F.col("i") * step + F.col("trial") * 104_729) % F.col("n")))
    given = numbered.select(by, F.col("i").alias("j"), F.col(label).alias("y"))
    x = dealt.drop(label).join(given, [by, "j"]).withColumn("test", F.col("i") >= F.floor(F.col("n") * (1 - test_share) + 1e-9))
    means = x.where("not test").groupBy(by, "trial").agg(*[F.avg(F.when(F.col("y") == c, F.col(f))).alias(f"{f}_{c}") for f in features for c in (0, 1)])
    away = lambda c: sum(((F.col(f) - F.col(f"{f}_{c}")) ** 2 for f in features), F.lit(0.0))
    told = x.where("test").join(means, [by, "trial"]).withColumn("right", (F.when(away(1) < away(0), 1).otherwise(0) == F.col("y")).cast("double"))
    scores = told.groupBy(by, "trial").agg(F.avg("right").alias("accuracy"))
    out = scores.groupBy(by).agg(F.max(F.when(F.col("trial") == 0, F.col("accuracy"))).alias("real_accuracy"), F.avg(F.when(F.col("trial") > 0, F.col("accuracy"))).alias("shuffled_accuracy"))
    return out.withColumn("leakage_suspected", F.col("shuffled_accuracy") > limit)


def rollout_metrics(pairs: DataFrame, by: str = "phase") -> DataFrame:
    """Metrics of a phase from compared signals: ts, old, new, old_regime, new_regime, latency_ms, failed; a gap above 0.3 is a discrepancy."""
    gap = F.abs(F.col("old") - F.col("new"))
    n = F.count(F.lit(1))
    return pairs.groupBy(by).agg(
        ((F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))) / 3600).alias("hours"), n.alias("comparisons"), F.avg(gap).alias("mean_diff"),
        F.avg((F.col("old_regime") == F.col("new_regime")).cast("double")).alias("match_rate"), F.avg("latency_ms").alias("mean_latency_ms"),
        (F.count_if(F.col("failed")) / n).alias("error_rate"), (F.count_if(gap > 0.3) / n).alias("discrepancy_rate"),
    )
