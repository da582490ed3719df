"""Normalising raw bar messages and checking bar series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.columns import correlation, over
from tidemark.operators import chunked, stationarity

# ---- fixed values: prefix aliases of exchange symbols, applied in this order ----
ALIASES = (("XBT", "BTC"), ("XXBT", "BTC"), ("XETH", "ETH"))


def symbol(raw: Column) -> Column:
    """Upper case without / and -, prefixes by their usual names."""
    s = F.translate(F.upper(raw), "/-", "")
    for prefix, name in ALIASES:
        s = F.regexp_replace(s, f"^{prefix}", name)
    return s


def normalise(raw: DataFrame) -> DataFrame:
    """Fill missing prices from ``price``, cast, default to 0, and drop what isn't a valid bar."""
    have = set(raw.columns)
    number = lambda c: F.coalesce(*[F.col(x).try_cast("double") for x in (c, "price") if x in have], F.lit(0.0))
    out = raw.withColumns({"symbol": symbol(F.col("symbol")), **{c: number(c) for c in ("open", "high", "low", "close")}})
    out = out.withColumn("volume", F.coalesce(F.col("volume").try_cast("double"), F.lit(0.0)) if "volume" in have else F.lit(0.0))
    return out.where(is_valid())


def is_valid() -> Column:
    """Ids present, close above 0, volume not below 0, high not below low, time known."""
    known = (F.coalesce(F.col("symbol"), F.lit("")) != "") & (F.coalesce(F.col("exchange"), F.lit("")) != "")
    return known & (F.col("close") > 0) & (F.col("volume") >= 0) & (F.col("high") >= F.col("low")) & (F.col("timestamp") > 0)


def level1(bars: DataFrame) -> DataFrame:
    """Structural faults by symbol; ``seq`` is the order of arrival."""
    prev, before = F.lag("close").over(over()), F.lag("ts").over(over("seq"))
    b = bars.select("*", (F.abs(F.col("close") / prev - 1) > 10).alias("jump"), (F.col("ts") <= before).alias("late"))
    any_null = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull() | F.col("volume").isNull()
    out = b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(any_null).alias("nulls"),
        F.count_if(F.expr("high < low")).alias("high_below_low"),
        F.count_if(F.expr("high < open or high < close")).alias("high_below"),
        F.count_if(F.expr("low > open or low > close")).alias("low_above"),
        (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicate_ts"),
        F.count_if(F.expr("volume < 0")).alias("negative_volume"),
        F.count_if(F.expr("open <= 0 or high <= 0 or low <= 0 or close <= 0")).alias("non_positive"),
        F.count_if("jump").alias("jumps"),
        F.count_if("late").alias("out_of_order"),
    )
    faults = sum((F.col(c) for c in out.columns[2:]), F.lit(0))
    return out.withColumn("passed", faults == 0)


def level2(bars: DataFrame) -> DataFrame:
    """Shape of returns by symbol: skew, excess kurtosis, autocorrelations, gaps, annualised Sharpe of minute bars."""
    w = over()
    r = bars.select("symbol", "ts", "ret", F.lag("ret", 1).over(w).alias("r1"), F.lag("ret", 5).over(w).alias("r5"), (F.unix_seconds("ts") - F.lag(F.unix_seconds("ts")).over(w)).alias("gap"))
    step = r.groupBy("symbol").agg(F.mode("gap").alias("step"))
    return (
        r.join(step, "symbol")
        .groupBy("symbol")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.skewness("ret").alias("skew"),
            F.kurtosis("ret").alias("kurtosis"),
            correlation("ret", "r1").alias("auto1"),
            correlation("ret", "r5").alias("auto5"),
            (F.count_if(F.col("gap") > F.col("step")) / F.count("gap")).alias("gap_ratio"),
            (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(525600.0))).alias("sharpe"),
        )
    )


def level2_tests(bars: DataFrame, span: float = chunked.SPAN) -> DataFrame:
    """Dickey-Fuller and ARCH-LM of the log returns, by symbol; the first bar has no return."""
    r = chunked.with_lags(bars, {"before_it": ("close", 1)}, span=span).select("symbol", "ts", F.ln(F.col("close") / F.col("before_it")).alias("r"))
    return stationarity.dickey_fuller(r, "r", span=span).join(stationarity.arch_lm(r, "r", span=span), "symbol")


def full(bars: DataFrame, span: float = chunked.SPAN) -> DataFrame:
    """Both levels by symbol; the second only where the first passes. Issues and warnings as comma-joined names.

    ``bars`` has seq, the order of arrival, and ret.
    """
    first = level1(bars)
    names = [c for c in first.columns if c not in ("symbol", "n", "passed")]
    faults = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in names]))
    first = first.select("symbol", "n", F.col("passed").alias("level1_passed"), faults.alias("faults"))
    sound = bars.join(first.where("level1_passed").select("symbol"), "symbol", "left_semi")
    second = level2(sound).drop("n").join(level2_tests(sound, span), "symbol")
    met = first.join(second, "symbol", "left")
    few, c = F.col("n") < 100, F.col
    enough = ~few & F.col("level1_passed")
    issues = F.array_compact(F.array(F.when(~c("level1_passed"), F.lit("level1_failed")), F.when(few & c("level1_passed"), F.lit("insufficient_data")), F.when(enough & (c("gap_ratio") > 0.05), F.lit("excessive_gaps"))))
    warnings = F.array_compact(
        F.array(
            F.when(F.abs("skew") > 5, F.lit("extreme_skew")),
            F.when(c("kurtosis") > 20, F.lit("heavy_tails")).when(c("kurtosis") < 0, F.lit("light_tails")),
            F.when((F.abs("auto1") < 0.01) & (c("n") > 1001), F.lit("no_autocorrelation")),
            F.when(c("adf_p") > 0.05, F.lit("not_stationary")),
            F.when(c("arch_p") > 0.10, F.lit("no_arch_effects")),
            F.when(c("gap_ratio") > 0.01, F.lit("gaps")),
        )
    )
    met = met.select("symbol", "n", "level1_passed", F.array_join("faults", ",").alias("faults"), F.array_join(issues, ",").alias("issues"), F.when(enough, F.array_join(warnings, ",")).otherwise("").alias("warnings"))
    return met.withColumn("overall_passed", F.col("issues") == "")
