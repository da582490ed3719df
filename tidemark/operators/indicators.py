"""Technical indicators that bounded windows express: no recursion, so Catalyst plans them whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import chunked
from tidemark.functions.columns import last, over, ratio, running


def _weighted(x: Column, weights: list[float], w) -> Column:
    """Sum of lagged values times weights, oldest weight first; null until all rows are there."""
    terms = [F.lag(x, len(weights) - 1 - i).over(w) * F.lit(float(v)) for i, v in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / F.lit(float(sum(weights)))


def wma(x: Column, n: int, w=None) -> Column:
    return _weighted(x, [i + 1 for i in range(n)], over() if w is None else w)


def hull(df: DataFrame, price: str, n: int, name: str) -> DataFrame:
    """WMA over sqrt(n) rows of 2 * WMA(n / 2) - WMA(n)."""
    raw = df.withColumn("_raw", 2 * wma(F.col(price), n // 2) - wma(F.col(price), n))
    return raw.withColumn(name, wma(F.col("_raw"), int(math.sqrt(n)))).drop("_raw")


def alma(df: DataFrame, price: str, n: int = 21, offset: float = 0.85, sigma: float = 6.0, name: str = "alma") -> DataFrame:
    """Gaussian weights centred at offset * (n - 1) of the last n rows."""
    m, s = offset * (n - 1), n / sigma
    return df.withColumn(name, _weighted(F.col(price), [math.exp(-((i - m) ** 2) / (2 * s * s)) for i in range(n)], over()))


def _full(c: Column, n: int) -> Column:
    return F.when(F.count(F.lit(1)).over(last(n)) == n, c)


def williams_r(df: DataFrame, n: int = 14) -> DataFrame:
    """-100 * (highest high - close) / range of the last n rows; -50 where flat."""
    high, low = F.max("high").over(last(n)), F.min("low").over(last(n))
    return df.withColumn("williams_r", _full(F.when(high != low, -100 * (high - F.col("close")) / (high - low)).otherwise(-50.0), n))


def raw_stochastic(df: DataFrame, n: int = 14) -> DataFrame:
    """Place of the close in the range of the last n rows; 0.5 where flat."""
    high, low = F.max("high").over(last(n)), F.min("low").over(last(n))
    return df.withColumn("stoch_raw", _full(F.when(high != low, (F.col("close") - low) / (high - low)).otherwise(0.5), n))


def simple_rsi(df: DataFrame, price: str = "close", n: int = 14, name: str = "rsi") -> DataFrame:
    """RSI from plain sums of gains and losses of the last n changes; 100 without losses."""
    change = df.withColumn("_d", F.col(price) - F.lag(price).over(over()))
    w = last(n)
    gains, losses = F.sum(F.greatest("_d", F.lit(0.0))).over(w), -F.sum(F.least("_d", F.lit(0.0))).over(w)
    rsi = F.when(losses == 0, 100.0).otherwise(100 - 100 / (1 + gains / losses))
    return change.withColumn(name, F.when(F.count("_d").over(w) == n, rsi)).drop("_d")


def true_range(df: DataFrame) -> DataFrame:
    """Largest of high - low and the distances of both to the previous close."""
    prev = F.lag("close").over(over())
    return df.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))


def efficiency_ratio(df: DataFrame, price: str = "close", n: int = 10) -> DataFrame:
    """Change over n rows by the path's length."""
    moved = df.withColumn("_s", F.abs(F.col(price) - F.lag(price).over(over())))
    path = F.sum("_s").over(last(n))
    change = F.abs(F.col(price) - F.lag(price, n).over(over()))
    return moved.withColumn("efficiency", F.when(change.isNotNull(), ratio(change, path))).drop("_s")


def volume_delta(df: DataFrame) -> DataFrame:
    """Synthetic delta of a bar: volume * (2 (close - low) - range) / range, 0 where flat; and its running sum."""
    r = F.col("high") - F.col("low")
    delta = F.when(r > 0, F.col("volume") * (2 * (F.col("close") - F.col("low")) - r) / r).otherwise(0.0)
    out = df.withColumn("delta", delta)
    return out.withColumn("cvd", F.sum("delta").over(running())).withColumn("pressure", F.when(r > 0, 2 * (F.col("close") - F.col("low")) / r - 1).otherwise(0.0))


def volume_trend(df: DataFrame, delta_rows: int = 20, pressure_rows: int = 10, span: float = chunked.SPAN) -> DataFrame:
    """Jurik averages of a bar's delta and pressure, the pressure's direction, and 1 or -1 where the price moves against the delta's average."""
    d = chunked.with_lags(volume_delta(df), {"before_it": ("close", 1)}, span=span)
    smooth = [chunked.jma("delta", delta_rows, warm=False, name="delta_trend"), chunked.jma("pressure", pressure_rows, warm=False, name="pressure_trend")]
    out = d.select("symbol", "ts", "delta", "pressure", (F.col("close") - F.col("before_it")).alias("change")).join(chunked.scan_chunks(d, smooth, span=span), ["symbol", "ts"])
    p = F.col("pressure_trend")
    direction = F.when(p > 0.2, "buying").when(p < -0.2, "selling").otherwise("neutral")
    against = F.when((F.abs("change") >= 1e-10) & (F.signum("change") * F.signum("delta_trend") < 0), -F.signum("change")).otherwise(0.0)
    return out.select("*", direction.alias("direction"), against.alias("divergence"))


def relative_volume(df: DataFrame) -> DataFrame:
    """z of volume among the same minute of the day, itself included; its unusual flag and label."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    w = running("ts", by=("symbol", "minute"))
    out = df.withColumn("minute", minute)
    std = F.stddev_samp("volume").over(w)
    z = F.when((F.count("volume").over(w) >= 2) & (std > 1e-10), (F.col("volume") - F.avg("volume").over(w)) / std).otherwise(0.0)
    out = out.withColumn("rvol_z", z)
    v = F.col("rvol_z")
    label = F.when(v > 3, "extreme_high").when(v > 2, "very_high").when(v > 1, "high").when(v > -1, "normal").when(v > -2, "low").otherwise("very_low")
    return out.select("*", (F.abs(v) > 2).alias("unusual"), label.alias("rvol_label"))
