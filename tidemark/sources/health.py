"""Health of message sources, from the messages themselves: counts, errors, age and the state that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def connector_health(messages: DataFrame, now: Column | None = None, stale: float = 60.0, lost: float = 300.0, by: str = "source") -> DataFrame:
    """Per source of (ts, error): messages, errors, seconds up and since the last message, and its state.

    connected within ``stale`` seconds of a message, reconnecting within ``lost``, else
    disconnected; error where the newest message is one. ``now`` is by default the newest time of all.
    """
    seen = messages.groupBy(by).agg(
        F.count_if(~F.col("error")).alias("messages"), F.count_if(F.col("error")).alias("errors"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.max_by("error", "ts").alias("failing")
    )
    if now is None:
        seen = seen.join(seen.agg(F.max("last").alias("now")))  # one row
        now = F.col("now")
    age = (F.unix_micros(now) - F.unix_micros("last")) / 1e6
    out = seen.select(by, "messages", "errors", age.alias("age"), ((F.unix_micros(now) - F.unix_micros("first")) / 1e6).alias("uptime"), "failing")
    state = F.when(F.col("failing"), "error").when(F.col("age") <= stale, "connected").when(F.col("age") <= lost, "reconnecting").otherwise("disconnected")
    return out.select(by, "messages", "errors", "age", "uptime", (F.col("age") > stale).alias("stale"), state.alias("state"))
