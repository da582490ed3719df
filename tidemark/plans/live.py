"""Queries of the sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.columns import tidy
from tidemark.operators import recursive as re_
from tidemark.plans.collect import collector
from tidemark.session import shared_folder
from tidemark.sources import venues
from tidemark.sources.fixtures import TICKS, table
from tidemark.streaming import live

QUERIES, ORACLES, query = collector()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage that the session names as shared."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _events(spark, sf, kind: str):
    """Payloads of a kind made from events, as a venue would send them."""
    e = table(spark, sf, "events")
    text = F.col("value").cast("string")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    made = {
        "binance_trade": F.struct(F.concat("event_type", F.lit("/usdt")).alias("s"), ms.alias("T"), text.alias("p"), F.get_json_object("props", "$.k").alias("q"), (F.col("event_id") % 2 == 1).alias("m")),
        "kraken_ohlc": F.struct(F.lit("XBT/USDT").alias("pair"), (ms / 1000).cast("long").cast("string").alias("time"), text.alias("open"), text.alias("high"), text.alias("low"), text.alias("close"), F.get_json_object("props", "$.k").alias("volume")),
        "channel": F.struct(F.concat(F.lit("text "), "event_type").alias("text"), F.concat((F.col("event_id") % 90 + 1).cast("string"), F.when(F.col("event_id") % 3 == 0, "K").when(F.col("event_id") % 3 == 1, "M").otherwise("")).alias("views")),
    }[kind]
    return e.select("event_id", F.to_json(made).alias("value"))


@query("source_trades", """SELECT event_id, upper(event_type) || 'USDT' AS symbol, epoch_us(ts) // 1000 AS ts_ms, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, CASE WHEN event_id % 2 = 1 THEN 'sell' ELSE 'buy' END AS side FROM events""")
def _trades(spark, sf):
    out = venues.parse(_events(spark, sf, "binance_trade"), "binance_trade")
    return out.select("event_id", "symbol", F.unix_millis("ts").alias("ts_ms"), "price", "quantity", "side")


@query("source_bars", """SELECT event_id, 'BTCUSDT' AS symbol, epoch_us(ts) // 1000000 AS ts_s, value AS close, round(value * CAST(json_extract_string(props, '$.k') AS DOUBLE), 4) + 0.0 AS quote_volume FROM events""")
def _bars(spark, sf):
    out = venues.parse(_events(spark, sf, "kraken_ohlc"), "kraken_ohlc")
    return out.select("event_id", "symbol", F.unix_seconds("ts").alias("ts_s"), "close", tidy("quote_volume").alias("quote_volume"))


@query("source_views", """SELECT event_id, CAST((event_id % 90 + 1) * CASE event_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS BIGINT) AS views, length('text ' || event_type) >= 10 AS keep FROM events""")
def _views(spark, sf):
    return venues.parse(_events(spark, sf, "channel"), "channel").select("event_id", "views", "keep")


@query("polled_bars", """WITH p AS (SELECT event_type AS symbol, ts, event_id, value AS price, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS b FROM events)
SELECT symbol, epoch_us(ts) AS ts_us, coalesce(b, price) AS open, greatest(price, coalesce(b, price)) AS high, least(price, coalesce(b, price)) AS low, price AS close FROM p""")
def _polls(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    return venues.bars_from_polls(e).select("symbol", F.unix_micros("ts").alias("ts_us"), "open", "high", "low", "close")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    e = live.read_files(spark, f"{sf}/events.parque[t]", schema)  # a glob may name a file or a folder
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), F.get_json_object("props", "$.k").cast("double").alias("quantity")).where("quantity > 0")


@query("stream_kalman", f"""WITH RECURSIVE {TICKS},
num AS (SELECT symbol, event_id, price AS z, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) AS n FROM ticks),
r AS (
  SELECT symbol, event_id, n, z::DOUBLE AS k, 0.1::DOUBLE AS v FROM num WHERE n = 1 UNION ALL
  SELECT x.symbol, x.event_id, x.n, p.k + (p.v + 0.01) / (p.v + 0.01 + 0.1) * (x.z - p.k), (1 - (p.v + 0.01) / (p.v + 0.01 + 0.1)) * (p.v + 0.01)
  FROM r p JOIN num x ON x.symbol = p.symbol AND x.n = p.n + 1)
SELECT symbol, event_id, round(k, 4) + 0.0 AS kalman FROM r""")
def _kalman(spark, sf):
    """The batch operator's step on a stream of files, drained into a table."""
    out, at = scratch(spark, "stream-kalman"), scratch(spark, "stream-checkpoint")
    live.drain(live.scan_stream(_stream(spark, sf), [re_.kalman("price")], order=("ts", "event_id")), out, at)
    return spark.read.parquet(out).select("symbol", "event_id", tidy("kalman").alias("kalman"))


@query("stream_bars", f"""WITH {TICKS}, m AS (SELECT max(ts) AS top FROM ticks),
b AS (
  SELECT symbol, date_trunc('hour', ts) AS h, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, round(sum(quantity), 4) + 0.0 AS volume, count(*) AS trades
  FROM ticks GROUP BY 1, 2)
SELECT symbol, epoch_us(h) AS ts_us, open, high, low, close, volume, trades FROM b, m WHERE h + INTERVAL 1 HOUR <= top - INTERVAL 10 MINUTE""")
def _stream_bars(spark, sf):
    """Bars by event time; windows that the watermark has not passed stay open and are not in the table."""
    out, at = scratch(spark, "stream-bars"), scratch(spark, "stream-checkpoint")
    live.drain(live.bars_stream(_stream(spark, sf)), out, at)
    return spark.read.parquet(out).select("symbol", F.unix_micros("ts").alias("ts_us"), "open", "high", "low", "close", tidy("volume").alias("volume"), "trades")
