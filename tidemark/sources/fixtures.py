"""Adapters that shape the local tables as market, text and venue inputs, with the same shapes in SQL.

Every ordered operator sorts by (ts, id), so ties in time have one order in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import valence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type: symbol, ts, open, high, low, close, volume, trades, n (from 1)."""
    e = table(spark, sf_dir, "events").select("event_type", "ts", "event_id", "value")
    at = F.struct("ts", "event_id")
    return e.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("value", at).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", at).alias("close"),
        F.sum("value").alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )


BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, (ts, event_id)) AS close, sum(value) AS volume, count(*) AS trades
  FROM events GROUP BY 1, 2)"""


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from events: symbol, ts, event_id, price, quantity (json k above 0), is_buyer_maker."""
    e = table(spark, sf_dir, "events")
    quantity = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"), quantity.alias("quantity"), (F.col("event_id") % 2 == 1).alias("is_buyer_maker")
    ).where("quantity > 0")


TICKS = """ticks AS (
  SELECT * FROM (
    SELECT event_type AS symbol, ts, event_id, value AS price,
           CAST(json_extract_string(props, '$.k') AS DOUBLE) AS quantity, event_id % 2 = 1 AS is_buyer_maker
    FROM events) WHERE quantity > 0)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book an order: bids (O lines) best first, asks (F lines) best first, as arrays of (price, qty).

    Prices are 100 -/+ linenumber / 100, so that levels lie within the 1 % band; level ties rank by quantity.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_linestatus")
    side = lambda status, sign: F.when(F.col("l_linestatus") == status, F.struct((F.lit(100.0) + sign * F.col("l_linenumber") / 100).alias("price"), F.col("l_quantity").alias("qty")))
    found = line.groupBy(F.col("l_orderkey").alias("book_id")).agg(F.collect_list(side("O", -1)).alias("b"), F.collect_list(side("F", 1)).alias("a"))
    best_bid = lambda x, y: F.when(x["price"] > y["price"], -1).when(x["price"] < y["price"], 1).when(x["qty"] < y["qty"], -1).when(x["qty"] > y["qty"], 1).otherwise(0)
    return found.select("book_id", F.array_sort("b", best_bid).alias("bids"), F.array_sort("a").alias("asks"))


BOOKS = """levels AS (
  SELECT l_orderkey AS book_id, l_linestatus AS side, l_quantity AS qty,
         CASE WHEN l_linestatus = 'O' THEN 100.0 - l_linenumber / 100 ELSE 100.0 + l_linenumber / 100 END::DOUBLE AS price
  FROM lineitem WHERE l_linestatus IN ('O', 'F')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY book_id, side ORDER BY CASE WHEN side = 'O' THEN -price ELSE price END, qty) AS lvl FROM levels),
tops AS (
  SELECT book_id, max(price) FILTER (side = 'O' AND lvl = 1) AS best_bid, max(price) FILTER (side = 'F' AND lvl = 1) AS best_ask FROM ranked GROUP BY book_id)"""


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social posts from documents: id, symbol, source, text, engagement, ts (minutes after 2024-01-01)."""
    d = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(x) for x in ("twitter", "reddit", "news", "telegram")])
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("S"), (F.col("doc_id") % 5).cast("string")).alias("symbol"),
        F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("source"),
        "text",
        (F.col("n_chars") % 200).cast("double").alias("engagement"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("ts"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word and valence: the terms of the trade and what the labelled documents' words tell of their labels."""
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("text", F.col("quality").alias("label"))
    return valence.induced_lexicon(labelled).union(valence.trade_terms(spark))


def scored_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with score, the valence of their whole text."""
    return valence.scored(posts(spark, sf_dir), lexicon(spark, sf_dir)).withColumnRenamed("compound", "score").drop("pos", "neg", "neu")


POSTS = """posts AS (
  SELECT doc_id AS id, 'S' || CAST(doc_id % 5 AS VARCHAR) AS symbol,
         ['twitter', 'reddit', 'news', 'telegram'][CAST(doc_id % 4 + 1 AS INT)] AS source, text,
         CAST(n_chars % 200 AS DOUBLE) AS engagement,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) AS ts
  FROM documents)"""

VALENCE = f"""labelled AS (SELECT doc_id AS id, text, quality AS label FROM documents JOIN labels USING (doc_id)), {valence.lexicon_sql('labelled')},
texts AS (SELECT doc_id AS id, text FROM documents), {valence.scored_sql('texts')}"""
SCORED = f"{VALENCE}, {POSTS.replace('posts AS', 'plain AS', 1)}, posts AS (SELECT plain.*, compound AS score FROM plain JOIN valence USING (id))"


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id with the symbol and the hour (ts) that its book is of."""
    names = F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")])
    line = table(spark, sf_dir, "lineitem").where(F.col("l_linestatus").isin("O", "F")).select(F.col("l_orderkey").alias("book_id")).distinct()
    hour = F.timestamp_seconds(F.lit(1704067200) + F.floor(F.col("book_id") / 5) % 720 * 3600)
    return line.select("book_id", F.element_at(names, (F.col("book_id") % 5 + 1).cast("int")).alias("symbol"), hour.alias("ts"))
