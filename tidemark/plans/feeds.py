"""Queries of the payload parsers and of what is built on parsed payloads."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.columns import tidy
from tidemark.operators import sentiment
from tidemark.plans.collect import collector
from tidemark.sources import health, venues
from tidemark.sources.fixtures import POSTS, SCORED, posts, scored_posts, table
from tidemark.streaming import live

QUERIES, ORACLES, query = collector()


def _payloads(spark, sf, name: str, key: str, **fields: Column):
    """Rows of a table as the JSON that a venue sends."""
    return table(spark, sf, name).select(F.col(key), F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])).alias("value"))


def _ms() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")


@query("source_klines", "SELECT event_id, upper(event_type) || 'USDT' AS symbol, epoch_us(ts) // 1000 AS ts_ms, value AS open, value + 1 AS high, value - 1 AS low, value AS close, event_id % 2 = 0 AS is_closed FROM events")
def _klines(spark, sf):
    k = F.struct(_ms().alias("t"), F.col("value").cast("string").alias("o"), (F.col("value") + 1).cast("string").alias("h"), (F.col("value") - 1).cast("string").alias("l"), F.col("value").cast("string").alias("c"), F.lit("1").alias("v"), (F.col("event_id") % 2 == 0).alias("x"))
    out = venues.parse(_payloads(spark, sf, "events", "event_id", s=F.concat("event_type", F.lit("usdt")), k=k), "binance_kline")
    return out.select("event_id", "symbol", F.unix_millis("ts").alias("ts_ms"), "open", "high", "low", "close", "is_closed")


@query("source_depth", """SELECT event_id, upper(event_type) || 'USDT' AS symbol, 2 AS n_bids, 1 AS n_asks, value AS best_bid, round(value + 0.5, 4) + 0.0 AS best_ask, 3.5::DOUBLE AS bid_qty FROM events""")
def _depth(spark, sf):
    level = lambda p, q: F.array(p.cast("string"), F.lit(q))
    data = F.struct(F.array(level(F.col("value"), "3.5"), level(F.col("value") - 1, "x")).alias("bids"), F.array(level(F.col("value") + 0.5, "2")).alias("asks"))
    out = venues.parse(_payloads(spark, sf, "events", "event_id", stream=F.concat("event_type", F.lit("usdt@depth20")), data=data), "binance_depth")
    return out.select("event_id", "symbol", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), F.col("bids")[0]["price"].alias("best_bid"), tidy(F.col("asks")[0]["price"]).alias("best_ask"), F.col("bids")[0]["qty"].alias("bid_qty"))


@query("source_price_points", "SELECT c_custkey, 'COIN' || c_nationkey AS symbol, c_custkey * 60 AS ts_s, round(c_acctbal, 4) + 0.0 AS price, round(c_acctbal * 1000, 4) + 0.0 AS market_cap FROM customer")
def _points(spark, sf):
    made = _payloads(spark, sf, "customer", "c_custkey", symbol=F.concat(F.lit("coin"), "c_nationkey"), usd=F.col("c_acctbal"), usd_market_cap=F.col("c_acctbal") * 1000, usd_24h_change=F.lit(0.5), last_updated_at=F.col("c_custkey") * 60)
    out = venues.parse(made, "price_point")
    return out.select("c_custkey", "symbol", F.unix_seconds("ts").alias("ts_s"), tidy("price").alias("price"), tidy("market_cap").alias("market_cap"))


@query("source_assets", "SELECT s_suppkey, 'A' || s_nationkey AS symbol, CASE WHEN s_suppkey % 3 > 0 THEN round(s_acctbal, 4) + 0.0 END AS price FROM supplier")
def _assets(spark, sf):
    price = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal").cast("string")).otherwise("n/a")
    out = venues.parse(_payloads(spark, sf, "supplier", "s_suppkey", symbol=F.concat(F.lit("a"), "s_nationkey"), priceUsd=price), "asset")
    return out.select("s_suppkey", "symbol", tidy("price").alias("price"))


_TRANSFERS = "t AS (SELECT o_orderkey, 'h' || o_orderkey AS hash, 'c' || o_custkey AS sender, o_totalprice / 1000 AS value, epoch(o_orderdate)::BIGINT AS ts_s FROM orders)"


def _transfers(spark, sf):
    made = _payloads(spark, sf, "orders", "o_orderkey", hash=F.concat(F.lit("h"), "o_orderkey"), **{"from": F.concat(F.lit("c"), "o_custkey"), "to": F.lit("x")}, value=(F.col("o_totalprice") * 1e15).cast("decimal(38,0)").cast("string"), gasPrice=F.lit("2000000000"), timeStamp=F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"))
    return venues.parse(made, "transfer")


@query("source_transfers", f"WITH {_TRANSFERS} SELECT o_orderkey, hash, sender, round(value, 4) + 0.0 AS value, 2.0::DOUBLE AS gas_price, ts_s FROM t")
def _transfer_rows(spark, sf):
    return _transfers(spark, sf).select("o_orderkey", "hash", "sender", tidy("value").alias("value"), "gas_price", F.unix_seconds("ts").alias("ts_s"))


@query("large_transfers", f"WITH {_TRANSFERS} SELECT hash, round(value, 4) + 0.0 AS value FROM t WHERE value >= 150 ORDER BY ts_s DESC, hash LIMIT 10")
def _large(spark, sf):
    """The ten newest transfers of 150 or more."""
    return venues.large_transfers(_transfers(spark, sf), 150.0, 10).select("hash", tidy("value").alias("value"))


@query("watched_balances", "SELECT 'n' || n_nationkey AS address, n_name AS name, round(coalesce(sum(c_acctbal) FILTER (c_nationkey % 3 > 0), 0), 2) + 0.0 AS balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _watched(spark, sf):
    wallets = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("address"), F.col("n_name").alias("name"))
    balances = table(spark, sf, "customer").where("c_nationkey % 3 > 0").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("address")).agg(F.sum("c_acctbal").alias("balance"))
    return venues.watched_balances(wallets, balances).select("address", "name", (F.round("balance", 2) + 0.0).alias("balance"))


@query("source_aggregates", "SELECT event_id, epoch_us(ts) // 1000 AS ts_ms, value AS open, value AS vwap, event_id AS trades FROM events")
def _aggregates(spark, sf):
    v = F.col("value")
    out = venues.parse(_payloads(spark, sf, "events", "event_id", t=_ms(), o=v, h=v, l=v, c=v, v=F.lit(1.0), vw=v, n=F.col("event_id")), "aggregate")
    return out.select("event_id", F.unix_millis("ts").alias("ts_ms"), "open", "vwap", "trades")


@query("source_news", "SELECT doc_id, source, substr(text, 1, 500) AS content, 'd' || doc_id AS title FROM documents")
def _news(spark, sf):
    out = venues.parse(_payloads(spark, sf, "documents", "doc_id", title=F.concat(F.lit("d"), "doc_id"), content=F.col("text"), pubDate=F.lit("2024-01-01"), source_id=F.col("source")), "news")
    return out.select("doc_id", "source", "content", "title")


@query("source_headlines", "SELECT doc_id, doc_id * 60 AS ts_s, source, lang AS category FROM documents")
def _headlines(spark, sf):
    out = venues.parse(_payloads(spark, sf, "documents", "doc_id", id=F.col("doc_id"), headline=F.lit("h"), source=F.col("source"), category=F.col("lang"), datetime=F.col("doc_id") * 60), "headline")
    return out.select("doc_id", F.unix_seconds("published").alias("ts_s"), "source", "category")


_UP, _DOWN = "(n_chars % 11)", "(n_chars % 7)"


@query("source_votes", f"SELECT doc_id, round(CASE WHEN {_UP} + {_DOWN} + 1 > 0 THEN ({_UP} + 1 - {_DOWN}) / ({_UP} + 1 + {_DOWN}) ELSE 0 END, 4) + 0.0 AS vote_score FROM documents")
def _votes(spark, sf):
    votes = F.struct((F.col("n_chars") % 11).alias("positive"), (F.col("n_chars") % 7).alias("negative"), F.lit(1).alias("liked"), F.lit(0).alias("disliked"))
    out = venues.parse(_payloads(spark, sf, "documents", "doc_id", id=F.col("doc_id"), title=F.lit("t"), votes=votes), "votes")
    return out.select("doc_id", tidy("vote_score").alias("vote_score"))


@query("source_messages", "SELECT doc_id, n_chars AS followers, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 END::DOUBLE AS tag FROM documents")
def _messages(spark, sf):
    basic = F.when(F.col("doc_id") % 3 == 0, "Bullish").when(F.col("doc_id") % 3 == 1, "Bearish")
    out = venues.parse(_payloads(spark, sf, "documents", "doc_id", id=F.col("doc_id"), body=F.lit("b"), user=F.struct(F.col("n_chars").alias("followers")), entities=F.struct(F.struct(basic.alias("basic")).alias("sentiment"))), "message")
    return out.select("doc_id", "followers", "tag")


@query("source_tweets", "SELECT doc_id, CAST(n_chars % 5 + n_chars % 3 + 1 AS BIGINT) AS engagement, epoch(TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)))::BIGINT AS ts_s FROM documents")
def _tweets(spark, sf):
    metrics = F.struct((F.col("n_chars") % 5).alias("like_count"), (F.col("n_chars") % 3).alias("retweet_count"), F.lit(1).alias("reply_count"))
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    out = venues.parse(_payloads(spark, sf, "documents", "doc_id", id=F.col("doc_id").cast("string"), text=F.lit("t"), created_at=at, public_metrics=metrics), "tweet")
    return out.select("doc_id", "engagement", F.unix_seconds("ts").alias("ts_s"))


@query("social_balance", """WITH p AS (SELECT lang AS slug, doc_id, (n_chars % 13)::DOUBLE AS up, (n_chars % 9)::DOUBLE AS down, n_chars AS v FROM documents),
b AS (SELECT *, CASE WHEN up + down > 0 THEN (up - down) / (up + down) ELSE 0.0 END AS b FROM p)
SELECT slug, count(*) AS points, round(avg(b), 4) + 0.0 AS score, round(arg_max(b, doc_id), 4) + 0.0 AS latest, round(avg(v), 4) + 0.0 AS mean_volume, CASE WHEN avg(b) > 0.1 THEN 'BULLISH' WHEN avg(b) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal FROM b GROUP BY slug""")
def _balance(spark, sf):
    at = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    made = _payloads(spark, sf, "documents", "doc_id", slug=F.col("lang"), datetime=at, positive=(F.col("n_chars") % 13).cast("double"), negative=(F.col("n_chars") % 9).cast("double"), volume=F.col("n_chars"))
    out = venues.social_balance(venues.parse(made, "social_balance"))
    return out.select("slug", "points", tidy("score").alias("score"), tidy("latest").alias("latest"), tidy("mean_volume").alias("mean_volume"), "signal")


_SUBS = f"{POSTS}, r AS (SELECT id, symbol AS subreddit, CAST(engagement AS BIGINT) AS score, CASE WHEN id % 4 = 0 THEN 'Buy BTC now' WHEN id % 6 = 1 THEN 'why $eth' ELSE 'x' END AS title, CASE WHEN id % 5 = 0 THEN 'btc, ETH' ELSE 'btcx' END AS text, id % 17 AS comments FROM posts)"


def _reddit(spark, sf):
    p = posts(spark, sf)
    title = F.when(F.col("id") % 4 == 0, "Buy BTC now").when(F.col("id") % 6 == 1, "why $eth").otherwise("x")
    return p.select("id", F.col("symbol").alias("subreddit"), F.col("engagement").cast("long").alias("score"), title.alias("title"), F.when(F.col("id") % 5 == 0, "btc, ETH").otherwise("btcx").alias("text"), (F.col("id") % 17).alias("comments"))


@query("hot_posts", f"WITH {_SUBS} SELECT subreddit, id, score, row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, id) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, id) <= 10")
def _hot(spark, sf):
    """The ten posts of highest score of each forum."""
    return venues.hot_posts(_reddit(spark, sf)).select("subreddit", "id", "score", F.col("rank").cast("long").alias("rank"))


@query("coin_mentions", f"""WITH {_SUBS}, h AS (SELECT *, unnest(list_filter(['BTC', 'ETH'], lambda c: list_contains(string_split_regex(upper(title || ' ' || text), '[^A-Z0-9]+'), c))) AS coin FROM r)
SELECT coin, count(*) AS mentions, CAST(sum(score) AS BIGINT) AS total_score, CAST(sum(comments) AS BIGINT) AS total_comments, round(avg(score), 4) + 0.0 AS mean_score FROM h GROUP BY coin""")
def _mentions(spark, sf):
    out = venues.coin_mentions(_reddit(spark, sf), ["btc", "eth"])
    return out.select("coin", "mentions", "total_score", "total_comments", tidy("mean_score").alias("mean_score"))


@query("price_history", "SELECT c_custkey * 1000 AS ts_ms, c_acctbal AS price, c_acctbal * 2 AS market_cap, CASE WHEN c_custkey % 2 = 0 THEN 1.0 END::DOUBLE AS volume FROM customer")
def _history(spark, sf):
    """Parallel arrays of [time, value], one payload a row here."""
    c = table(spark, sf, "customer")
    pair = lambda v: F.array((F.col("c_custkey") * 1000).cast("double"), v)
    made = F.struct(F.array(pair(F.col("c_acctbal"))).alias("prices"), F.array(pair(F.col("c_acctbal") * 2)).alias("market_caps"), F.when(F.col("c_custkey") % 2 == 0, F.array(pair(F.lit(1.0)))).otherwise(F.array().cast("array<array<double>>")).alias("total_volumes"))
    out = venues.parallel_series(c.select(F.to_json(made).alias("value")))
    return out.select(F.unix_millis("ts").alias("ts_ms"), "price", "market_cap", "volume")


@query("connector_health", """WITH m AS (SELECT event_type || event_id % 7 AS source, ts, event_id % 29 = 0 AS error FROM events), n AS (SELECT max(ts) AS now FROM m),
h AS (SELECT source, count(*) FILTER (NOT error) AS messages, count(*) FILTER (error) AS errors, epoch(any_value(now)) - epoch(max(ts)) AS age, arg_max(error, ts) AS failing FROM m, n GROUP BY source)
SELECT source, messages, errors, round(age, 3) AS age, age > 60 AS stale, CASE WHEN failing THEN 'error' WHEN age <= 60 THEN 'connected' WHEN age <= 300 THEN 'reconnecting' ELSE 'disconnected' END AS state FROM h""")
def _health(spark, sf):
    e = table(spark, sf, "events").select(F.concat("event_type", F.col("event_id") % 7).alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 29 == 0).alias("error"))
    return health.connector_health(e).select("source", "messages", "errors", F.round("age", 3).alias("age"), "stale", "state")


@query("published_signals", "SELECT event_id, event_type AS symbol, value AS signal, event_id % 3 = 0 AS tradable, epoch_us(ts) // 1000 AS ts_ms FROM events")
def _published(spark, sf):
    """Signals as the messages that a topic takes, read back from them."""
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("value").alias("signal"), (F.col("event_id") % 3 == 0).alias("tradable"), _ms().alias("ts_ms"))
    return live.from_messages(live.to_messages(e, kind="signal"), "event_id long, symbol string, signal double, tradable boolean, ts_ms long")


@query("published_onchain", "SELECT o_orderkey, 'S' || o_custkey % 5 AS symbol, round(o_totalprice / 1000, 4) + 0.0 AS netflow FROM orders")
def _published_onchain(spark, sf):
    """On-chain signals by the same way."""
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("S"), (F.col("o_custkey") % 5).cast("string")).alias("symbol"), tidy(F.col("o_totalprice") / 1000).alias("netflow"))
    return live.from_messages(live.to_messages(o, kind="onchain"), "o_orderkey long, symbol string, netflow double")


@query("routed_messages", """WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ohlcv' WHEN 1 THEN 'orderbook' WHEN 2 THEN 'trade' END AS type, CASE WHEN event_id % 11 > 0 THEN event_type END AS symbol, event_id % 10 / 10.0 AS q FROM events)
SELECT event_id, coalesce(type, 'ohlcv') AS kind FROM m WHERE symbol IS NOT NULL AND q >= 0.5""")
def _routed(spark, sf):
    """Messages by type; those without a symbol or of poor quality are dropped."""
    kind = F.when(F.col("event_id") % 4 == 0, "ohlcv").when(F.col("event_id") % 4 == 1, "orderbook").when(F.col("event_id") % 4 == 2, "trade")
    made = _payloads(spark, sf, "events", "event_id", type=kind, symbol=F.when(F.col("event_id") % 11 > 0, F.col("event_type")), quality_score=F.col("event_id") % 10 / 10)
    parts = [rows.select("event_id", F.lit(name).alias("kind")) for name, rows in live.route(made).items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("symbol_sentiment", f"""WITH {SCORED}
SELECT symbol, count(*) AS n, round(avg(score), 4) + 0.0 AS score, count(*) FILTER (score > 0.3) AS bullish, count(*) FILTER (score < -0.3) AS bearish, count(*) FILTER (score BETWEEN -0.3 AND 0.3) AS neutral,
  CASE WHEN avg(score) > 0.1 THEN 'BULLISH' WHEN avg(score) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal FROM posts GROUP BY symbol""")
def _symbol_sentiment(spark, sf):
    """A symbol's posts in one row."""
    return sentiment.summary(scored_posts(spark, sf)).select("symbol", "n", tidy("score").alias("score"), "bullish", "bearish", "neutral", "signal")


@query("recent_posts", f"WITH {POSTS}, n AS (SELECT max(ts) AS now FROM posts) SELECT id, symbol FROM posts, n WHERE ts >= now - INTERVAL 6 HOUR")
def _recent(spark, sf):
    """Posts of the last six hours."""
    return sentiment.recent(posts(spark, sf), 6).select("id", "symbol")
