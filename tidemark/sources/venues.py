"""Raw venue payloads (JSON text) to canonical columns, one projection a kind of payload.

Fetching is separate (see ``polling``): these run the same over a Kafka topic, files or a
polled source, in batch or on a stream. A payload that doesn't parse gives null columns, which
the bar and trade checks drop.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.bars import symbol

Projection = Callable[[Column], dict[str, Column]]


def _d(x: Column) -> Column:
    return x.try_cast("double")


def _ms(x: Column) -> Column:
    return F.timestamp_millis(x.cast("long"))


def _binance_kline(p: Column) -> dict[str, Column]:
    k = p["k"]
    return {"symbol": symbol(p["s"]), "ts": _ms(k["t"]), **{n: _d(k[c]) for n, c in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))}, "is_closed": k["x"]}


def _binance_trade(p: Column) -> dict[str, Column]:
    return {"symbol": symbol(p["s"]), "ts": _ms(p["T"]), "price": _d(p["p"]), "quantity": _d(p["q"]), "is_buyer_maker": p["m"], "side": F.when(p["m"], "sell").otherwise("buy")}


def _levels(x: Column) -> Column:
    return F.transform(x, lambda v: F.struct(_d(v[0]).alias("price"), _d(v[1]).alias("qty")))


def _binance_depth(p: Column) -> dict[str, Column]:
    """The symbol is the stream's name up to the @."""
    return {"symbol": symbol(F.substring_index(p["stream"], "@", 1)), "bids": _levels(p["data"]["bids"]), "asks": _levels(p["data"]["asks"])}


def _kraken_ohlc(p: Column) -> dict[str, Column]:
    close, volume = _d(p["close"]), _d(p["volume"])
    return {"symbol": symbol(p["pair"]), "ts": F.timestamp_seconds(_d(p["time"])), "open": _d(p["open"]), "high": _d(p["high"]), "low": _d(p["low"]), "close": close, "volume": volume, "quote_volume": close * volume}


def _price_point(p: Column) -> dict[str, Column]:
    return {"symbol": symbol(p["symbol"]), "ts": F.timestamp_seconds(p["last_updated_at"]), "price": _d(p["usd"]), "market_cap": _d(p["usd_market_cap"]), "change_24h_pct": _d(p["usd_24h_change"])}


def _asset(p: Column) -> dict[str, Column]:
    return {"symbol": symbol(p["symbol"]), "price": _d(p["priceUsd"]), "volume": _d(p["volumeUsd24Hr"]), "market_cap": _d(p["marketCapUsd"])}


def _transfer(p: Column) -> dict[str, Column]:
    return {"hash": p["hash"], "sender": p["from"], "receiver": p["to"], "value": _d(p["value"]) / 1e18, "gas_price": _d(p["gasPrice"]) / 1e9, "ts": F.timestamp_seconds(_d(p["timeStamp"]))}


def _aggregate(p: Column) -> dict[str, Column]:
    return {"ts": _ms(p["t"]), "open": p["o"], "high": p["h"], "low": p["l"], "close": p["c"], "volume": p["v"], "vwap": p["vw"], "trades": p["n"]}


def _news(p: Column) -> dict[str, Column]:
    return {"title": p["title"], "content": F.substring(p["content"], 1, 500), "published": p["pubDate"], "source": p["source_id"]}


def _votes(p: Column) -> dict[str, Column]:
    v = p["votes"]
    up, down = v["positive"] + v["liked"], v["negative"] + v["disliked"]
    return {"id": p["id"], "title": p["title"], "vote_score": F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0)}


def _message(p: Column) -> dict[str, Column]:
    tag = p["entities"]["sentiment"]["basic"]
    return {"id": p["id"], "text": p["body"], "followers": p["user"]["followers"], "tag": F.when(tag == "Bullish", 1.0).when(tag == "Bearish", -1.0)}


def _channel(p: Column) -> dict[str, Column]:
    """Views are written 1.2K or 3M; texts under 10 characters are dropped by the reader of ``keep``."""
    n, unit = _d(F.regexp_extract(p["views"], r"([\d.]+)", 1)), F.upper(F.right(p["views"], F.lit(1)))
    views = n * F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1.0)
    return {"text": p["text"], "views": F.round(views).cast("long"), "keep": F.length(p["text"]) >= 10}


def _reddit(p: Column) -> dict[str, Column]:
    return {"id": p["id"], "title": p["title"], "text": F.substring(p["selftext"], 1, 500), "score": p["score"], "ratio": p["upvote_ratio"], "engagement": p["score"] + p["num_comments"]}


def _headline(p: Column) -> dict[str, Column]:
    return {"id": p["id"], "title": p["headline"], "summary": p["summary"], "source": p["source"], "category": p["category"], "related": p["related"], "published": F.timestamp_seconds(p["datetime"])}


def _balance(p: Column) -> dict[str, Column]:
    """Positive less negative mentions by their sum, with the volume."""
    up, down = F.coalesce(p["positive"], F.lit(0.0)), F.coalesce(p["negative"], F.lit(0.0))
    return {"slug": p["slug"], "ts": p["datetime"].try_cast("timestamp"), "balance": F.when(up + down > 0, (up - down) / (up + down)).otherwise(0.0), "volume": p["volume"]}


def _tweet(p: Column) -> dict[str, Column]:
    m = p["public_metrics"]
    return {"id": p["id"], "text": p["text"], "ts": p["created_at"].try_cast("timestamp"), "engagement": m["like_count"] + m["retweet_count"] + m["reply_count"]}


#: kind: (schema of the payload, projection)
PAYLOADS: dict[str, tuple[str, Projection]] = {
    "binance_kline": ("s string, k struct<t:long,o:string,h:string,l:string,c:string,v:string,x:boolean>", _binance_kline),
    "binance_trade": ("s string, T long, p string, q string, m boolean", _binance_trade),
    "binance_depth": ("stream string, data struct<bids:array<array<string>>,asks:array<array<string>>>", _binance_depth),
    "kraken_ohlc": ("pair string, time string, open string, high string, low string, close string, volume string", _kraken_ohlc),
    "price_point": ("symbol string, usd double, usd_market_cap double, usd_24h_change double, last_updated_at long", _price_point),
    "asset": ("symbol string, priceUsd string, volumeUsd24Hr string, marketCapUsd string", _asset),
    "transfer": ("hash string, `from` string, `to` string, value string, gasPrice string, timeStamp string", _transfer),
    "aggregate": ("t long, o double, h double, l double, c double, v double, vw double, n long", _aggregate),
    "news": ("title string, content string, pubDate string, source_id string", _news),
    "votes": ("id long, title string, votes struct<positive:long,negative:long,liked:long,disliked:long>", _votes),
    "message": ("id long, body string, user struct<followers:long>, entities struct<sentiment:struct<basic:string>>", _message),
    "channel": ("text string, views string", _channel),
    "headline": ("id long, headline string, summary string, source string, category string, related string, datetime long", _headline),
    "social_balance": ("slug string, datetime string, positive double, negative double, volume long", _balance),
    "tweet": ("id string, text string, created_at string, public_metrics struct<like_count:long,retweet_count:long,reply_count:long>", _tweet),
    "reddit": ("id string, title string, selftext string, score long, upvote_ratio double, num_comments long", _reddit),
}


def parse(raw: DataFrame, kind: str, text: str = "value") -> DataFrame:
    """raw's other columns and the payload's canonical ones."""
    schema, project = PAYLOADS[kind]
    p = raw.withColumn("_p", F.from_json(F.col(text), schema))
    return p.select(*[c for c in raw.columns if c != text], *[v.alias(n) for n, v in project(F.col("_p")).items()])


def parallel_series(raw: DataFrame, text: str = "value") -> DataFrame:
    """Three parallel arrays of [time, value] zipped by place: a row a place, missing values null."""
    p = raw.select(F.from_json(text, "prices array<array<double>>, market_caps array<array<double>>, total_volumes array<array<double>>").alias("p"))
    z = p.select(F.inline(F.arrays_zip("p.prices", "p.market_caps", "p.total_volumes")))
    return z.select(F.timestamp_millis(F.col("prices")[0].cast("long")).alias("ts"), F.col("prices")[1].alias("price"), F.col("market_caps")[1].alias("market_cap"), F.col("total_volumes")[1].alias("volume"))


def bars_from_polls(points: DataFrame) -> DataFrame:
    """Polled prices as bars: open is the last price, high and low the extremes of both."""
    from tidemark.functions.columns import over

    before = F.coalesce(F.lag("price").over(over()), F.col("price"))
    return points.select("symbol", "ts", before.alias("open"), F.greatest("price", before).alias("high"), F.least("price", before).alias("low"), F.col("price").alias("close"))


def large_transfers(transfers: DataFrame, least: float = 100.0, n: int = 10) -> DataFrame:
    """The n newest transfers of at least ``least``."""
    return transfers.where(F.col("value") >= least).orderBy(F.desc("ts"), "hash").limit(n)


def social_balance(points: DataFrame, limit: float = 0.1) -> DataFrame:
    """Per slug: mean and latest balance, volumes and the signal, from points (slug, ts, balance, volume)."""
    out = points.groupBy("slug").agg(F.count(F.lit(1)).alias("points"), F.avg("balance").alias("score"), F.max_by("balance", "ts").alias("latest"), F.avg("volume").alias("mean_volume"))
    return out.withColumn("signal", F.when(F.col("score") > limit, "BULLISH").when(F.col("score") < -limit, "BEARISH").otherwise("NEUTRAL"))


def hot_posts(posts: DataFrame, n: int = 10, by: str = "subreddit") -> DataFrame:
    """The n posts of highest score of each ``by`` (ties by id), with their rank there."""
    from tidemark.functions.columns import over

    return posts.withColumn("rank", F.row_number().over(over(F.desc("score"), "id", by=(by,)))).where(F.col("rank") <= n)


def coin_mentions(posts: DataFrame, coins: list[str]) -> DataFrame:
    """Per coin the posts whose title or text names it (as a word, with or without $): mentions, sums and the mean score."""
    words = F.array_distinct(F.split(F.upper(F.concat_ws(" ", "title", "text")), r"[^A-Z0-9]+"))
    hit = posts.withColumn("coin", F.explode(F.array_intersect(words, F.array(*[F.lit(c.upper()) for c in coins]))))
    return hit.groupBy("coin").agg(F.count(F.lit(1)).alias("mentions"), F.sum("score").alias("total_score"), F.sum("comments").alias("total_comments"), F.avg("score").alias("mean_score"))


def watched_balances(wallets: DataFrame, balances: DataFrame) -> DataFrame:
    """Named wallets with their balances, 0 where none is known."""
    return wallets.join(balances, "address", "left").withColumn("balance", F.coalesce("balance", F.lit(0.0)))
