"""Order books and trade flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators import chunked
from tidemark.functions.columns import clip, last, over, ratio, running, z_score

TRADE = ("ts", "event_id")


def depth(levels: Column, k: int | None = None) -> Column:
    """Total quantity of the first k levels (all without k)."""
    part = levels if k is None else F.slice(levels, 1, k)
    return F.aggregate(part, F.lit(0.0), lambda t, x: t + x["qty"])


def within(levels: Column, mid: Column, share: float) -> Column:
    """The levels within ``share`` of the mid price."""
    return F.filter(levels, lambda x: F.abs(x["price"] - mid) <= mid * share)


def book_features(books: DataFrame, k: int = 5, band: float = 0.01) -> DataFrame:
    """Best prices, mid, spread, imbalances, depth in the band, microprice and its deviation.

    An empty side gives null prices, imbalance of what there is, and 0 where nothing is there.
    """
    bids, asks = F.col("bids"), F.col("asks")
    b = books.select("*", F.get(bids, 0)["price"].alias("best_bid"), F.get(asks, 0)["price"].alias("best_ask"), F.get(bids, 0)["qty"].alias("bid_qty"), F.get(asks, 0)["qty"].alias("ask_qty"))
    b = b.select("*", ((F.col("best_bid") + F.col("best_ask")) / 2).alias("mid"), (F.col("best_ask") - F.col("best_bid")).alias("spread"))
    mid = F.col("mid")
    imbalance = lambda x, y: F.when(x + y > 0, (x - y) / (x + y)).otherwise(0.0)
    near_b, near_a = depth(within(F.slice(bids, 1, k), mid, band)), depth(within(F.slice(asks, 1, k), mid, band))
    micro = F.when(F.col("bid_qty") + F.col("ask_qty") > 0, (F.col("best_bid") * F.col("ask_qty") + F.col("best_ask") * F.col("bid_qty")) / (F.col("bid_qty") + F.col("ask_qty"))).otherwise(mid)
    return b.select(
        "*",
        imbalance(depth(bids, k), depth(asks, k)).alias("obi"),
        imbalance(depth(bids, 10), depth(asks, 10)).alias("lob_imbalance"),
        F.when(mid.isNotNull(), imbalance(near_b, near_a)).otherwise(0.0).alias("obi_band"),
        F.when(mid.isNotNull(), F.when(near_a > 0, near_b / near_a).otherwise(1.0)).otherwise(1.0).alias("depth_ratio"),
        depth(within(bids, mid, band)).alias("bid_depth_1pct"),
        depth(within(asks, mid, band)).alias("ask_depth_1pct"),
        (F.col("spread") / mid * 100).alias("spread_pct"),
        F.when((F.col("spread") > 0) & (mid > 0), (micro - mid) / F.col("spread")).otherwise(0.0).alias("micro_dev"),
    )


def trade_metrics(trades: DataFrame, n: int = 100) -> DataFrame:
    """Running side volumes and CVD; VWAP, flow imbalance, velocity and mean size of the last n trades.

    Sums of the last n rows are differences of running sums, so the work doesn't grow with n.
    """
    buy = ~F.col("is_buyer_maker")
    q = F.col("quantity")
    run, w = running(*TRADE), over(*TRADE)
    t = trades.select("*", F.when(buy, q).otherwise(0.0).alias("bought"), F.when(buy, 0.0).otherwise(q).alias("sold"), F.row_number().over(w).alias("seq"))
    t = t.select(
        "*",
        F.sum("bought").over(run).alias("buy_volume"),
        F.sum("sold").over(run).alias("sell_volume"),
        F.sum(F.col("bought") - F.col("sold")).over(run).alias("cvd"),
        F.sum(F.col("price") * q).over(run).alias("_paid"),
        F.sum("quantity").over(run).alias("_total"),
        F.coalesce(F.lag("ts", n - 1).over(w), F.first("ts").over(run)).alias("_since"),
    )
    moved = lambda c: F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0.0))
    t = t.select("*", moved("_paid").alias("_p"), moved("_total").alias("_q"), moved("cvd").alias("_net"), F.least(F.col("seq"), F.lit(n)).alias("_n"), ((F.unix_micros("ts") - F.unix_micros("_since")) / 1e6).alias("_span"))
    return t.select(
        "*",
        ratio(F.col("_p"), F.col("_q")).alias("vwap"),
        ratio(F.col("_net"), F.col("_q")).alias("flow_imbalance"),
        F.when((F.col("_n") >= 2) & (F.col("_span") > 0), F.col("_n") / F.col("_span")).otherwise(0.0).alias("velocity"),
        (F.col("_q") / F.col("_n")).alias("mean_size"),
    ).drop("_paid", "_since", "_p", "_q", "_net", "_n", "_span")


def order_flow(trades: DataFrame, vpin_rows: int = 50, trend_rows: int = 20) -> DataFrame:
    """CVD z (clipped), CVD-price divergence, VPIN, intensity z (clipped) and the aggressive share."""
    t = trade_metrics(trades)
    trend, run, w = last(trend_rows, *TRADE), running(*TRADE), over(*TRADE)
    slope = lambda c: F.col(c) - F.lag(c, trend_rows - 1).over(w)
    width = lambda c: F.max(c).over(trend) - F.min(c).over(trend)
    full = F.col("seq") >= trend_rows
    moved = lambda c: F.col(c) - F.coalesce(F.lag(c, vpin_rows).over(w), F.lit(0.0))
    t = t.select(
        "*", ratio(slope("price"), width("price")).alias("price_slope"), F.when(width("cvd") != 0, slope("cvd") / width("cvd")).otherwise(slope("cvd")).alias("cvd_slope"),
        full.alias("full"), ratio(F.abs(moved("cvd")), moved("_total")).alias("vpin"),
    )
    divergence = F.when(F.col("full") & (F.col("cvd_slope") > 0.3) & (F.col("price_slope") < -0.3), 1.0).when(F.col("full") & (F.col("cvd_slope") < -0.3) & (F.col("price_slope") > 0.3), -1.0).otherwise(0.0)
    return t.select(
        "*",
        clip(z_score(F.col("cvd"), run), -5, 5).alias("cvd_z"),
        divergence.alias("divergence"),
        clip(z_score(F.col("velocity"), run), -5, 5).alias("intensity_z"),
        F.avg((~F.col("is_buyer_maker")).cast("double")).over(run).alias("aggressive"),
    ).drop("_total")


def sampled_trades(trades: DataFrame, every: int = 10) -> DataFrame:
    """Every n-th trade of a symbol, in order."""
    return trades.withColumn("seq", F.row_number().over(over(*TRADE))).where(F.col("seq") % every == 0)


def book_trend(books: DataFrame, n: int = 20, span: float = chunked.SPAN) -> DataFrame:
    """Running z of a symbol's imbalance and spread, exponential mean of the imbalance and its Jurik average, from ``book_features`` rows (symbol, ts, book_id)."""
    order = ("ts", "book_id")
    b = books.select("symbol", *order, "obi", "spread")
    moved = chunked.running_moments(b, [("obi", "obi"), ("spread", "spread")], order=order, span=span)

    def z(c: str) -> Column:
        n, mean, about = (F.col(f"{c}_{c}_{k}") for k in ("n", "mean_x", "mxx"))
        std = F.when(n > 1, F.sqrt(about / (n - 1)))
        return F.when(std > 1e-10, (F.col(c) - mean) / std).otherwise(0.0)

    scored = moved.select("symbol", *order, "obi", "spread", z("obi").alias("obi_z"), z("spread").alias("spread_z"))
    smooth = chunked.scan_chunks(b, [chunked.ema("obi", 2 / (n + 1), "obi_ema"), chunked.jma("obi", n, warm=False, name="obi_jma")], order=order, span=span)
    return scored.join(smooth, ["symbol", *order])
