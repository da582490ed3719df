"""Queries of the fusion, sentiment and on-chain operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import at, tidy
from tidemark.operators import fusion as fu, sentiment as se, valence as va_
from tidemark.plans.collect import collector
from tidemark.sources.fixtures import BARS, POSTS, SCORED, VALENCE, bars, lexicon, posts, scored_posts, table

QUERIES, ORACLES, query = collector()


# ---- fusion ----

_P = {"a": "(close - low) / (high - low + 1)", "b": "least(1.0, volume / 1000)", "c": "trades / 20.0"}


def _probs(spark, sf):
    b = bars(spark, sf)
    return b.select("symbol", "ts", ((F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1)).alias("a"), F.least(F.lit(1.0), F.col("volume") / 1000).alias("b"), (F.col("trades") / 20.0).alias("c"))


def _cell(z: int) -> str:
    return " + ".join(f"m[{x}] * e[{y}]" for x in range(1, 8) for y in range(1, 8) if x & y == z) or "0.0"


@query("dempster_shafer", f"""WITH {BARS}, p AS (SELECT symbol, ts, {_P['a']} AS a, {_P['b']} AS b FROM bars),
x AS (
  SELECT symbol, ts, [a * 0.6, (1 - a) * 0.3, 0.0, 0.0, 0.0, 0.0, 1 - a * 0.6 - (1 - a) * 0.3] AS m,
    [b * 0.5, 0.0, 0.0, 0.2, 0.0, 0.1, 1 - b * 0.5 - 0.2 - 0.1] AS e FROM p),
k AS (SELECT symbol, ts, {_cell(0)} AS conflict, [{', '.join(_cell(z) for z in range(1, 8))}] AS c FROM x),
n AS (SELECT *, list_transform(c, lambda v: v / (1 - conflict)) AS q FROM k),
b AS (
  SELECT symbol, ts, conflict, q[1] AS bb, q[2] AS be, q[4] AS bn, q[1] + q[3] + q[5] + q[7] AS pb, q[2] + q[3] + q[6] + q[7] AS pe, q[4] + q[5] + q[6] + q[7] AS pn FROM n),
d AS (SELECT *, CASE WHEN bb = greatest(bb, be, bn) THEN 'bullish' WHEN be = greatest(bb, be, bn) THEN 'bearish' ELSE 'neutral' END AS decision FROM b),
u AS (SELECT *, CASE decision WHEN 'bullish' THEN pb - bb WHEN 'bearish' THEN pe - be ELSE pn - bn END AS un FROM d)
SELECT symbol, epoch_us(ts) AS ts_us, round(bb, 4) + 0.0 AS bel_bullish, round(be, 4) + 0.0 AS bel_bearish, round(bn, 4) + 0.0 AS bel_neutral,
  round(pb, 4) + 0.0 AS pl_bullish, round(pe, 4) + 0.0 AS pl_bearish, round(pn, 4) + 0.0 AS pl_neutral, round(conflict, 4) + 0.0 AS conflict, decision,
  round(un, 4) + 0.0 AS uncertainty, CASE WHEN decision = 'neutral' THEN 'neutral' WHEN un > 0.5 THEN 'uncertain' WHEN greatest(bb, be, bn) < 0.4 THEN 'weak'
    WHEN conflict > 0.5 THEN 'conflict' ELSE 'trade' END AS gate, round((bb - be) * (1 - greatest(pb - bb, pe - be)), 4) + 0.0 AS signal FROM u""")
def _dempster(spark, sf):
    a, b = F.col("a"), F.col("b")
    out = fu.dempster_shafer(_probs(spark, sf), [{1: a * 0.6, 2: (1 - a) * 0.3}, {1: b * 0.5, 4: F.lit(0.2), 6: F.lit(0.1)}])
    names = [f"{k}_{n}" for k in ("bel", "pl") for n in fu.NAMES.values()] + ["conflict", "uncertainty", "signal"]
    return out.select("symbol", at(), *[tidy(n).alias(n) for n in names], "decision", "gate")


def _member(x: str, p: tuple) -> str:
    if len(p) == 3:
        a, b, c = p
        return f"CASE WHEN {x} <= {a} OR {x} >= {c} THEN 0.0 WHEN {x} <= {b} THEN {f'({x} - {a}) / ({b} - {a})' if b != a else '1.0'} ELSE {f'({c} - {x}) / ({c} - {b})' if c != b else '1.0'} END"
    a, b, c, d = p
    return f"CASE WHEN {x} < {a} OR {x} > {d} THEN 0.0 WHEN {x} < {b} THEN {f'({x} - {a}) / ({b} - {a})' if b != a else '1.0'} WHEN {x} <= {c} THEN 1.0 ELSE {f'({d} - {x}) / ({d} - {c})' if c != d else '1.0'} END"


_SETSQL = ", ".join(f"{_member(v, p)} AS {v}_{s}" for v, sets in fu.SETS.items() for s, p in sets.items())
_FIRE = {}
for _o, _w, _ps in fu.RULES:
    _FIRE.setdefault(_o, []).append(f"least({', '.join(f'{v}_{s}' for v, s in _ps)}) * {_w}")


@query("fuzzy_signal", f"""WITH {BARS},
i AS (SELECT symbol, ts, least(100.0, close / 4) AS rsi, (close - open) / 200 AS momentum, (high - low) / 5000 AS volatility, (close - open) / 300 AS trend FROM bars),
m AS (SELECT symbol, ts, {_SETSQL} FROM i),
f AS (SELECT *, {', '.join(f"greatest({', '.join(v)}) AS o_{k}" for k, v in _FIRE.items())} FROM m)
SELECT symbol, epoch_us(ts) AS ts_us, round(rsi_oversold, 4) + 0.0 AS oversold, round(CASE WHEN {' + '.join(f'o_{k}' for k in _FIRE)} < 1e-10 THEN 0.0
  ELSE ({' + '.join(f'o_{k} * {fu.CENTRES[k]}' for k in _FIRE)}) / ({' + '.join(f'o_{k}' for k in _FIRE)}) END, 4) + 0.0 AS signal FROM f""")
def _fuzzy(spark, sf):
    b = bars(spark, sf)
    move = F.col("close") - F.col("open")
    inputs = {"rsi": F.least(F.lit(100.0), F.col("close") / 4), "momentum": move / 200, "volatility": (F.col("high") - F.col("low")) / 5000, "trend": move / 300}
    return b.select("symbol", at(), tidy(fu.memberships(inputs)[("rsi", "oversold")]).alias("oversold"), tidy(fu.fuzzy_signal(inputs)).alias("signal"))


@query("ensemble_fusion", f"""WITH {BARS}, p AS (SELECT symbol, ts, [{_P['a']}, {_P['b']}, {_P['c']}] AS p FROM bars),
l AS (
  SELECT *, 1 / (1 + exp(-list_sum(list_transform(p, lambda x: ln(greatest(0.01, least(0.99, x)) / (1 - greatest(0.01, least(0.99, x)))))))) AS q,
    sqrt(list_sum(list_transform(p, lambda x: (x - list_avg(p)) ** 2)) / 3) AS sd, len(list_filter(p, lambda x: x > 0.5)) / 3 AS v FROM p)
SELECT symbol, epoch_us(ts) AS ts_us, round(q, 4) + 0.0 AS p, round(greatest(0.0, 1 - 2 * sd), 4) + 0.0 AS agreement, CASE WHEN q > 0.5 THEN 'bullish' ELSE 'bearish' END AS direction,
  round(abs(q - 0.5) * 2, 4) + 0.0 AS strength, round(v, 4) + 0.0 AS votes, round(2 * abs(v - 0.5), 4) + 0.0 AS vote_agreement FROM l""")
def _ensemble(spark, sf):
    out = _probs(spark, sf).select("symbol", "ts", fu.ensemble(F.array("a", "b", "c")).alias("e")).select("symbol", "ts", "e.*")
    return out.select("symbol", at(), "direction", *[tidy(c).alias(c) for c in ("p", "agreement", "strength", "votes", "vote_agreement")])


@query("centroid_vote", """WITH v AS (SELECT vec_id, list_transform(embedding[1:15], lambda x: x::DOUBLE) AS x, label FROM embeddings),
c AS (SELECT vec_id AS cid, x AS c, label % 2 AS label FROM v ORDER BY vec_id LIMIT 20),
d AS (SELECT v.vec_id AS id, cid, c.label AS label, list_sum(list_transform(list_zip(x, c), lambda z: ln(1 + abs(z[1] - z[2])))) AS d FROM v, c)
SELECT id, round(sum(CASE WHEN label = 1 THEN 1 / (1 + d) ELSE 0 END) / sum(1 / (1 + d)), 4) + 0.0 AS p_bullish, round(min(d), 4) + 0.0 AS nearest FROM d GROUP BY id""")
def _knn(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 15), lambda x: x.cast("double")).alias("x"), "label")
    c = v.orderBy("id").limit(20).select(F.col("id").alias("cid"), F.col("x").alias("c"), (F.col("label") % 2).alias("label"))
    return fu.centroid_vote(v.select("id", "x"), c).select("id", tidy("p_bullish").alias("p_bullish"), tidy("nearest").alias("nearest"))


_REG = f"""{BARS},
g AS (SELECT symbol, ts, CASE WHEN close > 150 THEN 'Bull' WHEN close < 40 THEN 'Bear' ELSE 'Range' END AS regime, least(1.0, 0.5 + trades / 20.0) AS confidence,
  (close - open) / 100 AS mom, (open - close) / 150 AS rev, (volume - 300) / 300 AS vol FROM bars),
h AS (SELECT *, CASE WHEN regime = lag(regime) OVER w THEN 0 ELSE 1 END AS ch FROM g WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r AS (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY ts) AS run FROM h),
q AS (SELECT *, row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS duration FROM r)"""


def _regimes(spark, sf):
    b = bars(spark, sf)
    c, o = F.col("close"), F.col("open")
    g = b.select("symbol", "ts", F.when(c > 150, "Bull").when(c < 40, "Bear").otherwise("Range").alias("regime"), F.least(F.lit(1.0), 0.5 + F.col("trades") / 20.0).alias("confidence"), ((c - o) / 100).alias("mom"), ((o - c) / 150).alias("rev"), ((F.col("volume") - 300) / 300).alias("vol"))
    return fu.regime_runs(g)


_FW = lambda i: "CASE WHEN t THEN CASE regime " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in fu.MULTIPLIERS.items()) + " END ELSE 1.0 END"


@query("regime_fusion", f"""WITH {_REG}, t AS (SELECT *, confidence >= 0.7 AND duration >= 2 AS t FROM q),
w AS (SELECT *, 1.2 * {_FW(0)} AS w1, 1.0 * {_FW(1)} AS w2, 0.8 * {_FW(4)} AS w3 FROM t)
SELECT symbol, epoch_us(ts) AS ts_us, duration, t AS tradable,
  round((greatest(-1.0, least(1.0, mom)) * w1 + greatest(-1.0, least(1.0, rev)) * w2 + greatest(-1.0, least(1.0, vol)) * w3) / (w1 + w2 + w3), 4) + 0.0 AS fused FROM w""")
def _fusion(spark, sf):
    out = fu.regime_fusion(_regimes(spark, sf), {"mom": ("momentum", 1.2), "rev": ("mean_reversion", 1.0), "vol": ("volume", 0.8)}, least=2)
    return out.select("symbol", at(), F.col("duration").cast("long").alias("duration"), "tradable", tidy("fused").alias("fused"))


# ---- sentiment ----


def _p(spark, sf):
    return scored_posts(spark, sf)


@query("lexicon_sentiment", f"""WITH {VALENCE}
SELECT id, round(compound, 4) + 0.0 AS score, round(pos, 4) + 0.0 AS pos, round(neg, 4) + 0.0 AS neg, round(neu, 4) + 0.0 AS neu, CASE WHEN compound > 0.3 THEN 'bullish' WHEN compound < -0.3 THEN 'bearish' ELSE 'neutral' END AS label FROM valence""")
def _lexicon(spark, sf):
    """Rule-based valence of whole texts by a lexicon that is a table, induced from the labelled ones."""
    s = va_.scored(posts(spark, sf), lexicon(spark, sf))
    return s.select("id", tidy("compound").alias("score"), *[tidy(c).alias(c) for c in ("pos", "neg", "neu")], se.label(F.col("compound")).alias("label"))


@query("spam_filter", f"""WITH {POSTS}
SELECT id FROM posts WHERE length(text) >= 10 AND engagement >= CASE source WHEN 'twitter' THEN 5 WHEN 'reddit' THEN 3 ELSE 0 END
  AND len(regexp_extract_all(text, '[\\x{{1F300}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}]')) / greatest(1, len(regexp_extract_all(text, '\\S+'))) <= 0.3""")
def _spam(spark, sf):
    return posts(spark, sf).where(se.passes_spam_filter()).select("id")


@query("trailing_sentiment", f"""WITH {SCORED}
SELECT id, round(CASE WHEN sum(engagement) OVER w > 0 THEN sum(score * engagement) OVER w / sum(engagement) OVER w ELSE avg(score) OVER w END, 4) + 0.0 AS mean_score,
  count(*) OVER w AS volume, round((sum((score > 0.3)::INT) OVER w - sum((score < -0.3)::INT) OVER w) / count(*) OVER w, 4) + 0.0 AS net_share
FROM posts WINDOW w AS (PARTITION BY symbol, source ORDER BY ts RANGE BETWEEN INTERVAL 120 MINUTE PRECEDING AND CURRENT ROW)""")
def _trailing(spark, sf):
    return se.trailing_sentiment(_p(spark, sf), 120).select("id", tidy("mean_score").alias("mean_score"), "volume", tidy("net_share").alias("net_share"))


@query("windowed_sentiment", f"""WITH {SCORED}
SELECT symbol, source, epoch_us(time_bucket(INTERVAL 60 MINUTE, ts)) AS start_us, round(CASE WHEN sum(engagement) > 0 THEN sum(score * engagement) / sum(engagement) ELSE avg(score) END, 4) + 0.0 AS mean_score,
  round(median(score), 4) + 0.0 AS median_score, count(*) AS volume, round((count(*) FILTER (score > 0.3) - count(*) FILTER (score < -0.3)) / count(*), 4) + 0.0 AS net_share
FROM posts GROUP BY 1, 2, 3""")
def _windowed(spark, sf):
    out = se.windowed_sentiment(_p(spark, sf), 60)
    return out.select("symbol", "source", F.unix_micros("w.start").alias("start_us"), tidy("mean_score").alias("mean_score"), tidy("median_score").alias("median_score"), "volume", tidy("net_share").alias("net_share"))


_LAG = lambda k: f"coalesce(lag(score, {k - 1}) OVER w, 0.0)"
_LAGS = ", ".join(f"round(CASE source {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN {_LAG(ks[i])}' for s, ks in se.LAGS.items())} ELSE 0.0 END, 4) + 0.0 AS lag_{i + 1}" for i in range(5))


@query("sentiment_lags", f"""WITH {SCORED},
f AS (SELECT *, CASE WHEN sign(score) * sign(lag(score) OVER (PARTITION BY symbol, source ORDER BY ts, id)) < 0 THEN 1 ELSE 0 END AS fl FROM posts)
SELECT id, {_LAGS}, round(coalesce((score - lag(score, 30) OVER w) / 30, 0.0), 4) + 0.0 AS acceleration,
  round(sum(score) OVER (PARTITION BY symbol, source ORDER BY ts, id ROWS 179 PRECEDING), 4) + 0.0 AS momentum,
  CAST(sum(fl) OVER (PARTITION BY symbol, source ORDER BY ts, id ROWS 58 PRECEDING) AS BIGINT) AS flips
FROM f WINDOW w AS (PARTITION BY symbol, source ORDER BY ts, id)""")
def _lags(spark, sf):
    out = se.lag_features(_p(spark, sf))
    return out.select("id", *[tidy(f"lag_{i}").alias(f"lag_{i}") for i in range(1, 6)], tidy("acceleration").alias("acceleration"), tidy("momentum").alias("momentum"), "flips")


@query("decayed_sentiment", f"""WITH {SCORED},
h AS (SELECT id, source, list_reverse(list(score) OVER (PARTITION BY symbol, source ORDER BY ts, id ROWS 360 PRECEDING)) AS h FROM posts),
r AS (SELECT *, pow(0.5, 1.0 / CASE source {' '.join(f"WHEN '{s}' THEN {v}" for s, v in se.HALF_LIVES.items())} ELSE 120.0 END) AS r FROM h)
SELECT id, round(list_sum(list_transform(h, lambda x, i: x * pow(r, i - 1))) / list_sum(list_transform(h, lambda x, i: pow(r, i - 1))), 4) + 0.0 AS decayed FROM r""")
def _decayed(spark, sf):
    return se.decayed_sentiment(_p(spark, sf)).select("id", tidy("decayed").alias("decayed"))


@query("sentiment_momentum", f"""WITH {SCORED},
v AS (SELECT id, score AS s, lag(score, 30) OVER w AS m, lag(score, 59) OVER w AS o FROM posts WINDOW w AS (PARTITION BY symbol, source ORDER BY ts, id))
SELECT id, round(coalesce(s - o, 0.0), 4) + 0.0 AS velocity, round(coalesce((s - o) / 60, 0.0), 4) + 0.0 AS rate, round(coalesce((s - m) - (m - o), 0.0), 4) + 0.0 AS turn FROM v""")
def _smom(spark, sf):
    return se.sentiment_momentum(_p(spark, sf)).select("id", *[tidy(c).alias(c) for c in ("velocity", "rate", "turn")])


@query("cross_source_sentiment", f"""WITH {SCORED}, n AS (SELECT symbol, source, arg_max(score, (ts, id)) AS s FROM posts GROUP BY 1, 2),
w AS (SELECT *, CASE source WHEN 'news' THEN 1.0 WHEN 'twitter' THEN 0.7 ELSE 0.5 END AS w FROM n)
SELECT symbol, round(sum(s * w) / sum(w), 4) + 0.0 AS weighted, count(*) AS sources FROM w GROUP BY symbol""")
def _cross(spark, sf):
    return se.cross_source(_p(spark, sf)).select("symbol", tidy("weighted").alias("weighted"), "sources")


@query("producer_signal", f"""WITH {SCORED}, n AS (SELECT symbol, source, avg(score) AS s, count(*) AS n FROM posts GROUP BY 1, 2),
w AS (SELECT *, CASE source WHEN 'news' THEN 0.6 * least(n, 5) WHEN 'telegram' THEN 0.4 * least(n / 10, 1.0) ELSE 0.5 END AS w FROM n),
a AS (SELECT symbol, sum(s * w) / sum(w) AS s, CAST(sum(n) AS BIGINT) AS n FROM w GROUP BY symbol)
SELECT symbol, round(s, 4) + 0.0 AS score, n, CASE WHEN s > 0.3 THEN 'bullish' WHEN s < -0.3 THEN 'bearish' ELSE 'neutral' END AS signal FROM a""")
def _producer(spark, sf):
    return se.producer_signal(_p(spark, sf)).select("symbol", tidy("score").alias("score"), "n", "signal")


@query("follower_weighted", f"""WITH {SCORED}, w AS (SELECT *, 1 + least(engagement * 50 / 1000, 10.0) AS w FROM posts)
SELECT symbol, round(sum(score * w) / sum(w), 4) + 0.0 AS score, count(*) AS n, CASE WHEN sum(score * w) / sum(w) > 0.3 THEN 'bullish' WHEN sum(score * w) / sum(w) < -0.3 THEN 'bearish' ELSE 'neutral' END AS signal FROM w GROUP BY symbol""")
def _followers(spark, sf):
    return se.follower_weighted(_p(spark, sf), F.col("engagement") * 50).select("symbol", tidy("score").alias("score"), "n", "signal")


@query("view_weighted", f"""WITH {SCORED}, w AS (SELECT *, 1 + least(engagement * 500 / 1000, 50.0) AS w FROM posts WHERE source = 'telegram')
SELECT symbol, round(sum(score * w) / sum(w), 4) + 0.0 AS score, count(*) AS n, CASE WHEN sum(score * w) / sum(w) > 0.3 THEN 'bullish' WHEN sum(score * w) / sum(w) < -0.3 THEN 'bearish' ELSE 'neutral' END AS signal FROM w GROUP BY symbol""")
def _views(spark, sf):
    """Channel messages by their views, a weight of 51 at most."""
    p = _p(spark, sf).where("source = 'telegram'")
    return se.follower_weighted(p, F.col("engagement") * 500, cap=50.0).select("symbol", tidy("score").alias("score"), "n", "signal")


@query("voted_sentiment", f"""WITH {SCORED}, v AS (SELECT id, symbol, score, CASE WHEN up + down > 0 THEN (up - down) / (up + down) END AS vote FROM (SELECT *, id % 7 AS up, id % 5 AS down FROM posts WHERE source = 'news'))
SELECT symbol, round(avg(CASE WHEN vote IS NULL THEN score ELSE 0.7 * score + 0.3 * vote END), 4) + 0.0 AS score, count(*) AS n, round(avg(vote), 4) + 0.0 AS mean_vote FROM v GROUP BY symbol""")
def _voted(spark, sf):
    """News whose text score and readers' votes are blended; without votes the text alone."""
    p = _p(spark, sf).where("source = 'news'").withColumns({"up": F.col("id") % 7, "down": F.col("id") % 5})
    vote = se.vote_balance(F.col("up"), F.col("down"))
    p = p.withColumn("vote", vote).withColumn("blend", se.blended(F.col("score"), F.col("vote")))
    return p.groupBy("symbol").agg(tidy(F.avg("blend")).alias("score"), F.count(F.lit(1)).alias("n"), tidy(F.avg("vote")).alias("mean_vote"))


@query("discussion_score", f"""WITH {SCORED}, r AS (SELECT *, (score + 1) / 2 AS ratio FROM posts)
SELECT symbol, round(greatest(-1.0, least(1.0, avg((2 * ratio - 1) * (1 + engagement / 100)))), 4) + 0.0 AS score, count(*) AS mentions, sum(engagement) AS engagement,
  round(avg(ratio), 4) + 0.0 AS mean_ratio FROM r GROUP BY symbol""")
def _discussion(spark, sf):
    return se.discussion_score(_p(spark, sf).withColumn("ratio", (F.col("score") + 1) / 2)).select("symbol", tidy("score").alias("score"), "mentions", "engagement", tidy("mean_ratio").alias("mean_ratio"))


@query("credibility", f"""WITH {SCORED},
o AS (SELECT source, score > 0 AS predicted, quality = 1 AS actual, greatest(0.1, abs(score)) AS st FROM posts JOIN labels ON id = doc_id),
c AS (SELECT source, 5 + sum(CASE WHEN predicted = actual THEN st ELSE 0 END) AS h, 5 + sum(CASE WHEN predicted <> actual THEN st ELSE 0 END) AS m FROM o GROUP BY source)
SELECT source, round(greatest(5.0, h * 0.95), 4) + 0.0 AS hits, round(greatest(5.0, m * 0.95), 4) + 0.0 AS misses, round(h / (h + m), 4) + 0.0 AS credibility,
  round(h / (h + m) / sum(h / (h + m)) OVER (), 4) + 0.0 AS weight FROM c""")
def _cred(spark, sf):
    o = _p(spark, sf).join(table(spark, sf, "labels"), F.col("id") == F.col("doc_id")).select("source", (F.col("score") > 0).alias("predicted"), (F.col("quality") == 1).alias("actual"), F.abs("score").alias("confidence"))
    return se.decay_credibility(se.credibility(o)).select("source", *[tidy(c).alias(c) for c in ("hits", "misses", "credibility", "weight")])


@query("dual_path_disagreement", f"""WITH {SCORED}, d AS (SELECT id, abs(score - (engagement / 100 - 1)) AS g, score, engagement FROM posts)
SELECT id, round(g, 4) + 0.0 AS gap, CASE WHEN g > 1 THEN 'severe' WHEN g > 0.5 THEN 'high' WHEN g > 0.3 THEN 'moderate' ELSE 'low' END AS kind, round(0.8 * (1 - g / 2), 4) + 0.0 AS confidence,
  CASE WHEN score > 0.3 AND engagement / 100 < 0.8 THEN 'weak_rise' WHEN score < -0.3 AND engagement / 100 < 0.8 THEN 'weak_fall'
    WHEN score > 0.3 AND engagement / 100 > 1.2 THEN 'confirmed_rise' WHEN score < -0.3 AND engagement / 100 > 1.2 THEN 'confirmed_fall' ELSE 'none' END AS divergence FROM d""")
def _disagree(spark, sf):
    p = _p(spark, sf)
    d = se.disagreement(F.col("score"), F.col("engagement") / 100 - 1, F.lit(0.8))
    return p.select("id", d.alias("d"), se.volume_divergence(F.col("score"), F.col("engagement") / 100).alias("divergence")).select("id", tidy("d.gap").alias("gap"), "d.kind", tidy("d.confidence").alias("confidence"), "divergence")


_TARGETS = (*se.SPILLOVER, "LTCUSDT")  # the last one has the default


@query("sentiment_spillover", f"""WITH {SCORED},
k(target, coef, lag) AS (VALUES {', '.join(f"('{k}', {c}, {m})" for k, (c, m) in {**se.SPILLOVER, _TARGETS[-1]: se.SPILLOVER_DEFAULT}.items())}),
s AS (SELECT id AS sid, ts, score FROM posts WHERE symbol = 'S0'),
t AS (SELECT k.*, p.id, p.ts - to_minutes(lag) AS at FROM posts p JOIN k ON k.target = [{', '.join(f"'{k}'" for k in _TARGETS)}][p.id % {len(_TARGETS)} + 1]),
j AS (SELECT t.*, s.score FROM t ASOF LEFT JOIN s ON t.at >= s.ts),
e AS (SELECT *, coalesce(score, (SELECT arg_min(score, (ts, sid)) FROM s)) AS source_score FROM j)
SELECT target, id, coef::DOUBLE AS coef, lag, round(source_score, 4) + 0.0 AS source_score, round(source_score * coef * CASE WHEN source_score < 0 THEN 1.3 ELSE 1 END, 4) + 0.0 AS spill FROM e""")
def _spill(spark, sf):
    """What the source's sentiment does to each target after its lag: seven targets and one that the table lacks."""
    p = _p(spark, sf)
    target = F.element_at(F.array(*[F.lit(k) for k in _TARGETS]), (F.col("id") % len(_TARGETS) + 1).cast("int"))
    out = se.spillover(p.select(target.alias("target"), "id", "ts"), p.where("symbol = 'S0'").select("id", "ts", "score"))
    return out.select("target", "id", "coef", "lag", tidy("source_score").alias("source_score"), tidy("spill").alias("spill"))


@query("model_majority", f"""WITH {SCORED},
m AS (
  SELECT id, unnest([0, 1, 2]) AS model, unnest([score, engagement / 100 - 1, (id % 21) / 10.0 - 1]) AS score, unnest([0.9, 0.6, 0.5 + (id % 5) / 10.0]) AS confidence FROM posts),
l AS (SELECT *, CASE WHEN score > 0.3 THEN 'bullish' WHEN score < -0.3 THEN 'bearish' ELSE 'neutral' END AS label FROM m),
v AS (SELECT id, label, count(*) AS n, min(model) AS f FROM l GROUP BY 1, 2),
b AS (SELECT id, arg_max(label, (n, -f)) AS label, max(n) / sum(n) AS a FROM v GROUP BY id),
s AS (SELECT id, sum(score * confidence) / sum(confidence) AS s FROM l GROUP BY id)
SELECT id, label, round(a, 4) + 0.0 AS agreement, round(s, 4) + 0.0 AS score, CASE WHEN a >= 0.99 THEN 'FULL' WHEN a >= 0.6 THEN 'REDUCED' ELSE 'HOLD' END AS action FROM b JOIN s USING (id)""")
def _majority(spark, sf):
    rows = F.array(*[F.struct(F.lit(i).alias("model"), s.cast("double").alias("score"), c.cast("double").alias("confidence")) for i, (s, c) in enumerate(
        ((F.col("score"), F.lit(0.9)), (F.col("engagement") / 100 - 1, F.lit(0.6)), ((F.col("id") % 21) / 10.0 - 1, 0.5 + (F.col("id") % 5) / 10.0)))])
    m = _p(spark, sf).select("id", F.inline(rows))
    out = se.majority(m.withColumn("label", se.label(F.col("score"))))
    return out.select("id", "label", tidy("agreement").alias("agreement"), tidy("score").alias("score"), "action")


@query("onchain_netflow", f"""WITH {BARS}, f AS (SELECT symbol, ts, CASE WHEN high + low <> 0 THEN (high - low) / (high + low) ELSE 0.0 END AS net, close, open FROM bars)
SELECT symbol, epoch_us(ts) AS ts_us, round(net, 4) + 0.0 AS net, round(greatest(-1.0, least(1.0, CASE WHEN count(net) OVER w >= 2 AND stddev_samp(net) OVER w > 1e-10
  THEN (net - avg(net) OVER w) / stddev_samp(net) OVER w ELSE 0.0 END / 3)), 4) + 0.0 AS net_z, round(tanh((close - open) / 5), 4) + 0.0 AS whale
FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def _netflow(spark, sf):
    f = bars(spark, sf).select("symbol", "ts", F.col("high").alias("inflow"), F.col("low").alias("outflow"), F.col("close").alias("buys"), F.col("open").alias("sells"))
    return se.netflow(f).select("symbol", at(), *[tidy(c).alias(c) for c in ("net", "net_z", "whale")])


@query("network_health", f"""WITH {BARS},
s AS (
  SELECT symbol, ts, volume, high / first(high) OVER w AS hr, greatest(0.0, least(1.0, (low - 20) / 80)) AS fee, 1 / (1 + trades) AS cv,
    CASE WHEN row_number() OVER w > 10 THEN greatest(-1.0, least(1.0, (volume - avg(volume) OVER w) / stddev_samp(volume) OVER w / 3)) ELSE 0.0 END AS act
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))
SELECT symbol, epoch_us(ts) AS ts_us, round(act, 4) + 0.0 AS activity, round(hr, 4) + 0.0 AS hash_ratio, round(fee, 4) + 0.0 AS fee_pressure, round(cv, 4) + 0.0 AS conviction,
  round(0.3 * (act + 1) / 2 + 0.4 * least(1.0, hr) + 0.3 * cv, 4) + 0.0 AS health FROM s""")
def _health(spark, sf):
    s = bars(spark, sf).select("symbol", "ts", F.col("volume").alias("addresses"), F.col("high").alias("hashrate"), F.col("low").alias("gas"), F.col("trades").alias("turnover"))
    return se.network_health(s).select("symbol", at(), *[tidy(c).alias(c) for c in ("activity", "hash_ratio", "fee_pressure", "conviction", "health")])
