"""Queries of the model paths, with fixed functions of a text's length as the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import tidy
from tidemark.operators import models as mo
from tidemark.plans.collect import collector
from tidemark.sources.fixtures import POSTS, posts, table

QUERIES, ORACLES, query = collector()


def by_length(a: int, b: int, c: int):
    """A stand-in for a model: class weights are remainders of the text's length."""

    def model(texts: list[str]) -> list[tuple[int, int, int]]:
        return [tuple(len(t) % m + 1 for m in (a, b, c)) for t in texts]

    return model


_FAST, _ACCURATE = (29, 3, 17), (13, 4, 31)
_W = lambda m: [f"(length(coalesce(text, '')) % {v} + 1)" for v in m]
_SUM = lambda m: f"({' + '.join(_W(m))})"
_SCORE = lambda m: f"(({_W(m)[2]} - {_W(m)[0]}) / {_SUM(m)})"
_CONF = lambda m: f"(greatest({', '.join(_W(m))}) / {_SUM(m)})"
_LABEL = lambda s: f"CASE WHEN {s} > 0.3 THEN 'bullish' WHEN {s} < -0.3 THEN 'bearish' ELSE 'neutral' END"


@query("routed_sentiment", f"""WITH {POSTS}, p AS (SELECT *, CASE WHEN source IN ('twitter', 'reddit', 'telegram') THEN 'fast' ELSE 'accurate' END AS path FROM posts),
s AS (SELECT id, path, CASE path WHEN 'fast' THEN {_SCORE(_FAST)} ELSE {_SCORE(_ACCURATE)} END AS s, CASE path WHEN 'fast' THEN {_CONF(_FAST)} ELSE {_CONF(_ACCURATE)} END AS c FROM p),
l AS (SELECT *, {_LABEL('s')} AS label FROM s)
SELECT id, path, round(s, 4) + 0.0 AS model_score, round(c, 4) + 0.0 AS confidence, label,
  CASE WHEN label <> 'neutral' AND path = 'accurate' AND c >= 0.7 THEN 'TRADE' WHEN label <> 'neutral' AND c >= 0.6 THEN 'ALERT' ELSE 'INFO' END AS signal FROM l""")
def _routed(spark, sf):
    """Social posts by the fast model, others by the accurate one."""
    out = mo.analyze(posts(spark, sf), by_length(*_FAST), by_length(*_ACCURATE))
    return out.select("id", "path", tidy("model_score").alias("model_score"), tidy("confidence").alias("confidence"), "label", "signal")


@query("dual_sentiment", f"""WITH {POSTS}, s AS (SELECT id, {_SCORE(_FAST)} AS f, {_CONF(_FAST)} AS cf, {_SCORE(_ACCURATE)} AS a, {_CONF(_ACCURATE)} AS ca FROM posts),
g AS (SELECT *, abs(f - a) AS gap, CASE WHEN abs(f - a) > 1 THEN 'HIGH_VOL_EXPECTED' WHEN abs(f - a) > 0.3 THEN 'DIVERGENCE' ELSE 'ALIGNED' END AS d FROM s),
r AS (SELECT *, CASE WHEN d = 'ALIGNED' THEN (f + a) / 2 WHEN ca > cf THEN a ELSE f END AS r, CASE WHEN d = 'ALIGNED' THEN greatest(cf, ca) WHEN ca > cf THEN 0.8 * ca ELSE 0.7 * cf END AS rc FROM g)
SELECT id, round(gap, 4) + 0.0 AS gap, d AS disagreement, round(r, 4) + 0.0 AS recommended, round(rc, 4) + 0.0 AS recommended_confidence, {_LABEL('r')} AS recommended_label FROM r""")
def _dual(spark, sf):
    """Both models on every post."""
    out = mo.analyze_dual(posts(spark, sf), by_length(*_FAST), by_length(*_ACCURATE))
    return out.select("id", tidy("gap").alias("gap"), "disagreement", tidy("recommended").alias("recommended"), tidy("recommended_confidence").alias("recommended_confidence"), "recommended_label")


@query("asset_sentiment", f"""WITH {POSTS}, s AS (SELECT id, CASE WHEN symbol = 'S0' THEN {_SCORE(_ACCURATE)} WHEN symbol = 'S1' THEN {_SCORE((7, 5, 11))} ELSE {_SCORE(_FAST)} END AS s FROM posts)
SELECT id, round(s, 4) + 0.0 AS model_score, {_LABEL('s')} AS label FROM s""")
def _assets(spark, sf):
    """Some symbols have models of their own."""
    out = mo.analyze_by_asset(posts(spark, sf), {"S0": by_length(*_ACCURATE), "S1": by_length(7, 5, 11)}, by_length(*_FAST))
    return out.select("id", tidy("model_score").alias("model_score"), "label")


@query("labelled_scores", "SELECT o_orderkey, round(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN -1 ELSE 0 END * (o_custkey % 100 / 100.0), 4) + 0.0 AS score FROM orders")
def _labelled(spark, sf):
    o = table(spark, sf, "orders")
    name = F.when(F.col("o_orderstatus") == "O", "Positive").when(F.col("o_orderstatus") == "F", "NEGATIVE").otherwise("neutral")
    return o.select("o_orderkey", tidy(mo.from_label(name, F.col("o_custkey") % 100 / 100)).alias("score"))


@query("lexicon_table", """WITH l AS (SELECT lower(n_name) AS w, (n_nationkey - 12) / 5.0 AS v FROM nation UNION ALL SELECT * FROM (VALUES ('the', 0.4), ('und', -0.7), ('la', 0.9), ('de', -0.2)) t(w, v)),
w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z]+')) AS w FROM documents), s AS (SELECT id, sum(v)::DOUBLE AS t FROM w JOIN l USING (w) GROUP BY id)
SELECT doc_id AS id, round(coalesce(t, 0) / sqrt(coalesce(t, 0) * coalesce(t, 0) + 15), 4) + 0.0 AS score FROM documents LEFT JOIN s ON s.id = doc_id""")
def _lexicon(spark, sf):
    """Scores by a lexicon that is a table."""
    words = table(spark, sf, "nation").select(F.col("n_name").alias("word"), ((F.col("n_nationkey") - 12) / 5).alias("valence"))
    words = words.union(spark.createDataFrame([("the", 0.4), ("und", -0.7), ("la", 0.9), ("de", -0.2)], "word string, valence double"))
    out = mo.lexicon_join(table(spark, sf, "documents"), words, "text", "doc_id")
    return out.select(F.col("doc_id").alias("id"), tidy("score").alias("score"))
