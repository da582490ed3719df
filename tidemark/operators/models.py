"""Sentiment models as a parameter: batches of texts to class probabilities, routed by source, with both paths compared.

A model is any picklable function from a list of texts to rows of class weights, (negative,
neutral, positive) or (negative, positive), which count by their share of the row's sum; probabilities are weights that
sum to 1. Whole weights give scores without rounding before the last division, so that a score of exactly a limit is
told from one beyond it. It runs as an Arrow-batched UDF beside the data; a
model with weights to load should load them on its first call in a worker and keep them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

Model = Callable[[list[str]], Sequence[Sequence[float]]]

# ---- fixed values: sources of each path, limits of labels and of signal kinds ----
SOCIAL = ("twitter", "reddit", "telegram", "discord", "stocktwits")
NEWS = ("bloomberg", "reuters", "coindesk", "cointelegraph", "news")
LIMIT, ALERT, TRADE = 0.3, 0.60, 0.70


def probabilities(model: Model) -> Callable[[Column], Column]:
    """The model as a column function; a null text counts as empty."""

    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([list(map(float, p)) for p in model(part.fillna("").tolist())], index=part.index, dtype=object)

    return run


def _total(p: Column) -> Column:
    """Sum of two or three weights."""
    return F.get(p, 0) + F.get(p, 1) + F.coalesce(F.get(p, 2), F.lit(0.0))


def score(p: Column) -> Column:
    """-1 to 1: positive less negative of two or three classes by their sum, 0 of any other number."""
    last = F.get(p, F.size(p) - 1)
    return F.when(F.size(p).isin(2, 3) & (_total(p) != 0), (last - F.get(p, 0)) / _total(p)).otherwise(0.0)


def confidence(p: Column) -> Column:
    return F.when(F.size(p).isin(2, 3) & (_total(p) != 0), F.array_max(p) / _total(p)).otherwise(0.5)


def from_label(label: Column, sure: Column) -> Column:
    """Score of a labelled answer: its confidence with the label's sign, 0 if neutral."""
    return F.when(F.lower(label) == "positive", sure).when(F.lower(label) == "negative", -sure).otherwise(0.0)


def label(score_: Column) -> Column:
    return F.when(score_ > LIMIT, "bullish").when(score_ < -LIMIT, "bearish").otherwise("neutral")


def signal_kind(label_: Column, sure: Column, accurate: Column) -> Column:
    """TRADE only on the accurate path; neutral labels inform."""
    return F.when((label_ != "neutral") & accurate & (sure >= TRADE), "TRADE").when((label_ != "neutral") & (sure >= ALERT), "ALERT").otherwise("INFO")


def path(source: Column, force: str | None = None) -> Column:
    """fast for social sources, accurate for others, unless forced."""
    return F.lit(force) if force else F.when(F.lower(source).isin(*SOCIAL), "fast").otherwise("accurate")


def analyze(posts: DataFrame, fast: Model, accurate: Model, text: str = "text", force: str | None = None) -> DataFrame:
    """posts with path, score, confidence, label and signal: each row goes through its path's model only.

    The two parts are split before the models run and joined by union, so a model never sees the
    other's rows and no row is shuffled.
    """
    routed = posts.withColumn("path", path(F.col("source"), force))
    parts = [routed.where(F.col("path") == name).withColumn("_p", probabilities(model)(F.col(text))) for name, model in (("fast", fast), ("accurate", accurate))]
    out = parts[0].unionByName(parts[1])
    out = out.select("*", score(F.col("_p")).alias("model_score"), confidence(F.col("_p")).alias("confidence")).drop("_p")
    out = out.withColumn("label", label(F.col("model_score")))
    return out.withColumn("signal", signal_kind(F.col("label"), F.col("confidence"), F.col("path") == "accurate"))


def analyze_dual(posts: DataFrame, fast: Model, accurate: Model, text: str = "text") -> DataFrame:
    """posts with both paths' scores, their disagreement and the recommended score, confidence and label."""
    both = posts.withColumn("_f", probabilities(fast)(F.col(text))).withColumn("_a", probabilities(accurate)(F.col(text)))
    both = both.select("*", *[f(F.col(c)).alias(f"{name}_{f.__name__}") for c, name in (("_f", "fast"), ("_a", "accurate")) for f in (score, confidence)]).drop("_f", "_a")
    gap = F.abs(F.col("fast_score") - F.col("accurate_score"))
    kind = F.when(gap > 1.0, "HIGH_VOL_EXPECTED").when(gap > 0.3, "DIVERGENCE").otherwise("ALIGNED")
    surer = F.col("accurate_confidence") > F.col("fast_confidence")
    both = both.withColumn("gap", gap).withColumn("disagreement", kind)
    aligned = F.col("disagreement") == "ALIGNED"
    both = both.withColumn("recommended", F.when(aligned, (F.col("fast_score") + F.col("accurate_score")) / 2).when(surer, F.col("accurate_score")).otherwise(F.col("fast_score")))
    sure = F.when(aligned, F.greatest("fast_confidence", "accurate_confidence")).when(surer, 0.8 * F.col("accurate_confidence")).otherwise(0.7 * F.col("fast_confidence"))
    return both.withColumn("recommended_confidence", sure).withColumn("recommended_label", label(F.col("recommended")))


def analyze_by_asset(posts: DataFrame, models: dict[str, Model], default: Model, text: str = "text") -> DataFrame:
    """posts with the score and confidence of the model that their symbol names, or of the default one."""
    named = F.col("symbol").isin(*models) if models else F.lit(False)
    parts = [(posts.where(F.col("symbol") == s), m) for s, m in models.items()] + [(posts.where(~F.coalesce(named, F.lit(False))), default)]
    scored = [rows.withColumn("_p", probabilities(m)(F.col(text))) for rows, m in parts]
    out = scored[0]
    for part in scored[1:]:
        out = out.unionByName(part)
    return out.select("*", score(F.col("_p")).alias("model_score"), confidence(F.col("_p")).alias("confidence")).drop("_p").withColumn("label", label(F.col("model_score")))


def lexicon_join(posts: DataFrame, lexicon: DataFrame, text: str = "text", by: str = "id") -> DataFrame:
    """by and score: valences of a lexicon table (word, valence) summed over a text's words and squashed by x / sqrt(x^2 + 15); 0 without a known word.

    The words of a text are counted where it lies and joined by word, so a lexicon of any size will do.
    """
    words = posts.select(by, F.explode(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z]+"), lambda w: w != "")).alias("word"))
    counted = words.groupBy(by, "word").agg(F.count(F.lit(1)).alias("n"))
    total = counted.join(lexicon.select(F.lower("word").alias("word"), "valence"), "word").groupBy(by).agg(F.sum(F.col("n") * F.col("valence")).alias("t"))
    out = posts.select(by).join(total, by, "left").withColumn("t", F.coalesce("t", F.lit(0.0)))
    return out.select(by, (F.col("t") / F.sqrt(F.col("t") * F.col("t") + 15)).alias("score"))
