"""Values worked out by chunks of time against the same worked out in one sweep; tests of series; shared blocks; valence."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bars as quality, chunked as ch, recursive as rec, stationarity as sy, validation as va, valence
from tidemark.functions.columns import normal_cdf

DRAW = random.Random(11)


@pytest.fixture(scope="module")
def series(spark):
    """A hot symbol, one with gaps of days, one of one row; prices that wander, returns, some nulls."""
    rows = []
    for symbol, n, step in (("hot", 700, 600), ("sparse", 60, 40_000), ("one", 1, 1)):
        price, at = 100.0, 1_700_000_000
        for i in range(n):
            price *= math.exp(DRAW.gauss(0, 0.02))
            at += step * DRAW.choice([1, 1, 1, 5])
            rows.append((symbol, at, i, price, DRAW.gauss(0, 0.02), DRAW.random() * 1000, None if DRAW.random() < 0.2 else DRAW.random(), DRAW.random() * 100))
    df = spark.createDataFrame(rows, "symbol string, at long, id long, close double, ret double, volume double, raw double, rsi double")
    return df.select("symbol", F.timestamp_seconds("at").alias("ts"), "id", "close", "ret", "volume", "raw", "rsi").repartition(4).cache()


PAIRS = [
    (ch.kalman, rec.kalman, ()), (ch.velocity_kalman, rec.velocity_kalman, ()), (ch.garch, rec.garch, ("ret",)), (ch.super_smoother, rec.super_smoother, ()), (ch.ultimate_smoother, rec.ultimate_smoother, ()),
    (ch.jma, rec.jma, ()), (ch.smoothed_tr, rec.smoothed_tr, ("close",)), (ch.roofing, rec.roofing, ()), (ch.stochastic, rec.stochastic, ("raw",)), (ch.fisher, rec.fisher, ("rsi",)),
    (ch.ew_relation, rec.ew_relation, ("close", "volume")), (ch.regime_forward, rec.regime_forward, ("ret",)),
]


@pytest.mark.parametrize("span", [3_600, 86_400, 10**9])
def test_chunks_equal_one_sweep(spark, series, span):
    """All recurrences at once, with chunks of few rows, of one row and of all."""
    apart, whole = ([(a if i == 0 else b)(*args) for a, b, args in PAIRS] for i in (0, 1))
    want = {(r["symbol"], r["id"]): r for r in rec.scan_all(series, whole, order=("ts", "id")).collect()}
    made = ch.scan_chunks(series, apart, order=("ts", "id"), span=span)
    got = made.collect()
    assert len(got) == len(want) == 761
    for r in got:
        for c in made.columns[3:]:
            a, b = r[c], want[(r["symbol"], r["id"])][c]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-7)), (c, r["symbol"], r["id"])


def test_ema_of_chunks(spark, series):
    a = ch.scan_chunks(series, [ch.ema("close", 0.1, "e")], order=("ts", "id"), span=3_600)
    b = rec.scan(series, rec.ema("close", 0.1, "e"), order=("ts", "id")).withColumnRenamed("e", "f")
    assert a.join(b, ["symbol", "ts", "id"]).where("abs(e - f) > 1e-9").count() == 0 and a.count() == 761


def test_one_symbol_runs_in_many_tasks(spark, series):
    plan = ch.scan_chunks(series.where("symbol = 'hot'"), [ch.kalman()], order=("ts", "id"), span=3_600)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in text and "_chunk" in text
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # these partitions are so small that they would be read by one task
    before = spark.conf.get(merged)
    try:
        spark.conf.set(merged, "false")
        assert len({r["p"] for r in plan.select(F.spark_partition_id().alias("p")).collect()}) > 1
    finally:
        spark.conf.set(merged, before)


@pytest.mark.parametrize("span", [1_000, 86_400, 10**9])
def test_lags_reach_over_chunks(spark, series, span):
    got = ch.with_lags(series, {"a": ("close", 1), "b": ("close", 7), "c": ("volume", 30)}, order=("ts", "id"), span=span)
    assert got.columns == [*series.columns, "a", "b", "c"]
    rows: dict = {}
    for r in sorted(got.collect(), key=lambda r: r["id"]):
        seen = rows.setdefault(r["symbol"], [])
        for name, x, i in (("a", "close", 1), ("b", "close", 7), ("c", "volume", 30)):
            assert r[name] == (seen[-i][x] if len(seen) >= i else None)
        seen.append(r)


@pytest.mark.parametrize("span", [1_000, 86_400])
def test_running_moments_of_pairs(spark, series, span):
    got = ch.running_moments(series, [("close", "raw"), ("ret", "ret")], order=("ts", "id"), span=span).orderBy("symbol", "id").collect()
    seen: dict = {}
    for r in got:
        pairs = seen.setdefault(r["symbol"], ([], []))
        for k, (x, y) in enumerate((("close", "raw"), ("ret", "ret"))):
            if r[x] is not None and r[y] is not None:
                pairs[k].append((r[x], r[y]))
            v, name = np.array(pairs[k]).reshape(-1, 2), f"{x}_{y}_"
            assert r[name + "n"] == len(v)
            if len(v):
                d = v - v.mean(axis=0)
                assert [r[name + c] for c in ("mean_x", "mean_y", "mxx", "myy", "mxy")] == pytest.approx([*v.mean(axis=0), (d[:, 0] ** 2).sum(), (d[:, 1] ** 2).sum(), (d[:, 0] * d[:, 1]).sum()], rel=1e-9, abs=1e-9)
            else:
                assert r[name + "mxx"] is None


@pytest.mark.parametrize("ranges, span", [(1, 10**9), (8, 3_600), (8, 86_400), (40, 20_000)])
def test_running_rank_is_exact(spark, ranges, span):
    draw = random.Random(ranges)
    values = [draw.choice([1.0, 1.0, 1.0, 2.5, draw.random() * 4, draw.gauss(0, 1), None, float("nan"), 0.0, -0.0]) for _ in range(900)]
    rows = [("a" if i % 3 else "b", 1_700_000_000 + i // 2 * 100, i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, at long, id long, x double").select("symbol", F.timestamp_seconds("at").alias("ts"), "id", "x").repartition(3)
    got = {r["id"]: r["position"] for r in ch.running_rank(df, "x", order=("ts", "id"), span=span, ranges=ranges).collect()}
    assert len(got) == len(rows)
    for s in "ab":
        seen: list = []
        for symbol, _, i, v in rows:
            if symbol == s:
                if v is None or v != v:
                    assert got[i] is None
                    continue
                seen.append(v)
                assert got[i] == pytest.approx(sum(w <= v for w in seen) / len(seen), abs=1e-12)


def test_running_rank_of_nothing(spark):
    empty = spark.createDataFrame([], "symbol string, ts timestamp, x double")
    assert ch.running_rank(empty, "x").count() == 0 and ch.scan_chunks(empty, [ch.kalman("x")]).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 1000])
def test_earlier_below(n):
    x = np.random.default_rng(n).integers(0, max(1, n // 3), n).astype(float)
    assert ch.earlier_below(x, True).tolist() == [int((x[:i] <= v).sum()) for i, v in enumerate(x)]
    assert ch.earlier_below(x, False).tolist() == [int((x[:i] < v).sum()) for i, v in enumerate(x)]


# ---- stationarity ----


def slow_adf(x: np.ndarray, most: int = 10) -> tuple[int, float]:
    """Lags by AIC and the statistic, by least squares of the whole design."""
    d = np.diff(x)

    def fit(lags: int, skip: int):
        rows = range(skip, len(d))
        y = d[skip:]
        a = np.array([[1.0, x[t], *(d[t - i] for i in range(1, lags + 1))] for t in rows])
        beta, *_ = np.linalg.lstsq(a, y, rcond=None)
        ssr = ((y - a @ beta) ** 2).sum()
        n, k = a.shape
        return n * math.log(ssr / n) + 2 * k, beta[1] / math.sqrt(ssr / (n - k) * np.linalg.inv(a.T @ a)[1, 1])

    best = min(range(most + 1), key=lambda k: fit(k, most)[0])
    return best, fit(best, best)[1]


def test_dickey_fuller_against_a_slow_solver(spark):
    draw = np.random.default_rng(3)
    walks = {"walk": draw.normal(size=300).cumsum(), "noise": draw.normal(size=200), "ar": np.zeros(250), "short": draw.normal(size=8), "flat": np.ones(50)}
    for t in range(3, 250):
        walks["ar"][t] = 0.5 * walks["ar"][t - 1] - 0.4 * walks["ar"][t - 3] + draw.normal()
    rows = [(s, 1_700_000_000 + i * 7_000, float(v)) for s, x in walks.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, at long, x double").select("symbol", F.timestamp_seconds("at").alias("ts"), "x").repartition(3)
    got = {r["symbol"]: r for r in sy.dickey_fuller(df, "x").collect()}
    for s in ("walk", "noise", "ar"):
        lags, tau = slow_adf(walks[s])
        assert (got[s]["adf_lags"], got[s]["adf_statistic"]) == (lags, pytest.approx(tau, rel=1e-6))
    assert got["noise"]["adf_p"] < 0.01 < 0.05 < got["walk"]["adf_p"]
    assert got["short"]["adf_statistic"] is None and got["flat"]["adf_statistic"] is None and len(got) == 5


def test_mackinnon_p_at_known_critical_values(spark):
    """The published critical values at 1, 5 and 10 % of a long series with a constant."""
    got = spark.range(1).select(*[sy.mackinnon_p(F.lit(t)).alias(f"p{i}") for i, t in enumerate((-3.43, -2.86, -2.57, 3.0, -20.0))]).first()
    assert list(got) == pytest.approx([0.01, 0.05, 0.10, 1.0, 0.0], abs=2e-3)


def test_arch_lm_against_a_slow_solver(spark):
    draw = np.random.default_rng(5)
    x, v = np.zeros(400), 1.0
    for t in range(400):
        v = 0.2 + 0.7 * (x[t - 1] ** 2 if t else 0)
        x[t] = draw.normal() * math.sqrt(v)
    calm = draw.normal(size=400)
    rows = [(s, 1_700_000_000 + i * 5_000, float(a)) for s, z in (("arch", x), ("calm", calm), ("few", calm[:9])) for i, a in enumerate(z)]
    df = spark.createDataFrame(rows, "symbol string, at long, x double").select("symbol", F.timestamp_seconds("at").alias("ts"), "x").repartition(3)
    got = {r["symbol"]: r for r in sy.arch_lm(df, "x").collect()}
    for s, z in (("arch", x), ("calm", calm)):
        q = z**2
        a = np.array([[1.0, *q[t - 10 : t][::-1]] for t in range(10, len(q))])
        beta, *_ = np.linalg.lstsq(a, q[10:], rcond=None)
        r2 = 1 - ((q[10:] - a @ beta) ** 2).sum() / ((q[10:] - q[10:].mean()) ** 2).sum()
        assert got[s]["arch_lm"] == pytest.approx(390 * r2, rel=1e-6)
    assert got["arch"]["arch_p"] < 1e-6 < 0.01 < got["calm"]["arch_p"] and got["few"]["arch_lm"] is None


def test_second_level_only_where_the_first_passes(spark):
    rows = [(s, i, 100.0 + (i % 7) - (200 if s == "bad" and i == 50 else 0)) for s, n in (("good", 300), ("bad", 300), ("few", 40)) for i in range(n)]
    b = spark.createDataFrame(rows, "symbol string, seq long, close double").select("symbol", "seq", F.timestamp_seconds(F.col("seq") * 60).alias("ts"), *[F.col("close").alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"), F.lit(0.01).alias("ret"))
    got = {r["symbol"]: r for r in quality.full(b).collect()}
    assert got["good"]["overall_passed"] and not got["bad"]["level1_passed"] and "non_positive" in got["bad"]["faults"] and got["bad"]["issues"] == "level1_failed" and got["bad"]["warnings"] == ""
    assert got["few"]["issues"] == "insufficient_data" and not got["few"]["overall_passed"]


# ---- bootstrap ----


@pytest.mark.parametrize("kind", ["blocks", "geometric"])
def test_bootstrap_of_shared_blocks(spark, kind):
    draw = np.random.default_rng(9)
    n, reps = 60, 40
    x = {s: draw.normal(m, 1, n) for s, m in (("a", 0.3), ("b", 0.0), ("c", -0.2))}
    rows = [(s, 1_700_000_000 + i * 30_000, float(v)) for s, line in x.items() for i, v in enumerate(line) if (s, i) != ("b", 5)]
    df = spark.createDataFrame(rows, "strategy string, at long, x double").select("strategy", F.timestamp_seconds("at").alias("ts"), "x").repartition(3)
    length = df.agg(F.count_distinct("ts").alias("n"))
    blocks = va.shared_blocks(length, reps) if kind == "blocks" else va.geometric_blocks(length, reps, 5)
    drawn: dict = {}
    for r in blocks.collect():
        drawn.setdefault(r["rep"], []).extend(range(r["start"], r["stop"]))
    assert len(drawn) == reps and all(len(d) == (n // 7 * 7 if kind == "blocks" else n) and 0 <= min(d) and max(d) < n for d in drawn.values())
    got = {r["strategy"]: r for r in va.bootstrap_test(va.running_sums(df), blocks).collect()}
    stat = lambda v, m=0.0: (v.mean() - m) / (v.std(ddof=1) / math.sqrt(len(v)))
    own = {s: (np.delete(line, 5) if s == "b" else line) for s, line in x.items()}
    tops = []
    for d in drawn.values():
        tops.append(max(stat(np.array([x[s][i] for i in d if (s, i) != ("b", 5)]), own[s].mean()) for s in x))
    for s in x:
        plain = [stat(np.array([x[s][i] for i in d if (s, i) != ("b", 5)])) for d in drawn.values()]
        assert got[s]["stat"] == pytest.approx(stat(own[s])) and got[s]["p_white"] == pytest.approx(np.mean(np.array(plain) >= stat(own[s])))
        assert got[s]["p_best"] == pytest.approx(np.mean(np.array(tops) >= max(stat(own[t]) for t in x)))


# ---- valence ----


def slow_valence(text: str | None, lexicon: dict[str, float]) -> float:
    """The published rules word by word."""
    text = text or ""
    parts = [p for p in __import__("re").split(valence.SPACES, text) if p]
    punct = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    ws = [p.strip(punct) if len(p.strip(punct)) > 2 else p for p in parts]
    low = [w.translate(str.maketrans(valence.UPPER, valence.LOWER)) for w in ws]
    caps = [any(c in valence.UPPER for c in w) and not any(c in valence.LOWER for c in w) for w in ws]
    mixed = 0 < sum(caps) < len(ws)
    boost = {w: valence.BOOST for w in valence.BOOSTERS} | {w: -valence.BOOST for w in valence.DAMPENERS}
    negates = lambda w: w in valence.NEGATIONS or "n't" in w
    out = []
    for i, w in enumerate(low):
        if w not in lexicon or w in boost:
            continue
        v = lexicon[w]
        if caps[i] and mixed:
            v += 0.733 if v > 0 else -0.733
        for k in range(3):
            j = i - 1 - k
            if j < 0 or low[j] in lexicon:
                continue
            if low[j] in boost:
                s = boost[low[j]] * (-1 if v < 0 else 1)
                if caps[j] and mixed:
                    s += 0.733 if v > 0 else -0.733
                v += s * (1, 0.95, 0.9)[k]
            between = low[j + 1 : i]
            if low[j] == "never" and {"so", "this"} & set(between):
                v *= 1.25
            elif low[j] == "without" and "doubt" in between:
                pass
            elif negates(low[j]):
                v *= -0.74
        if i and low[i - 1] == "least" and "least" not in lexicon and not (i > 1 and low[i - 2] in ("at", "very")):
            v *= -0.74
        if "but" in low:
            b = low.index("but")
            v *= 0.5 if i < b else 1.5
        out.append(v)
    total = sum(out)
    q = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0.96 if q > 3 else q * 0.18 if q > 1 else 0)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0
    return total / math.sqrt(total * total + 15)


def test_valence_against_a_slow_scorer(spark):
    lexicon = {"good": 1.9, "bad": -2.5, "great": 3.1, "awful": -2.0, "fine": 0.8, "it's": 0.2}
    pool = ["good", "bad", "GREAT", "great", "awful", "Fine.", "(good)", "very", "VERY", "slightly", "not", "isn't", "never", "so", "this", "without", "doubt", "least", "at", "but", "BUT", "the", "market", "is", "!", "??", "ok!", "it's", "no", "é", "a", "'tis", "--"]
    draw = random.Random(2)
    texts = [None, "", "  ", "good", "not good", "not very good!", "never so good", "without doubt good", "without a doubt good", "least good", "at least good", "bad but great", "GREAT stuff", "GREAT", "good???", "good????", "good bad", "good " * 3000 + "but bad"]
    texts += [" ".join(draw.choice(pool) for _ in range(draw.randrange(1, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("terms", F.lit(1)).withColumn("w", F.lit("x"))
    words = spark.createDataFrame([*lexicon.items(), ("GOOD", 5.0), (None, 1.0), ("market", None)], "word string, valence double")
    scored = valence.scored(df, words)
    assert scored.columns == [*df.columns, "compound", "pos", "neg", "neu"]
    for r in scored.collect():
        assert r["compound"] == pytest.approx(slow_valence(texts[r["id"]], lexicon), abs=1e-9), texts[r["id"]]
        assert r["pos"] + r["neg"] + r["neu"] == pytest.approx(1.0 if (texts[r["id"]] or "").strip() else 0.0)


def test_induced_lexicon_and_its_bound(spark, monkeypatch):
    rows = [("up up good", 1)] * 30 + [("down bad the", 0)] * 30 + [("the rare", 1)] + [("unlabelled", None), (None, 1)]
    got = {r["word"]: r["valence"] for r in valence.induced_lexicon(spark.createDataFrame(rows, "text string, label int"), share=0.05).collect()}
    assert set(got) == {"up", "good", "down", "bad", "the"} and got["up"] == 4.0 and got["down"] == -4.0
    monkeypatch.setattr(valence, "MOST_WORDS", 3)
    with pytest.raises(ValueError):
        valence.scored(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([(str(i), 1.0) for i in range(4)], "word string, valence double"))


def test_texts_are_judged_where_they_lie_and_once(spark, sf, monkeypatch):
    from tidemark.plans import feeds, signals

    for queries, name in ((signals.QUERIES, "decayed_sentiment"), (signals.QUERIES, "sentiment_momentum"), (signals.QUERIES, "producer_signal"), (signals.QUERIES, "discussion_score"), (signals.QUERIES, "trailing_sentiment"), (feeds.QUERIES, "symbol_sentiment")):
        plan = queries[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan, name
    draw = random.Random(3)
    texts = pa.array([None, "", *[" ".join(draw.choice(["good", "bad", "not", "VERY", "but", "the", "é!"]) for _ in range(draw.randrange(60))) for _ in range(50)]])
    terms = pa.table({"word": ["good", "bad", "very", "not"], "v": [1.9, -2.5, None, None], "b": [None, None, valence.BOOST, None], "no": [False, False, False, True]})
    whole = valence._judge(pc.fill_null(texts, ""), terms)
    for size in (1, 100, 1000):
        monkeypatch.setattr(valence, "PIECE", size)
        parts = list(valence._pieces(texts))
        assert len(parts) > 3 and pa.concat_arrays([valence._judge(part, terms) for part in parts]).equals(whole)


def test_chi2_tail(spark):
    got = spark.range(1).select(sy.chi2_upper(F.lit(18.307), 10).alias("a"), normal_cdf(F.lit(0.0)).alias("b")).first()
    assert got["a"] == pytest.approx(0.05, abs=1e-4)
    with pytest.raises(ValueError):
        sy.chi2_upper(F.lit(1.0), 3)


# ---- learned parameters ----


def test_sensitivities_are_the_slopes_of_the_values():
    """With no learning, a state's sensitivity is what finite differences of its parameter give."""
    from tidemark.operators import adaptive as ad

    draw = random.Random(4)
    z = [100.0 + draw.gauss(0, 3) for _ in range(40)]

    def end(step):
        s = None
        for v in z:
            s, y = step(s, (v,))
        return s, y

    h = 1e-5
    jma = lambda n=20.0, phase=5.0, power=2.0: end(ad.learned_jma(n=n, phase=phase, power=power, rate=0.0).step)
    s, _ = jma()
    up, down = math.exp(h), math.exp(-h)
    for at, pair in ((7, (jma(n=20 * up), jma(n=20 * down))), (11, (jma(phase=5 + h), jma(phase=5 - h))), (15, (jma(power=2 * up), jma(power=2 * down)))):
        assert s[at] == pytest.approx((pair[0][1][0] - pair[1][1][0]) / (2 * h), rel=1e-4)
    tr = lambda n=14.0: end(ad.learned_tr(n=n, rate=0.0).step)
    assert tr()[0][4] == pytest.approx((tr(14 * up)[1][0] - tr(14 * down)[1][0]) / (2 * h), rel=1e-4)


def test_learned_parameters_move_and_stay_in_bounds():
    from tidemark.operators import adaptive as ad

    draw, s, t, price, seen = random.Random(1), None, None, 100.0, []
    for _ in range(2000):
        price *= math.exp(draw.gauss(0, 0.05))
        s, y = ad.learned_jma(rate=0.5).step(s, (price,))
        t, r = ad.learned_tr(rate=5.0).step(t, (abs(draw.gauss(0, 1)),))
        seen.append((*y[1:], r[1]))
    assert len({round(p, 6) for p, *_ in seen}) > 50 and len({round(x[3], 6) for x in seen}) > 50
    assert all(2 <= p <= 740 and -100 <= f <= 100 and 0.5 <= w <= 7.4 and 2 <= n <= 104 for p, f, w, n in seen)
