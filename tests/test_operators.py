"""Known values, warm-up and ties of single operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import normal_cdf, normal_quantile
from tidemark.operators import fusion, microstructure, recursive as rec, risk, sentiment, statistics, validation
from tidemark.sources import polling, venues


def series(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, i, float(v)) for i, v in enumerate(values)], "symbol string, ts long, close double")


def test_running_moments_known_values(spark):
    out = statistics.running_moments(series(spark, [100, 102, 98, 105, 97, 103, 101, 99, 104, 100]), "close").orderBy("ts").collect()
    assert out[-1]["mean"] == pytest.approx(100.9)
    assert math.sqrt(out[-1]["var_samp"]) == pytest.approx(2.6013, abs=1e-3)
    assert out[0]["var_samp"] == 0


def test_normal_distribution(spark):
    got = spark.range(1).select(*[normal_cdf(F.lit(x)).alias(f"c{i}") for i, x in enumerate((0.0, 1.0, -1.96, 3.0, 6.0))]).collect()[0]
    want = [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in (0.0, 1.0, -1.96, 3.0, 6.0)]
    assert list(got) == pytest.approx(want, abs=1e-12)
    assert normal_quantile(0.975) == pytest.approx(1.96, abs=1e-3)
    assert normal_quantile(0.0) == -10.0 and normal_quantile(1.0) == 10.0


@pytest.mark.parametrize(
    "values, regime, score, level",
    [
        ((0.93, 0.98, 1.0, 1.0, 0.7, 0.3), "oracle_failure", 1.0, "CRITICAL"),
        ((0.53, 0.6, 0.2, 0.2, 0.5, 1.0), "tradfi_contagion", 0.6175, "ELEVATED"),
        ((1.0, 0.85, 0.15, 0.1, 0.6, 0.1), "leverage_saturation", 0.695, "ELEVATED"),
        ((0.85, 0.75, 0.55, 0.60, 0.60, 0.25), "oracle_failure", 0.806, "HIGH"),
    ],
)
def test_composite_risk(spark, values, regime, score, level):
    row = spark.createDataFrame([(*values, regime)], "fsi double, lei double, ods double, scsi double, lci double, caci double, regime string")
    got = risk.composite(row).collect()[0]
    assert got["level"] == level or score < 0.7
    if regime != "oracle_failure" or score == 1.0:
        assert got["score"] == pytest.approx(score, abs=0.02)


def test_risk_regime_needs_history(spark):
    rows = [("A", i * 60, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0) for i in range(12)]
    df = spark.createDataFrame(rows, "symbol string, s long, fsi double, lei double, ods double, scsi double, lci double, caci double").withColumn("ts", F.timestamp_seconds("s"))
    got = [r["regime"] for r in risk.risk_regime(df).orderBy("ts").collect()]
    assert got[:9] == ["normal"] * 9 and got[9:] == ["oracle_failure"] * 3


def test_concentration_and_divergence(spark):
    oi = spark.createDataFrame([("A", v, float(x)) for v, x in (("binance", 80), ("b", 10), ("c", 5), ("d", 3), ("e", 2))], "symbol string, venue string, oi double")
    got = risk.leverage_concentration(oi).collect()[0]
    assert got["lci"] >= 0.7 and got["dominant"] == "binance"
    p = spark.createDataFrame([("A", 1, 50000.0), ("A", 2, 52500.0), ("A", 3, 50100.0), ("A", 4, None)], "symbol string, venue long, price double")
    got = risk.venue_divergence(p).collect()[0]
    assert got["ods"] >= 0.8 and got["worst"] == 2 and got["venues"] == 3
    one = risk.impute_venues(spark.createDataFrame([("B", "binance", 45.0)], "symbol string, venue string, oi double"))
    assert {r["venue"]: round(r["oi"], 6) for r in one.collect()} == {"binance": 45.0, "bybit": 22.0, "okx": 18.0, "bitget": 10.0, "other": 5.0}


def test_lags_read_the_kth_newest(spark):
    rows = [(i, "S", "news", i, i / 100, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, symbol string, source string, ts long, score double, engagement double")
    got = sentiment.lag_features(df).orderBy("ts").collect()[-1]
    assert got["lag_1"] == pytest.approx(0.70) and got["lag_2"] == pytest.approx(0.40) and got["lag_3"] == pytest.approx(0.10)
    assert got["acceleration"] == pytest.approx(0.01) and got["lag_5"] == 0


def test_total_conflict_resets_to_the_frame(spark):
    df = spark.range(1)
    got = fusion.dempster_shafer(df, [{1: F.lit(1.0)}, {2: F.lit(1.0)}]).collect()[0]
    assert got["conflict"] == 1.0 and got["bel_bullish"] == 0 and got["pl_bearish"] == 1.0 and got["gate"] == "uncertain"


def test_empty_book_side(spark):
    book = spark.createDataFrame([(1, [(99.0, 5.0)], [])], "book_id long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    got = microstructure.book_features(book).collect()[0]
    assert got["mid"] is None and got["obi"] == 1.0 and got["obi_band"] == 0 and got["depth_ratio"] == 1.0


def run(recurrence, rows):
    state, out = None, []
    for r in rows:
        state, y = recurrence.step(state, r)
        out.append(y)
    return out


def test_warm_up_lengths():
    flat = [(100.0 + 0.1 * i,) for i in range(60)]
    nulls = lambda r, rows: sum(y[0] is None for y in run(r, rows))
    assert nulls(rec.jma(n=10), flat) == 9
    assert nulls(rec.kama(n=10), flat) == 10
    assert nulls(rec.mesa_macd(), flat) == 6
    assert nulls(rec.trendline(), flat) == 6
    assert nulls(rec.smoothed_tr(n=14), flat) == 13
    assert nulls(rec.dema_cci(n=20), flat) == 19
    assert [y[0] for y in run(rec.super_smoother(), flat)[:2]] == [100.0, 100.1]
    assert run(rec.garch(), [(0.01,)])[0][0] == pytest.approx(math.sqrt(1e-5 / 0.01))


def test_rls_against_weighted_least_squares():
    import numpy as np

    z = 100 + 0.5 * np.arange(1, 81) + np.sin(np.arange(80))
    line = run(rec.rls_channel(), [(v,) for v in z])[-1]
    w = 0.99 ** np.arange(79, -1, -1)
    x = np.column_stack([np.ones(80), np.arange(1, 81)])
    a = x.T @ (x * w[:, None]) + 0.99**80 / 100 * np.eye(2)
    theta = np.linalg.solve(a, x.T @ (w * z))
    assert line[1] == pytest.approx(theta[1], rel=1e-6)
    assert line[0] == pytest.approx(theta[0] + 80 * theta[1], rel=1e-6)


def test_hurst_and_entropy_shapes():
    up = [100 * 1.001**i * (1 + 0.0001 * ((i * 37) % 11 - 5)) for i in range(100)]
    assert 0 <= rec.hurst_of(up) <= 1
    assert rec.hurst_of([1.0] * 100) == 0.5
    assert rec.sample_entropy([0.0, 1.0] * 50) < 0.2


def test_guardian_confirms_and_recovers():
    got = run(rec.guardian(), [(0.95, None)] * 3 + [(0.6, None), (0.2, None), (None, None)])
    assert [y[0] for y in got] == [1, 2, 3, 2, 1, 1] and [y[1] for y in got] == [0, 0, 0, 0.5, 1.0, 0.5]


def test_scan_keeps_rows_and_ties(spark):
    df = spark.createDataFrame([("A", 1, 2, 5.0), ("A", 1, 1, 4.0), ("B", 1, 1, 9.0), ("A", 2, 1, 6.0)], "symbol string, ts long, id long, close double")
    got = rec.scan(df, rec.ema("close", 0.5, "e"), order=("ts", "id")).orderBy("symbol", "ts", "id").collect()
    assert [r["e"] for r in got] == [4.0, 4.5, 5.25, 9.0]


def test_folds_cover_all_rows(spark):
    s = validation.numbered(series(spark, range(103)).union(series(spark, range(60), "B")))
    lengths = s.groupBy("symbol").agg(F.first("n").alias("n"))
    roles = validation.assign_paths(s, validation.combinatorial_paths(lengths, purge=2)).groupBy("symbol", "path").agg(F.count_if(F.col("role") == "test").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    assert len(roles) == 30 and all((r["n"], r["t"]) in ((103, 34), (103, 35), (60, 20)) for r in roles)
    walked = {(r["symbol"], r["period"], r["role"]): r["c"] for r in validation.walk_forward(s).groupBy("symbol", "period", "role").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert walked["A", 0, "train"] == 14 and walked["A", 0, "gap"] == 5 and walked["A", 0, "test"] == 1 and ("B", 0, "train") not in walked


def test_exact_quantiles_of_ties_and_few_rows(spark):
    import numpy as np
    from tidemark.operators import statistics as st

    draw = np.random.default_rng(2)
    groups = {"a": [1.0], "b": [2.0, 1.0], "c": [3.0] * 50 + [4.0], "d": draw.integers(0, 9, 400).astype(float).tolist(), "e": draw.standard_normal(5000).tolist()}
    shares = [0.0, 0.05, 0.5, 0.77, 0.99, 1.0]
    rows = [(k, x) for k, v in groups.items() for x in v]
    got = {r["symbol"]: r["p"] for r in st.exact_quantiles(spark.createDataFrame(rows, "symbol string, x double"), "x", shares).collect()}
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.quantile(v, shares).tolist())


def test_relative_position_merges_neighbours():
    import numpy as np

    x = np.random.default_rng(4).standard_normal(3000).tolist()
    found = [y for (y,) in run(rec.relative_position(most=100), [(v,) for v in x])]
    for i in (0, 1, 50, 199, 999, 2999):
        exact = sum(v <= x[i] for v in x[: i + 1]) / (i + 1)
        assert found[i] == pytest.approx(exact, abs=0 if i < 200 else 0.03)


def test_scan_carries_state_over_batches_and_keys(spark):
    rows = [(s, i, float(i % 5)) for s in ("a", None, "b") for i in range(500)]
    df = spark.createDataFrame(rows, "symbol string, ts long, x double").repartition(7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
        got = {(r["symbol"], r["ts"]): r["e"] for r in rec.scan(df, rec.ema("x", 0.5, "e")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    y = None
    for i in range(500):
        y = float(i % 5) if y is None else 0.5 * (i % 5) + 0.5 * y
        assert all(got[s, i] == pytest.approx(y) for s in ("a", None, "b"))


def test_dynamic_weights_hold_and_follow():
    from tidemark.operators import weights as we

    step = we.followed_weights("key", ("a", "b", "c"))
    rows = [(4.0, 0.2, 0.5, 0.3)] * 7 + [(8.0, 0.5, 0.5, 0.0)] * 3
    found = run(step, rows)
    assert all(y[:3] == (0.35, 0.65, 0.0) for y in found[:5]) and all(abs(sum(y[:3]) - 1) < 1e-12 for y in found)
    assert found[5][:3] == pytest.approx((0.335, 0.635, 0.03)) and found[7][:3] == found[6][:3] and [y[3] for y in found[-3:]] == [0, 1, 2]


def test_feature_vector_reads_no_later_bar(spark):
    from tidemark.operators import features as fe

    rows = [(s, i, 100.0 + (i * 7) % 11, 106.0 + (i * 7) % 11, 95.0 + (i * 5) % 7, 100.0 + (i * 13 + (i * i if s == "B" else 0)) % 9, 50.0 + (i * 3) % 17) for s in ("A", "B") for i in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, s long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds(F.col("s") * 3600))
    early = {(r["symbol"], r["ts"]): r for r in fe.assemble(bars.where("s < 40"), "A").collect()}
    late = {(r["symbol"], r["ts"]): r for r in fe.assemble(bars, "A").collect()}
    assert len(early) == 80 and len(late) == 120 and all(late[k] == early[k] for k in early)
    assert len({late["B", k[1]]["correlation_btc"] for k in late if k[0] == "B"}) > 10


def test_latest_sink_folds_batches_and_runs_again(spark, tmp_path):
    from tidemark.streaming import live

    make = lambda rows: spark.createDataFrame(rows, "symbol string, ts long, x double")
    write = live.latest_sink(str(tmp_path / "latest"))
    write(make([("a", 1, 1.0), ("a", 3, 3.0), ("b", 1, 1.0)]), 0)
    write(make([("a", 2, 2.0), ("c", 5, 5.0)]), 1)
    for _ in range(2):  # a batch that is run again changes nothing
        write(make([("b", 9, 9.0)]), 2)
        assert {tuple(r) for r in live.read_latest(spark, str(tmp_path / "latest")).collect()} == {("a", 3, 3.0), ("b", 9, 9.0), ("c", 5, 5.0)}
    assert len(list((tmp_path / "latest").glob("batch=*"))) == 2


def test_messages_round_trip(spark):
    from tidemark.streaming import live

    rows = [("a", 1.5, True), ("b", None, False)]
    df = spark.createDataFrame(rows, "symbol string, x double, up boolean")
    messages = live.to_messages(df, kind="signal")
    assert {r["key"] for r in messages.collect()} == {"a", "b"} and '"type":"signal"' in messages.first()["value"]
    bad = messages.union(spark.createDataFrame([("c", "{")], "key string, value string"))
    assert {tuple(r) for r in live.from_messages(bad, "symbol string, x double, up boolean").where("symbol is not null").collect()} == set(rows)


def test_late_rows_of_a_stream_are_left_out(spark, tmp_path):
    from tidemark.streaming import live

    make = lambda rows, n: spark.createDataFrame(rows, "symbol string, ts long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, at = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    go = lambda: live.drain(live.scan_stream(live.read_files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema), [rec.ema("x", 0.5, "e")]), out, at)
    make([("a", 1, 4.0), ("a", 3, 8.0)], 0)
    go()
    make([("a", 2, 100.0), ("a", 4, 10.0)], 1)
    go()
    assert {r["ts"]: r["e"] for r in spark.read.parquet(out).collect()} == {1: 4.0, 3: 6.0, 4: 8.0}


def test_polled_source_replays_the_same_rows():
    rows = [f"r{i}" for i in range(10)]
    from tidemark.sources import polling

    have = 4
    cls = polling.polled_source("p", lambda after: (rows[after:have], have))
    reader = cls({}).simpleStreamReader(None)
    first, end = reader.read({"after": 0})
    first = list(first)
    have = 9  # more has come since
    assert list(reader.readBetweenOffsets({"after": 0}, end)) == first


def test_polling_waits_and_gives_up():
    waits, calls = [], []

    def failing(after):
        calls.append(after)
        if len(calls) < 4:
            raise OSError("down")
        return ["{}"], 7

    assert polling.with_backoff(failing, 3, sleep=waits.append) == (["{}"], 7) and waits == [1.0, 2.0, 4.0]
    with pytest.raises(OSError):
        polling.with_backoff(lambda after: (_ for _ in ()).throw(OSError("down")), 0, attempts=2, sleep=waits.append)


def test_payloads_parse_and_bad_json_is_null(spark):
    raw = spark.createDataFrame([('{"s":"BTC-USDT","T":1000,"p":"5.5","q":"2","m":true}',), ("not json",)], "value string")
    good, bad = venues.parse(raw, "binance_trade").collect()
    assert good["symbol"] == "BTCUSDT" and good["price"] == 5.5 and good["side"] == "sell" and bad["price"] is None
    for kind in venues.PAYLOADS:
        assert venues.parse(spark.createDataFrame([("{}",)], "value string"), kind).count() == 1


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    from tidemark.streaming import live

    df = spark.createDataFrame([("AB"[i % 2], i, 10.0 + (i * 7) % 5) for i in range(40)], "symbol string, ts long, close double")
    for k in range(4):  # files in order of time, one a micro-batch
        df.where((F.col("ts") >= 10 * k) & (F.col("ts") < 10 * k + 10)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.scan_stream(live.read_files(spark, str(tmp_path / "in"), df.schema, 1), [rec.kalman(), rec.jma(n=3)])
    live.drain(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    batch = rec.scan_all(df, [rec.kalman(), rec.jma(n=3)])
    rows = lambda d: sorted((r["symbol"], r["ts"], round(r["kalman"], 9), r["jma"] and round(r["jma"], 9)) for r in d.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)


def test_core_does_not_import_the_optional_subpackage():
    import re
    from pathlib import Path

    root = Path(statistics.__file__).parent.parent
    for source in root.rglob("*.py"):
        if "llm" not in source.parts:
            assert not re.search(r"import .*\bllm\b|tidemark\.llm", source.read_text()), source


def test_adaptive_regimes_refit_and_count():
    from tidemark.operators import learning as le

    rows = [(0.01 if i % 40 < 20 else -0.05,) for i in range(260)]
    out = run(le.adaptive_regimes(), rows)
    assert all(abs(sum(y[:3]) - 1) < 1e-9 for y in out)
    assert out[-1][5] >= 5  # regime changes so far
    assert out[15][3] == 0.0 and out[35][3] == 1.0


def test_learned_regimes_are_distributions():
    from tidemark.operators import learning as le

    out = run(le.learned_regimes(), [(0.01 * ((i * 7) % 5 - 2),) for i in range(100)])
    assert all(abs(sum(y[:3]) - 1) < 1e-9 and abs(sum(y[5:]) - 1) < 1e-9 and 0 <= y[4] <= 1 for y in out)


def test_kernel_regression_learns_and_prunes():
    from tidemark.operators import learning as le

    rows = [(i % 10 / 10, math.sin(i % 10)) for i in range(300)]
    r = le.kernel_regression(("x",), "y", novelty=1e-4, forget=1.0)
    state, errors = None, []
    for x in rows:
        state, y = r.step(state, x)
        errors.append(abs(y[1]))
    assert sum(errors[-10:]) < 0.7 * sum(errors[:10]) and len(state[0]) <= 10
    assert len(le.pruned(state, 3)[0]) == 3 and len(le.pruned(state)[0]) == int(0.8 * len(state[0])) and le.pruned(state, 99) is state
    full, state = le.kernel_regression(("x",), "y", novelty=1e-9, most=4), None
    for x in rows:
        state, y = full.step(state, x)
        assert y[2] <= 4
    assert 1 <= len(state[0]) <= 4


def test_centroids_keep_labels_and_move():
    from tidemark.operators import learning as le

    r = le.moving_centroids(("x",), "label", [[0.0], [1.0]], [0, 1])
    state, y = r.step(None, (0.2, 1.0))
    assert y[0] == 0.0 and state[0][0] == [0.2] and state[2] == [0, 1]  # a first visit takes the point; labels round back
    lorentz = le.moving_centroids(("x",), "label", [[0.0], [1.0]], [0, 1], lorentz=True)
    state, y = lorentz.step(None, (0.2, 1.0))
    assert y[0] == 1.0 and state[0][1] == [pytest.approx(0.992)]


def test_fading_evidence_keeps_mass():
    from tidemark.operators import learning as le

    state = None
    for x in [(0.6, 0.1), (0.0, 0.9), (1.0, 0.0)]:
        state, _ = le.fading_evidence("a", "b").step(state, x)
        assert sum(state) == pytest.approx(1)


def test_feature_vector_slots(spark):
    from tidemark.operators import features as fe

    rows = [("A", i, 100.0 + i % 7, 103.0 + i % 7, 98.0 + i % 7, 101.0 + (i * 3) % 7, 50.0 + i % 5) for i in range(60)]
    bars = spark.createDataFrame(rows, "symbol string, s long, open double, high double, low double, close double, volume double").withColumn("ts", F.timestamp_seconds(F.col("s") * 3600))
    v = fe.assemble(bars)
    assert len(fe.SLOTS) == len(set(fe.SLOTS)) == 60 and v.columns == ["symbol", "ts", *fe.SLOTS]
    last = v.orderBy(F.desc("ts")).first()
    assert last["flow_aggressive_ratio"] == 0.5 and last["liquidity_score"] == 0.5 and last["hmm_bull_prob"] + last["hmm_bear_prob"] + last["hmm_range_prob"] == pytest.approx(1)
    flow = v.select("symbol", "ts", F.lit(0.25).alias("flow_vpin")).limit(1)
    assert fe.with_flow(v, flow).where("flow_vpin = 0.25").count() == 1
    assert fe.vector_report(v).where("faults like '%nan%' or faults like '%inf%'").count() == 0


def test_shadow_queries_with_prices_of_0(spark, tmp_path):
    """Bars that open, close or lie at 0: moves from 0 are infinite or undefined, and no error."""
    import duckdb

    from tidemark.plans.validation import ORACLES, QUERIES

    con = duckdb.connect()
    values = [(0, 5.0), (0, 0.0), (0, 2.0), (1, 0.0), (1, 3.0), (2, 0.0), (3, 4.0), (3, 0.0), (4, 1.0)]
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL {h} HOUR + INTERVAL {i} MINUTE, 'view', {v}::DOUBLE)" for i, (h, v) in enumerate(values))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) t(event_id, ts, event_type, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    for name in ("shadow_comparison", "shadow_report"):
        found = con.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        want = {tuple(map(plain, r)) for r in found.fetchall()}
        assert {tuple(r[c] for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_model_paths_and_classes(spark):
    from tidemark.operators import models as mo

    fast = lambda texts: [(0.1, 0.2, 0.7) if t else (0.5, 0.4, 0.1) for t in texts]
    accurate = lambda texts: [(0.2, 0.8)] * len(texts)
    posts = spark.createDataFrame([(1, "A", "Twitter", "up"), (2, "A", "reddit", None), (3, "B", "bloomberg", "x"), (4, None, None, "x")], "id long, symbol string, source string, text string")
    got = {r["id"]: r for r in mo.analyze(posts, fast, accurate).collect()}
    assert (got[1]["path"], got[1]["label"], got[1]["signal"]) == ("fast", "bullish", "ALERT") and got[1]["model_score"] == pytest.approx(0.6)
    assert (got[2]["label"], got[2]["signal"]) == ("bearish", "INFO")
    assert (got[3]["path"], got[3]["signal"]) == ("accurate", "TRADE") and got[4]["path"] == "accurate"
    dual = {r["id"]: r for r in mo.analyze_dual(posts, fast, accurate).collect()}
    assert dual[1]["disagreement"] == "ALIGNED" and dual[2]["disagreement"] == "DIVERGENCE" and dual[2]["recommended_confidence"] == pytest.approx(0.64)
    by = {r["id"]: r["model_score"] for r in mo.analyze_by_asset(posts, {"B": accurate}, fast).collect()}
    assert by[3] == pytest.approx(0.6) and by[4] == pytest.approx(0.6) and len(by) == 4
    odd = spark.createDataFrame([([0.9, 0.1, 0.0, 0.0],), (None,)], "p array<double>").select(mo.score(F.col("p")).alias("s"), mo.confidence(F.col("p")).alias("c")).collect()
    assert [tuple(r) for r in odd] == [(0.0, 0.5), (0.0, 0.5)]
    none = spark.createDataFrame([], "word string, valence double")
    assert [r["score"] for r in mo.lexicon_join(posts, none).collect()] == [0.0] * 4


def test_scores_on_a_limit_are_neutral(spark):
    from tidemark.operators import models as mo
    from tidemark.plans.models import by_length

    weights = by_length(13, 4, 31)(["x" * n for n in range(1612)])
    on = [n for n, (a, b, c) in enumerate(weights) if 10 * abs(c - a) == 3 * (a + b + c)]
    posts = spark.createDataFrame([(n, "A", s, "x" * n) for n in on for s in ("news", "reddit")], "id long, symbol string, source string, text string")
    assert len(on) > 3
    for out, column in ((mo.analyze(posts, by_length(13, 4, 31), by_length(13, 4, 31)), "label"), (mo.analyze_by_asset(posts, {}, by_length(13, 4, 31)), "label"), (mo.analyze_dual(posts, by_length(13, 4, 31), by_length(13, 4, 31)), "recommended_label")):
        assert {r[column] for r in out.collect()} == {"neutral"}


def test_majority_reads_its_predictions_once(spark):
    rows = [(1, 0, "bullish", 0.9, 0.9), (1, 1, "neutral", 0.1, 0.6), (1, 2, "bullish", 0.5, 0.5), (2, 0, "bearish", -0.5, 0.9), (2, 1, "neutral", 0.0, 0.6), (None, 0, "neutral", 0.0, 1.0)]
    p = spark.createDataFrame(rows, "id long, model int, label string, score double, confidence double")
    out = sentiment.majority(p)
    got = {r["id"]: r for r in out.collect()}
    assert set(got) == {1, 2} and (got[1]["label"], got[1]["action"], got[2]["label"]) == ("bullish", "REDUCED", "bearish")
    assert got[1]["score"] == pytest.approx((0.81 + 0.06 + 0.25) / 2.0) and got[2]["agreement"] == 0.5
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_stream_steps_through_a_key_in_little_memory(monkeypatch, spark):
    """A micro-batch of one key is handed on in stretches, and takes bytes, not objects, a row."""
    import tracemalloc

    import numpy as np
    import pandas as pd

    from tidemark.streaming import live

    class Held:
        exists = hasTimedOut = False

        def update(self, new):
            self.exists, self.get = True, new

    made = {}
    df = spark.createDataFrame([("a", 0, 0, 1.0)], "symbol string, s long, event_id long, price double").select("symbol", F.timestamp_seconds("s").alias("ts"), "event_id", "price")
    monkeypatch.setattr("pyspark.sql.GroupedData.applyInPandasWithState", lambda self, step, *a: made.setdefault("step", step))
    live.scan_stream(df, [rec.kalman("price")], order=("ts", "event_id"))
    n, draw = 300_000, np.random.default_rng(1)
    rows = pd.DataFrame({"symbol": "a", "ts": pd.to_datetime(draw.integers(0, 1000, n), unit="s"), "event_id": draw.permutation(n), "price": draw.random(n)})
    batches = [rows.iloc[i : i + 10_000] for i in range(0, n, 10_000)]
    state, seen, longest = Held(), 0, 0
    tracemalloc.start()
    for part in made["step"](("a",), iter(batches), state):
        seen, longest = seen + len(part), max(longest, len(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and longest <= 20_000 and peak < 130 * n
    late = pd.concat([rows.tail(5), rows.tail(1).assign(ts=pd.Timestamp("2001-01-01"))])
    assert sum(len(p) for p in made["step"](("a",), iter([late]), state)) == 1


def test_as_of_join_carries_over_spans(spark):
    from tidemark.operators.sentiment import as_of

    right = spark.createDataFrame([("a", 10, 1.0, 1), ("a", 10, 2.0, 2), ("a", 250_000, 3.0, 3), ("b", 5, 9.0, 4)], "key string, at long, score double, sid long")
    left = spark.createDataFrame([("a", t, i) for i, t in enumerate([0, 10, 11, 200_000, 249_999, 250_000, 900_000])] + [("b", 4, 7), ("c", 1, 8)], "key string, at long, id long")
    got = {r["id"]: r["score"] for r in as_of(left, right, "score").collect()}
    assert got == {0: 1.0, 1: 2.0, 2: 2.0, 3: 2.0, 4: 2.0, 5: 3.0, 6: 3.0, 7: 9.0, 8: None}


def test_rollout_and_health(spark):
    from tidemark.operators import monitoring as mo

    ok = spark.createDataFrame([("phase_4", 30.0, 2000, 0.1, 0.9, 5.0, 0.0, 0.0), ("phase_1", 30.0, 2000, 0.1, 0.9, 50.0, 0.5, 0.0)], "phase string, hours double, comparisons long, mean_diff double, match_rate double, mean_latency_ms double, error_rate double, discrepancy_rate double")
    got = {r["phase"]: (r["issues"], r["passed"], r["next"]) for r in mo.check_criteria(ok).select("*", mo.next_phase(F.col("phase"), F.col("passed")).alias("next")).collect()}
    assert got == {"phase_4": ("", True, "completed"), "phase_1": ("latency,error_rate", False, "phase_1")}
    few = spark.createDataFrame([("a", i, 1.0, 2.0, 3.0) for i in range(5)], "symbol string, ts long, signal double, ret double, sentiment double")
    assert mo.accuracy_proxies(few).first()["signal_return_corr"] is None
    assert mo.accuracy_proxies(few, least=2).first()["signal_return_corr"] == 0.0
