"""The training-data operators: SQL on the same tables, slow versions, odd ids, long texts and adversarial words."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import brute_groups, lower
from tidemark.llm.common import row_keys
from tidemark.llm import bpe, exact_dedup, jaccard_join, language_id, license_scan, mixing, quality, queries, secrets, shingles, sketch, token_rollups


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    found = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str) == sorted(found.fetchall(), key=str)


# ---- exact dedup ----


@pytest.mark.parametrize("kind, ids", [("string", ["b", "a", None, "", "c"]), ("long", [-(2**63), 2**63 - 1, None, 0, 5]), ("decimal(20,2)", [3, 1, None, 2, 9])])
def test_exact_groups_take_ids_of_any_type(spark, kind, ids):
    from decimal import Decimal

    ids = [Decimal(i) if kind.startswith("decimal") and i is not None else i for i in ids]
    rows = list(zip(ids, ["x y", "xy", "x  y", "z", "z"]))
    got = {r["text"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(spark.createDataFrame(rows, f"doc_id {kind}, text string")).join(spark.createDataFrame(rows, f"d {kind}, text string"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()}
    assert got["x y"] == got["xy"] == got["x  y"] == (None, 3)  # the longest original stays, even without an id
    least = min((i for i in ids[3:]), key=lambda i: i)
    assert got["z"] == (least, 2)


# ---- shingles and the join ----


def thue_morse(steps: int) -> str:
    w = "a"
    for _ in range(steps):
        w += w.translate(str.maketrans("ab", "ba"))
    return w


@pytest.mark.parametrize("steps", [3, 5, 6, 10, 11, 12])
def test_complementary_words_differ(steps):
    w = thue_morse(steps)
    hashes, _ = shingles.words(pa.array([w, w.translate(str.maketrans("ab", "ba")), w.upper()], pa.large_string()))
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_word_hashes_are_those_of_their_bytes():
    draw = random.Random(1)
    words = ["".join(draw.choice("abé漢1-") for _ in range(draw.randint(1, 90))) for _ in range(500)]
    together, _ = shingles.words(pa.array([" ".join(words)], pa.large_string()))
    alone = [shingles.words(pa.array([w], pa.large_string()))[0][0] for w in words]
    assert together.tolist() == alone and len(set(alone)) == len(set(words))


def test_near_groups_of_long_texts(spark):
    """Texts above the slice size, and one word of that size."""
    long = " ".join(f"w{i}" for i in range(400_000))
    rows = [(1, long), (2, long + " tail"), (3, "x" * 3_000_000), (4, "x" * 3_000_000), (5, "y" * 3_000_000), (6, "a b")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (399_996, 1), 2: (399_997, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 6)}


def test_digests_have_two_halves():
    a, b = (np.array([i, 7], np.uint64) for i in (1, 2))
    assert jaccard_join._digest(a) == jaccard_join._digest(a.copy()) and set(jaccard_join._digest(a)).isdisjoint(jaccard_join._digest(b))


@pytest.mark.parametrize("most", [sketch.MOST_BITS, 1 << 6])
def test_sketch_clears_and_leaves_the_rest_to_the_join(spark, monkeypatch, most):
    monkeypatch.setattr(sketch, "LEAST_BITS", 1 << 6)
    monkeypatch.setattr(sketch, "MOST_BITS", most)
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit(1).alias("k1"), F.lit(2).alias("row"))
    docs = docs.union(docs.where("doc_id % 14 = 0"))
    marks = docs.select(*(k.alias(name) for name, k in row_keys(F.col("doc_id"), F.col("text")).items()), F.expr("doc_id % 7 = 0").alias("marked"), F.expr("doc_id % 14 = 0").alias("stay")).where("marked").drop("marked").distinct()
    kept = sketch.without(docs, marks)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [i for i in range(1000) if i % 7 or i % 14 == 0]


# ---- BPE ----


def test_texts_without_spaces_cost_no_more_than_twice_the_plain_encoding():
    draw = random.Random(3)
    codec = bpe.Codec(open(bpe.vocabulary_path(), "rb").read())
    letters = "".join(chr(0x4E00 + draw.randrange(3000)) for _ in range(700_000))
    took = {}
    for size in (350_000, 700_000):
        text = letters[:size]
        began = time.time()
        (ids, _), *_ = list(bpe.encode_texts(pa.array([text]), codec))
        took[size] = time.time() - began
        assert ids == codec.plain(text.encode())
    assert took[700_000] < 4 * took[350_000] + 1  # linear; the join of windows was quadratic


def test_anchors_part_texts():
    codec = bpe.Codec(open(bpe.vocabulary_path(), "rb").read())
    draw = random.Random(9)
    for _ in range(3000):
        data = "".join(draw.choice("ab'sl1. \n漢é,、-_٣") for _ in range(draw.randint(1, 30))).encode()
        if found := bpe.anchors(data):
            for at in found:
                assert codec.plain(data[:at]) + codec.plain(data[at:]) == codec.plain(data)


# ---- quality ----


def slow_features(text: str | None) -> list[float]:
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for w in words]
    classes = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#$%&*@^~<>{}[]\\=+", b"!?", b".,;:", b"\n")
    shares = [sum(b in c for b in raw) / max(len(raw), 1) for c in classes]
    n = len(words)
    repeats = sum(a == b for a, b in zip(low, low[1:])) / max(n, 1)
    distinct = len(set(low)) / max(n, 1)
    return [*shares, *[np.log1p(40 * s) for s in shares], repeats, np.log1p(40 * repeats), distinct, distinct * np.log1p(n), np.log1p(n), len(raw) / max(n, 1) / 10, float(n == 0)]


def test_quality_against_a_slow_scorer(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    ranking = quality.learn(d, labels.where(~quality.held_out(F.col("doc_id"))))
    got = {r["doc_id"]: r for r in quality.predict_quality(d, labels).collect()}
    for r in d.collect():
        x = np.clip((np.array(slow_features(r["text"])) - ranking.mean) / ranking.spread, -8, 8)
        z = sum(a * b for a, b in zip(x, ranking.weights))
        score = 1 / (1 + np.exp(-((z - ranking.cut) / ranking.scale + np.log(0.7 / 0.3))))
        assert got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)
        assert got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.7)


# ---- secrets ----


def test_all_rules_against_regular_expressions():
    draw = random.Random(21)
    parts = ["password", "secret", "api_key", "=", ": ", '"', "ghp_", "gho_", "xoxb-", "AIza", "sk_live_", "rk_live_", "eyJ", ".", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "AKIA", "abcdef0123456789", "A1b2C3d4" * 5, "-", "_", " ", "\n", "é", "😀"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(1, 40))) for _ in range(2500)]
    texts += ["x" * 2_500_000 + " password=abcdefabcdef12 " + "y" * 2_500_000]
    got = secrets.scan_texts(pa.array(texts))
    for text, found in zip(texts, got):
        want = {}
        for name, pattern, least, value, chars in secrets.RULES:
            spans = [m.span() for m in re.finditer(pattern, text, re.ASCII) if (len(re.search(r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$", m[0])[1]) >= value if value else len(m[0]) >= least)]
            if spans:
                want[name] = spans
        assert found == want


# ---- licenses ----


def slow_licenses(text: str | None) -> tuple[str, float]:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    pairs = list(zip(words, words[1:]))
    labels, best = set(), 0.0
    for k, (phrase, label) in enumerate((*license_scan.BASE, *license_scan.NOTICES)):
        p = phrase.split()
        want = list(zip(p, p[1:]))
        votes: dict[int, set] = {}
        for i, pair in enumerate(pairs):
            for at, w in enumerate(want):
                if w == pair:
                    votes.setdefault(i - at, set()).add(at)
        near = 0 if k < len(license_scan.BASE) else license_scan.NEAR
        for d in votes:
            share = len(set().union(*(votes.get(d + e, set()) for e in range(near + 1)))) / len(want)
            if share >= (1.0 if k < len(license_scan.BASE) else license_scan.SHARE):
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def test_license_labels_and_scores_against_a_slow_scan(spark):
    draw = random.Random(8)
    notices = [n for n, _ in license_scan.NOTICES]
    texts = ["mit license " * 4, "apache license " * 6, "the mit license the mit license", None, "", "one", " ".join(["released under the mit license"] * 50)]
    for _ in range(150):
        w = draw.choice(notices).split()
        for _ in range(draw.randrange(5)):
            at = draw.randrange(len(w))
            w[at:at + draw.randrange(2)] = draw.choice([[], ["new"], ["MIT"], ["license", "license"]])
        texts.append(" ".join(draw.choice(["x", "license", "the"]) for _ in range(draw.randrange(6))) + " " + " ".join(w) + draw.choice(["", " cc by", " All Rights Reserved."]))
    texts.append("lorem ipsum " * 100_000 + "released under the MIT license")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.license_report(df).collect()}
    for i, t in enumerate(texts):
        labels, score = slow_licenses(t)
        assert got[i] == (labels, pytest.approx(score))
    assert got[0] == got[1] == ("", 0.0) and got[len(texts) - 1][0] == "mit"


# ---- rollups ----


def _changes(spark, rows):
    return spark.createDataFrame(rows, "op string, source string, lang string, version string, n_tokens long, old_tokens long")


def test_a_crash_within_publishing_leaves_the_last_version(spark, tmp_path, monkeypatch):
    roll = token_rollups.Rollup(spark, str(tmp_path / "r"))
    assert roll.totals().count() == 0
    roll.commit(1, _changes(spark, [("insert", "a", "en", "v", 5, None)]))

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(token_rollups.Rollup, "_create", crash)
        with pytest.raises(RuntimeError):
            roll.commit(2, _changes(spark, [("insert", "a", "en", "v", 7, None)]))
    # a writer that died within its write leaves a part of a draft, and totals that nothing names
    (tmp_path / "r/versions/.0123").write_text('{"version": 2, "batch')
    (tmp_path / "r/totals/lost/_temporary").mkdir(parents=True)
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v", 1, 5)]
    roll.commit(2, _changes(spark, [("insert", "a", "en", "v", 7, None)]))
    roll.commit(2, _changes(spark, [("insert", "a", "en", "v", 7, None)]))
    assert [tuple(r) for r in roll.totals().collect()] == [("a", "en", "v", 2, 12)]
    assert [r["batch_id"] for r in roll.versions().orderBy("version").collect()] == [1, 2]


def test_of_two_writers_of_a_version_one_fails_and_may_commit_again(spark, tmp_path):
    a, b = (token_rollups.Rollup(spark, str(tmp_path / "r")) for _ in "ab")
    a.commit(1, _changes(spark, [("insert", "a", "en", "v", 5, None)]))
    last = b._last()
    a.commit(2, _changes(spark, [("insert", "a", "en", "v", 7, None)]))
    with pytest.raises(Exception, match="(?i)exist"):
        b._publish(last, 3, b._at(last))
    b.commit(3, _changes(spark, [("delete", "a", "en", "v", 5, None)]))
    assert [tuple(r) for r in a.totals().collect()] == [("a", "en", "v", 1, 7)] and a.versions().count() == 3


def test_feed_takes_nulls(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", None, None), (2, None, "en", "s"), (None, "x", "en", "s"), (3, "p|q |", "en", "s")], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r["source"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in token_rollups.feed(spark, docs, labels, str(tmp_path / "f")).totals().collect()}
    assert got[(None, "words-v1")] == (1, 2) and got[("s", "words-v1")] == (3, 2) and got[("s", "bytes-v1")] == (3, 4)


# ---- others ----


def test_quality_and_mixing_of_many_sources_and_long_texts(spark):
    x = quality.features(pa.array(["word " * 600_000, "w" * 3_000_000, None]))
    assert x.shape[0] == 3 and np.isfinite(x).all() and x[0] == pytest.approx(slow_features("word " * 600_000))
    df = spark.createDataFrame([(i, f"s{i % 5000}") for i in range(10_000)], "doc_id long, source string")
    assert mixing.mix(df, block=1).select("mix_unit", "mix_slot").distinct().count() == 10_000


def test_pipeline_takes_empty_tables_and_clashing_columns(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, node long, h long, label long, mix_slot long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "e/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
    rows = [(i, t, None, "s", len(t), "r", 1, 2, 3, 4) for i, t in enumerate(["the cat sat on the mat", "the  cat sat on the mat", "123", "der hund"])]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), schema)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 3]


def test_identified_languages_fill_the_column(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en")] * 20 + [("der hund und die katze", "de")] * 20 + [("the dog", None), ("die katze", None), ("12", None)])]
    got = {r["doc_id"]: r["lang"] for r in language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[40] == "en" and got[41] == "de" and 42 not in got and len(got) == 42


def test_loose_copies_in_many_rings_match_brute_force(spark, monkeypatch):
    """Copies of several texts that lie within, around and beyond the radius of each other."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 24)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 3)
    draw = random.Random(12)
    rows = []
    for k in range(3):
        base = [f"{k}b{i}" for i in range(120)]
        for i in range(120):
            w = list(base)
            for _ in range(draw.randrange(14)):
                w[draw.randrange(120)] = f"e{draw.randrange(30)}"
            rows.append((k * 1000 + i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_recall_on_the_table(spark):
    """Against brute force on ``embeddings`` itself, by the query's own result."""
    from tidemark.llm import ann

    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got: dict = {}
    for r in ann.search(v, v.where("vec_id % 100 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    rows = v.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hit = 0
    for q in got:
        d = ((x - x[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        hit += len(set(ids[np.argsort(d)[:10]].tolist()) & got[q])
    assert hit / (10 * len(got)) >= 0.93 and all(len(found) == 10 for found in got.values())


def test_lists_of_few_vectors_still_give_ten(spark):
    from tidemark.llm import ann

    draw = np.random.default_rng(6)
    far = [(i, [float(100 + i), *draw.standard_normal(7)]) for i in range(2)]
    rows = far + [(i, [0.0, *draw.standard_normal(7)]) for i in range(2, 4000)]
    df = spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    assert ann.search(df, df.where("vec_id < 2")).groupBy("query_id").count().where("count = 10").count() == 2


def test_repeated_and_null_vector_ids(spark):
    from tidemark.llm import ann

    draw = np.random.default_rng(8)
    rows = [(i % 300 if i else None, [float(c) for c in draw.standard_normal(6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r["rank"])
    assert set(by) == {0, 100, 200} and all(sorted(v) == list(range(1, 11)) for v in by.values()) and all(r["vec_id"] != r["query_id"] for r in got)


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    """60 nodes of one component and 5 others: all links between components are found, from few replicas."""
    import pandas as pd

    from tidemark.llm import jaccard_join as jj

    sets = {i: sorted({*range(20), *([100 + i] if i % 3 else [])}) for i in range(65)}
    s = spark.createDataFrame(list(sets.items()), "node long, s array<long>")
    regions = spark.createDataFrame([(7, i, 0 if i < 60 else i) for i in sets] + [(8, 1, 0), (8, 64, 64)], "region long, node long, label long")
    monkeypatch.setattr(jj, "BLOCK", 8)
    got = {tuple(sorted(r)) for r in jj._in_blocks(regions, jj._sizes(regions), s, 92).collect()}
    near = lambda x, y: 100 * len({*sets[x]} & {*sets[y]}) >= 92 * len({*sets[x]} | {*sets[y]})
    assert got == {(x, y) for x in sets for y in range(max(x + 1, 60), 65) if near(x, y)} and 0 < len(got) < 310
    monkeypatch.setattr(jj, "_compare", lambda percent: lambda rows: pd.DataFrame({"u": [len(rows)], "v": [0]}))
    assert sum(r["u"] for r in jj._in_blocks(regions, jj._sizes(regions), s, 92).collect()) < 65 * 9 / 4


def test_buckets_of_the_same_nodes_are_joined_once(spark, monkeypatch):
    """Two near copies share many bands, whose buckets hold the same two nodes: a pair costs one row, not one a band and size class."""
    from tidemark.llm import minhash

    rows, write = {}, minhash.write_and_reread

    def counted(df, name):
        made = write(df, name)
        rows[name] = made.count()
        return made

    monkeypatch.setattr(minhash, "write_and_reread", counted)
    texts = [[f"w{i}x{j}" for j in range(200)] for i in range(20)]
    docs = [(2 * i + k, " ".join(t[:-1] + ["z"] if k else t)) for i, t in enumerate(texts) for k in (0, 1)]
    got = minhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: d - d % 2 for d, _ in docs}
    assert rows["held"] == 20
