"""MinHash near-dedup, source divergence and the Merkle manifest against slow versions; repeated and null ids in both dedups."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import LONG, SCHEMA, WORDS, corpus, lower
from tidemark.llm import divergence, exact_dedup, jaccard_join, manifest, minhash, shingles

SPACE = re.compile(r"[\x20\x09-\x0D]")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- MinHash near-dedup ----


def shingle_set(text: str | None, k: int) -> set:
    w = WORDS.findall(lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(rows: list[tuple], k: int, percent: int) -> list[int]:
    """Number of the component of each row (id, text), by links between rows."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x, a in enumerate(sets):
        for y in range(x):
            if a and sets[y] and 100 * len(a & sets[y]) >= percent * len(a | sets[y]):
                parent[find(x)] = find(y)
    return [find(i) for i in range(len(rows))]


def slow_copies(rows: list[tuple], k: int, percent: int) -> Counter:
    found = components(rows, k, percent)
    ids: dict[int, list] = {}
    for (i, _), c in zip(rows, found):
        ids.setdefault(c, []).append(i)
    least = {c: min((i for i in m if i is not None), default=None) for c, m in ids.items()}
    return Counter((i, len(shingle_set(t, k)), least[c] if shingle_set(t, k) else i) for (i, t), c in zip(rows, found))


def loose(n: int, seed: int) -> list[tuple]:
    draw = random.Random(seed)
    base = [f"b{i}" for i in range(90)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(draw.randrange(7)):
            w[draw.randrange(90)] = f"e{draw.randrange(40)}"
        rows.append((i, " ".join(w)))
    return rows


MIXED = [(r[0], r[1]) for r in corpus()] + [(None, "a b c d e f"), (None, "A b c d e f"), (None, None), (7, "a b c d e f"), (3, "x y z u v w"), (3, "x y z u v w")]


@pytest.mark.parametrize("rows", [MIXED, loose(250, 3), [(None, "p q r s"), (None, "p q r s")]])
def test_near_copies_against_brute_force(spark, rows):
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(tuple(r)[:3] for r in got) == slow_copies(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_links_beside_the_centre_are_found(spark):
    """Stars alone would miss links between two nodes that don't link with their bucket's centre."""
    rows = []
    for g in range(40):
        w = [f"g{g}w{i}" for i in range(60)]
        for v in range(4):  # v links with v + 1 alone
            rows.append((g * 10 + v, " ".join(f"c{g}v{v}" if 3 * v <= i < 3 * v + 3 else x for i, x in enumerate(w)) + f" t{g} u{g}" * v))
    got = minhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r)[:3] for r in got) == slow_copies(rows, 3, 85)


def test_near_copies_take_empty_tables_and_clashing_columns(spark):
    assert minhash.near_copies(spark.createDataFrame([], SCHEMA)).count() == 0
    names = "doc_id long, text string, node long, label long, k1 long, bucket long, n long, kept boolean"
    assert minhash.near_copies(spark.createDataFrame([(1, "a b c", 1, 2, 3, 4, 5, None), (2, "A b c", 1, 2, 3, 4, 5, None)], names)).where("component_id = 1").count() == 2


def test_signatures_agree_as_the_sets_do():
    """Over many pairs, the share of equal bins is the Jaccard similarity, also where most bins are filled by donors."""
    draw = np.random.default_rng(5)
    for size in (6, 40, 2000):
        same, want = [], 0.8
        for _ in range(300):
            common = draw.integers(0, 1 << 63, int(size * want)).astype(np.uint64) << np.uint64(1)
            own = [draw.integers(0, 1 << 63, (size - len(common)) // 2 or 1).astype(np.uint64) << np.uint64(1) for _ in "ab"]
            a, b = (np.unique(np.concatenate([common, x])) for x in own)
            same.append((minhash.signature(a) == minhash.signature(b)).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(same)) < 0.02


def test_signature_of_one_shingle_fills_all_bins():
    (s,) = shingles.shingle_sets(pa.array(["one two three"], pa.large_string()), 3)
    assert set(minhash.signature(s)) == set(s.tolist())


# ---- rows of repeated and null ids ----

TWICE = [(1, "a b"), (5, "c  d"), (5, "a b"), (6, "cd"), (None, "a  b"), (None, "zz"), (7, "z z"), (8, "q"), (8, "q"), (None, "n n"), (None, "n n"), (9, None), (10, "")]


def test_exact_groups_keep_one_row_of_each_text(spark):
    docs = spark.createDataFrame(TWICE, "doc_id long, text string").repartition(3)
    got = exact_dedup.exact_groups(docs).collect()
    want: dict[str, list] = {}
    for i, t in TWICE:
        want.setdefault(sha(SPACE.sub("", t or "")), []).append((-len(t or ""), i is None, i if i is not None else 0))
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(want.keys())
    for r in got:
        _, void, best = min(want[r["text_sha256"]])
        assert r["keep_id"] == (None if void else best) and r["group_size"] == len(want[r["text_sha256"]])
    assert Counter((r["doc_id"], r["text_sha256"]) for r in got) == Counter((i, sha(SPACE.sub("", t or ""))) for i, t in TWICE)


def test_drop_copies_loses_no_text(spark):
    docs = spark.createDataFrame([(*r, "x") for r in TWICE], "doc_id long, text string, stay string").repartition(3)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((SPACE.sub("", r["text"] or ""), len(r["text"] or "")) for r in kept.collect()) == [("", 0), ("ab", 4), ("cd", 4), ("nn", 3), ("q", 1), ("zz", 3)]
    assert {(r["doc_id"]) for r in kept.where("text is not null and text != ''").collect()} == {None, 5, 7, 8}


def test_keep_one_of_each_loses_no_text(spark):
    base = [f"w{i}" for i in range(40)]
    near = " ".join(base[:-1] + ["end"])
    rows = [(1, " ".join(base)), (5, near), (5, "an altogether different text of words"), (None, near + " more"), (None, "alone"), (None, "alone"), (8, "eight"), (8, "eight"), (9, None), (9, None), (3, "one two"), (2, "ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_of_each(docs).collect()), key=str)
    want = [(1, " ".join(base)), (5, "an altogether different text of words"), (None, "alone"), (8, "eight"), (9, None), (9, None), (2, "ONE two")]
    assert got == sorted(want, key=str)
    groups = {r["component_id"] for r in jaccard_join.near_groups(docs).where("doc_id is null").collect()}
    assert groups == {1, None}


# ---- source divergence ----

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow_divergence(rows: list[tuple], least: int = 10) -> set:
    n, docs, groups = {}, Counter(), {}
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text or ""))
        groups.setdefault(lang, set()).add(source)
        n.setdefault((lang, source), Counter()).update(found)
        docs.update((lang, t) for t in set(found))
    out = set()
    for lang, sources in groups.items():
        kept = sorted((t for g, t in docs if g == lang and docs[(lang, t)] >= least), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        whole = share(sum((n[(lang, s)] for s in sources), Counter()))
        p = {s: share(n[(lang, s)]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}]
            some = [(f(p[s][t], whole[t]), t) for t in kept if n[(lang, s)][t] and p[s][t] > whole[t]]
            for part, ranked in (("pair", pairs), ("term", some)):
                ranked = sorted(ranked, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(ranked, 1) if part == "pair" or r <= 10}
    return out


@pytest.mark.parametrize("shard, seated", [(1 << 17, 8), (7, 2), (3, 1)])
def test_divergence_against_a_slow_version(spark, monkeypatch, shard, seated):
    monkeypatch.setattr(divergence, "SHARD", shard)
    monkeypatch.setattr(divergence, "SEATED", seated)
    draw = random.Random(shard)
    words = [f"{a}{b}" for a in "aäżz" for b in "bcéД漢"] + ["İx", "ﬁ"]
    rows = []
    for i in range(400):
        lang, source = draw.choice(["de", "en", "", None]), f"s{draw.randrange(9)}" if i % 11 else None
        text = draw.choice(" \x0b1_-").join(draw.choice(words[: 3 + draw.randrange(20)]).upper() if draw.random() < 0.3 else draw.choice(words) for _ in range(draw.randrange(30)))
        rows.append((lang, source, text if i % 13 else None))
    rows += [("xx", "alone", "one text of its own"), ("yy", "a", None), ("yy", "b", "few"), ("en", "s1", "Long" * 300_000)] + [("en", "hot", "bc bc Bc")] * 50
    docs = spark.createDataFrame([(1, *r, 2, "c") for r in rows], "doc_id long, lang string, source string, text string, shard int, term string").repartition(4)
    got = divergence.divergence(docs).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == slow_divergence(rows)


def test_divergence_takes_empty_tables(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_are_exact_for_large_counts():
    n = np.array([0, 1, 10**14, 4 * 10**15], np.int64)
    whole = 9 * 10**15
    assert divergence.shares(n, whole).tolist() == [1 + 10**9 * (int(x) + 2) // whole for x in n]
    assert divergence.shares(np.array([5]), 7).tolist() == [1 + 10**9]


# ---- Merkle manifest ----


def slow_manifest(rows: list[tuple], tampered) -> Counter:
    """Rows (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: sha("".join(map(field, r)))

    def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
        """The root, and for each node its siblings (before, after) by level."""
        steps: list[list] = [[] for _ in nodes]
        below = [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(a, min(a + 8, len(nodes))) for a in range(0, len(nodes), 8)]
            for run in runs:
                for i in run:
                    for x in below[i]:
                        steps[x].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
            below = [[x for i in run for x in below[i]] for run in runs]
            nodes = [sha("".join(nodes[i] for i in run)) for run in runs]
        return nodes[0], steps

    langs: dict = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in order:
        members = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[lang] = (members, *tree([leaf(r) for r in members]))
    root, above = tree([made[lang][1] for lang in order])
    out = Counter()
    for lang, outer in zip(order, above):
        members, subroot, steps = made[lang]
        for r, own in zip(members, steps):
            way = own + outer
            h = leaf(r[:4] + (lower(r[4]),)) if tampered(r) and r[4] is not None else leaf(r)
            for before, after in way:
                h = sha(before + h + after)
            out[(r[0], leaf(r), subroot, root, sha("".join(a + b for a, b in way)), h, h == root)] += 1
    return out


def chosen(r) -> bool:
    return r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0


@pytest.mark.parametrize("many", [0, 1, 8, 9, 600, 9000])
def test_manifest_against_a_slow_version(spark, many):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}" if i % 2 else f"text {i}") for i in range(many)]
    rows += [(5, None, None, None, None), (-3, "s", None, 2, ""), (None, "ß", "de", 1, "Äß A"), (None, "ß", "de", 1, "Äß A"), (12, "x", "", 3, "one"), (12, "y", "zz", 3, LONG), (40, "x", "fr", 1, "A\nb")]
    rows += [(7, "x", "aé", i % 4, "Same") for i in range(20)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree int, place string").repartition(3)
    got = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0).collect()
    assert Counter(tuple(r) for r in got) == slow_manifest(rows, chosen)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "T")], [(1, "s", None, 1, "T"), (2, "s", None, 1, "T")]])
def test_manifest_of_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id int, source string, lang string, n_chars long, text string")
    got = manifest.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    assert Counter(tuple(r) for r in got.collect()) == (slow_manifest(rows, chosen) if rows else Counter()) and got.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert all(r["verified"] for r in manifest.manifest(docs).collect())


# ---- vectors of several lengths ----


def test_vectors_are_compared_within_their_length(spark):
    from tidemark.llm import ann

    draw = np.random.default_rng(8)
    rows = [(i, draw.normal(size=3 if i % 3 else 5).tolist()) for i in range(240)] + [(300, [1.0]), (400, None), (500, [0.0, 0.0, 0.0]), (600, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got: dict = {}
    for r in ann.search(vectors, vectors.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    known = {i: np.array(v) for i, v in rows[:240]}
    for q in (0, 100, 200):
        near = sorted((float(np.sqrt(((known[q] - v) ** 2).sum())), i) for i, v in known.items() if i != q and len(v) == len(known[q]))[:10]
        assert [i for i, _ in got[q]] == [i for _, i in near] and [s for _, s in got[q]] == pytest.approx([d for d, _ in near])
    assert 300 not in got  # alone of its length
