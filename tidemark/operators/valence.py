"""Rule-based valence of texts: a lexicon's words with what stands around them.

A text is read whole, as one run of words; each word of the lexicon is judged by the three words before it (boosters,
dampeners, negations), by capitals where not all words have them, and by a contrasting "but"; exclamation and question
marks add emphasis. Texts are judged where they lie, a few MB at a time by Arrow and numpy; nothing is exploded or
shuffled.

The lexicon is a table (word, valence). It is broadcast once to the executors; a lexicon of more than ``MOST_WORDS``
words is refused. Each different word of a few MB of text is looked up once.

Cases: null text is empty and scores 0; words part at white space and lose ASCII punctuation at both ends if more than
two characters are left; letters are lower-cased and judged as capitals by A-Z alone; of a word given twice the least
valence counts, a null valence doesn't.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

SPACES = r"[\x20\x09-\x0D]+"
ENDS = r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
MOST_WORDS = 500_000
#: Bytes of text that are judged at a time.
PIECE = 4_000_000

# fixed values: the published rules' weights
BOOST, CAPITALS, NEGATED, NEVER_SO, HALF, MORE = 0.293, 0.733, -0.74, 1.25, 0.5, 1.5
DISTANCE = (1.0, 0.95, 0.9)
EXCLAIM, MOST_EXCLAIM, QUESTION, MOST_QUESTION = 0.292, 4, 0.18, 0.96
ALPHA = 15.0
SCORES = ("compound", "pos", "neg", "neu")
SCORE_TYPE = pa.struct([(c, pa.float64()) for c in SCORES])
BOOSTERS = ("absolutely", "amazingly", "completely", "considerably", "deeply", "enormously", "entirely", "especially", "exceptionally", "extremely", "greatly", "highly", "hugely", "incredibly", "intensely", "more", "most", "particularly", "purely", "quite", "really", "remarkably", "so", "substantially", "thoroughly", "totally", "tremendously", "unbelievably", "utterly", "very")
DAMPENERS = ("almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally", "partly", "scarcely", "slightly", "somewhat", "sorta")
NEGATIONS = ("ain't", "aint", "cannot", "cant", "dont", "hadnt", "isnt", "neither", "never", "no", "nobody", "none", "nope", "nor", "not", "nothing", "nowhere", "rarely", "seldom", "wasnt", "without", "wont", "despite")
# fixed values: terms of the trade
TRADE_TERMS = {"moon": 3.0, "mooning": 3.5, "bullish": 2.5, "hodl": 1.5, "ath": 2.0, "pump": 2.0, "accumulation": 1.5, "btfd": 1.5, "rekt": -3.5, "dump": -2.5, "rug": -3.5, "bearish": -2.5, "capitulation": -3.0, "liquidated": -3.0, "scam": -3.5, "ponzi": -4.0, "fud": -1.5, "crash": -3.0, "bleeding": -2.0, "whale": 0.5, "degen": 0.0, "ngmi": -1.5, "wagmi": 1.5}


def lowered(w: Column) -> Column:
    return F.translate(w, UPPER, LOWER)


def _pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, about ``PIECE`` bytes at a time; null is empty."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("int64"))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, side="right")))
        yield texts.slice(at, upto - at)
        at = upto


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts in order: number of its text, place of its form, and the different forms without the punctuation around them."""
    parts = pc.ascii_split_whitespace(texts)
    flat, owner = parts.flatten(), pc.list_parent_indices(parts)
    some = pc.not_equal(flat, "")
    flat, owner = flat.filter(some), owner.filter(some).to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    bare = pc.ascii_trim(coded.dictionary, characters=PUNCTUATION)
    return owner, coded.indices.to_numpy(zero_copy_only=False), pc.if_else(pc.greater(pc.utf8_length(bare), 2), bare, coded.dictionary)


def trade_terms(spark) -> DataFrame:
    return spark.createDataFrame(list(TRADE_TERMS.items()), "word string, valence double")


def induced_lexicon(texts: DataFrame, share: float = 0.01, least: float = 0.3) -> DataFrame:
    """word and valence from texts(text, label): twice the log ratio of the shares of texts with label 1 and 0 that have the word.

    Only words in at least ``share`` of the labelled texts count, so the lexicon has at most 1 / share times as many
    words as a text has distinct ones on average, however many texts there are.
    """
    known = texts.where(F.col("label").isin(0, 1))
    each = known.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(_texts_with, "word string, n1 long, n0 long")
    counts = each.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    whole = known.agg(F.count_if(F.col("label") == 1).alias("t1"), F.count_if(F.col("label") == 0).alias("t0"))  # one row
    met = counts.join(F.broadcast(whole)).where(F.col("n1") + F.col("n0") >= share * (F.col("t1") + F.col("t0")))
    value = 2 * F.ln((F.col("n1") + 0.5) / (F.col("t1") + 1) / ((F.col("n0") + 0.5) / (F.col("t0") + 1)))
    met = met.select("word", F.round(F.greatest(F.lit(-4.0), F.least(F.lit(4.0), value)), 2).alias("valence"))
    return met.where(F.abs("valence") >= least)


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word with the number of texts of label 1 and of label 0 that have it, piece by piece."""
    for batch in batches:
        labels, at = batch.column("label").to_numpy(zero_copy_only=False), 0
        for texts in _pieces(batch.column("text")):
            owner, place, forms = _words(texts)
            low = pc.ascii_lower(forms).dictionary_encode()
            n = len(low.dictionary)
            seen = np.unique(owner.astype("int64") * n + low.indices.to_numpy(zero_copy_only=False)[place])
            one = labels[at : at + len(texts)][seen // max(n, 1)] == 1
            yield pa.RecordBatch.from_arrays([low.dictionary, *[pa.array(np.bincount(seen[part] % max(n, 1), minlength=n).astype("int64")) for part in (one, ~one)]], names=["word", "n1", "n0"])
            at += len(texts)


def _terms(lexicon: DataFrame) -> pa.Table:
    """word, v (valence), b (boost) and no (negates) of each word, with those of the rules."""
    spark = lexicon.sparkSession
    rules = [(w, None, BOOST, False) for w in BOOSTERS] + [(w, None, -BOOST, False) for w in DAMPENERS] + [(w, None, None, True) for w in NEGATIONS]
    own = lexicon.limit(MOST_WORDS + 1).select(lowered(F.col("word")).alias("word"), F.col("valence").cast("double").alias("v")).toArrow()
    if own.num_rows > MOST_WORDS:
        raise ValueError(f"a lexicon of {own.num_rows} words or more, {MOST_WORDS} at most")
    least = own.filter(pc.is_valid(own["word"])).group_by("word").aggregate([("v", "min")]).rename_columns(["word", "v"])
    terms = {w: (v, None, False) for w, v in zip(least["word"].to_pylist(), least["v"].to_pylist())}
    for w, _, b, no in rules:
        terms[w] = (terms.get(w, (None,))[0], b, no)
    v, b, no = zip(*terms.values())
    return pa.table({"word": pa.array(terms, pa.string()), "v": pa.array(v, pa.float64()), "b": pa.array(b, pa.float64()), "no": pa.array(no, pa.bool_())})


def _judge(texts: pa.Array, terms: pa.Table) -> pa.Array:
    """compound, pos, neg and neu of each text."""
    owner, place, forms = _words(texts)
    n = np.bincount(owner, minlength=len(texts))
    low = pc.ascii_lower(forms)
    found = pc.index_in(low, value_set=terms["word"].combine_chunks())
    values = lambda c: terms[c].combine_chunks().take(found)
    whole = lambda x, empty: pc.fill_null(x, empty).to_numpy(zero_copy_only=False)
    of = lambda x: x[place]
    v, b = values("v"), values("b")
    has_v, has_b = of(whole(v.is_valid(), False)), of(whole(b.is_valid(), False))
    no = of(whole(values("no"), False) | whole(pc.match_substring(low, "n't"), False))
    caps = of(whole(pc.and_(pc.not_equal(forms, low), pc.equal(forms, pc.ascii_upper(forms))), False))
    v, b = of(whole(v, 0.0)), of(whole(b, 0.0))
    is_ = lambda *ws: of(whole(pc.is_in(low, value_set=pa.array(ws)), False))
    n_caps = np.bincount(owner, weights=caps, minlength=len(texts))
    mixed = (n_caps > 0) & (n_caps < n)
    start = np.cumsum(n) - n
    but = np.full(len(texts), -1)
    at = np.flatnonzero(is_("but"))[::-1]
    but[owner[at]] = at  # the first one stays

    hit = np.flatnonzero(has_v & ~has_b)
    who = owner[hit]
    with_case = lambda c, x: np.where(c & mixed[who], np.where(x > 0, CAPITALS, -CAPITALS), 0.0)

    def before(marks: np.ndarray, k: int) -> np.ndarray:
        """The mark of the word k places before each hit, False where there is none."""
        there = hit - k >= start[who]
        return there & marks[np.where(there, hit - k, hit)]

    x = v[hit] + with_case(caps[hit], v[hit])
    so, doubt, never, without = is_("so", "this"), is_("doubt"), is_("never"), is_("without")
    so_between = doubt_between = np.zeros(len(hit), bool)
    for k, distance in enumerate(DISTANCE, 1):
        plain = (hit - k >= start[who]) & ~before(has_v, k)
        back = np.maximum(hit - k, 0)
        boost = np.where(before(has_b, k), np.where(x < 0, -b[back], b[back]) + with_case(caps[back], x), 0.0)
        moved = x + boost * distance
        turned = np.where(before(never, k) & so_between, moved * NEVER_SO, np.where(before(without, k) & doubt_between, moved, np.where(before(no, k), moved * NEGATED, moved)))
        x = np.where(plain, turned, x)
        so_between, doubt_between = so_between | before(so, k), doubt_between | before(doubt, k)
    least = before(is_("least") & ~has_v, 1) & ~before(is_("at", "very"), 2)
    x = np.where(least, x * NEGATED, x)
    x = np.where(but[who] < 0, x, np.where(hit < but[who], x * HALF, x * MORE))

    summed = lambda keep, y: np.bincount(who[keep], weights=y[keep], minlength=len(texts))
    marks = lambda c: pc.count_substring(texts, c).to_numpy(zero_copy_only=False)
    asked = marks("?")
    emphasis = np.minimum(marks("!"), MOST_EXCLAIM) * EXCLAIM + np.where(asked > 3, MOST_QUESTION, np.where(asked > 1, asked * QUESTION, 0.0))
    total, ups, downs = summed(x == x, x), summed(x > 0, x + 1), summed(x < 0, 1 - x)
    flat = n - np.bincount(who[x != 0], minlength=len(texts))
    ups, downs = ups + np.where(ups > downs, emphasis, 0.0), downs + np.where(downs > ups, emphasis, 0.0)
    total = total + np.sign(total) * emphasis
    every = ups + downs + flat
    share = lambda y: np.divide(y, every, out=np.zeros(len(texts)), where=every > 0)
    return pa.StructArray.from_arrays([pa.array(y) for y in (total / np.sqrt(total * total + ALPHA), share(ups), share(downs), share(flat))], names=list(SCORES))


def scored(texts: DataFrame, lexicon: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds compound (-1 to 1) and the shares pos, neg and neu, their names led by ``prefix``."""
    shared = texts.sparkSession.sparkContext.broadcast(_terms(lexicon))  # at most MOST_WORDS words

    @F.arrow_udf("struct<" + ", ".join(f"{c}: double" for c in SCORES) + ">")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            made = [_judge(part, shared.value) for part in _pieces(batch)]
            yield pa.concat_arrays(made) if made else pa.array([], SCORE_TYPE)

    t = texts.select("*", judged(F.col(text_col)).alias("_judged"))
    return t.select(*[F.col(f"`{c}`") for c in texts.columns], *[F.col("_judged")[c].alias(prefix + c) for c in SCORES])


# ---- the same in SQL: words as rows, their surroundings as windows ----


def lexicon_sql(texts: str, share: float = 0.01, least: float = 0.3) -> str:
    """CTEs up to ``lexicon``(word, valence), induced from table ``texts``(id, text, label), with the terms of the trade."""
    own = ", ".join(f"('{w}', {v})" for w, v in TRADE_TERMS.items())
    return f"""
lx_w AS (SELECT id, label, unnest(string_split_regex(coalesce(text, ''), '{SPACES}')) AS p FROM {texts} WHERE label IN (0, 1)),
lx_b AS (SELECT id, label, p, regexp_replace(p, '{ENDS}', '', 'g') AS b FROM lx_w WHERE p <> ''),
lx_d AS (SELECT DISTINCT id, label, translate(CASE WHEN length(b) > 2 THEN b ELSE p END, '{UPPER}', '{LOWER}') AS word FROM lx_b),
lx_t AS (SELECT count(*) FILTER (label = 1) AS t1, count(*) FILTER (label = 0) AS t0 FROM {texts}),
lx_n AS (SELECT word, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0 FROM lx_d GROUP BY word),
lx_v AS (SELECT word, round(greatest(-4.0, least(4.0, 2 * ln((n1 + 0.5) / (t1 + 1) / ((n0 + 0.5) / (t0 + 1))))), 2) AS valence FROM lx_n, lx_t WHERE n1 + n0 >= {share} * (t1 + t0)),
lexicon AS (SELECT word, min(valence)::DOUBLE AS v FROM (SELECT * FROM lx_v WHERE abs(valence) >= {least} UNION ALL VALUES {own}) GROUP BY word)"""


def scored_sql(texts: str) -> str:
    """CTEs up to ``valence``(id, compound, pos, neg, neu) of table ``texts``(id, text), by table ``lexicon``(word, v)."""
    rules = ", ".join([f"('{w}', {BOOST}, false)" for w in BOOSTERS] + [f"('{w}', {-BOOST}, false)" for w in DAMPENERS] + [f"""('{w.replace("'", "''")}', NULL, true)""" for w in NEGATIONS])

    def step(k: int) -> str:
        """v after the word k + 1 places before."""
        p = k + 1
        boost = f"CASE WHEN b{p} IS NULL THEN 0 ELSE CASE WHEN v < 0 THEN -b{p} ELSE b{p} END + CASE WHEN c{p} AND mixed THEN CASE WHEN v > 0 THEN {CAPITALS} ELSE -{CAPITALS} END ELSE 0 END END"
        moved = f"(v + ({boost}) * {DISTANCE[k]})"
        so = " OR ".join(f"coalesce(l{i} IN ('so', 'this'), false)" for i in range(1, p)) or "false"
        sure = " OR ".join(f"coalesce(l{i} = 'doubt', false)" for i in range(1, p)) or "false"
        return f"CASE WHEN l{p} IS NULL OR v{p} IS NOT NULL THEN v WHEN l{p} = 'never' AND ({so}) THEN {moved} * {NEVER_SO} WHEN l{p} = 'without' AND ({sure}) THEN {moved} WHEN no{p} THEN {moved} * {NEGATED} ELSE {moved} END"

    lags = ", ".join(f"lag({c}, {i}) OVER o AS {n}{i}" for i in (1, 2, 3) for c, n in (("l", "l"), ("v0", "v"), ("b", "b"), ("no", "no"), ("caps", "c")))
    return f"""
vt_r(word, b, no) AS (VALUES {rules}),
vt_p AS (SELECT id, unnest(list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')) AS p, generate_subscripts(list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> ''), 1) AS i FROM {texts}),
vt_s AS (SELECT id, i, CASE WHEN length(regexp_replace(p, '{ENDS}', '', 'g')) > 2 THEN regexp_replace(p, '{ENDS}', '', 'g') ELSE p END AS w FROM vt_p),
vt_l AS (SELECT id, i, translate(w, '{UPPER}', '{LOWER}') AS l, regexp_matches(w, '[A-Z]') AND NOT regexp_matches(w, '[a-z]') AS caps FROM vt_s),
vt_m AS (SELECT id, i, l, caps, x.v AS v0, r.b, coalesce(r.no, false) OR contains(l, 'n''t') AS no FROM vt_l LEFT JOIN lexicon x ON x.word = l LEFT JOIN vt_r r ON r.word = l),
vt_a AS (SELECT id, count(*) AS n, count(*) FILTER (caps) AS caps, min(i) FILTER (l = 'but') AS but FROM vt_m GROUP BY id),
vt_o AS (SELECT vt_m.*, {lags} FROM vt_m WINDOW o AS (PARTITION BY id ORDER BY i)),
vt_h AS (SELECT vt_o.*, vt_a.caps > 0 AND vt_a.caps < n AS mixed, but FROM vt_o JOIN vt_a USING (id) WHERE v0 IS NOT NULL AND b IS NULL),
vt_0 AS (SELECT *, v0 + CASE WHEN caps AND mixed THEN CASE WHEN v0 > 0 THEN {CAPITALS} ELSE -{CAPITALS} END ELSE 0 END AS v FROM vt_h),
vt_1 AS (SELECT * EXCLUDE (v), {step(0)} AS v FROM vt_0), vt_2 AS (SELECT * EXCLUDE (v), {step(1)} AS v FROM vt_1), vt_3 AS (SELECT * EXCLUDE (v), {step(2)} AS v FROM vt_2),
vt_4 AS (SELECT id, i, but, CASE WHEN coalesce(l1 = 'least', false) AND v1 IS NULL AND NOT coalesce(l2 IN ('at', 'very'), false) THEN v * {NEGATED} ELSE v END AS v FROM vt_3),
vt_5 AS (SELECT id, CASE WHEN but IS NULL THEN v WHEN i < but THEN v * {HALF} ELSE v * {MORE} END AS v FROM vt_4),
vt_6 AS (SELECT id, sum(v) AS total, coalesce(sum(v + 1) FILTER (v > 0), 0) AS ups, coalesce(sum(1 - v) FILTER (v < 0), 0) AS downs, count(*) FILTER (v <> 0) AS marked FROM vt_5 GROUP BY id),
vt_7 AS (
  SELECT t.id, coalesce(total, 0)::DOUBLE AS total, coalesce(ups, 0)::DOUBLE AS ups, coalesce(downs, 0)::DOUBLE AS downs, coalesce(n, 0) - coalesce(marked, 0) AS flat,
    least(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')), {MOST_EXCLAIM}) * {EXCLAIM} + CASE WHEN length(text) - length(replace(text, '?', '')) > 3 THEN {MOST_QUESTION} WHEN length(text) - length(replace(text, '?', '')) > 1 THEN (length(text) - length(replace(text, '?', ''))) * {QUESTION} ELSE 0 END AS em
  FROM {texts} t LEFT JOIN vt_6 USING (id) LEFT JOIN vt_a USING (id)),
vt_8 AS (SELECT id, total + sign(total) * em AS s, ups + CASE WHEN ups > downs THEN em ELSE 0 END AS u, downs + CASE WHEN downs > ups THEN em ELSE 0 END AS d, flat FROM vt_7),
valence AS (SELECT id, (s / sqrt(s * s + {ALPHA}))::DOUBLE AS compound, CASE WHEN u + d + flat > 0 THEN u / (u + d + flat) ELSE 0 END AS pos, CASE WHEN u + d + flat > 0 THEN d / (u + d + flat) ELSE 0 END AS neg, CASE WHEN u + d + flat > 0 THEN flat / (u + d + flat) ELSE 0 END AS neu FROM vt_8)"""
