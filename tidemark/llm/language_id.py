"""Language identification by word-first backoff.

Words are runs of letters (``[\\p{L}\\p{M}]+``) after lower-casing. A word seen in training scores by its
log frequency in each language. An unseen word, padded by a space on each side, backs off at each
of its positions to the longest known character n-gram that starts there: 5 letters, then 4, 3, 2
and 1. A document's score is the mean of its words'; the probability is a softmax over languages
of that mean, sharpened by the square root of the number of words.

Learning reads a bounded sample of labelled rows (about ``sample_rows`` and 64 MB of text a language,
taken by hash of id and text over all rows); of their words and n-grams all are kept that a language
has ``least`` times (1 keeps every one). Every document is predicted from its whole text. The model is a sorted array of 64-bit hashes with a row
of float32 logs for each, so a task looks all distinct words of a slice up at once.

Cases: ids may repeat or be null; columns besides doc_id, text and lang are ignored, and pass
through ``keep_identified`` whatever their names; null text, empty text and text without a letter give ``und`` with score 0; ties go to
the language first in order; no labelled rows at all give ``und`` for every document; a text
longer than a slice is read in parts that end at spaces.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import SLICE_BYTES, byte_view, column, give_back, held_out, mix64, slices, small_batches
from tidemark.llm.shingles import hash_spans

_BREAK = r"[^\p{L}\p{M}]+"
UNKNOWN = "und"
LONGEST = 5
SMOOTH = 0.5
FLOOR = math.log(1e-6)
_GRAM, _NEXT = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Logs:
    """Log frequencies by language: hashes in order and a row for each."""

    keys: np.ndarray
    rows: np.ndarray

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each hash, whether it is there)."""
        if not len(self.keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    words: Logs
    grams: Logs


def word_hashes(words: pa.Array) -> np.ndarray:
    raw, ends = byte_view(words.cast(pa.large_string()))
    return hash_spans(raw, ends[:-1], ends[1:])


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, each between two spaces; where each word ends)."""
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return points, np.cumsum([len(w) + 2 for w in words])


def _gram_hashes(points: np.ndarray) -> Iterator[np.ndarray]:
    """For k = 1 to LONGEST the hash of the k letters that start at each place."""
    h = np.full(len(points), _GRAM)
    for k in range(LONGEST):
        h = mix64(h[: len(points) - k] * _NEXT ^ points[k:]) if len(points) > k else h[:0]
        yield h


#: Words whose n-grams are hashed at once while learning.
AT_ONCE = 20_000


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, group = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(group, weights=n, minlength=len(distinct))


def gram_counts(words: list[str], times: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length the hashes and counts of the n-grams of words that occur ``least`` times."""
    found: list[list[tuple]] = [[(np.zeros(0, np.uint64), np.zeros(0))] for _ in range(LONGEST)]
    for begin in range(0, len(words), AT_ONCE):
        points, ends = _letters(words[begin : begin + AT_ONCE])
        whose = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        for k, h in enumerate(_gram_hashes(points), 1):
            inside = np.arange(len(h)) + k <= ends[whose[: len(h)]]
            found[k - 1].append(_summed(h[inside], times[begin + whose[: len(h)][inside]]))
    out = []
    for parts in found:
        keys, n = _summed(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
        out.append((keys[n >= least], n[n >= least]))
    return out


def _logs(counts: list[tuple[np.ndarray, np.ndarray]]) -> Logs:
    """From (hashes, counts) of each language, smoothed over the hashes of all."""
    keys = np.unique(np.concatenate([k for k, _ in counts])) if counts else np.zeros(0, np.uint64)
    rows = np.zeros((len(keys), len(counts)))
    for i, (k, n) in enumerate(counts):
        rows[np.searchsorted(keys, k), i] = n
    rows = np.log((rows + SMOOTH) / (rows.sum(axis=0) + SMOOTH * max(1, len(keys))))
    return Logs(keys, rows.astype(np.float32))


def fit(counts: dict[str, tuple[list[str], np.ndarray]], least: int = 2) -> Model:
    """The model of the words and their counts of each language."""
    langs = tuple(sorted(counts))
    words, grams = [], []
    for lang in langs:
        known, times = counts[lang]
        grams.append(gram_counts(known, times, least))
        top = np.flatnonzero(times >= least)
        words.append((word_hashes(pa.array([known[i] for i in top], pa.string())), times[top]))
    by_length = [_logs([g[k] for g in grams]) for k in range(LONGEST)] if langs else []
    keys = np.concatenate([x.keys for x in by_length]) if langs else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    rows = np.concatenate([x.rows for x in by_length])[order] if langs else np.zeros((0, 0), np.float32)
    return Model(langs, _logs(words) if langs else Logs(keys, rows), Logs(keys[order], rows))


def bounded_sample(rows: DataFrame, by: str, most: int, most_bytes: int = 64 << 20) -> DataFrame:
    """Of rows(by, doc_id and maybe text) about ``most`` of each value of ``by`` and ``most_bytes`` of their texts, chosen by a hash of the others.

    One pass measures the values; the rate for each then selects rows where they lie, without a shuffle. Equal rows, which
    the hash can't tell apart, count once.
    """
    keys = [c for c in ("doc_id", "text") if c in rows.columns]
    size = F.sum(F.octet_length("text")) if "text" in keys else F.lit(0)
    sizes = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), size.alias("b")).collect()  # a row a value
    rate = F.lit(0.0)
    for value, n, b in sorted(sizes):
        rate = F.when(F.col(by) == value, F.lit(min(1.0, most / n, most_bytes / max(1, b or 0)))).otherwise(rate)
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < rate * (1 << 30)).dropDuplicates([by, *keys])


def _split(text: pa.Array) -> pa.Array:
    return pc.split_pattern_regex(pc.utf8_lower(text), _BREAK)


def learn(docs: DataFrame, sample_rows: int = 2000, least: int = 2) -> Model:
    """Fit on rows with a language: whole texts of about ``sample_rows`` rows of each.

    The counts come back as one row a language and word; what reaches the driver is bounded by the sample.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "doc_id", "text")
    rows = bounded_sample(rows, "lang", sample_rows).select("lang", "text")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            langs = column(batch, "lang").to_pylist()
            for at, part in slices(column(batch, "text")):
                for i, found in enumerate(_split(part).to_pylist()):
                    words.setdefault(langs[at + i], Counter()).update(found)
        found = [(lang, w, n) for lang, c in words.items() for w, n in c.items() if w]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

    seen = rows.mapInArrow(counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    found = {}
    for lang in pc.unique(seen["lang"]).to_pylist():
        part = seen.filter(pc.equal(seen["lang"], lang))
        found[lang] = part["word"].to_pylist(), part["n"].to_numpy().astype(float)
    return fit(found, least)


def _backoff(model: Model, words: list[str]) -> np.ndarray:
    """Scores of words that the model doesn't know: a row each."""
    points, ends = _letters(words)
    whose = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    hashes = list(_gram_hashes(points))
    total = np.full((len(words), len(model.langs)), 0.0)
    left = np.arange(len(points))
    for k in range(LONGEST, 0, -1):
        fits = left[left + k <= ends[whose[left]]]
        at, known = model.grams.find(hashes[k - 1][fits])
        for i in range(len(model.langs)):
            total[:, i] += np.bincount(whose[fits[known]], weights=model.grams.rows[at[known], i], minlength=len(words))
        done = np.zeros(len(points), bool)
        done[fits[known]] = True
        left = left[~done[left]]
    total += (np.bincount(whose[left], minlength=len(words)) * FLOOR)[:, None]
    return total / np.diff(ends, prepend=0)[:, None] * 2


def word_scores(model: Model, words: pa.Array) -> np.ndarray:
    """A row a word; only differences between languages matter, so the best is 0."""
    at, known = model.words.find(word_hashes(words))
    rows = np.zeros((len(words), len(model.langs)))
    rows[known] = model.words.rows[at[known]]
    if not known.all():
        rows[~known] = _backoff(model, words.filter(pa.array(~known)).to_pylist())
    return rows - rows.max(axis=1, keepdims=True)


def _parts(text: str) -> Iterator[str]:
    """Parts of about SLICE_BYTES letters of a long text, cut at spaces."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = text.find(" ", at + SLICE_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _sums(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sums of word scores and number of words of each text; a long text is read in parts."""
    if len(text) == 1 and text[0].as_buffer() is not None and text[0].as_buffer().size > 2 * SLICE_BYTES:
        parts = [_slice_sums(model, pa.array([p], pa.large_string())) for p in _parts(text[0].as_py())]
        return sum(s for s, _ in parts), sum(n for _, n in parts)
    return _slice_sums(model, text)


def _slice_sums(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(sums of word scores, number of words) of each text; a text without a letter has no words."""
    lists = _split(text)
    words = lists.flatten()
    whose = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.binary_length(words).to_numpy() > 0
    words, whose = words.filter(pa.array(real)), whose[real]
    coded = words.dictionary_encode()
    scores, index = word_scores(model, coded.dictionary), coded.indices.to_numpy()
    n = np.bincount(whose, minlength=len(text))
    sums = np.stack([np.bincount(whose, weights=scores[index, i], minlength=len(text)) for i in range(len(model.langs))], axis=1) if len(words) else np.zeros((len(text), len(model.langs)))
    n = np.where(pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False), n, 0)
    return sums, n


def predict(model: Model, text: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(language, score) of each text."""
    langs, scores = [], []
    for _, part in slices(text):
        if not model.langs:
            langs += [UNKNOWN] * len(part)
            scores.append(np.zeros(len(part)))
            continue
        sums, n = _sums(model, part)
        mean = sums / np.maximum(n, 1)[:, None]
        odds = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.sqrt(n)[:, None])
        best = odds.argmax(axis=1)
        langs += [model.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist())]
        scores.append(np.where(n > 0, odds.max(axis=1) / odds.sum(axis=1), 0.0))
    return pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every whole text."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the limits of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *predict(shared.value, column(batch, "text"))], names=schema.names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, predict all rows."""
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """Drop the documents whose language can't be told and give those without a ``lang`` the one predicted.

    All columns stay. The prediction is made beside the row in the same task, so nothing is joined.
    A text without a letter has no language whatever there is to learn from; where no row has a
    label, the others stay as they are.
    """
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang = column(batch, "text"), column(batch, "lang")
            if shared.value.langs:
                found, _ = predict(shared.value, text)
                told = pc.not_equal(found, UNKNOWN)
                lang = pc.coalesce(lang, found)
            else:
                told = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)
            at = batch.schema.get_field_index("lang")
            yield batch.set_column(at, batch.schema.field(at), lang.cast(batch.schema.field(at).type)).filter(told)
        give_back()

    return docs.mapInArrow(keep, docs.schema)
