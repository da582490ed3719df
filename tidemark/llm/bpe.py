"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 16 bytes is small, so passages
that documents share make the same chunks wherever they stand. Each distinct chunk is encoded
once in a task and kept (up to ``KEEP_BYTES``). A chunk's own encoding is right between its
anchors, the places where pre-tokens part whatever stands around them: behind a letter that no
letter follows, behind a digit that no digit follows, and before a lone space between two visible
ASCII characters. At each join the bytes from the last anchor on the left to the first anchor on
the right are encoded again; where that disagrees with what the two chunks gave, it replaces it,
and where a chunk has no anchor the window goes on through it, so the result is that of the whole
text. What a window holds is gathered and joined once, so a text without any anchor costs no more
than its plain encoding.

Special tokens' strings in a text are special tokens, as the tokenizers library has it by
default. The vocabulary file's path is a parameter; the driver reads it and sends its contents.
Cases: null text counts as empty; an empty text has no tokens; equal rows give equal rows; columns
besides id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.llm.common import byte_view, column, eight_bytes, give_back, slices, small_batches

#: Bytes that a cut looks back on, and the hashes that cut: one in 512.
WINDOW, LIMIT = 16, np.uint64(1 << 55)
KEEP_BYTES = 32 << 20
#: Fixed value: the vocabulary's only special token and its id.
SPECIAL = {b"<|endoftext|>": 50256}
#: Anchors that bytes alone show; a byte of 0x80 or more may belong to a letter.
_ANCHOR = re.compile(rb"(?<=[A-Za-z])(?=[^A-Za-z\x80-\xff])|(?<=[0-9])(?=[^0-9\x80-\xff])|(?<=[\x21-\x7e])(?= [\x21-\x7e])")
#: Anchors of other scripts.
_WIDE = r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"
_FIRST, _LAST = regex.compile(_WIDE), regex.compile("(?r)" + _WIDE)
#: Anchors are sought in so many bytes at either end of a chunk first.
_NEAR = 48


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def anchors(data: bytes) -> tuple[int, int] | None:
    """The first and the last anchor of a chunk; None where there is none."""
    first = _ANCHOR.search(data)
    if first is not None:
        last = None
        if len(data) > _NEAR:
            for last in _ANCHOR.finditer(data, len(data) - _NEAR):
                pass
        if last is None:
            for last in _ANCHOR.finditer(data):
                pass
        return first.start(), last.start()
    if data.isascii():
        return None
    text = data.decode("utf-8", "surrogatepass")
    if (first := _FIRST.search(text)) is None:
        return None
    size = lambda m: len(text[: m.start()].encode("utf-8", "surrogatepass"))
    return size(first), size(_LAST.search(text))


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, ranks_file: bytes):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        self._encode = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        made = {i: t for t, i in ranks.items()} | {i: t for t, i in SPECIAL.items()}
        self.token = [made.get(i, b"") for i in range(max(made) + 1)]
        self.names = [str(i) for i in range(len(self.token))]
        self.known: dict[bytes, tuple] = {}
        self.held = 0
        self.reused = self.encoded = self.disagreed = 0

    def plain(self, data: bytes) -> list[int]:
        return self._encode(data.decode("utf-8"))

    def chunk(self, data: bytes) -> tuple:
        """(ids, first anchor, ids before it, last anchor, ids before it); anchors None where there is none."""
        if (got := self.known.get(data)) is not None:
            self.reused += 1
            return got
        ids = self.plain(data)
        self.encoded += 1
        found = anchors(data)
        if found:
            got = (ids, found[0], self._before(ids, found[0]), found[1], len(ids) - self._before(ids[::-1], len(data) - found[1]))
        else:
            got = (ids, None, 0, None, 0)
        if self.held > KEEP_BYTES:
            self.known.clear()
            self.held = 0
        self.known[data] = got
        self.held += len(data) + 36 * len(ids) + 300
        return got

    def _before(self, ids: list[int], size: int) -> int:
        """How many of the first tokens make up ``size`` bytes."""
        n = 0
        while size > 0:
            size -= len(self.token[ids[n]])
            n += 1
        return n

    def join(self, pieces: list[bytes]) -> list[int]:
        """Ids of the concatenated chunks."""
        out: list[int] = []
        tail: list[bytes] = []  # what follows the last anchor, by chunk
        tail_ids: list[int] = []
        for data in pieces:
            ids, first, n_first, last, n_last = self.chunk(data)
            if first is None:
                tail.append(data)
                tail_ids += ids
                continue
            if tail:
                tail.append(data[:first])
                tail_ids += ids[:n_first]
                again = self.plain(b"".join(tail))
                self.disagreed += again != tail_ids
                out += again
            else:
                out += ids[:n_first]
            out += ids[n_first:n_last]
            tail, tail_ids = [data[last:]], ids[n_last:]
        return out + (tail_ids if len(tail) < 2 else self.plain(b"".join(tail)))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token.__getitem__, ids)).decode("utf-8", "replace").encode("utf-8")


_LOW, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def cuts(raw: np.ndarray) -> np.ndarray:
    """Places where chunks begin, from the WINDOW bytes before them alone."""
    if len(raw) < WINDOW:
        return np.zeros(0, np.int64)
    eight = eight_bytes(raw)
    rolled = (eight[:-8] * _LOW ^ eight[8:]) * _HIGH
    rolled ^= rolled >> np.uint64(29)
    rolled *= _LOW
    at = np.flatnonzero(rolled < LIMIT) + WINDOW
    at = at[at < len(raw)]
    while (inside := (raw[at] & 0xC0) == 0x80).any():  # not within a character
        at[inside] += 1
        at = at[at < len(raw)]
    return np.unique(at)


_SPLIT = re.compile(b"(" + b"|".join(map(re.escape, SPECIAL)) + b")")


def encode_texts(text: pa.Array, codec: Codec) -> Iterator[tuple[list[int], bytes]]:
    """(ids, UTF-8) of each text."""
    for _, part in slices(text):
        raw, ends = byte_view(part)
        at = cuts(raw)
        edges = np.searchsorted(at, ends)
        data = raw.tobytes()
        for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            whole = data[a:b]
            if any(s in whole for s in SPECIAL):
                ids = []
                for piece in _SPLIT.split(whole):
                    ids += [SPECIAL[piece]] if piece in SPECIAL else codec.join([piece]) if piece else []
            else:
                # a window that reaches into the text before could cut early; only full windows inside count
                marks = [a, *(x for x in at[edges[i] : edges[i + 1]].tolist() if x - a >= WINDOW), b]
                ids = codec.join([data[x:y] for x, y in zip(marks, marks[1:]) if y > x])
            yield ids, whole


@lru_cache(maxsize=1)
def _codec_of(ranks_file: bytes) -> Codec:
    return Codec(ranks_file)


def _shared(spark: SparkSession, path: str | None) -> Broadcast:
    """The vocabulary file, a fixed file of about half a megabyte, as the driver reads it."""
    small_batches(spark)
    with open(path or vocabulary_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array of int) of every whole text."""
    shared = _shared(docs.sparkSession, path)
    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x for x, _ in encode_texts(column(batch, text_col), _codec_of(shared.value))]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(ids, pa.list_(pa.int32()))], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """id and text of every row of ids (null ids: empty)."""
    shared = _shared(encoded.sparkSession, path)
    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_codec_of(shared.value).decode(x or []).decode("utf-8") for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, id_col), pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(id_col, "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_tokens, ids_sha256 and decoded_sha256: ids are encoded, digested and decoded in one pass."""
    shared, keep = _shared(docs.sparkSession, path), ("doc_id", *keep)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec_of(shared.value)
        for batch in batches:
            n, a, b = [], [], []
            for ids, _ in encode_texts(column(batch, "text"), codec):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(codec.names.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in keep), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names)
        give_back()

    return docs.select(*keep, "text").mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and n_tokens."""
    return encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
