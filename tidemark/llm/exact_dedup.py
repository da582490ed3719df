"""Exact dedup by Golomb-coded fingerprint exchange.

1. Each input partition fingerprints its normalised texts (64 bits) and sends, to the owner
   of each hash range, its sorted distinct fingerprints as Golomb-Rice coded gaps, with one
   bit per fingerprint for "more than once here".
2. Owners decode, mark fingerprints that occur twice or more over all senders, and return a
   bitmap to each sender. A sender gives one entry a fingerprint, so a hot text costs its
   owner one entry a partition, however many copies there are.
3. Senders map the bitmaps back to rows. Only the texts of these suspects are shuffled, and
   grouped by their bytes (copies combine map-side), which decides.

Cases: null text counts as empty; empty texts equal each other; of equal texts the one with
most code points in the original stays, ties to the smaller id, a null id after all others;
of rows that tie in both, one stays. A row repeated with the same id counts again. Rows are told
apart by keys of id and text, never by the id alone: ids may repeat or be null and be of any type
that sorts. Texts of any length are read whole. An empty table gives an empty result; columns
besides id and text are ignored, and pass through ``drop_copies`` whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import SPACES, column, forget, give_back, row_keys, shuffle_partitions, write_and_reread
from tidemark.llm.sketch import sketched, without

_DROP = str.maketrans("", "", SPACES)


# ---- Golomb-Rice coding of sorted distinct unsigned integers below 2**bits ----


def rice_parameter(n: int, bits: int) -> int:
    """log2 of about 0.69 times the mean gap."""
    return max(0, bits - max(1, n).bit_length())


def rice_encode(values: np.ndarray, r: int) -> bytes:
    """Gaps of sorted distinct uint64 values: quotients in unary, then remainders of r bits."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(r)).astype(np.int64)
    unary = np.zeros(int(quotients.sum()) + len(gaps), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 1
    low = np.zeros((len(gaps), r), np.uint8)
    for i in range(r):
        low[:, i] = (gaps >> np.uint64(r - 1 - i)) & np.uint64(1)
    return len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def rice_decode(data: bytes, n: int, r: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    head = 8 + (size + 7) // 8
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(data[8:head], np.uint8), count=size))
    quotients = np.diff(ones, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(data[head:], np.uint8), count=n * r).reshape(n, r)
    rest = np.zeros(n, np.uint64)
    for i in range(r):
        rest = (rest << np.uint64(1)) | low[:, i].astype(np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(r)) | rest, dtype=np.uint64)


# ---- the exchange ----

#: Fingerprints that one owner marks.
OWNED = 1 << 20


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    seen = part << 40
    for batch in batches:
        digests, hashes, points = [], [], []
        for text in column(batch, "text"):
            text = text.as_py() or ""
            digest = hashlib.sha256(text.translate(_DROP).encode("utf-8", "surrogatepass")).digest()
            digests.append(digest.hex())
            hashes.append(int.from_bytes(digest[:8], "little", signed=True))
            points.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [column(batch, "row_id"), column(batch, "k1"), column(batch, "k2"), pa.array(range(seen, seen + len(digests)), pa.int64()), pa.array([part] * len(digests), pa.int32())]
            + [pa.array(hashes, pa.int64()), pa.array(points, pa.int32()), pa.array(digests, pa.string())],
            names=["row_id", "k1", "k2", "at", "sender", "h", "points", "text_sha256"],
        )
        seen += len(digests)
    give_back()


def _owned(h: np.ndarray, owners: int) -> np.ndarray:
    """Owner of each fingerprint: ranges of its high bits."""
    return ((h >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def _start(owner: int, owners: int) -> np.uint64:
    """The least fingerprint that an owner gets."""
    return np.uint64(-(-(owner << 32) // owners) << 32)


def _send(owners: int):
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        distinct, counts = np.unique(rows["h"].to_numpy(np.int64).view(np.uint64), return_counts=True)
        cut = np.searchsorted(_owned(distinct, owners), np.arange(owners + 1))
        out = []
        for owner in np.flatnonzero(np.diff(cut)).tolist():
            part, many = distinct[cut[owner] : cut[owner + 1]], counts[cut[owner] : cut[owner + 1]] > 1
            # ranges cover 2**64 / owners values: code what lies above the range's start
            start = _start(owner, owners)
            r = rice_parameter(len(part), 65 - owners.bit_length())
            out.append((owner, int(rows["sender"].iloc[0]), len(part), r, rice_encode(part - start, r), np.packbits(many).tobytes()))
        return pd.DataFrame(out, columns=["owner", "sender", "n", "r", "gaps", "many"])

    return send


def _mark(owners: int):
    def mark(lists: pd.DataFrame) -> pd.DataFrame:
        start = _start(int(lists["owner"].iloc[0]), owners)
        parts = [rice_decode(g, n, r) + start for g, n, r in zip(lists["gaps"], lists["n"], lists["r"])]
        many = [np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m, n in zip(lists["many"], lists["n"])]
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        twice = values[counts > 1]
        bits = [np.packbits(m | np.isin(p, twice, assume_unique=True)).tobytes() for p, m in zip(parts, many)]
        return pd.DataFrame({"sender": lists["sender"], "owner": lists["owner"], "bits": bits})

    return mark


def _suspects(owners: int):
    def suspects(rows: pd.DataFrame, bitmaps: pd.DataFrame) -> pd.DataFrame:
        h = rows["h"].to_numpy(np.int64).view(np.uint64)
        distinct, at = np.unique(h, return_inverse=True)
        cut = np.searchsorted(_owned(distinct, owners), np.arange(owners + 1))
        flag = np.zeros(len(distinct), bool)
        for owner, bits in zip(bitmaps["owner"], bitmaps["bits"]):
            a, b = cut[owner], cut[owner + 1]
            flag[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a)
        return rows.loc[flag[at], ["row_id", "k1", "k2", "at", "points", "text_sha256"]]

    return suspects


def _exchanged(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """prints (a row each document), suspects (rows whose fingerprint occurs again) and groups (a row each text that repeats)."""
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text")).withColumns(row_keys(F.col("row_id"), F.col("text")))
    row_id = T.StructField("row_id", rows.schema["row_id"].dataType)
    long, digest = T.LongType(), T.StructField("text_sha256", T.StringType())
    known = [row_id, *(T.StructField(c, long) for c in ("k1", "k2", "at"))]
    schema = T.StructType([*known, T.StructField("sender", T.IntegerType()), T.StructField("h", long), T.StructField("points", T.IntegerType()), digest])
    prints = write_and_reread(rows.mapInArrow(_fingerprints, schema), "fingerprints")
    owners = max(1, shuffle_partitions(docs.sparkSession) * 2, prints.count() // OWNED)

    sent = prints.select("sender", "h").groupBy("sender").applyInPandas(_send(owners), "owner int, sender int, n int, r int, gaps binary, many binary")
    bitmaps = sent.groupBy("owner").applyInPandas(_mark(owners), "sender int, owner int, bits binary")
    suspects = prints.groupBy("sender").cogroup(bitmaps.groupBy("sender")).applyInPandas(_suspects(owners), T.StructType([*known, T.StructField("points", T.IntegerType()), digest]))
    suspects = write_and_reread(suspects, "suspects")
    # who stays: rows that tie combine first, so that a text that many rows share is one row a class
    classes = suspects.groupBy("text_sha256", "points", "row_id").agg(F.min(F.struct("at", "k1", "k2")).alias("first"), F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("points")).alias("fewer"), F.col("row_id").isNull().alias("unnamed"), "row_id", "first")).alias("best")
    best = classes.groupBy("text_sha256").agg(best, F.sum("n").alias("size"))

    # byte verification: the suspects' texts, grouped by their bytes; copies combine before the shuffle. A sketch of
    # the suspects' keys keeps the other texts out of it, the join decides
    doubted = suspects.select("k1", "k2", "text_sha256").distinct()
    may = sketched(doubted.select("k1"))
    bare = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    texts = rows.where(may(F.col("k1"))).join(doubted, ["k1", "k2"]).select("text_sha256", bare.alias("bytes"))
    same = texts.groupBy("text_sha256", "bytes").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & (F.sha2("bytes", 256) == F.col("text_sha256")))
    groups = same.select("text_sha256").join(best, "text_sha256").select(F.col("text_sha256").alias("same"), F.col("best.row_id").alias("keep"), F.col("best.first.at").alias("keep_at"), "size")
    return prints, suspects, write_and_reread(groups, "groups")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256 (of the text without white space)."""
    prints, suspects, groups = _exchanged(docs, id_col, text_col)
    forget(suspects)
    return prints.join(groups, prints["text_sha256"] == groups["same"], "left").select(
        F.col("row_id").alias(id_col),
        F.when(F.col("same").isNotNull(), F.col("keep")).otherwise(F.col("row_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("at") == F.col("keep_at"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, one of each text, with all their columns."""
    prints, suspects, groups = _exchanged(docs, "doc_id", "text")
    met = suspects.join(groups, suspects["text_sha256"] == groups["same"])
    marks = met.groupBy("k1", "k2").agg(F.bool_or(F.col("at") == F.col("keep_at")).alias("stay"), F.count(F.lit(1)).alias("n"))
    marks = write_and_reread(marks.where("not stay or n > 1").select("k1", "k2", "stay"), "marks")
    forget(prints, suspects, groups)
    return without(docs, marks)
