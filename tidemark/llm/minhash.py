"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, stars, and exact confirmation.

1. A document is the set of its distinct word shingles; texts with equal sets form one node. One hash per shingle both
   picks its bin and orders it there, so a signature costs one pass. An empty bin takes the value of the first filled
   bin in a fixed random sequence of its own (optimal densification): two sets agree in a bin with the probability of
   their Jaccard similarity, whether bins are filled or not.
2. ``BANDS`` bands of ``ROWS`` bins hash to buckets. A pair at the threshold of 0.85 shares none of its 32 bands of 5
   with probability below 1e-8.
3. Buckets of the same nodes count once. A bucket forms a star around its node of least hash, which is the same in most
   buckets of a group: candidate pairs grow with the documents, not with the square of a bucket. Stars are confirmed on
   full sets; nodes that two steps towards the least centre bring together need no more comparisons.
4. The exact rest: buckets that still hold several components may hide links between nodes other than the centre. All
   nodes of such buckets around one centre fall into rings by their confirmed distance from it, as wide as the radius;
   a link joins nodes of one ring or of neighbours, whatever their sizes. Rings of several components are joined exactly by
   the metric join of ``jaccard_join``. So no bucket is capped, whatever its size.

Cases: null, empty and blank texts have no shingle and no link; fewer than k words make one shingle of all; equal sets
always link; rows are told apart by keys of id and text, so ids may repeat or be null (a null id counts as the largest,
a group of null ids alone has a null component_id, and ``kept`` is true for it); texts of any length are read whole; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import column, forget, give_back, mix64, slices, write_and_reread
from tidemark.llm.jaccard_join import KNOWN, _digest, _joined, _verified, keyed_rows, known_schema, labelled, sets_of, told_apart, with_components
from tidemark.llm.shingles import shingle_sets

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
_STARTS = np.array([-(-(b << 64) // BINS) for b in range(BINS)], np.uint64)
_SALT, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _first_tries() -> np.ndarray:
    """At [b, d], the attempt at which bin b's sequence of donors first comes to bin d."""
    tries = np.full((BINS, BINS), -1, np.int32)
    b = np.arange(BINS, dtype=np.uint64) + np.uint64(1)
    attempt = 0
    while (tries < 0).any():
        donor = (mix64(mix64(b * _SALT) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        at = tries[np.arange(BINS), donor]
        tries[np.arange(BINS), donor] = np.where(at < 0, attempt, at)
        attempt += 1
    return tries


_TRIES = _first_tries()


def signature(s: np.ndarray) -> np.ndarray:
    """The least hash of each bin, from the sorted distinct hashes of a set that isn't empty."""
    at = np.searchsorted(s, _STARTS)
    filled = at < np.append(at[1:], len(s))
    out = s[np.minimum(at, len(s) - 1)]
    full, void = np.flatnonzero(filled), np.flatnonzero(~filled)
    if len(void):
        out[void] = out[full[_TRIES[np.ix_(void, full)].argmin(axis=1)]]
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature (a row)."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(mix64((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _SALT), parts.shape[:2]).copy()
    for i in range(ROWS):
        keys = mix64(keys * _STEP ^ parts[:, :, i])
    return keys.view(np.int64)


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, keys = [], [], []
            for _, part in slices(column(batch, "text")):
                sets = shingle_sets(part, k)
                n += map(len, sets)
                node += map(_digest, sets)
                found = iter(bands(np.array([signature(s) for s in sets if len(s)], np.uint64).reshape(-1, BINS)))
                keys += [next(found) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [*(column(batch, c) for c in KNOWN), pa.array(n, pa.int64()), *(pa.array([x[i] for x in node], pa.int64()) for i in (0, 1)), pa.array(keys, pa.list_(pa.int64()))],
                names=[*KNOWN, "n_shingles", "node", "other", "bands"],
            )
        give_back()

    return run


def _held(buckets: DataFrame) -> DataFrame:
    """bucket, centre (its node of least hash) and node of buckets of several nodes; buckets of the same nodes count once."""
    same = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    centre = F.min(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("centre"))).alias("least")
    many = buckets.groupBy("bucket").agg(*same, centre).where("c > 1")
    once = many.groupBy("c", "x", "y").agg(F.min(F.struct("bucket", "least.centre")).alias("one")).select("one.*")
    return buckets.join(write_and_reread(once, "centres"), "bucket").where("node != centre")


def _open(members: DataFrame) -> DataFrame:
    """Rows of members(bucket, label, ...) in buckets of several components."""
    ends = members.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most")
    return members.join(write_and_reread(ends.select("bucket"), "open"), "bucket")


def _near_label(linked: DataFrame) -> DataFrame:
    """node and label of every node that linked(u: centre, v) has as v: its least centre by hash, or that one's own."""
    least = linked.groupBy("v").agg(F.min(F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("up"))).alias("x")).select(F.col("v").alias("node"), "x.up")
    least = write_and_reread(least, "least")
    above = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
    return least.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("label"))


def _links(buckets: DataFrame, sets, percent: int) -> DataFrame:
    """Links (u, v) that join all linked nodes of each bucket(bucket, node), directly or through others; ``sets`` makes the nodes' sets."""
    held = write_and_reread(_held(buckets), "held")
    pairs = write_and_reread(held.select(F.col("centre").alias("u"), F.col("node").alias("v")).distinct(), "pairs")
    sets = sets(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct())
    stars = write_and_reread(_verified(pairs, sets, percent), "stars")
    linked = stars.where("linked").select("u", "v")
    # two steps towards the least centre tell most components; what they leave apart costs comparisons, no link
    label = write_and_reread(_near_label(linked), "labels")
    members = held.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = _open(members).select(F.col("centre").alias("u"), F.col("node").alias("v"), "label").distinct()
    # rings as wide as the radius around a centre: a link joins nodes of one ring or of two neighbours
    ring = F.floor(F.col("d") * 100 / (100 - percent) + 1e-9).cast("int") if percent < 100 else F.lit(0)
    rings = left.join(stars, ["u", "v"]).select("u", F.explode(F.array(ring, ring + 1)).alias("ring"), F.col("v").alias("node"), "label")
    rings = write_and_reread(rings.select(F.xxhash64("u", "ring").alias("region"), "node", "label"), "rings")
    found = write_and_reread(linked.union(_joined(rings, sets, percent)), "links")
    forget(held, pairs, sets, stars, label, rings)
    return found


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs by their keys, with n_shingles and the label of their group."""
    rows = keyed_rows(docs, id_col, text_col)
    nodes = write_and_reread(rows.mapInArrow(_signed(k), known_schema(rows, T.StructField("bands", T.ArrayType(T.LongType())))), "signed")
    chosen = nodes.where("n_shingles > 0").groupBy("node", "other").agg(F.min(F.struct("k1", "k2")).alias("key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes, chosen = told_apart(nodes.drop("bands"), write_and_reread(chosen, "chosen"))
    buckets = chosen.select(F.explode("bands").alias("bucket"), "node")
    links = _links(buckets, lambda alive: sets_of(rows, chosen.drop("bands", "n").join(alive, "node"), k), percent)
    made = labelled(nodes, links)
    forget(links)
    return made


def near_copies(docs: DataFrame, k: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id (least id that links reach) and kept (the id is that one)."""
    return with_components(_grouped(docs, k, percent, id_col, text_col), id_col).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
