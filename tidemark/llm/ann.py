"""Approximate nearest neighbours by adaptive dimension scan within inverted lists.

Centroids are fitted on a bounded sample; every vector goes to the list of its nearest
centroid. A query probes its nearest lists first, the ``FIRST`` share of them and as many as hold
four times the vectors asked for; the tenth best distance found there is carried on. Of the
other lists it then probes those where, by the distance of the centroid and the spread of the
list around it, most vectors within the carried distance are to be expected, until the lists that
are left hold less than the ``MISSED`` share of the vectors asked for. Clustered vectors need few
lists, vectors without any structure most of them. Within a list vectors are rotated by a random orthogonal matrix, so that any first k dimensions hold about k/d of a
distance, and scanned in blocks of columns: after each block a candidate whose partial
distance, scaled up, exceeds the tenth best so far by more than the test allows is given up.
The tenth best is that carried on, or in the nearest lists that of a block's first rows.
Survivors are measured exactly, in double precision on the original vectors; every test allows
for the rounding of rotated vectors and for the partial distances of the ten best so far, so
that copies of the query and of those ten always survive and ties go by id.

Long lists (a hot vector) are cut into blocks of about ``LIST_ROWS`` rows and queries visit
each block, so no task holds a whole list.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, as queries
or candidates; vectors are compared within their length, each length with lists of its own; equal
distances rank by id; fewer candidates than asked for give all of them (all lists are nearest lists
then); repeated ids count as rows of their own but a query never meets its own id; an empty table
gives an empty result; columns besides id and vector are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidemark.llm.common import column, write_and_reread

SAMPLE_ROWS = 16_384
LIST_ROWS = 1024
FIRST, MISSED = 0.1, 0.08
COLUMNS = 16
#: Rounding of a squared distance between rotated vectors, as a share of the square of their norms' sum; far above what doubles lose.
ROUNDING = 1e-9
#: Width of the hypothesis test, in standard deviations of a partial distance's estimate.
SPREAD = 2.1


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors that take part."""
    v = F.col("embedding")
    inf = F.lit(float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull())
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf)) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(fine, F.lit(False)))


def centroids(rows: DataFrame, seed: int = 5, rounds: int = 8) -> np.ndarray | None:
    """k-means on a sample of about SAMPLE_ROWS rows, chosen by hash of the id."""
    n = rows.count()
    if not n:
        return None
    rate = min(1.0, SAMPLE_ROWS / n)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < rate * (1 << 30)).orderBy("vec_id").toArrow()
    x = np.unique(np.array(sample.column("embedding").to_pylist()), axis=0) if len(sample) else np.zeros((0, 1))
    if not len(x):
        return None
    k = int(np.clip(np.sqrt(n) / 2, 1, min(1024, max(1, len(x) // 8))))
    draw = np.random.default_rng(seed)
    c = x[draw.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        sums, counts = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each row, nearest first."""
    d = (c * c).sum(axis=1)[None, :] - 2 * x @ c.T
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def _chance(away: np.ndarray, spread: np.ndarray, limit: float, d: int) -> np.ndarray:
    """Chance that a vector of a list lies within a squared distance: its direction from the centroid is taken to be random."""
    std = 2 * np.sqrt(np.maximum(away * spread, 1e-300) / d)
    z = (away + spread - limit) / std
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def largest_norm(x: np.ndarray) -> float:
    return float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))


def scan(base: np.ndarray, turned: np.ndarray, ids: np.ndarray, query: np.ndarray, turned_query: np.ndarray, own: int, k: int, norm: float | None = None, carried: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the k nearest rows of a block; norm: the largest of its rows', carried: a distance that k rows elsewhere don't exceed."""
    d = turned.shape[1]
    live = np.flatnonzero(ids != own)
    if carried is not None and len(live):
        slack = ROUNDING * (np.sqrt(query @ query) + (largest_norm(base) if norm is None else norm)) ** 2
        part, limit = np.zeros(len(live)), carried * carried
        for to in range(COLUMNS, d + COLUMNS, COLUMNS):
            cols, done = slice(to - COLUMNS, min(to, d)), min(to, d)
            part = part + ((turned[live, cols] - turned_query[cols]) ** 2).sum(axis=1)
            most = limit * (1 + 1e-9) if done == d else limit * done / d * (1 + SPREAD / np.sqrt(done)) ** 2
            keep = part <= most + slack
            live, part = live[keep], part[keep]
    elif len(live) > 4 * k:
        # the first rows set the threshold; the others must pass the tests
        head = live[: 4 * k]
        full = ((turned[head] - turned_query) ** 2).sum(axis=1)
        best = np.argpartition(full, k - 1)[:k]
        limit, best, reached = full[best].max(), head[best], np.zeros(k)
        slack = ROUNDING * (np.sqrt(query @ query) + (largest_norm(base) if norm is None else norm)) ** 2
        live, part = live[4 * k :], np.zeros(len(live) - 4 * k)
        for to in range(COLUMNS, d + COLUMNS, COLUMNS):
            cols = slice(to - COLUMNS, min(to, d))
            part = part + ((turned[live, cols] - turned_query[cols]) ** 2).sum(axis=1)
            reached = reached + ((turned[best, cols] - turned_query[cols]) ** 2).sum(axis=1)
            done = min(to, d)
            # at the last block the test is exact, but for rounding
            most = limit * (1 + 1e-9) if done == d else max(limit * done / d * (1 + SPREAD / np.sqrt(done)) ** 2, reached.max())
            keep = part <= most + slack
            live, part = live[keep], part[keep]
        live = np.concatenate([head, live])
    score = np.sqrt(((base[live] - query) ** 2).sum(axis=1))
    order = np.lexsort((ids[live], score))[:k]
    return ids[live][order], score[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of each query's k nearest found, among vectors of its length."""
    rows, asked = valid(vectors, id_col, vec_col), valid(queries, id_col, vec_col)
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in asked.select(F.size("embedding").alias("d")).distinct().orderBy("d").collect():  # lengths of queries: one, as a rule
        of_length = F.size("embedding") == r["d"]
        found = found.union(_search(rows.where(of_length), asked.where(of_length), k))
    return found


def _search(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``search`` among valid vectors of one length."""
    spark = rows.sparkSession
    out_schema = "query_id long, vec_id long, score double"
    c = centroids(rows)
    if c is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, lists = c.shape[1], len(c)
    shared = spark.sparkContext.broadcast(c)  # at most 1024 centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array(column(batch, "embedding").flatten()).reshape(-1, d)
                near = _nearest(x, shared.value, 1)[:, 0]
                away = ((x - shared.value[near]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "embedding"), pa.array(near.astype(np.int32)), pa.array(away)], names=["vec_id", "embedding", "list", "away"])

    indexed = rows.mapInArrow(assign, "vec_id long, embedding array<double>, list int, away double")
    held, spread = np.zeros(lists, np.int64), np.zeros(lists)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.avg("away").alias("away")).collect():  # a row a list
        held[r["list"]], spread[r["list"]] = r["n"], r["away"]
    blocks = F.array(*[F.lit(max(1, -(-int(n) // LIST_ROWS))) for n in held])
    indexed = indexed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.get(blocks, F.col("list"))).cast("int"))

    def first_lists(x: np.ndarray) -> list[np.ndarray]:
        order = _nearest(x, shared.value, lists)
        enough = (np.cumsum(held[order], axis=1) <= 4 * k).sum(axis=1) + 1
        return [o[:n] for o, n in zip(order, np.minimum(lists, np.maximum(int(np.ceil(lists * FIRST)), enough)))]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The lists that each query probes: first ones where no distance is carried, else the others that are worth it."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(column(batch, "embedding").flatten()).reshape(-1, d)
            probed = first_lists(x)
            for i, limit in enumerate(column(batch, "carried").to_pylist()):
                if limit is not None:
                    others = np.setdiff1d(np.arange(lists), probed[i])
                    expected = held[others] * _chance(((shared.value[others] - x[i]) ** 2).sum(axis=1), spread[others], limit * limit, d)
                    order = np.argsort(-expected, kind="stable")
                    left = expected[order].sum() - np.cumsum(expected[order])
                    probed[i] = others[order][: int((left > MISSED * k).sum()) + 1]
            yield pa.RecordBatch.from_arrays([column(batch, "vec_id"), column(batch, "embedding"), column(batch, "carried"), pa.array([p.astype(np.int32) for p in probed], pa.list_(pa.int32()))], names=["vec_id", "embedding", "carried", "lists"])

    def probe(asked: DataFrame) -> DataFrame:
        planned = asked.mapInArrow(plan, "vec_id long, embedding array<double>, carried double, lists array<int>").withColumn("list", F.explode("lists"))
        planned = planned.withColumn("block", F.explode(F.sequence(F.lit(0), F.get(blocks, F.col("list")) - 1)))
        return indexed.drop("away").groupBy("list", "block").cogroup(planned.drop("lists").groupBy("list", "block")).applyInPandas(near, out_schema)

    def near(base: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        if not len(base) or not len(query):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        turn = rotation(d)
        x, ids = np.stack(base["embedding"].to_numpy()), base["vec_id"].to_numpy()
        q = np.stack(query["embedding"].to_numpy())
        tx, tq, norm = x @ turn, q @ turn, largest_norm(x)
        limits = [None if np.isnan(v) else v for v in query["carried"].to_numpy(float)]
        found = [(own, *scan(x, tx, ids, q[i], tq[i], own, k, norm, limits[i])) for i, own in enumerate(query["vec_id"].to_numpy())]
        return pd.DataFrame({"query_id": np.concatenate([np.full(len(v), o) for o, v, _ in found]), "vec_id": np.concatenate([v for _, v, _ in found]), "score": np.concatenate([s for _, _, s in found])})

    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    close = probe(asked.withColumn("carried", F.lit(None).cast("double")))
    close = write_and_reread(close.withColumn("rank", rank).where(F.col("rank") <= k), "close")
    limits = close.where(F.col("rank") == k).select("query_id", F.col("score").alias("carried"))
    best = close.drop("rank").union(probe(asked.join(limits, asked["vec_id"] == limits["query_id"]).select("vec_id", "embedding", "carried")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
