"""Source divergence audit: how far the term shares of each source lie from those of its peers, by systolic rotation.

1. Tasks count terms by (lang, source) and send one row a term, so that a hot source costs a task one row a term.
2. A lang's kept terms are dealt by hash to shards of about ``SHARD`` terms; a term's place in its shard follows
   UTF-8 order. A group's counts in a shard are one compressed vector, bounded by the shard whatever the group's size.
3. The groups of a lang sit in blocks of about ``SEATED`` groups. A seat (lang, shard, block) keeps its block for the
   whole tournament; in round r the vectors of the block r places further visit it, so that after half a turn of the
   ring every two blocks have met once. A meeting values both directions of every pair. In round 0 a seat's groups meet
   each other and the lang's own vector, and a heap of ten per group ranks its terms.
4. Partial values of the shards are added by pair; the heaps of the shards are merged.

All arithmetic is in integers, exact for fewer than 9 * 10**15 terms a lang.

Cases: null lang, source and text count as ''; a group whose texts have no kept term has the share of a count of 0 for
every term; a lang without kept terms gives pairs of value 0; a lang of one source gives no pair; repeated rows (and
ids) count again; ties go by the item's bytes; a text of any length, also one endless word, is read whole; an empty
table gives an empty result; columns besides lang, source and text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.llm.common import column, forget, give_back, shuffle_partitions, slices, unzip_planes, write_and_reread, zip_planes

#: Documents of its lang that a kept term is in, at least; the scale of shares; terms ranked a group.
LEAST_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a shard, groups of a seat, and terms that a task gathers before it sends their counts.
SHARD, SEATED, GATHERED = 1 << 13, 8, 1 << 18

#: Bytes of terms: letters, lower-cased, and all that are not ASCII; any other byte parts terms.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, docs); an empty term tells of each group that occurs."""
    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in found.items():
            all_terms = [b"", *n]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(all_terms), pa.string()) for x in (lang, source)]
                + [pa.array(all_terms, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())],
                names=["lang", "source", "term", "n", "docs"],
            )
        found.clear()

    held = 0
    for batch in batches:
        lang, source = column(batch, "lang").to_pylist(), column(batch, "source").to_pylist()
        for at, part in slices(column(batch, "text")):
            for i, text in enumerate(part.cast(pa.large_binary()).to_pylist(), at):
                n, docs = found.setdefault((lang[i], source[i]), (Counter(), Counter()))
                before, words = len(n), terms(text)
                n.update(words)
                docs.update(set(words))
                held += len(n) - before
                if held >= GATHERED:
                    yield from flush()
                    held = 0
    yield from flush()
    give_back()


def _segment(rows: pa.Table) -> pa.Table:
    """One compressed vector from the rows (lang, shard, source, place, n) of a group in a shard."""
    place = rows["place"].to_numpy().astype(np.int64)
    order = np.argsort(place)
    place, n = place[order], rows["n"].to_numpy().astype(np.int64)[order]
    first = rows.slice(0, 1)
    return pa.table(
        {
            **{c: first[c] for c in ("lang", "shard", "source")},
            "entries": pa.array([len(place)], pa.int32()),
            "total": pa.array([int(n.sum())], pa.int64()),
            "gaps": pa.array([zip_planes(np.diff(place, prepend=0).astype(np.uint32))], pa.binary()),
            "counts": pa.array([zip_planes(n.astype(np.uint64))], pa.binary()),
        }
    )


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 2) / whole), by long division in thousands, which int64 holds."""
    out, rest = np.divmod(n + 2, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def values(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _unpacked(rows: pa.Table) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(source, counts, shares) over all terms of the shard, for each vector."""
    out = []
    for row in rows.to_pylist():
        n = np.zeros(row["size"], np.int64)
        if row["entries"]:
            n[np.cumsum(unzip_planes(row["gaps"], row["entries"], np.uint32), dtype=np.int64)] = unzip_planes(row["counts"], row["entries"], np.uint64).astype(np.int64)
        out.append((row["source"], n, shares(n, row["held"] + 2 * row["terms"]) if row["size"] else n))
    return out


def _best(value: np.ndarray, among: np.ndarray) -> list[tuple[int, int]]:
    """The TOP places among some by value, ties to the smaller place: (value, place)."""
    some = value[among]
    if len(some) > TOP:
        bar = np.partition(some, len(some) - TOP)[len(some) - TOP]
        over = np.flatnonzero(some > bar)
        among = among[np.concatenate([over, np.flatnonzero(some == bar)[: TOP - len(over)]])]
    return heapq.nsmallest(TOP, zip(value[among].tolist(), among.tolist()), key=lambda x: (-x[0], x[1]))


def _meet(first: bool):
    """The values of one meeting: rows (lang, shard, source, peer, place, value)."""

    def meet(seated: pa.Table, visiting: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if seated.num_rows and visiting.num_rows:
            lang, shard = seated["lang"][0].as_py(), seated["shard"][0].as_py()
            here, there = _unpacked(seated), _unpacked(visiting)
            if first:
                (_, _, q), = there
                for source, n, p in here:
                    out += [(lang, shard, source, None, place, value) for value, place in _best(values(p, q), np.flatnonzero((n > 0) & (p > q)))]
                meetings = ((a, b) for i, a in enumerate(here) for b in here[:i])
            else:
                meetings = ((a, b) for a in here for b in there)
            for (a, _, p), (b, _, q) in meetings:
                value = int(values(p, q).sum())
                out += [(lang, shard, a, b, None, value), (lang, shard, b, a, None, value)]
        kinds = {"lang": pa.string(), "shard": pa.int32(), "source": pa.string(), "peer": pa.string(), "place": pa.int32(), "value": pa.int64()}
        return pa.table({c: pa.array([row[i] for row in out], kind) for i, (c, kind) in enumerate(kinds.items())})

    return meet


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value and rank (per group and part)."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    counted = write_and_reread(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    named = counted.where("term != ''")
    kept = named.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= LEAST_DOCS)
    kept = write_and_reread(kept.select("lang", "term", "n"), "kept")

    groups = counted.select("lang", "source").where("term = ''")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(sizes, "lang", "left").fillna(0, ["terms", "total"])
    langs = write_and_reread(
        langs.select("lang", "terms", "total", F.greatest(F.lit(1), F.ceil(F.col("terms") / SHARD)).cast("int").alias("shards"), F.ceil(F.col("groups") / SEATED).cast("int").alias("blocks")), "langs"
    )
    shard = F.pmod(F.xxhash64("term"), F.col("shards")).cast("int")
    placed = kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", shard)
    in_bytes = Window.partitionBy("lang", "shard").orderBy("term")
    placed = write_and_reread(placed.select("lang", "term", "n", "shard", (F.row_number().over(in_bytes) - 1).alias("place")), "placed")

    entries = named.select("lang", "source", "term", "n").join(placed.drop("n"), ["lang", "term"])
    whole = placed.withColumn("source", F.lit(None).cast("string"))
    columns = ["lang", "shard", "source", "place", "n"]
    segments = entries.select(*columns).union(whole.select(*columns)).groupBy("lang", "shard", "source")
    segments = write_and_reread(segments.applyInArrow(_segment, "lang string, shard int, source string, entries int, total long, gaps binary, counts binary"), "segments")

    places = placed.groupBy("lang", "shard").agg(F.count(F.lit(1)).cast("int").alias("size"))
    shards = langs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).join(places, ["lang", "shard"], "left").fillna(0, ["size"])
    of_groups = segments.where("source is not null")
    held = of_groups.groupBy("lang", "source").agg(F.sum("total").alias("held"))
    vector = ["lang", "shard", "block", "blocks", "source", "terms", "held", "size", "entries", "gaps", "counts"]
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    seated = groups.join(held, ["lang", "source"], "left").fillna(0, ["held"]).join(shards, "lang").join(of_groups.drop("total"), ["lang", "source", "shard"], "left").fillna(0, ["entries"]).withColumn("block", block)
    seated = write_and_reread(seated.select(*vector), "seated")
    own = shards.join(segments.where("source is null").drop("total"), ["lang", "shard"], "left").fillna(0, ["entries"]).withColumn("held", F.col("total"))
    own = own.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*vector)

    # every seat's block stays in its partition for all rounds; only visitors move
    keys = ["lang", "shard", "block"]
    residents = seated.repartition(shuffle_partitions(spark), *keys).persist(StorageLevel.MEMORY_AND_DISK)
    rounds = (langs.agg(F.max("blocks")).collect()[0][0] or 0) // 2
    meetings = []
    for turn in range(rounds + 1):
        to = F.pmod(F.col("block") - turn, F.col("blocks"))
        once = (2 * turn < F.col("blocks")) | ((2 * turn == F.col("blocks")) & (to < turn))  # at half a turn both blocks would be hosts
        visitors = seated.where(once).withColumn("block", to) if turn else own
        met = residents.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(_meet(turn == 0), "lang string, shard int, source string, peer string, place int, value long")
        meetings.append(write_and_reread(met, "meeting"))
    residents.unpersist()

    heaps = meetings[0].where("peer is null").join(placed.select("lang", "shard", "place", "term"), ["lang", "shard", "place"])
    pairs = meetings[0].where("peer is not null")
    for met in meetings[1:]:
        pairs = pairs.union(met)
    pairs = pairs.groupBy("lang", "source", "peer").agg(F.sum("value").alias("value"))
    both = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), "value").union(heaps.select("lang", "source", F.lit("term"), "term", "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    result = write_and_reread(ranked.where((F.col("part") == "pair") | (F.col("rank") <= TOP)), "divergence")
    forget(counted, kept, langs, placed, segments, seated, *meetings)
    return result
