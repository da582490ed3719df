"""Exact n-gram Jaccard join and the groups it links.

A document is the set of its distinct word shingles (64-bit hashes), and 1 - Jaccard is a
metric between sets. Texts with equal sets form one node.

1. Filter. Nodes without any partner are the bulk of a corpus. Take the L-prefix of a set in
   hash order: two sets with Jaccard >= t share at least L elements of their prefixes. Tasks
   send the prefixes as sorted, gap-coded lists by hash range; each range's owner counts, for
   every node, the elements that another node has too. A node below its L can't have a
   partner. An element that several nodes of one task have is counted there and sent once, so
   a passage of many documents costs its owner one entry a task. Nothing is lost: the count is
   never below the true one.
2. First regions. Pivots of the first level are single shingles: every set holding s is nearer to
   {s} than to any shingle that it lacks, so a region is the sets that hold its shingle, and
   as two sets within the radius share one of their first (n - ceil(t n) + 1) elements in any
   fixed order, replicating a set to these regions only is exact. The order puts common
   shingles last. Document pivots cannot do this level: unrelated documents are all at
   distance 1.
3. Within a region the most central set (of the commonest shingles) is the pivot. Exact
   distances to it give links within the radius; members of one component need no more
   comparisons. The rest fall into rings around the pivot as wide as the radius. By the
   triangle inequality a link joins nodes of one ring or of neighbours, so each ring gets a
   replica of the ring before it.
4. Recursion. A ring of more than ``BLOCK`` nodes takes ``PIVOTS`` of its nodes as pivots; each
   node belongs to the Voronoi region of the nearest. If x and y are within the radius r of each
   other and x's nearest pivot is p, then d(y, p) <= d(y, nearest of y) + 2 r; so a replica of
   each node within that window goes to the regions of earlier pivots, and every link lies within
   a region. Regions are cut into rings again and join recursively. Where a cut doesn't lessen the
   pairs left to compare (all nodes about equally far from each other), the ring is compared in
   blocks instead. Regions of at most ``BLOCK`` nodes are compared exactly, their overlaps counted
   all at once; only links leave a task.

A set is known by 128 bits of the digest of its shingles, which are 64-bit hashes.

Cases: null, empty and blank texts have no shingle and no link; fewer than k words make one
shingle of all; equal sets always link. Rows are told apart by keys of id and text, never by the
id alone: a repeated id has a row each time it occurs, and a null id counts as the largest (a
group of null ids alone has a null component_id). Texts of any length are read whole. An empty
table gives an empty result; other columns are ignored, and pass through ``keep_one_of_each``
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import column, forget, give_back, mix64, row_keys, shuffle_partitions, slices, unzip_planes, write_and_reread, zip_planes
from tidemark.llm.components import connected
from tidemark.llm.shingles import shingle_sets
from tidemark.llm.sketch import sketched, without

#: Elements of a prefix that must be shared, as a share of a set: longer prefixes filter better and cost more.
EXTRA = 0.15
#: Elements gathered in a task before they are sent.
SEND_ELEMENTS = 1 << 18
#: Shingles whose counts one owner gets.
OWNED = 1 << 19
#: Shingles that this many nodes share are moved to the end of the order, the most common HOT_KEPT of them; the others
#: keep their place by hash, which makes some regions larger and changes no result.
HOT, HOT_KEPT = 24, 200_000
#: Columns that tell rows apart.
KNOWN = ("row_id", "k1", "k2")
_LOW = np.uint64(16)  # the filter works on the upper 48 bits of a shingle's hash


def _digest(s: np.ndarray) -> tuple[int, int]:
    """A set's node and a second number by which sets of one node are told apart."""
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _needed(n: np.ndarray | int, percent: int):
    """Least overlap of a set of n with any partner."""
    return -(-n * percent // 100)


def _nodes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node = [], []
            for _, part in slices(column(batch, "text")):
                for s in shingle_sets(part, k):
                    n.append(len(s))
                    node.append(_digest(s))
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in KNOWN), pa.array(n, pa.int64()), *(pa.array([x[i] for x in node], pa.int64()) for i in (0, 1))], names=[*KNOWN, "n_shingles", "node", "other"])
        give_back()

    return run


def _send(k: int, percent: int, owners: int):
    """Prefix lists by owner; for elements of several nodes here, their counts; and each node's own local count."""
    names = ["owner", "n", "gaps", "nodes", "counts", "own_node", "own_size", "own_count"]

    def flush(sets: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
        node = np.fromiter(sets, np.int64, len(sets))
        size = np.array([n for n, _ in sets.values()], np.int64)
        lengths = [len(p) for _, p in sets.values()]
        h = np.concatenate([p for _, p in sets.values()]) >> _LOW
        whose = np.repeat(np.arange(len(node)), lengths)
        order = np.argsort(h, kind="stable")
        h, whose = h[order], whose[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        counts = np.diff(first, append=len(h))
        shared = np.repeat(counts > 1, counts)
        local = np.bincount(whose[shared], minlength=len(node))
        h, sent = h[first], np.where(counts > 1, np.int64(0), node[whose[first]])
        cut = np.searchsorted(h * np.uint64(owners) >> np.uint64(48), np.arange(owners + 1))
        mine = np.arange(len(node)) % owners
        rows = []
        for o in range(owners):
            part, who = slice(cut[o], cut[o + 1]), np.flatnonzero(mine == o)
            if cut[o] < cut[o + 1] or len(who):
                gaps = np.diff(h[part], prepend=np.uint64(0))
                rows.append((o, cut[o + 1] - cut[o], zip_planes(gaps), sent[part].tobytes(), zip_planes(counts[part].astype(np.uint32)), node[who].tobytes(), size[who].tobytes(), local[who].tobytes()))
        kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 6
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[int, np.ndarray]] = {}
        held = 0
        for batch in batches:
            for _, part in slices(column(batch, "text")):
                for s in shingle_sets(part, k):
                    if not len(s) or (node := _digest(s)[0]) in sets:
                        continue
                    n = len(s)
                    prefix = s[: n - _needed(n, percent) + max(1, int(np.ceil(EXTRA * n)))].copy()
                    sets[node] = (n, prefix)
                    held += len(prefix)
                    if held >= SEND_ELEMENTS:
                        yield flush(sets)
                        sets, held = {}, 0
        if sets:
            yield flush(sets)
        give_back()

    return run


def _count(lists: pd.DataFrame) -> pd.DataFrame:
    """Per node the elements it shares; per common element its number of nodes."""
    total = int(lists["n"].sum())
    h, node, many = np.empty(total, np.uint64), np.empty(total, np.int64), np.empty(total, np.int64)
    at = 0
    for n, gaps, nodes, counts in zip(lists["n"], lists["gaps"], lists["nodes"], lists["counts"]):
        if n:
            h[at : at + n] = np.cumsum(unzip_planes(gaps, n, np.uint64), dtype=np.uint64)
            node[at : at + n] = np.frombuffer(nodes, np.int64)
            many[at : at + n] = unzip_planes(counts, n, np.uint32)
            at += n
    order = np.lexsort((node, h)) if total else np.zeros(0, np.int64)
    h, node, many = h[order], node[order], many[order]
    fresh = np.concatenate([[True], h[1:] != h[:-1]]) if total else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    differs = fresh | np.concatenate([[True], node[1:] != node[:-1]]) if total else fresh
    # nodes behind an element: each single node once, and those counted at their task
    alone = many == 1
    behind = np.bincount(group, weights=np.where(alone, differs, many)) if total else np.zeros(0)
    told = alone & (behind[group] > 1) & differs if total else alone
    found, times = np.unique(node[told], return_counts=True)
    firsts = np.flatnonzero(fresh)
    hot = behind >= HOT
    own = [np.frombuffer(b"".join(lists[c]), np.int64) for c in ("own_node", "own_size", "own_count")]
    zeros = np.zeros(len(found), np.int64)
    return pd.DataFrame(
        {
            "kind": np.concatenate([np.zeros(len(found) + len(own[0]), np.int32), np.ones(int(hot.sum()), np.int32)]),
            "key": np.concatenate([found, own[0], h[firsts][hot].astype(np.int64)]),
            "size": np.concatenate([zeros, own[1], np.zeros(int(hot.sum()), np.int64)]),
            "n": np.concatenate([times, own[2], behind[hot].astype(np.int64)]),
        }
    )


def _regions(percent: int, shared: Broadcast):
    """A row for each element of a set's prefix in the order (common last, then hash), with its place in the set.

    ``central`` is high for sets made of common elements: such a set lies amid its group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        for batch in batches:
            regions, nodes, sizes, places, centres = [], [], [], [], []
            for node, s in zip(column(batch, "node").to_pylist(), column(batch, "s")):
                s = np.asarray(s.values).view(np.uint64)
                n, central = len(s), 0
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, s >> _LOW), len(hot) - 1)
                    common = np.where(hot[at] == s >> _LOW, rank[at], 0)
                    central = int(1000 * np.log1p(common).mean())
                    s = s[np.lexsort((s, common))]
                s = s[: n - _needed(n, percent) + 1]
                regions.append(s.view(np.int64))
                nodes.append(np.full(len(s), node, np.int64))
                sizes.append(np.full(len(s), n, np.int32))
                places.append(np.arange(len(s), dtype=np.int32))
                centres.append(np.full(len(s), central, np.int32))
            if regions:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (regions, nodes, sizes, places, centres)], names=["region", "node", "n", "at", "central"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(u, v) with the exact distance and whether they link."""
    a = sets.select(F.col("node").alias("u"), F.col("s").alias("su"))
    b = sets.select(F.col("node").alias("v"), F.col("s").alias("sv"))
    both = pairs.join(b, "v").join(a, "u")
    common = F.size(F.array_intersect("su", "sv"))
    either = F.size("su") + F.size("sv") - F.col("common")
    return both.select("u", "v", common.alias("common"), "su", "sv").select("u", "v", (1 - F.col("common") / either).alias("d"), (100 * F.col("common") >= percent * either).alias("linked"))


def _open(members: DataFrame, percent: int) -> DataFrame:
    """Members of regions that more than one component has, without those too late in their sets to link with any other.

    At the first element that two sets share, x holds ``at`` elements before it that y lacks and
    y holds at least ``first`` that x lacks: the overlap is n - at at most, the union n + first at least.
    """
    ends = members.groupBy("region").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("at").alias("first")).where("least != most")
    ends = write_and_reread(ends.select("region", "first"), "ends")
    near = 100 * (F.col("n") - F.col("at")) >= percent * (F.col("n") + F.col("first"))
    return members.join(ends, "region").where(near).drop("first")


def _overlaps(elements: np.ndarray, whose: np.ndarray, m: int, few: int = 32, wide: int = 4096) -> np.ndarray:
    """Sizes of the common parts of m sets, all pairs of a block at once.

    Elements of few sets count by shifted comparison of the sorted list, others by products of
    0/1 matrices of ``wide`` columns, so memory is bounded whatever the sets' sizes.
    """
    order = np.argsort(elements, kind="stable")
    elements, whose = elements[order], whose[order]
    first = np.flatnonzero(np.concatenate([[True], elements[1:] != elements[:-1]])) if len(elements) else np.zeros(0, np.int64)
    counts = np.diff(first, append=len(elements))
    total = np.zeros(m * m, np.int64)
    rare = np.repeat((counts > 1) & (counts <= few), counts)
    e, w = elements[rare], whose[rare]
    for k in range(1, few):
        same = np.flatnonzero(e[k:] == e[:-k])
        if not len(same):
            break
        x, y = np.minimum(w[same], w[same + k]), np.maximum(w[same], w[same + k])
        total += np.bincount(x * m + y, minlength=m * m)
    total = total.reshape(m, m)
    total = total + total.T
    common = np.flatnonzero(counts > few)
    for at in range(0, len(common), wide):
        part = common[at : at + wide]
        dense = np.zeros((m, len(part)), np.float32)
        for i, c in enumerate(part.tolist()):
            dense[whose[first[c] : first[c] + counts[c]], i] = 1
        total = total + (dense @ dense.T).astype(np.int64)
    return total


def _compare(percent: int):
    """Links between the nodes of one region or of two blocks of it."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("node").reset_index(drop=True)
        sets = [np.asarray(s, np.int64) for s in rows["s"]]
        n = np.array([len(s) for s in sets], np.int64)
        m = len(sets)
        common = _overlaps(np.concatenate(sets), np.repeat(np.arange(m), n), m) if m else np.zeros((0, 0), np.int64)
        label = rows["label"].to_numpy()
        linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (label[:, None] != label[None, :])
        x, y = np.nonzero(np.triu(linked, 1))
        node = rows["node"].to_numpy()
        return pd.DataFrame({"u": node[x], "v": node[y]})

    return run


#: Nodes of a region that are compared at once; pivots of a larger one; nodes that one task assigns to them.
BLOCK, PIVOTS, ASSIGNED = 384, 16, 1024
#: A cut must bring the pairs to compare down to this share, else the region is compared in blocks.
WORTH = 0.6


def _ring(d, percent: int):
    """Number of the ring, as wide as the radius, that a distance lies in."""
    return np.floor(d * 100 / (100 - percent) + 1e-9).astype(np.int64)


def _assign(percent: int):
    """Voronoi regions of some nodes: a row each replica (link false), and the links with pivots."""

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"parent": [], "region": [], "node": [], "label": [], "link": []}).astype({"parent": "int64", "region": "int64", "node": "int64", "label": "int64", "link": "bool"})
        if not len(rows) or not len(pivots):
            return none
        pivots = pivots.sort_values("node")
        sets = [np.asarray(s, np.int64) for s in rows["s"]]
        n = np.array([len(s) for s in sets], np.int64)
        elements, whose = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        d, near = np.ones((len(sets), len(pivots))), np.zeros((len(sets), len(pivots)), bool)
        for j, s in enumerate(pivots["s"]):
            s = np.asarray(s, np.int64)
            at = np.minimum(np.searchsorted(s, elements), len(s) - 1)
            common = np.bincount(whose[s[at] == elements], minlength=len(sets))
            either = n + len(s) - common
            d[:, j], near[:, j] = 1 - common / either, 100 * common >= percent * either
        node, label, pivot = rows["node"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), pivots["node"].to_numpy(np.int64)
        home = d.argmin(axis=1)
        window = d <= d[np.arange(len(d)), home][:, None] + 2 * (100 - percent) / 100 + 1e-9
        x, p = np.nonzero(window & (np.arange(len(pivot))[None, :] <= home[:, None]))
        ring = _ring(d[x, p], percent)
        x, p, ring = np.tile(x, 2), np.tile(p, 2), np.concatenate([ring, ring + 1])
        key = mix64(pivot[p].view(np.uint64) ^ mix64(ring.astype(np.uint64) ^ mix64(rows["parent"].to_numpy(np.int64)[x].view(np.uint64)))).view(np.int64)
        u, v = np.nonzero(near & (node[:, None] != pivot[None, :]))
        return pd.DataFrame(
            {
                "parent": rows["parent"].iloc[0],
                "region": np.concatenate([key, node[u]]),
                "node": np.concatenate([node[x], pivot[v]]),
                "label": np.concatenate([label[x], np.zeros(len(u), np.int64)]),
                "link": np.concatenate([np.zeros(len(x), bool), np.ones(len(u), bool)]),
            }
        )

    return run


def _sizes(regions: DataFrame) -> DataFrame:
    """region, c, and the commonest component with its m nodes, of the regions of several components; regions of the same nodes count once."""
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    of = regions.groupBy("region", "label").agg(F.count(F.lit(1)).alias("m"), *same)
    most = F.max(F.struct("m", F.col("label").alias("most"))).alias("of")
    of = of.groupBy("region").agg(F.sum("m").alias("c"), F.count(F.lit(1)).alias("labels"), most, F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("labels > 1")
    return of.groupBy("c", "x", "y").agg(F.min(F.struct("region", "of.m", "of.most")).alias("one")).select("one.region", "c", "one.m", "one.most")


def _in_blocks(regions: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links within regions: all at once up to BLOCK nodes, else by pairs of blocks.

    Nodes of a region's commonest component have blocks of their own, which meet the others' blocks only: nodes of one
    component need no comparison.
    """
    whole, ours = F.col("c") <= BLOCK, F.col("label") == F.col("most")
    k1 = F.when(whole, 0).otherwise(F.ceil(F.col("m") / BLOCK)).cast("int")
    k2 = F.when(whole, 1).otherwise(F.ceil((F.col("c") - F.col("m")) / BLOCK)).cast("int")
    placed = regions.join(sizes, "region").select("region", "node", "label", (ours & ~whole).alias("ours"), k1.alias("k1"), k2.alias("k2"))
    part = F.pmod(F.xxhash64("node"), F.when(F.col("ours"), F.col("k1")).otherwise(F.col("k2"))).cast("int")
    placed = placed.withColumn("block", part + F.when(F.col("ours"), 0).otherwise(F.col("k1")))
    # a block's own pairs are compared wherever it meets another
    met = F.when(F.col("ours"), F.sequence("k1", F.col("k1") + F.col("k2") - 1)).when(F.col("k1") == 0, F.array(F.lit(0)))
    met = met.otherwise(F.filter(F.sequence(F.lit(0), F.col("k1") + F.col("k2") - 1), lambda o: o != F.col("block")))
    placed = placed.join(sets, "node").withColumn("other", F.explode(met))
    placed = placed.select("region", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "node", "label", "s")
    return placed.groupBy("region", "b1", "b2").applyInPandas(_compare(percent), "u long, v long")


def _cut(regions: DataFrame, sizes: DataFrame, sets: DataFrame, percent: int, level: int) -> DataFrame:
    """Regions of more than BLOCK nodes, cut at pivots: parent, region, node, label, link."""
    h = F.xxhash64("node", F.lit(level))
    large = regions.join(sizes, "region").select(F.col("region").alias("parent"), "c", F.ceil(F.col("c") / ASSIGNED).cast("int").alias("salts"), "node", "label")
    large = write_and_reread(large, "large")
    # about PIVOTS nodes by hash and, so that there is one, the node of the least
    some = F.collect_set(F.when(F.pmod(h, F.ceil(F.col("c") / PIVOTS)) == 0, F.col("node")))
    chosen = large.groupBy("parent", "salts").agg(some.alias("some"), F.min(F.struct(h.alias("h"), "node")).alias("least"))
    chosen = chosen.select("parent", "salts", F.explode(F.array_union("some", F.array("least.node"))).alias("node"))
    pivots = write_and_reread(chosen.join(sets, "node"), "pivots").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    members = large.join(sets, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    return members.select("parent", "salt", "node", "label", "s").groupBy("parent", "salt").cogroup(pivots.select("parent", "salt", "node", "s").groupBy("parent", "salt")).applyInPandas(
        _assign(percent), "parent long, region long, node long, label long, link boolean"
    )


def _joined(regions: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between nodes of different labels within regions (region, node, label)."""
    links, level = regions.select(F.col("node").alias("u"), F.col("node").alias("v")).limit(0), 0
    while True:
        sizes = write_and_reread(_sizes(regions), "sizes")
        large = sizes.where(F.col("c") > BLOCK)
        if large.isEmpty():
            return links.union(_in_blocks(regions, sizes, sets, percent))
        cut = write_and_reread(_cut(regions, large, sets, percent, level), "cut")
        links = links.union(cut.where("link").select(F.col("region").alias("u"), F.col("node").alias("v")))
        cut = cut.where("not link")
        # the pairs that are left in the regions of each parent
        child = cut.groupBy("parent", "region").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
        pairs = child.where("a != b").groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
        judged = large.join(pairs, large["region"] == pairs["parent"], "left").select("region", "c", "m", "most", (F.coalesce("pairs", F.lit(0)) <= WORTH * F.col("c") * F.col("c")).alias("worth"))
        judged = write_and_reread(judged, "judged")
        rest = sizes.where(F.col("c") <= BLOCK).union(judged.where("not worth").drop("worth"))
        links = links.union(write_and_reread(_in_blocks(regions, rest, sets, percent), "links"))
        if (worth := judged.where("worth")).isEmpty():
            return links
        regions = cut.join(worth.select(F.col("region").alias("parent")), "parent").select("region", "node", "label").distinct()
        regions, level = write_and_reread(regions, "regions"), level + 1


def _links(sets: DataFrame, hot: np.ndarray, rank: np.ndarray, percent: int) -> DataFrame:
    """Links (u, v) that join all nodes within the radius, directly or through others; hot: common shingles in order, rank: their nodes."""
    shared = sets.sparkSession.sparkContext.broadcast((hot, rank))  # HOT_KEPT rows at most
    members = write_and_reread(sets.mapInArrow(_regions(percent, shared), "region long, node long, n int, at int, central int"), "regions")
    first, members = members, write_and_reread(_open(members.withColumn("label", F.col("node")), percent), "members")
    forget(first)
    best = F.max(F.struct("central", -F.col("at"), "node")).alias("p")
    pivots = write_and_reread(members.groupBy("region").agg(best).select("region", F.col("p.node").alias("pivot")), "pivots")
    held = members.join(pivots, "region").where(F.col("node") != F.col("pivot"))
    stars = held.select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct()
    stars = write_and_reread(_verified(stars, sets, percent), "stars")
    linked = stars.where("linked").select("u", "v")
    label = write_and_reread(connected(linked), "labels")
    # what is left: regions whose members are not yet one component, without their pivots
    left = held.drop("label").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    left = write_and_reread(left, "left")
    forget(members, pivots)
    met = _open(left, percent).groupBy("pivot", "node").agg(F.first("label").alias("label"))
    met = met.join(stars.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "d"), ["pivot", "node"])
    # rings as wide as the radius around the pivot: a link joins nodes of one ring or of two neighbours
    ring = F.floor(F.col("d") * 100 / (100 - percent) + 1e-9).cast("int")
    rings = met.select("pivot", "node", "label", F.explode(F.array(ring, ring + 1)).alias("ring"))
    rings = write_and_reread(rings.select(F.xxhash64("pivot", "ring").alias("region"), "node", "label"), "rings")
    found = write_and_reread(linked.union(_joined(rings, sets, percent)), "links")
    forget(stars, left, rings)
    return found


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    return rows.withColumns(row_keys(F.col("row_id"), F.col("text")))


def known_schema(rows: DataFrame, *more: T.StructField) -> T.StructType:
    """KNOWN, n_shingles, node and other, then ``more``."""
    return T.StructType([rows.schema["row_id"], *(T.StructField(c, T.LongType()) for c in (*KNOWN[1:], "n_shingles", "node", "other")), *more])


def told_apart(nodes: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and chosen, where different sets of one node, if there are any, have nodes of their own; chosen with ``first``, the old node."""
    chosen = chosen.withColumn("first", F.col("node"))
    twins = write_and_reread(chosen.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node", F.lit(True).alias("twin")), "twins")
    if twins.isEmpty():
        return nodes, chosen
    apart = F.when(F.col("twin"), F.xxhash64("node", "other")).otherwise(F.col("node"))
    return tuple(x.join(twins, "node", "left").withColumn("node", apart).drop("twin") for x in (nodes, chosen))


def sets_of(rows: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """node and s, the sorted shingles, of each of chosen(node, first, other, key: k1 and k2 of a row that has the set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, first, other = (column(batch, c).to_pylist() for c in ("node", "first", "other"))
            for at, part in slices(column(batch, "text")):
                found = {node[at + i]: s.view(np.int64) for i, s in enumerate(shingle_sets(part, k)) if _digest(s) == (first[at + i], other[at + i])}
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int64()))], names=["node", "s"])
        give_back()

    # most documents are not chosen: a sketch keeps their texts out of the shuffle, the join decides; equal rows combine first
    keys = chosen.select("node", "first", "other", "key.*")
    may = sketched(keys.select("k1"))
    picked = rows.where(may(F.col("k1"))).groupBy("k1", "k2").agg(F.first("text").alias("text")).join(keys, ["k1", "k2"])
    return write_and_reread(picked.select("node", "first", "other", "text").mapInArrow(run, "node long, s array<long>"), "sets")


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the label of their component; rows without shingles have none."""
    label = connected(links)
    return nodes.join(label, "node", "left").withColumn("label", F.when(F.col("n_shingles") > 0, F.coalesce("label", "node")))


def with_components(rows: DataFrame, id_col: str) -> DataFrame:
    """id, n_shingles and component_id of labelled rows."""
    least = write_and_reread(rows.where("label is not null").groupBy("label").agg(F.min("row_id").alias("component_id")), "least")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("row_id"))
    return rows.join(least, "label", "left").select(F.col("row_id").alias(id_col), "n_shingles", component.alias("component_id"))


def marked(rows: DataFrame) -> DataFrame:
    """Marks for ``sketch.without``: of labelled rows, the least id (null last) of each label stays, ties by the keys."""
    best = F.min(F.struct(F.col("row_id").isNull().alias("unnamed"), "row_id", "k1", "k2")).alias("best")
    kept = write_and_reread(rows.where("label is not null").groupBy("label").agg(best).select("label", F.struct("best.k1", "best.k2").alias("kept")), "kept")
    met = rows.join(kept, "label").groupBy("k1", "k2").agg(F.bool_or(F.struct("k1", "k2") == F.col("kept")).alias("stay"), F.count(F.lit(1)).alias("n"))
    marks = write_and_reread(met.where("not stay or n > 1").select("k1", "k2", "stay"), "marks")
    forget(kept)
    return marks


def _grouped(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs by their keys, with n_shingles and the label of their group."""
    rows = keyed_rows(docs, id_col, text_col)
    nodes = write_and_reread(rows.mapInArrow(_nodes(k), known_schema(rows)), "nodes")
    elements = nodes.agg(F.sum("n_shingles")).collect()[0][0] or 0
    owners = max(shuffle_partitions(docs.sparkSession) * 2, elements // OWNED)

    sent = rows.select("text").mapInArrow(_send(k, percent, owners), "owner int, n int, gaps binary, nodes binary, counts binary, own_node binary, own_size binary, own_count binary")
    counted = write_and_reread(sent.repartition(owners, "owner").groupBy("owner").applyInPandas(_count, "kind int, key long, size long, n long"), "counted")
    need = F.greatest(F.lit(1), F.floor(F.col("size") * percent / 100 * EXTRA))
    alive = counted.where("kind = 0").groupBy("key").agg(F.max("size").alias("size"), F.sum("n").alias("n")).where(F.col("n") >= need)
    # one row of each node that is left gives its set
    chosen = nodes.where("n_shingles > 0").groupBy("node", "other").agg(F.min(F.struct("k1", "k2")).alias("key")).join(alive.select(F.col("key").alias("node")), "node")
    nodes, chosen = told_apart(nodes, write_and_reread(chosen, "chosen"))
    sets = sets_of(rows, chosen, k)
    hot = counted.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "key").limit(HOT_KEPT)
    hot = hot.toArrow().sort_by("key")  # a bounded table that only orders shingles
    links = _links(sets, hot["key"].to_numpy().view(np.uint64), hot["n"].to_numpy(), percent)
    made = labelled(nodes, links)
    forget(counted, sets, links)
    return made


def near_groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles and component_id (least id that links reach)."""
    return with_components(_grouped(docs, k, percent, id_col, text_col), id_col)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group, that of the least id, and all rows without words, with all their columns."""
    return without(docs, marked(_grouped(docs, 5, 80, "doc_id", "text")))
