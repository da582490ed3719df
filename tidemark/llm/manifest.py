"""Merkle manifest of a dataset: one tree a lang over its documents, one tree over the langs, and a proof for each row.

1. Spark hashes every row to its leaf; only leaves and keys are shuffled, never texts. A range sort by (lang, doc_id)
   and running counts of its partitions give each leaf its place in its lang, so that a lang of any size is placed by
   many tasks.
2. Leaves are dealt to blocks of ``BLOCK`` = 8 ** 4 consecutive places, whose bounds agree with runs at every level up
   to the block's root. A task hands a block to DuckDB as Arrow; level queries (ordered string_agg, then sha256) climb
   to the root.
3. Block roots are the leaves of the next climb, until a tree has one node; the langs' subroots make the last tree.
4. Going down again, each block meets the siblings on the way from its root to the dataset's root, and DuckDB folds
   every leaf's own siblings and these into its proof.

A digest is the lowercase hex sha256 of its inputs, concatenated. A leaf's inputs are doc_id, source, lang, n_chars and
text: ``-`` for null, else the count of UTF-8 bytes, ``:`` and the value. While a tree has several nodes, every 8
consecutive ones (the last run may be shorter, also one node) become the digest of their digests.

Cases: null ids come before all others of their lang, equal ids go by leaf, so equal rows may change places without
a change of any digest; a lang of one row has its leaf as subroot, a dataset of one lang its subroot as root; null,
empty and very long texts are hashed whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tidemark.llm.common import forget, shuffle_partitions, write_and_reread

#: Children of a node; levels of a block; leaves of a block.
FAN, LEVELS = 8, 4
BLOCK = FAN**LEVELS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = "array<struct<before: string, after: string>>"


def _field(value) -> F.Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id, source, lang, n_chars, text) -> F.Column:
    """The digest of a row."""
    return F.sha2(F.concat(*map(_field, (doc_id, source, lang, n_chars, text))), 256)


def lowered(text) -> F.Column:
    return F.translate(text, _UPPER, _LOWER)


def levels(n: int) -> int:
    """Levels above the leaves of a tree of n."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


# ---- one block, in DuckDB ----


def _engine(nodes: pa.Table) -> tuple[duckdb.DuckDBPyConnection, int]:
    """A connection whose tables l0, l1, ... hold the levels (i, h) of a block, and the number of levels above l0."""
    up = min(LEVELS, levels(nodes["n"][0].as_py()))
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.register("block", nodes.select(["place", "digest"]))
    con.execute(f"CREATE TABLE l0 AS SELECT place % {BLOCK} AS i, digest AS h FROM block")
    for k in range(up):
        con.execute(f"CREATE TABLE l{k + 1} AS SELECT i // {FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM l{k} GROUP BY i // {FAN}")
    return con, up


def _climb(nodes: pa.Table) -> pa.Table:
    """The block's root, as a node of the next climb."""
    con, up = _engine(nodes)
    root = con.execute(f"SELECT h FROM l{up}").fetchone()[0]
    con.close()
    first = nodes.slice(0, 1)
    n = first["n"][0].as_py()
    return pa.table({"tree": first["tree"], "place": pa.array([first["place"][0].as_py() // BLOCK], pa.int64()), "n": pa.array([-(-n // BLOCK)], pa.int64()), "digest": [root]})


def _siblings(con: duckdb.DuckDBPyConnection, up: int) -> None:
    """Tables s0, s1, ...: the digests of a node's run before and after it."""
    for k in range(up):
        run = f"PARTITION BY i // {FAN} ORDER BY i ROWS BETWEEN"
        con.execute(f"CREATE TABLE s{k} AS SELECT i, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM l{k}")


def _descend(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """The steps from each node of a block to the dataset's root."""
    con, up = _engine(nodes)
    _siblings(con, up)
    steps = "".join(f", {{'before': s{k}.before, 'after': s{k}.after}}" for k in range(up))[2:]
    joins = "".join(f" JOIN s{k} ON s{k}.i = l0.i // {FAN**k}" for k in range(up))
    own = dict(con.execute(f"SELECT l0.i, [{steps}] FROM l0{joins}").fetchall()) if up else {}
    con.close()
    onward = above["steps"][0].as_py()
    kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
    way = [own.get(p % BLOCK, []) + onward for p in nodes["place"].to_pylist()]
    return pa.table({"tree": nodes["tree"], "place": nodes["place"], "steps": pa.array(way, kind)})


def _prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Proof digest and folded root of each leaf of a block."""
    con, up = _engine(nodes)
    _siblings(con, up)
    con.register("shown", nodes.select(["place", "shown"]))
    con.execute(f"CREATE TABLE f0 AS SELECT place % {BLOCK} AS i, shown AS h, '' AS proof FROM shown")
    for k in range(up):
        con.execute(f"CREATE TABLE f{k + 1} AS SELECT f.i, sha256(s.before || f.h || s.after) AS h, f.proof || s.before || s.after AS proof FROM f{k} f JOIN s{k} s ON s.i = f.i // {FAN**k}")
    for step in above["steps"][0].as_py():
        con.execute(f"CREATE TABLE f{up + 1} AS SELECT i, sha256(? || h || ?) AS h, proof || ? || ? AS proof FROM f{up}", [step["before"], step["after"]] * 2)
        up += 1
    found = con.sql(f"SELECT i, h AS folded_root, sha256(proof) AS proof_sha256 FROM f{up}").to_arrow_table()
    con.close()
    at = pc.index_in(pc.bit_wise_and(nodes["place"], BLOCK - 1), found["i"].cast(pa.int64()).combine_chunks())
    out = {"doc_id": nodes["doc_id"], "leaf": nodes["digest"], "tree": nodes["tree"]}
    return pa.table(out | {c: found[c].take(at) for c in ("proof_sha256", "folded_root")})


# ---- the dataset ----


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(tree, ...) with place (from 0 in its tree, by ``order``) and n (rows of its tree), without a window over a tree."""
    n = shuffle_partitions(rows.sparkSession)
    ties = F.pmod(F.monotonically_increasing_id(), F.lit(1 << 16))  # parts equal rows, whose order shows nowhere
    keys = ["tree", *order]
    salted = rows.withColumn("salt", ties)
    ranged = salted.repartitionByRange(n, *keys, "salt").sortWithinPartitions(*keys, "salt").drop("salt")
    ranged = write_and_reread(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranged")
    # a row for each partition and tree in it: partitions and trees in number
    counts = ranged.groupBy("part", "tree").agg(F.count(F.lit(1)).alias("c"), F.min("at").alias("least"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "tree", "least", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    placed = ranged.join(counts, ["part", "tree"]).withColumn("place", F.col("at") - F.col("least") + F.col("before")).drop("part", "at", "least", "before")
    made = write_and_reread(placed, "placed")
    forget(ranged)
    return made


def _blocks(nodes: DataFrame):
    return nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block"))


def _with_steps(nodes: DataFrame, steps: DataFrame):
    """Blocks of nodes, each with the row of steps(tree, place, steps) of its root."""
    return _blocks(nodes).cogroup(steps.groupBy("tree", F.col("place").alias("block")))


def _climbs(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes(tree, place, n, digest) from the given one up to the one that has the roots alone."""
    tables = [nodes]
    while len(tables) == 1 or not tables[-1].where("n > 1").isEmpty():
        tables.append(write_and_reread(_blocks(tables[-1]).applyInArrow(_climb, "tree string, place long, n long, digest string"), "nodes"))
    return tables


def _descents(tables: list[DataFrame], steps: DataFrame) -> list[DataFrame]:
    """steps(tree, place, steps) of each table's nodes, from those of the last, which are given, downwards."""
    made = [steps]
    for nodes in reversed(tables[:-1]):
        made.append(write_and_reread(_with_steps(nodes, made[-1]).applyInArrow(_descend, f"tree string, place long, steps {_STEPS}"), "steps"))
    return made


def manifest(docs: DataFrame, tampered=None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row.

    ``tampered``: a condition; rows that meet it present themselves with their text's A-Z lower-cased.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    digest, changed = leaf(*fields, F.col("text")), leaf(*fields, lowered(F.col("text")))
    shown = digest if tampered is None else F.when(tampered, changed).otherwise(digest)
    tree = F.coalesce(F.concat(F.lit("+"), "lang"), F.lit("")).alias("tree")  # null first, then by bytes
    rows = write_and_reread(docs.select(tree, "doc_id", digest.alias("digest"), shown.alias("shown")), "leaves")
    leaves = _placed(rows, ["doc_id", "digest"])
    below = _climbs(leaves)
    subroots = below[-1].select("tree", F.col("digest").alias("subroot"))
    # the tree over the langs: its nodes' steps are those of the langs' subroots
    tops = _placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("subroot").alias("digest")), ["of"])
    above = _climbs(tops)
    root = above[-1].first()  # one node, if any
    start = above[-1].select("tree", "place", F.array().cast(_STEPS).alias("steps"))
    over = _descents(above, start)
    start = tops.join(over[-1], ["tree", "place"]).select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("place"), "steps")
    steps = _descents(below[1:], start)
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, T.StringType()) for c in ("leaf", "tree", "proof_sha256", "folded_root"))])
    proofs = _with_steps(leaves, steps[-1]).applyInArrow(_prove, schema).join(subroots, "tree").withColumn("root", F.lit(root and root["digest"]).cast("string"))
    result = proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
    made = write_and_reread(result, "manifest")
    forget(rows, tops, *below, *above[1:], *over[1:], *steps[1:])
    return made
