"""Token counts as delta-maintained rollups.

A change feed of inserts, deletes and revised counts becomes signed rows, pre-aggregated by
source, language and tokenizer version. A commit adds a batch's deltas to the totals so far and
writes the new totals to a folder of its own, then a file that names it, and publishes by renaming
this file to the next version's name. Nothing that was published is ever changed or deleted: a
crash before the rename, also one within a write, leaves the old version in force, a batch that
was committed before changes nothing, and of two writers that make the same version the second
fails and may commit again. Totals are read from
the last version alone, so their cost doesn't grow with the number of batches.

Change rows: op ('insert', 'delete' or 'revise'), source, lang, version, n_tokens, old_tokens
(of a revise: the count it replaces; null counts as 0). A null source or lang is a group of its
own; an op that is none of the three is an error; an empty batch commits nothing but its id;
a change repeated within a batch counts each time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F

from tidemark.llm.common import write_and_reread

KEYS = ("source", "lang", "version")

#: Native tokenizers by version name: words between white space, and UTF-8 bytes.
WORDS, BYTES = "words-v1", "bytes-v1"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def byte_count(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def by_version(counts: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row a document and tokenizer version, from one count column a version."""
    pairs = F.array(*[F.struct(F.lit(v).alias("version"), F.col(c).alias("n_tokens")) for v, c in columns.items()])
    return counts.select(*[c for c in counts.columns if c not in columns.values()], F.explode(pairs).alias("x")).select("*", "x.version", "x.n_tokens").drop("x")


def signed(changes: DataFrame) -> DataFrame:
    """Additive deltas of documents and tokens by key."""
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.col("op")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("int"))
    tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("d_docs"), F.sum(tokens).cast("long").alias("d_tokens"))


class Rollup:
    """Totals below one folder of the shared file system, version by version."""

    VERSION = "version long, batch_id long, totals string"
    TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> DataFrame:
        """version, batch_id and totals folder of each commit; batch_id is null where ``compact`` began anew."""
        none = self.spark.createDataFrame([], self.VERSION)
        try:
            return none.union(self.spark.read.schema(self.VERSION).json(f"{self.path}/versions"))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return none

    def _last(self) -> Row | None:
        return next(iter(self.versions().orderBy(F.desc("version")).limit(1).collect()), None)

    def _at(self, last: Row | None) -> DataFrame:
        if last is None:
            return self.spark.createDataFrame([], self.TOTALS)
        return self.spark.read.schema(self.TOTALS).parquet(f"{self.path}/totals/{last['totals']}")

    def _publish(self, last: Row | None, batch_id: int | None, totals: DataFrame) -> None:
        folder, version = uuid.uuid4().hex, 1 if last is None else last["version"] + 1
        totals.write.parquet(f"{self.path}/totals/{folder}")
        self._create(f"{self.path}/versions/{version:012d}.json", json.dumps({"version": version, "batch_id": batch_id, "totals": folder}))

    def _create(self, name: str, text: str) -> None:
        """A file with that text, whole or not at all; an error if there is one of that name."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        final = jvm.org.apache.hadoop.fs.Path(name)
        files = final.getFileSystem(conf)
        # readers skip names that begin with a dot
        draft = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}")
        out = files.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        whole = files.makeQualified(draft)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), conf)
        context.rename(whole, files.makeQualified(final), self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def commit(self, batch_id: int, changes: DataFrame) -> None:
        """Add a batch, once."""
        if not self.versions().where(F.col("batch_id") == batch_id).isEmpty():
            return
        last = self._last()
        deltas = signed(changes).select(*KEYS, F.col("d_docs").alias("n_docs"), F.col("d_tokens").alias("n_tokens"))
        sums = self._at(last).union(deltas).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        self._publish(last, batch_id, sums)

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens of the last version; groups without documents left go."""
        return self._at(self._last()).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self, into: "Rollup") -> None:
        """Begin a fresh folder with the totals as its first version; batches committed there later add to it."""
        into._publish(None, None, self.totals())


def feed(spark: SparkSession, docs: DataFrame, labels: DataFrame, path: str) -> Rollup:
    """Commit all documents, then deletes of toxic ones and revisions of poor ones, the last batch twice.

    A revised text has lost the characters ``|%&$#*!``.
    """
    clean = F.translate(F.coalesce("text", F.lit("")), "|%&$#*!", "")
    counted = docs.select("doc_id", "source", "lang", word_count(F.col("text")).alias("w"), byte_count(F.col("text")).alias("b"), word_count(clean).alias("w2"), byte_count(clean).alias("b2"))
    counted = write_and_reread(counted, "counted")
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"), F.min(F.col("quality")).alias("quality"))
    both = counted.join(marked, "doc_id")
    none = F.lit(None).cast("long").alias("old_tokens")
    plain = {WORDS: "w", BYTES: "b"}
    roll = Rollup(spark, path)
    roll.commit(1, by_version(counted.drop("w2", "b2"), plain).select("*", F.lit("insert").alias("op"), none))
    gone = both.where(F.coalesce("toxic", F.lit(False)))
    roll.commit(2, by_version(gone.drop("w2", "b2"), plain).select("*", F.lit("delete").alias("op"), none))
    poor = both.where(~F.coalesce("toxic", F.lit(False)) & (F.col("quality") == 0))
    pairs = F.array(F.struct(F.lit(WORDS).alias("version"), F.col("w2").alias("n_tokens"), F.col("w").alias("old_tokens")), F.struct(F.lit(BYTES).alias("version"), F.col("b2").alias("n_tokens"), F.col("b").alias("old_tokens")))
    revised = poor.select("source", "lang", F.explode(pairs).alias("x")).select("source", "lang", "x.*", F.lit("revise").alias("op"))
    for _ in range(2):  # a retry must change nothing
        roll.commit(3, revised)
    return roll
