"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source are shuffled by hash and dealt into blocks; a mix is an order of blocks, one a slot. A source with
weight a of q in all (integers) owes its block k a slot from its release floor(k q / a) to before its deadline
ceil((k + 1) q / a), and earliest deadline first keeps every deadline, as the weights sum to one: at any slot a source's
blocks differ from its exact share by less than one. Releases, deadlines and so the schedule repeat with every q slots,
each source taking a of them. So the schedule of one period, a fold over its slots with one row of counters, gives the
slot of every block of any run: block k sits in period k div a at the place of the source's block k mod a. Nothing is
scheduled in sequence beyond the period, and a hot source is joined with one row of the period.

Weights are integers by what they are to stand for: targets that are ratios of small numbers exactly, others to about
1 / PERIOD, or to a sixteenth of an even share where there are many sources. Slots go on as if no source ended; those of
blocks that a source lacks are skipped and the others keep their order, so that the sources that last share by their
weights. A source whose target is 0 or missing comes after all others, those among themselves by their rows. No document
is dropped or repeated: the weights say how the sources interleave, for as long as each lasts.

Cases: a null source is a source of its own; ties of the shuffle are broken by doc_id (null first); rows repeated whole
keep one place each; a text of any length is a document like others; an empty table gives an empty result. Extra columns
pass through; columns of the names mix_unit, mix_slot and mix_at give way to the result's.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.llm.common import shuffle_partitions, write_and_reread

#: Temperature of the default weights: a source's share is proportional to rows ** ALPHA.
ALPHA = 0.5
#: Slots of a unit, in which slots are counted; it has no effect on the order.
SLOTS = 200
#: Documents a block.
BLOCK = 64
#: Slots of a period, about, and the most that exact targets may take; slots of a period for each source, at least.
PERIOD, MOST_EXACT, EACH = 4096, 1 << 16, 16

#: Slots worked out at a time within a period.
STRETCH = 512

MADE = ("mix_unit", "mix_slot", "mix_at")


def _key(source: Column) -> Column:
    """Never null; a null source gets a name of its own."""
    return F.coalesce(source.cast("string"), F.lit("\0"))


def exact_weights(target: dict[str | None, float]) -> dict[str | None, int] | None:
    """Integers in the ratio of the targets above 0, if a period of at most MOST_EXACT slots holds them to within a double's digits."""
    some = {s: w for s, w in target.items() if w > 0}
    total = sum(some.values())
    parts = {s: Fraction(w / total).limit_denominator(MOST_EXACT) for s, w in some.items()}
    period = math.lcm(*(p.denominator for p in parts.values())) if parts else 0
    if not 0 < period <= MOST_EXACT or sum(parts.values()) != 1 or any(abs(p - Fraction(some[s] / total)) > Fraction(1, 10**12) for s, p in parts.items()):
        return None
    return {s: int(p * period) for s, p in parts.items()}


def weights(sources: DataFrame, target: dict[str | None, float] | None = None) -> DataFrame:
    """source_key, n, rest (comes after all others) and a, the integer weight within its group, from (source_key, n).

    One row a source: what windows over all of them hold is as small as the list of sources. Shares of the period's
    slots are rounded down, to 1 at least, and what is left goes to the largest remainders.
    """
    share, whole = F.pow(F.col("n").cast("double"), F.lit(ALPHA)), None
    if target is not None:
        whole = exact_weights(target)
        share = F.lit(0.0)
        for source, weight in (whole or target).items():
            share = F.when(F.col("source_key") == _key(F.lit(source)), F.lit(float(weight))).otherwise(share)
    sources = sources.select("source_key", "n", share.alias("share")).withColumn("rest", F.col("share") <= 0)
    sources = sources.withColumn("share", F.when(F.col("rest"), F.col("n").cast("double")).otherwise(F.col("share")))
    group = W.partitionBy("rest")
    slots = F.greatest(F.lit(PERIOD), EACH * F.count(F.lit(1)).over(group))
    sources = sources.withColumn("exact", F.col("share") / F.sum("share").over(group) * slots).withColumn("slots", slots)
    sources = sources.withColumn("least", F.greatest(F.lit(1), F.floor("exact")).cast("long"))
    place = F.row_number().over(group.orderBy((F.floor("exact") - F.col("exact")), "source_key"))
    sources = sources.withColumn("more", place <= F.col("slots") - F.sum("least").over(group))
    a = F.col("least") + F.col("more").cast("long")
    if whole is not None:
        a = F.when(F.col("rest"), a).otherwise(F.col("share").cast("long"))
    return sources.select("source_key", "n", "rest", a.alias("a"))


def schedules(weighted: DataFrame) -> DataFrame:
    """source_key, rest, a, q and slots (of its blocks 0 to a - 1 in a period of q slots): earliest deadline first.

    Sources of one weight owe their k-th blocks at the same times, so they take turns in order of source_key: the fold has
    a counter for each different weight, of which integers that sum to q can have sqrt(2 q) at most. Ties of deadlines go
    to the larger weight.
    """
    alike = weighted.groupBy("rest", "a").agg(F.array_sort(F.collect_list("source_key")).alias("keys"))
    group = F.array_sort(F.collect_list(F.struct((-F.col("a")).alias("less"), F.size("keys").cast("long").alias("m"), "keys"))).alias("member")
    groups = alike.groupBy("rest").agg(group, F.sum(F.col("a") * F.size("keys")).cast("long").alias("q"))

    def due(m: Column, done: Column) -> Column:
        """When the next block of the sources of one weight may and must run, after ``done`` of theirs."""
        k = F.floor(done / m["m"])
        return F.struct(F.floor(k * F.col("q") / -m["less"]).alias("release"), F.ceil((k + 1) * F.col("q") / -m["less"]).alias("deadline"), done.alias("done"))

    zero = F.lit(0).cast("long")
    start = F.struct(F.transform("member", lambda m: due(m, zero)).alias("next"), F.array().cast("array<struct<at:int,done:bigint>>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        ready = F.transform(state["next"], lambda x, i: F.when(x["release"] <= slot, F.struct(x["deadline"].alias("deadline"), i.alias("at"), x["done"].alias("done"))))
        best = F.array_min(ready)  # nulls don't count
        moved = F.transform(state["next"], lambda x, i: F.when(i == best["at"], due(F.get("member", i), x["done"] + 1)).otherwise(x))
        return F.struct(moved.alias("next"), F.array_append(state["order"], F.struct(best["at"].alias("at"), best["done"].alias("done"))).alias("order"))

    # stretch after stretch, as an array that grows by a slot is copied each time
    none = F.array().cast("array<struct<at:int,done:bigint>>").alias("order")
    stretch = lambda c: F.sequence(c * STRETCH, F.least(F.col("q"), (c + 1) * STRETCH) - 1)
    onward = lambda done, c: F.array_append(done, F.aggregate(stretch(c), F.struct(F.element_at(done, -1)["next"].alias("next"), none), step))
    folded = F.aggregate(F.sequence(zero, F.floor((F.col("q") - 1) / STRETCH)), F.array(start), onward)
    order = F.flatten(F.transform(folded, lambda x: x["order"]))
    placed = groups.select("rest", "member", "q", F.posexplode(order).alias("slot", "took"))
    m = F.get("member", F.col("took.at"))
    key = F.get(m["keys"], (F.col("took.done") % m["m"]).cast("int"))
    placed = placed.select("rest", "q", key.alias("source_key"), (-m["less"]).alias("a"), F.col("slot").cast("long").alias("slot"))
    return placed.groupBy("source_key", "a", "rest", "q").agg(F.array_sort(F.collect_list("slot")).alias("slots"))


def source_slots(keyed: DataFrame, target: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """source_key, a, q, slots and base (slots before the first of its group): a row a source."""
    counts = keyed.groupBy("source_key").agg(F.count(F.lit(1)).alias("n"))
    weighted = weights(counts, target)
    table = write_and_reread(schedules(weighted).join(weighted.select("source_key", "n"), "source_key"), "schedule")  # the fold runs once
    last = table.where("not rest").agg(F.max(_slot(F.ceil(F.col("n") / block).cast("long") - 1)).alias("last"))
    return table.join(last).select("source_key", "a", "q", "slots", F.when(F.col("rest"), F.coalesce(F.col("last") + 1, F.lit(0))).otherwise(0).cast("long").alias("base"))


def _slot(number: Column) -> Column:
    """The slot of a source's block of that number."""
    return F.floor(number / F.col("a")) * F.col("q") + F.get("slots", F.pmod(number, F.col("a")).cast("int"))


def _numbered(keyed: DataFrame) -> DataFrame:
    """keyed with place (from 0) in its source's shuffled order.

    Rows of a source are spread over hash ranges; each is numbered by itself and starts where
    the counts of the ranges before it end, so a hot source is no single task's work.
    """
    ranges = shuffle_partitions(keyed.sparkSession) * 16
    h = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), F.lit(":9"))), 1, 10), 16, 10).cast("long")  # 40 bits
    rows = keyed.withColumn("h", h).withColumn("range", F.floor(F.col("h") * ranges / (1 << 40)).cast("int"))
    counts = rows.groupBy("source_key", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("source_key", "range", (F.sum("n").over(W.partitionBy("source_key").orderBy("range")) - F.col("n")).alias("start"))
    local = rows.withColumn("at", F.row_number().over(W.partitionBy("source_key", "range").orderBy("h", "row.doc_id")) - 1)
    return local.join(before, ["source_key", "range"]).select("row", "source_key", (F.col("start") + F.col("at")).alias("place"))


def _mixed(docs: DataFrame, target: dict[str | None, float] | None, key: str, slots: int, block: int) -> DataFrame:
    """row (all columns of docs), mix_unit, mix_slot, mix_at."""
    keyed = docs.select(F.struct(*docs.columns).alias("row"), _key(F.col(key)).alias("source_key"))
    slots_of = source_slots(docs.select(_key(F.col(key)).alias("source_key")), target, block)
    # one row a source; Spark broadcasts it while it is small
    placed = _numbered(keyed).join(slots_of, "source_key").withColumn("number", F.floor(F.col("place") / block))
    slot = (F.col("base") + _slot(F.col("number"))).alias("slot")
    placed = placed.select("row", slot, F.pmod("place", F.lit(block)).cast("int").alias("mix_at"))
    return placed.select("row", F.floor(F.col("slot") / slots).alias("mix_unit"), F.pmod("slot", F.lit(slots)).cast("long").alias("mix_slot"), "mix_at")


def mix(docs: DataFrame, target: dict[str | None, float] | None = None, key: str = "source", slots: int = SLOTS, block: int = BLOCK) -> DataFrame:
    """docs with mix_unit, mix_slot and mix_at (place in the block): sorted by these, they are the mix."""
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in MADE]
    return _mixed(docs, target, key, slots, block).select(*own, *MADE)


def in_mixed_order(docs: DataFrame, target: dict[str | None, float] | None = None, key: str = "source") -> DataFrame:
    """The documents, all of them and unchanged, in the order of the mix; ``stored_order`` tells it once they are written."""
    return _mixed(docs, target, key, SLOTS, BLOCK).orderBy("mix_unit", "mix_slot", "mix_at").select("row.*")


def stored_order() -> Column:
    """A long by which the rows of a Parquet table that Spark wrote sort as they were written.

    Reading doesn't keep that order: tasks take files by size and parts of large files. Of the
    bits 20 hold the number of the task that wrote the file, 10 the file's among its task's, 33
    the row's.
    """
    number = lambda pattern: F.regexp_extract("_metadata.file_name", pattern, 1).cast("long")
    return F.shiftleft(number(r"part-(\d+)-"), 43) + F.shiftleft(number(r"-c(\d+)\."), 33) + F.col("_metadata.row_index")
