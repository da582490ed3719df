"""Running values of a key whose history runs in many tasks: chunks of time side by side, joined by a small table.

A chunk is a key's rows within a span of time. What a chunk does to a running value is worked out from its own rows and
is small: its totals, its moments, or the map that takes the state before it to the state behind it. A scan of these,
one row a chunk, gives each chunk the state that it starts from; then all chunks are worked out side by side. Rows are
exchanged by (key, chunk), once for both passes, so a key with a third of all rows is as many tasks as it has chunks.

Cases: null inputs are as the recurrence has them; rows without a time form the first chunk; ties in the order columns
must be told apart by the last of them; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tidemark.operators import recursive as rec
from tidemark.operators.recursive import Recurrence

#: Seconds of a chunk: a day.
SPAN = 86_400.0
#: A map's coefficient below this leaves nothing of a state that a double can hold beside the rest.
GONE = 1e-40


def chunk_of(span: float = SPAN, ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(int(span * 1_000_000))).alias("chunk")


def _before(by: str, of: Column, chunk: str = "chunk") -> Column:
    """``of`` summed over a key's chunks before this one."""
    return F.coalesce(F.sum(of).over(W.partitionBy(by).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))


def with_lags(df: DataFrame, lags: dict[str, tuple[str, int]], by: str = "symbol", order: Sequence[str] = ("ts",), span: float = SPAN) -> DataFrame:
    """Adds, for each name: (x, i), the value of x on the key's i-th row before this one; null where there is none.

    A chunk gets the last rows of those before it, as many as the longest lag.
    """
    most, values = max(i for _, i in lags.values()), list(dict.fromkeys(x for x, _ in lags.values()))
    inside = W.partitionBy(by, "chunk")
    ordered = inside.orderBy(*order)
    chunked = df.withColumn("chunk", chunk_of(span, order[0])).repartition(by, "chunk")
    numbered = chunked.withColumns({"_place": F.row_number().over(ordered), "_size": F.count(F.lit(1)).over(inside), **{f"_{name}": F.lag(x, i).over(ordered) for name, (x, i) in lags.items()}})
    tails = numbered.where(F.col("_place") > F.col("_size") - most).groupBy(by, "chunk").agg(F.array_sort(F.collect_list(F.struct("_place", *values))).alias("tail"))
    earlier = F.flatten(F.collect_list("tail").over(W.partitionBy(by).orderBy("chunk").rowsBetween(-most, -1)))
    tails = tails.select(F.col(by).alias("_by"), F.col("chunk").alias("_chunk"), F.slice(F.reverse(earlier), 1, most).alias("_tail"))
    met = numbered.join(tails, F.col(by).eqNullSafe(F.col("_by")) & F.col("chunk").eqNullSafe(F.col("_chunk")), "left")
    found = [F.when(F.col("_place") > i, F.col(f"_{name}")).otherwise(F.get("_tail", F.lit(i) - F.col("_place"))[x]).alias(name) for name, (x, i) in lags.items()]
    return met.select(*[numbered[c] for c in df.columns], *found)


def log_return(df: DataFrame, price: str = "close", span: float = SPAN, by: str = "symbol", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Adds ret: ln of price over the previous price, 0 on a key's first row."""
    met = with_lags(df, {"before_it": (price, 1)}, by, order, span)
    return met.withColumn("ret", F.coalesce(F.ln(F.col(price) / F.col("before_it")), F.lit(0.0))).drop("before_it")


def running_moments(df: DataFrame, pairs: Sequence[tuple[str, str]], by: str = "symbol", order: Sequence[str] = ("ts",), span: float = SPAN) -> DataFrame:
    """Adds, for each pair (x, y), moments over the key's rows so far that have both: {x}_{y}_n, mean_x, mean_y, mxx, myy, mxy.

    The last three are sums of squares and products about the means. Chunks are summed about the mean of the key's first
    chunk, which lies near all values, so the sums keep their digits; within a chunk the engine's own moments are used.
    """
    chunked = df.withColumn("chunk", chunk_of(span, order[0])).repartition(by, "chunk")
    w = W.partitionBy(by, "chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    made, ends, shown, offsets = [], [], [], []
    for i, (x, y) in enumerate(pairs):
        both = F.col(x).isNotNull() & F.col(y).isNotNull()
        a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
        parts = {"n": F.count(a), "a": F.avg(a), "b": F.avg(b), "aa": F.var_pop(a), "bb": F.var_pop(b), "ab": F.covar_pop(a, b)}
        made += [e.over(w).alias(f"_{k}{i}") for k, e in parts.items()]
        ends += [e.alias(f"_{k}{i}") for k, e in parts.items()]
        n, a0, b0 = (F.col(f"_{k}{i}") for k in ("n", "a", "b"))
        first = W.partitionBy(by).orderBy("chunk").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        ca, cb = F.first(a0, ignorenulls=True).over(first), F.first(b0, ignorenulls=True).over(first)
        da, db = f"_da{i}", f"_db{i}"
        shown.append((n, a0, b0, ca, cb, da, db))
    totals = chunked.groupBy(by, "chunk").agg(*ends)
    for i, (n, a0, b0, ca, cb, da, db) in enumerate(shown):
        totals = totals.withColumns({f"_ca{i}": ca, f"_cb{i}": cb}).withColumns({da: a0 - F.col(f"_ca{i}"), db: b0 - F.col(f"_cb{i}")})
        about = {"sn": n, "sa": n * F.col(da), "sb": n * F.col(db), "saa": n * (F.col(f"_aa{i}") + F.col(da) ** 2), "sbb": n * (F.col(f"_bb{i}") + F.col(db) ** 2), "sab": n * (F.col(f"_ab{i}") + F.col(da) * F.col(db))}
        offsets += [f"_ca{i}", f"_cb{i}", *(_before(by, F.coalesce(e.cast("double"), F.lit(0.0))).alias(f"_{k}{i}") for k, e in about.items())]
    starts = totals.select(F.col(by).alias("_by"), F.col("chunk").alias("_chunk"), *offsets)
    met = chunked.select(*df.columns, "chunk", *made).join(starts, F.col(by).eqNullSafe(F.col("_by")) & F.col("chunk").eqNullSafe(F.col("_chunk")), "left")
    out = []
    for i, (x, y) in enumerate(pairs):
        c = lambda k: F.col(f"_{k}{i}")  # noqa: B023, E731
        here = c("n").cast("double")
        inner = lambda e: F.coalesce(e, F.lit(0.0))
        da, db = inner(c("a") - c("ca")), inner(c("b") - c("cb"))
        n = here + c("sn")
        # sums about the common centre, then moved to the mean
        sa, sb = c("sa") + here * da, c("sb") + here * db
        saa = c("saa") + here * (inner(c("aa")) + da * da)
        sbb = c("sbb") + here * (inner(c("bb")) + db * db)
        sab = c("sab") + here * (inner(c("ab")) + da * db)
        some = lambda e: F.when(n > 0, e)  # noqa: B023, E731
        name = f"{x}_{y}_"
        out += [
            n.cast("long").alias(name + "n"), some(c("ca") + sa / n).alias(name + "mean_x"), some(c("cb") + sb / n).alias(name + "mean_y"),
            some(F.greatest(F.lit(0.0), saa - sa * sa / n)).alias(name + "mxx"), some(F.greatest(F.lit(0.0), sbb - sb * sb / n)).alias(name + "myy"), some(sab - sa * sb / n).alias(name + "mxy"),
        ]
    return met.select(*[met[c] for c in df.columns], *out)


# ---- ranks ----

#: Rows of a value range of a key, about.
RANGE_ROWS = 200_000


def earlier_below(x: np.ndarray, equal: bool) -> np.ndarray:
    """For each element the number of earlier ones that are less (``equal``: or equal), in n log n steps of whole arrays."""
    n = len(x)
    # ranks without ties: earlier equals come first if they count, else last
    order = np.lexsort((np.arange(n) if equal else -np.arange(n), x))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    count = np.zeros(n, np.int64)
    at = np.arange(n)  # elements in order of time within each prefix of their rank's bits
    for bit in range(max(n - 1, 0).bit_length() - 1, -1, -1):
        r = rank[at]
        one = (r >> bit) & 1 == 1
        group = r >> (bit + 1)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        first = np.searchsorted(group, group)  # where each prefix begins
        count[at[one]] += (zeros[:-1] - zeros[first])[one]
        at = at[np.argsort(r >> bit, kind="stable")]
    return count


def running_rank(df: DataFrame, x: str, name: str = "position", by: str = "symbol", order: Sequence[str] = ("ts",), span: float = SPAN, ranges: int | None = None) -> DataFrame:
    """Key and order columns with the share of the key's values so far, this one included, that are no greater: exact for any number of values.

    Values are parted into ranges at quantiles of a sketch; a value that is a cut has a range of its own, so that none
    can hold too many rows. Of the values no greater than a row's, those in lower ranges and earlier chunks come from
    a table of counts by (range, chunk), those in its own chunk and those in its own range from a count within that
    group. Null and NaN have no position and don't count.
    """
    rows = df.select(F.col(by).alias("_key"), chunk_of(span, order[0]).alias("_chunk"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(x).cast("double").alias("_x"), by, *order)
    some = rows.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if ranges is None:
        most = some.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
        ranges = min(10_000, 1 + most // RANGE_ROWS)
    shares = [i / ranges for i in range(1, ranges)] or [0.5]
    cuts = some.groupBy("_key").agg(F.array_distinct(F.percentile_approx("_x", shares, 10_000)).alias("cuts"))
    part = some.repartition("_key", "_chunk")
    known = part.groupBy("_key", "_chunk").agg(F.count(F.lit(1)).alias("c")).select(F.col("_key").alias("k"), F.col("_chunk").alias("h"))
    known = known.join(cuts.withColumnRenamed("_key", "of"), F.col("k").eqNullSafe(F.col("of"))).select("k", "h", "cuts")
    sort = [(f"_o{i}", "ascending") for i in range(len(order))]
    own = ["_key", "_chunk", *[f"_o{i}" for i in range(len(order))], "_x", by, *order]
    placed_schema = T.StructType([*(rows.select(*own).schema.fields), T.StructField("_range", T.IntegerType()), T.StructField("_inside", T.LongType()), T.StructField("_nth", T.LongType())])

    def place(table: pa.Table, known: pa.Table) -> pa.Table:
        """Even ranges lie between cuts, odd ones are a cut's own."""
        table = table.sort_by(sort)
        v, cut = table["_x"].to_numpy(), np.array(known["cuts"][0].as_py())
        at = np.searchsorted(cut, v, "left")
        point = (at < len(cut)) & (cut[np.minimum(at, len(cut) - 1)] == v)
        key = 2 * at + point
        inside = np.where(point, earlier_below(key, True), earlier_below(key, False))
        made = {"_range": pa.array(key, pa.int32()), "_inside": pa.array(inside, pa.int64()), "_nth": pa.array(np.arange(1, len(v) + 1), pa.int64())}
        return pa.table({c: table[c] for c in own} | made)

    placed = part.groupBy("_key", "_chunk").cogroup(known.groupBy("k", "h")).applyInArrow(place, placed_schema)
    # counts of all ranges of each chunk, and their sums over the chunks before it
    counts = placed.groupBy("_key", "_chunk", "_range").agg(F.count(F.lit(1)).alias("c"))
    found = counts.groupBy("_key", "_chunk").agg(F.map_from_entries(F.collect_list(F.struct("_range", "c"))).alias("m"), F.sum("c").alias("all"))
    every = F.transform(F.sequence(F.lit(0), F.lit(2 * len(shares))), lambda r: F.coalesce(F.try_element_at("m", r), F.lit(0)))
    dense = found.select("_key", "_chunk", "all", F.posexplode(every).alias("_range", "c"))
    lower = W.partitionBy("_key", "_chunk").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    dense = dense.withColumn("below", F.coalesce(F.sum("c").over(lower), F.lit(0)))
    before = W.partitionBy("_key", "_range").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    summed = dense.select("_key", "_chunk", "_range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("below", "c", "all")))
    same = F.col("_key").eqNullSafe(F.col("k")) & F.col("_chunk").eqNullSafe(F.col("h")) & (F.col("_range") == F.col("r"))
    met = placed.join(summed.withColumnsRenamed({"_key": "k", "_chunk": "h", "_range": "r"}), same).drop("k", "h", "r")
    shown = T.StructType([df.schema[c] for c in (by, *order)] + [T.StructField(name, T.DoubleType())])

    def rank(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_chunk", "ascending"), *sort])
        total = table["_below"].to_numpy() + table["_inside"].to_numpy() + 1
        if table["_range"][0].as_py() % 2:
            total = total + table["_c"].to_numpy()
        else:
            total = total + earlier_below(table["_x"].to_numpy(), True)
        share = total / (table["_all"].to_numpy() + table["_nth"].to_numpy())
        return pa.table({c: table[c] for c in (by, *order)} | {name: pa.array(share, pa.float64())})

    # a cut's own range may hold any share of the rows, and needs no order: it is worked out by chunk
    apart = F.when(F.col("_range") % 2 == 1, F.col("_chunk"))
    ranked = met.groupBy("_key", "_range", apart.alias("_apart")).applyInArrow(rank, shown)
    rest = rows.where(F.col("_x").isNull() | F.isnan("_x")).select(by, *order, F.lit(None).cast("double").alias(name))
    return ranked.union(rest)


# ---- recurrences ----


@dataclass(frozen=True)
class Affine:
    """A recurrence whose state behind a chunk is an affine map of the state before it.

    ``lead(n)`` is the state after n rows with its entries that depend on data at 0 (gains and counts depend on n
    alone). ``layers`` are the positions of the others: a layer's map may depend on the layers before it. Positions in
    ``squared`` act by their squares. The map comes from the recurrence's own step, by superposition: the chunk's rows
    from 0 give its constant, empty rows from each unit state its matrix.
    """

    recurrence: Recurrence
    lead: Callable[[int], list]
    layers: tuple[tuple[int, ...], ...]
    squared: frozenset = frozenset()

    def _set(self, n: int, known: Sequence[float]) -> list:
        state = list(self.lead(n))
        for i, v in zip((i for layer in self.layers for i in layer), known):
            state[i] = math.sqrt(max(v, 0.0)) if i in self.squared else float(v)
        return state

    def _get(self, state: list, layer: int) -> list[float]:
        return [state[i] ** 2 if i in self.squared else state[i] for i in self.layers[layer]]

    def _size(self, upto: int) -> int:
        return sum(map(len, self.layers[:upto]))

    def summary(self, layer: int, n: int, known: list[float], rows: list[tuple]) -> list[float]:
        """The constant, then the matrix by columns, of a layer's map over rows that follow n others; ``known`` has the layers before."""
        step, d, whole = self.recurrence.step, len(self.layers[layer]), self._size(len(self.layers))
        state = self._set(n, known + [0.0] * (whole - len(known))) if n else None
        for x in rows:
            state, _ = step(state, x)
        constant = self._get(state, layer)
        if not n:
            return constant + [0.0] * (d * d)
        at = self._size(layer)
        units = [[0.0] * whole] + [[float(j == at + i) for j in range(whole)] for i in range(d)]
        states = [self._set(n, u) for u in units]
        for x in rows:
            void = tuple(None if v is None or v != v else 0.0 for v in x)
            states = [step(s, void)[0] for s in states]
            base, *moved = (self._get(s, layer) for s in states)
            if all(abs(v - b) < GONE for m in moved for v, b in zip(m, base)):
                return constant + [0.0] * (d * d)
        return constant + [v - b for m in moved for v, b in zip(m, base)]

    def move(self, layer: int, summary: Sequence[float], start: Sequence[float]) -> list[float]:
        d = len(self.layers[layer])
        matrix = np.asarray(summary[d:]).reshape(d, d)
        return (np.asarray(summary[:d]) + np.asarray(start) @ matrix).tolist()

    def start(self, n: int, known: list[float]) -> list | None:
        return self._set(n, known) if n else None


@dataclass(frozen=True)
class Product:
    """The forward filter of a hidden Markov model: a product of matrices, up to scale, from which its floor of 1e-10 is left out."""

    recurrence: Recurrence
    trans: tuple = rec.TRANSITIONS
    means: tuple = rec.MEANS
    stds: tuple = rec.STDS
    layers: tuple = ((0, 1, 2),)

    def summary(self, layer: int, n: int, known: list[float], rows: list[tuple]) -> list[float]:
        trans, whole = np.asarray(self.trans), np.eye(len(self.means))
        for (r,) in rows:
            logs = np.array([-0.5 * ((r - m) / d) ** 2 - math.log(d) for m, d in zip(self.means, self.stds)])
            whole = whole @ trans * np.exp(logs - logs.max())
            whole /= whole.max()
        return whole.ravel().tolist()

    def move(self, layer: int, summary: Sequence[float], start: Sequence[float]) -> list[float]:
        p = np.asarray(start) if any(start) else np.ones(len(self.means))
        p = p @ np.asarray(summary).reshape(len(p), len(p))
        p = np.maximum(p / p.sum(), 1e-10)
        return (p / p.sum()).tolist()

    def start(self, n: int, known: list[float]) -> list | None:
        return list(known) if n else None


def _gains(first: list, step: Callable[[list], list]) -> Callable[[int], list]:
    """The state after n rows of data-free entries that start at ``first`` and settle at a fixed point."""

    def lead(n: int) -> list:
        state = first
        for _ in range(n - 1):
            if (moved := step(state)) == state:
                break
            state = moved
        return state

    return lead


def _free_step(r: Recurrence, linear: Sequence[int]) -> Callable[[list], list]:
    """The step of the entries that don't depend on data, with those that do held at 0."""

    def step(state: list) -> list:
        moved = list(r.step(state, (0.0,) * len(r.inputs))[0])
        for i in linear:
            moved[i] = 0.0
        return moved

    return step


def kalman(*args, **kw) -> Affine:
    r = rec.kalman(*args, **kw)
    return Affine(r, _gains(r.step(None, (0.0,))[0], _free_step(r, (0,))), ((0,),))


def velocity_kalman(*args, **kw) -> Affine:
    r = rec.velocity_kalman(*args, **kw)
    return Affine(r, _gains(r.step(None, (0.0,))[0], _free_step(r, (0, 1))), ((0, 1),))


def garch(*args, **kw) -> Affine:
    return Affine(rec.garch(*args, **kw), lambda n: [0.0, 0.0], ((0, 1),), frozenset({1}))


def super_smoother(*args, **kw) -> Affine:
    return Affine(rec.super_smoother(*args, **kw), lambda n: [n, 0.0, 0.0, 0.0], ((1, 2, 3),))


def ultimate_smoother(*args, **kw) -> Affine:
    return Affine(rec.ultimate_smoother(*args, **kw), lambda n: [n, 0.0, 0.0, 0.0, 0.0], ((1, 2, 3, 4),))


def ema(*args, **kw) -> Affine:
    return Affine(rec.ema(*args, **kw), lambda n: [0.0], ((0,),))


def jma(*args, **kw) -> Affine:
    return Affine(rec.jma(*args, **kw), lambda n: [n, 0.0, 0.0, 0.0, 0.0], ((1, 2, 3, 4),))


def smoothed_tr(*args, **kw) -> Affine:
    return Affine(rec.smoothed_tr(*args, **kw), lambda n: [n, 0.0, 0.0, 0.0], ((1, 2, 3),))


def roofing(*args, **kw) -> Affine:
    return Affine(rec.roofing(*args, **kw), lambda n: [0.0] * 6, (tuple(range(6)),))


def stochastic(*args, **kw) -> Affine:
    return Affine(rec.stochastic(*args, **kw), lambda n: [0.0, 0.0], ((0, 1),))


def fisher(*args, **kw) -> Affine:
    return Affine(rec.fisher(*args, **kw), lambda n: [0.0], ((0,),))


def ew_relation(*args, **kw) -> Affine:
    """The means move first; the covariances' map depends on where they stand."""
    return Affine(rec.ew_relation(*args, **kw), lambda n: [0.0] * 5, ((0, 1), (2, 3, 4)))


def regime_forward(ret: str = "ret", trans=rec.TRANSITIONS, means=rec.MEANS, stds=rec.STDS) -> Product:
    return Product(rec.regime_forward(ret, trans, means, stds), trans, means, stds)


def _rows(part: pa.Table, r: Recurrence) -> list[tuple]:
    return list(zip(*(part[c].to_pylist() for c in r.inputs)))


def _ordered(part: pa.Table, order: Sequence[str]) -> pa.Table:
    return part.sort_by([(c, "ascending") for c in order])


def scan_chunks(df: DataFrame, parts: Sequence[Affine | Product], by: str = "symbol", order: Sequence[str] = ("ts",), span: float = SPAN) -> DataFrame:
    """df's key and order columns with the outputs, one row an input row, as ``recursive.scan_all`` has them."""
    need = list(dict.fromkeys(c for p in parts for c in p.recurrence.inputs))
    keep = [by, *order]
    rows = df.select(F.col(by).alias("_key"), chunk_of(span, order[0]).alias("_chunk"), *keep, *[c for c in need if c not in keep]).repartition("_key", "_chunk")
    keys, key_type = ["_key", "_chunk"], df.schema[by].dataType
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    # rows before each chunk; nothing else is known yet
    starts = counts.select(*keys, _before("_key", F.col("c").cast("double"), "_chunk").cast("long").alias("n"), F.lit(None).cast("array<array<double>>").alias("known"))
    layers = max(len(p.layers) for p in parts)
    maps = T.StructType([T.StructField("_key", key_type), T.StructField("_chunk", T.LongType()), T.StructField("n", T.LongType()), T.StructField("known", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("maps", T.ArrayType(T.ArrayType(T.DoubleType())))])

    def met(starts: DataFrame):
        """Chunks with their rows of starts, whose keys get names of their own: both sides come from the same rows."""
        return rows.groupBy(*keys).cogroup(starts.select(F.col("_key").alias("k"), F.col("_chunk").alias("h"), "n", "known").groupBy("k", "h"))

    def summarise(layer: int):
        def run(part: pa.Table, start: pa.Table) -> pa.Table:
            n, known = start["n"][0].as_py(), start["known"][0].as_py() or [[] for _ in parts]
            part = _ordered(part, order)
            found = [p.summary(layer, n, k, _rows(part, p.recurrence)) if layer < len(p.layers) else [] for p, k in zip(parts, known)]
            made = pa.array([found], pa.list_(pa.list_(pa.float64())))
            return pa.table([start["k"], start["h"], start["n"], pa.array([known], made.type), made], names=maps.fieldNames())

        return run

    def chain(layer: int):
        def run(table: pd.DataFrame) -> pd.DataFrame:
            table = table.sort_values("_chunk", na_position="first")
            now = [[0.0] * len(p.layers[layer]) if layer < len(p.layers) else [] for p in parts]
            known = []
            for before, step in zip(table["known"], table["maps"]):
                known.append([[*k, *s] for k, s in zip(before, now)])
                now = [p.move(layer, m, s) if layer < len(p.layers) else s for p, m, s in zip(parts, step, now)]
            return table[[*keys, "n"]].assign(known=known)

        return run

    for layer in range(layers):
        summed = met(starts).applyInArrow(summarise(layer), maps)
        starts = summed.groupBy("_key").applyInPandas(chain(layer), T.StructType(maps.fields[:4]))

    outputs = [o for p in parts for o in p.recurrence.outputs]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(o, T.DoubleType()) for o in outputs])

    def replay(part: pa.Table, start: pa.Table) -> pa.Table:
        part = _ordered(part, order)
        n, known = start["n"][0].as_py(), start["known"][0].as_py()
        columns = [part[c] for c in keep]
        for p, k in zip(parts, known):
            state, made = p.start(n, k), []
            for x in _rows(part, p.recurrence):
                state, y = p.recurrence.step(state, x)
                made.append(y)
            columns += [pa.array([None if v is None else float(v) for v in column], pa.float64()) for column in zip(*made)]
        return pa.table(columns, names=schema.fieldNames())

    return met(starts).applyInArrow(replay, schema)

