"""Streams: routing messages, stateful recurrences, windowed sentiment, sinks."""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.recursive import Recurrence
from tidemark.operators.sentiment import windowed_sentiment


def read_files(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder (or one file by glob) of Parquet as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Key and value of a topic as text; needs Spark's Kafka package on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def route(messages: DataFrame, text: str = "value") -> dict[str, DataFrame]:
    """Messages by their type field: ohlcv (the default), orderbook, trade; without a symbol or of poor quality they are dropped."""
    kind = F.coalesce(F.get_json_object(text, "$.type"), F.lit("ohlcv"))
    quality = F.coalesce(F.get_json_object(text, "$.quality_score").try_cast("double"), F.lit(1.0))
    good = messages.where((F.coalesce(F.get_json_object(text, "$.symbol"), F.lit("")) != "") & (quality >= 0.5))
    return {k: good.where(kind == k) for k in ("ohlcv", "orderbook", "trade")}


#: Rows of a key that are stepped through before they are handed on.
STRETCH = 20_000


def _in_order(rows: pd.DataFrame, order: Sequence[str]) -> pd.DataFrame:
    keys = [rows[c].to_numpy() for c in reversed(order)]
    if any(k.dtype == object for k in keys):
        return rows.sort_values(list(order), kind="stable")
    return rows.take(np.lexsort(keys))


def scan_stream(df: DataFrame, recurrences: Sequence[Recurrence], by: str = "symbol", order: Sequence[str] = ("ts",), idle: int | None = None) -> DataFrame:
    """The recurrences of ``scan_all`` over a stream: the same step functions on keyed state.

    Rows of a micro-batch are put in order by key, as columns of numbers, and stepped through in stretches, so a row of
    the micro-batch takes some tens of bytes of its task's memory; state survives restarts in the checkpoint. A
    row that comes before one that was already stepped through (by ``order``) is late: a
    recurrence can't take it back, so it is left out. With ``idle`` a key
    that has had no row for so many seconds of processing time forgets its state and begins anew; such a stream
    waits for its clocks and so never drains.
    """
    need = list(dict.fromkeys(c for r in recurrences for c in r.inputs))
    keep = [by, *order]
    part = df.select(*keep, *[c for c in need if c not in keep])
    columns = [c for c in part.columns if c != by]
    schema = T.StructType([part.schema[c] for c in keep] + [T.StructField(o, T.DoubleType()) for r in recurrences for o in r.outputs])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = json.loads(state.get[0]) if state.exists else ([None] * len(recurrences), None)
        rows = _in_order(pd.concat([batch[columns] for batch in batches], ignore_index=True), order)
        stamps = rows[list(order)]
        place = lambda i: [v.value if isinstance(v, pd.Timestamp) else v for v in next(stamps.iloc[i : i + 1].itertuples(index=False))]
        first = bisect.bisect_right(range(len(rows)), last, key=place) if last is not None else 0
        if idle is not None:
            state.setTimeoutDuration(idle * 1000)
        for at in range(first, len(rows), STRETCH):
            some = rows.iloc[at : at + STRETCH]
            out = {by: [key[0]] * len(some), **{c: some[c] for c in order}}
            for i, r in enumerate(recurrences):
                made = []
                for x in zip(*[some[c].tolist() for c in r.inputs]):
                    held[i], y = r.step(held[i], x)
                    made.append(y)
                out.update({o: [None if v is None else float(v) for v in column] for o, column in zip(r.outputs, zip(*made))})
            if at + STRETCH >= len(rows):
                state.update((json.dumps([held, place(len(rows) - 1)]),))
            yield pd.DataFrame(out)

    timeout = GroupStateTimeout.NoTimeout if idle is None else GroupStateTimeout.ProcessingTimeTimeout
    return part.groupBy(by).applyInPandasWithState(step, schema, "state string", "append", timeout)


def unseen(posts: DataFrame, late: str = "1 hour", key: str = "id") -> DataFrame:
    """Each id once, remembered as long as the watermark allows."""
    return posts.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sentiment_stream(posts: DataFrame, minutes: int, late: str = "30 minutes") -> DataFrame:
    """Windowed sentiment; windows close when the watermark passes them."""
    return windowed_sentiment(posts.withWatermark("ts", late), minutes)


def bars_stream(ticks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of trades by event time."""
    at = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", length).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("quantity").alias("volume"), F.count(F.lit(1)).alias("trades")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "trades")


def latest_sink(path: str, by: str = "symbol", at: str = "ts") -> Callable[[DataFrame, int], None]:
    """foreachBatch: keep the newest row of each key.

    A batch is folded into the table of the batch before it and written as a table of its own,
    so the last one alone is read; the one before stays for a batch that is run again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _versions(spark, path) if n < batch_id]
        rows = batch.unionByName(spark.read.parquet(f"{path}/batch={max(before):012d}")) if before else batch
        row = F.struct(at, *[c for c in batch.columns if c not in (by, at)])
        rows.groupBy(by).agg(F.max_by(row, F.col(at)).alias("r")).select(by, "r.*").write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")
        for n in before[:-1]:
            _folder(spark, f"{path}/batch={n:012d}", delete=True)

    return write


def _folder(spark: SparkSession, path: str, delete: bool = False):
    """The names in a folder of the shared file system; or the folder deleted."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if delete:
        return files.delete(place, True)
    return [x.getPath().getName() for x in files.listStatus(place)] if files.exists(place) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batches whose table is complete."""
    return sorted(int(n.removeprefix("batch=")) for n in _folder(spark, path) if n.startswith("batch=") and "_SUCCESS" in _folder(spark, f"{path}/{n}"))


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of each key as of the last complete batch."""
    return spark.read.parquet(f"{path}/batch={_versions(spark, path)[-1]:012d}")


def to_messages(signals: DataFrame, key: str = "symbol", kind: str | None = None) -> DataFrame:
    """key and value (JSON of all columns, with the kind of signal) as a Kafka sink takes them."""
    columns = ([F.lit(kind).alias("type")] if kind else []) + [F.col(c) for c in signals.columns]
    return signals.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*columns)).alias("value"))


def publish(signals: DataFrame, servers: str, topic: str, checkpoint: str | None = None, key: str = "symbol", kind: str | None = None):
    """Write signals to a topic: a batch at once, a stream until it is stopped; needs Spark's Kafka package on the cluster."""
    out = to_messages(signals, key, kind)
    options = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all"}
    if signals.isStreaming:
        return out.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).start()
    return out.write.format("kafka").options(**options).save()


def from_messages(messages: DataFrame, schema: str) -> DataFrame:
    """Columns of JSON messages; rows that don't parse are null throughout and dropped."""
    return messages.select(F.from_json("value", schema).alias("m")).where("m is not null").select("m.*")


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now into a Parquet table, and stop."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
