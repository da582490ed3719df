"""Helpers shared by the operators: session settings, table folders, byte arrays."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.session import shared_folder

#: Characters deleted or split on by the contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

#: Text bytes handled at once inside a task; bounds the numpy arrays made from them.
SLICE_BYTES = 1 << 20


#: Bytes of an Arrow batch between Spark and a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes: ten thousand whole texts may be any size, on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def give_back() -> None:
    """Return memory that Arrow and the allocator keep after large arrays to the system, so that idle workers are small."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def write_and_reread(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._folder = path  # for ``forget``, without listing the table's files
    return made


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``write_and_reread`` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_keys(row_id, text) -> dict[str, "F.Column"]:
    """k1 and k2: 128 bits by which rows are told apart; rows of equal id (also null) and equal text have equal keys."""
    return {"k1": F.xxhash64(row_id, text), "k2": F.xxhash64(F.lit(1), text, row_id)}


def held_out(doc_id) -> "F.Column":
    """True for the rows that learning never sees: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def slices(text: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a string array of about ``limit`` bytes each (a longer text is one part), nulls as empty."""
    text = text.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    at = 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
        yield at, text.slice(at, to - at)
        at = to


def byte_view(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_string array without nulls; offsets start at 0."""
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def eight_bytes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer, for all places that have them."""
    return np.ndarray(max(0, len(raw) - 7), "<u8", raw.tobytes(), strides=(1,))


def zip_planes(numbers: np.ndarray) -> bytes:
    """Byte planes of unsigned integers, compressed."""
    size = numbers.dtype.itemsize
    planes = numbers.view(np.uint8).reshape(-1, size).T.copy()
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unzip_planes(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
