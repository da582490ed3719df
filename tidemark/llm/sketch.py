"""A sketch of a set of keys, to keep rows out of joins that can't concern them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import row_keys

#: Bits of the sketch for each key, and its least and most bits (32 MB). A set of more keys than that leaves more of
#: the other rows in doubt; the join that follows decides on all of these, whatever the size.
BITS_EACH, LEAST_BITS, MOST_BITS = 8, 1 << 20, 1 << 28


def sketched(keys: DataFrame):
    """A function of a 64-bit key: false only for keys that ``keys`` (one column of longs) lacks."""
    n = keys.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(1, n * BITS_EACH).bit_length()))
    bit = F.pmod(F.col(keys.columns[0]), F.lit(bits))
    words = keys.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    found = words.toArrow()  # bits / 64 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        at = np.mod(h.to_numpy(np.int64), bits)
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return may


def without(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs less the rows whose keys (``row_keys``) marks(k1, k2, stay) has with stay false; of those with stay true, one row a key.

    Rows that the sketch clears stay where they lie; only the others meet ``marks`` in a join.
    """
    may = sketched(marks.select("k1"))
    keyed = docs.select(F.struct("*").alias("row"), *(k.alias(name) for name, k in row_keys(F.col(id_col), F.col(text_col)).items()))
    doubt = may(F.col("k1"))
    met = keyed.where(doubt).join(marks, ["k1", "k2"], "left")
    left = keyed.where(~doubt).select("row.*").union(met.where("stay is null").select("row.*"))
    if marks.where("stay").isEmpty():
        return left
    return left.union(met.where("stay").dropDuplicates(["k1", "k2"]).select("row.*"))
