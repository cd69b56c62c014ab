"""Helpers the operators share: staged tables, Arrow batches cut by bytes, distributed ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import read_table, shared_dir, staged  # noqa: F401


BATCH_BYTES = "4m"


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches of about BATCH_BYTES, however long the rows are.

    Spark counts rows unless told otherwise, and each task holds a batch in the JVM and one
    in its worker. The bound is a setting of the session, which keeps it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        _released()

    return df.mapInArrow(run, schema)


def _released() -> None:
    """Give memory that a task has freed back to the machine: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``most`` bytes of ``text`` (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for k, x in enumerate(lengths):
            if total and total + x > most:
                yield batch.slice(start, k - start)
                start, total = k, 0
            total += x
        yield batch.slice(start, n - start)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as the empty string."""
    return ["" if x is None else x for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]


FILTER_WORDS = 1 << 20  # of 64 bits, at most, in a broadcast filter


def _bits(name: str, blocks: int) -> list[Column]:
    """A key's word in a filter and its four bits there."""
    block = F.pmod(F.xxhash64(F.lit(3), name), F.lit(blocks)).cast("int")
    bits = (f"shiftleft(1L, CAST(shiftrightunsigned(xxhash64(3, `{name}`), {k}) & 63 AS INT))" for k in (40, 46, 52, 58))
    return [block.alias("block"), F.expr(" | ".join(bits)).alias("mask")]


def bloom_words(keys: DataFrame, key: str) -> np.ndarray | None:
    """A blocked Bloom filter of the distinct keys, FILTER_WORDS words at most; None where they are too many for that."""
    n = keys.count()
    if n > 8 * FILTER_WORDS:
        return None
    blocks = min(FILTER_WORDS, max(64, 1 << (n // 4).bit_length()))
    rows = keys.select(*_bits(key, blocks)).groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()  # a row for each word at most
    words = np.zeros(blocks, np.int64)
    words[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return words


def likely_among(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose long ``column`` may be among the distinct ``keys``, so that a join need not move the others.

    All rows with a key stay, and few others; where the keys are too many for a filter, all rows stay.
    """
    words = bloom_words(keys, key)
    if words is None:
        return df
    blocks = len(words)
    shared = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def may_be(block: pd.Series, mask: pd.Series) -> pd.Series:
        m = mask.to_numpy()
        return pd.Series(shared.value[block.to_numpy()] & m == m)

    return df.where(may_be(*_bits(column, blocks)))


HEAVY = 1000  # keys that each have more than this part of all rows are fewer than this


def joined(df: DataFrame, table: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``df`` with ``table``, which has one row a key, nulls equal; ``weight`` counts the rows of a key and is dropped.

    Rows of heavy keys stay where they are and their few table rows are broadcast; other rows move to their key's
    row. No task gets all rows of a heavy key. ``df`` is read twice and ``table`` three times, so both should be written.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    table = table.withColumnRenamed(key, "_joined")
    is_heavy = F.col(weight) * HEAVY > total
    heavy, light = (table.where(x).drop(weight) for x in (is_heavy, ~is_heavy))
    same = F.col(key).eqNullSafe(F.col("_joined"))
    heavy = F.broadcast(heavy)  # fewer than HEAVY rows
    rest = df.join(heavy.select("_joined"), same, "left_anti").join(light, same)
    return df.join(heavy, same).unionByName(rest).drop("_joined")


def ranked(df: DataFrame, key: str, order: list[str], rank: str, spread: list[str], few_keys: int, buckets: int = 256) -> DataFrame:
    """Number the rows of each ``key`` from 0 without one task holding a whole key.

    Rows of a key are dealt to ``buckets`` by a hash of the columns ``spread``; the
    bucket sizes give each bucket its first number. There are at most ``few_keys`` keys,
    so at most ``few_keys * buckets`` sizes.
    """
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(F.col(key).alias("_key"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    if few_keys * buckets <= 1 << 18:
        first = F.broadcast(first)  # at most 2**18 short rows
    out = df.withColumn("_own", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1)
    out = out.join(first, (out[key] == first["_key"]) & (out["_bucket"] == first["_b"]))
    return out.withColumn(rank, (F.col("_first") + F.col("_own")).cast("long")).drop("_bucket", "_own", "_key", "_b", "_first")
