"""Shards by jump consistent hashing: key and shard count decide, without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

# Fixed value: the multiplier of the published jump consistent hash.
_MULTIPLIER = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key. One more shard takes keys only into itself.

    Each key's own pseudo-random sequence tells at which shard counts it moves; the
    last move below ``shards`` is its shard. All keys step together.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = np.asarray(keys).astype(np.uint64)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        state[live] = state[live] * _MULTIPLIER + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        to = np.floor((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live, to = live[to < shards], to[to < shards]
        at[live] = to
    return at


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a long column as a column; null keys count as 0."""

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.fillna(0).to_numpy(np.int64), shards).astype(np.int32))

    return place(F.coalesce(key, F.lit(0).cast("long")))


def assign_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Deal rows to ``shards`` by their stable key; number the rows of each shard from 0.

    Integer ids are keys as they are, other kinds by a 64-bit hash; a null id counts as
    key 0. A null text has size ``overhead`` and checksum 0. Repeated rows get slots of
    their own. Rows with one key share a shard, as the law demands; they are dealt to buckets by their texts as well, so many of
    them are not in one task. Slots follow from counts by shard and hash bucket, so that no task holds a whole shard. No row
    gives none, and columns other than ``id_col`` and ``text`` are not read.
    """
    kind = docs.schema[id_col].dataType.typeName()
    integral = kind in ("long", "integer", "short", "byte")
    key = F.col(id_col).cast("long") if integral else F.xxhash64(id_col)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = docs.select(
        F.col(id_col), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.lit("key").alias("law"),
        shard_of(key, shards).alias("shard"), shard_of(key, shards + 1).alias("grown_shard"),
    )
    return ranked(out, "shard", [id_col, "size", "text_crc32"], "slot", spread=[id_col, "size", "text_crc32"], few_keys=shards)
