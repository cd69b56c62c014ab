"""Best-fit packing by linear grouping, planned on the histogram of lengths.

Only the counts of each length (at most ``capacity`` numbers, whatever the corpus)
reach the driver. Large lengths, in falling order, are cut into groups of equal
cardinality and rounded up to their group's largest; configurations of these few
sizes are optimised one after the other by a bounded knapsack. Actual documents
then take the places of their groups, which opens gaps; small ones fill the gaps,
longest first, each into the tightest that holds it. The plan is a list of ranges
of ranks by length, so every piece finds its place by its length and rank.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import codec
from .common import mapped, ranked, slices, staged, strings


PLAN_ROWS = 1 << 22  # of 32 bytes, that a plan may have


@dataclass
class Run:
    """``n`` sequences that hold the same lengths."""

    n: int
    lengths: list[int]
    free: int


class _Stream:
    """Counts of lengths in falling order, taken from the front."""

    def __init__(self, counts: list[tuple[int, int]]):
        self.counts = [list(x) for x in counts]
        self.at = 0

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            length, have = self.counts[self.at]
            own = min(n, have)
            out.append((length, own))
            self.counts[self.at][1] -= own
            self.at += self.counts[self.at][1] == 0
            n -= own
        return out


def _groups(large: list[tuple[int, int]], groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(rounded size, counts by actual length) of groups of equal cardinality, longest first."""
    total = sum(n for _, n in large)
    stream, out, done = _Stream(large), [], 0
    for g in range(1, groups + 1):
        upto = total * g // groups
        if upto > done:
            own = stream.take(upto - done)
            out.append((own[0][0], own))
            done = upto
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for size, own in out:
        if merged and merged[-1][0] == size:
            merged[-1] = (size, merged[-1][1] + own)
        else:
            merged.append((size, own))
    return merged


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> Iterator[tuple[int, list[int]]]:
    """(times, how many of each size): the fullest configuration that has the largest size left, as often as counts allow."""
    left = list(counts)
    while True:
        lead = next((g for g, n in enumerate(left) if n), None)
        if lead is None:
            return
        room = capacity - sizes[lead]
        reach, trail = 1, []
        mask = (1 << (room + 1)) - 1
        for g in range(lead, len(sizes)):
            trail.append(reach)
            for _ in range(min(left[g] - (g == lead), room // sizes[g])):
                wider = reach | (reach << sizes[g] & mask)
                if wider == reach:
                    break
                reach = wider
        fill = reach.bit_length() - 1
        use = [0] * len(sizes)
        use[lead] = 1
        for g in range(len(sizes) - 1, lead - 1, -1):
            while not trail[g - lead] >> fill & 1:
                use[g] += 1
                fill -= sizes[g]
        times = min(left[g] // u for g, u in enumerate(use) if u)
        for g, u in enumerate(use):
            left[g] -= u * times
        yield times, use


def _substitute(times: int, use: list[int], streams: list[_Stream], capacity: int) -> list[Run]:
    """Actual lengths in the places of a configuration, cut where any place changes its length."""
    places = [streams[g].take(times) for g, u in enumerate(use) for _ in range(u)]
    runs, at = [], [0] * len(places)
    left = [p[0][1] for p in places]
    done = 0
    while done < times:
        n = min(left)
        lengths = [p[k][0] for p, k in zip(places, at, strict=True)]
        runs.append(Run(n, lengths, capacity - sum(lengths)))
        done += n
        for k, p in enumerate(places):
            left[k] -= n
            if not left[k] and done < times:
                at[k] += 1
                left[k] = p[at[k]][1]
    return runs


def _best_fit(runs: list[Run], small: list[tuple[int, int]], capacity: int) -> list[Run]:
    gaps: list[list[Run]] = [[] for _ in range(capacity + 1)]
    for r in runs:
        gaps[r.free].append(r)
    for length, count in small:
        free = length
        while count:
            while free <= capacity and not gaps[free]:
                free += 1
            if free > capacity:
                each = min(count, capacity // length)
                n = count // each
                gaps[capacity - each * length].append(Run(n, [length] * each, capacity - each * length))
                count -= n * each
                free = length
                continue
            run = gaps[free].pop()
            each = min(free // length, count)
            n = min(run.n, count // each)
            if n < run.n:
                gaps[free].append(Run(run.n - n, run.lengths, free))
            gaps[free - each * length].append(Run(n, run.lengths + [length] * each, free - each * length))
            count -= n * each
            free = length
    return [r for g in gaps for r in g]


def plan(counts: dict[int, int], capacity: int, groups: tuple[int, ...] = (16, 64, 256), large: tuple[float, ...] = (0.5, 0.25, 0.125)) -> list[Run]:
    """Runs of sequences for all lengths; of the numbers of groups and bounds of large ones, those that need the fewest sequences."""
    whole = counts.get(capacity, 0)
    rest = sorted(((k, n) for k, n in counts.items() if n and k < capacity), reverse=True)
    best: list[Run] | None = None
    bound = -(-sum(k * n for k, n in rest) // capacity)
    for share in large:
        big = [x for x in rest if x[0] > share * capacity]
        small = [x for x in rest if x[0] <= share * capacity]
        for g in groups:
            grouped = _groups(big, g)
            streams = [_Stream(own) for _, own in grouped]
            runs: list[Run] = []
            for times, use in _configurations([s for s, _ in grouped], [sum(n for _, n in own) for _, own in grouped], capacity):
                runs += _substitute(times, use, streams, capacity)
            runs = _best_fit(runs, small, capacity)
            if best is None or sum(r.n for r in runs) < sum(r.n for r in best):
                best = runs
            if sum(r.n for r in best) == bound:
                break
    return ([Run(whole, [capacity], 0)] if whole else []) + (best or [])


def placements(runs: list[Run]) -> pd.DataFrame:
    """length, first (rank), sequence (of that rank), offset: sorted by length and first rank."""
    rows, taken, sequence = [], {}, 0
    for r in runs:
        offset = 0
        for length in r.lengths:
            first = taken.get(length, 0)
            rows.append((length, first, sequence, offset))
            taken[length] = first + r.n
            offset += length
        sequence += r.n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def tokenized(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document: id, piece, start, length, ids_crc32 (and ids)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, "t"):
            rows, flat = [], []
            for k, ids in enumerate(own.encode(strings(batch, "t"))):
                ids = np.append(ids, end_id).astype("<u4")
                for p in range(0, len(ids), capacity):
                    part = ids[p : p + capacity]
                    rows.append((k, p // capacity, p, len(part), zlib.crc32(part.tobytes())))
                    if keep_ids:
                        flat.append(part.astype(np.int32))
            k, piece, start, length, crc = map(np.array, zip(*rows, strict=True))
            columns = [batch.column(0).take(pa.array(k)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(flat, pa.list_(pa.int32()))] if keep_ids else []), ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), work, schema).withColumnRenamed("id", id_col)


def pack(pieces: DataFrame, capacity: int, order: list[str], length: str = "length") -> DataFrame:
    """Add sequence_id and offset to rows that have a ``length`` from 1 to ``capacity``.

    Rows of one length are ranked over hash buckets, so neither a length that a
    third of all rows have nor a large corpus lands in one task. The plan that is broadcast
    has a row for each place of each run; runs end where some place changes its length, so their
    number depends on ``capacity`` and the groups, not on how many rows there are; PLAN_ROWS is checked.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}  # at most ``capacity`` rows
    table = placements(plan(counts, capacity))
    if len(table) > PLAN_ROWS:
        raise ValueError(f"a plan of {len(table)} rows")
    shared = spark.sparkContext.broadcast((table["length"].to_numpy() << 40 | table["first"].to_numpy(), table["first"].to_numpy(), table["sequence"].to_numpy(), table["offset"].to_numpy()))

    @F.pandas_udf("sequence_id long, offset long")
    def place(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, sequence, offset = shared.value
        k = np.searchsorted(keys, n.to_numpy(np.int64) << 40 | rank.to_numpy(np.int64), side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[k] + rank.to_numpy(np.int64) - first[k], "offset": offset[k]})

    out = ranked(pieces, length, order, "_rank", spread=order, few_keys=capacity, buckets=128)
    return out.withColumn("_at", place(F.col(length), F.col("_rank"))).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut what is longer than ``capacity``, pack.

    A null text counts as the empty one and has one id, ``end_id``. Repeated rows are
    packed each. Pieces of a document may lie in different sequences. Only ``id_col`` and
    ``text`` are read. No row gives none. A plan of more than PLAN_ROWS rows is an error.
    """
    pieces = staged(tokenized(docs, path, capacity, end_id, id_col, text, keep_ids))
    return pack(pieces, capacity, [id_col, "piece"])
