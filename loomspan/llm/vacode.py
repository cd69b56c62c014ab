"""Codes of vectors: each part is replaced by its nearest codebook entry, found by VA-file filtering.

A codebook's entries are approximated: along each coordinate they fall into cells of a few
bits, each with the least and the largest coordinate in it. For each part that asks, a table holds,
for every coordinate and cell, the least and the largest squared difference possible; summed
along an entry's cells they bound its distance from both sides. Only entries whose
lower bound does not exceed the smallest upper bound are compared exactly. All arithmetic is in whole
numbers, so the same vectors give the same codebooks and codes on any machine, in any order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, mapped, staged
from .vectors import kept, scaled

PARTS, ENTRIES, ROUNDS = 16, 64, 2
CELL_BITS = 3
_BLOCK = 2048  # vectors whose bounds are worked out at once


class Cells:
    """The approximation of one codebook (entries x width): cells along each coordinate, and every entry's cell."""

    def __init__(self, entries: np.ndarray, bits: int = CELL_BITS):
        n, width = entries.shape
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.entries = entries
        self.cell = rank * min(1 << bits, n) // n  # cells hold equal numbers of entries
        cells = int(self.cell.max()) + 1
        self.low, self.high = np.empty((2, width, cells), np.int64)
        for j in range(width):
            for c in range(cells):
                own = entries[self.cell[:, j] == c, j]
                self.low[j, c], self.high[j, c] = own.min(), own.max()

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds (queries x entries) of squared distances, by one table a query."""
        below = queries[:, :, None] - self.low  # queries x width x cells
        above = queries[:, :, None] - self.high
        least = np.maximum(np.maximum(-below, above), 0) ** 2
        most = np.maximum(np.abs(below), np.abs(above)) ** 2
        lower = np.zeros((len(queries), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(queries.shape[1]):
            lower += least[:, j, self.cell[:, j]]
            upper += most[:, j, self.cell[:, j]]
        return lower, upper

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest entry (ties: the lower number) and its squared distance."""
        lower, upper = self.bounds(queries)
        query, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))  # in order of query, then entry
        exact = ((queries[query] - self.entries[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        best = np.minimum.reduceat(exact, first)
        at = np.flatnonzero(exact == np.repeat(best, np.diff(np.append(first, len(query)))))
        at = at[np.append(True, query[at][1:] != query[at][:-1])]
        return entry[at], best


def cells_of(codebooks: np.ndarray) -> list[Cells]:
    return [Cells(book) for book in codebooks]


def encode(vectors: np.ndarray, cells: list[Cells]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (vectors x parts) and squared distances by part."""
    parts = vectors.reshape(len(vectors), len(cells), -1)
    codes, distances = np.empty((2, len(vectors), len(cells)), np.int64)
    for k in range(0, len(vectors), _BLOCK):
        for p, c in enumerate(cells):
            codes[k : k + _BLOCK, p], distances[k : k + _BLOCK, p] = c.nearest(parts[k : k + _BLOCK, p])
    return codes, distances


def decode(codes: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The scaled vectors that codes (vectors x parts) stand for."""
    return np.concatenate([book[codes[:, p]] for p, book in enumerate(codebooks)], axis=1)


def first_entries(rows: DataFrame, d: int, id_col: str, vector: str, parts: int, entries: int) -> np.ndarray:
    """Codebooks (parts x entries x width) from the ``entries`` smallest ids, ascending; rows of one id by vector, rows without an id last."""
    least = rows.orderBy(F.col(id_col).asc_nulls_last(), vector).select(vector).limit(entries).toArrow()
    v = scaled(least.column(0).combine_chunks(), d) if least.num_rows else np.empty((0, d), np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, d // parts).swapaxes(0, 1))


def refined(rows: DataFrame, codebooks: np.ndarray, vector: str) -> np.ndarray:
    """One round: every vector's parts are assigned, and each entry becomes the floored mean of its parts; entries without any stay.

    Tasks add up the parts of their rows, so that each gives as many rows as there are entries at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(cells_of(codebooks))
    parts, entries, width = codebooks.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            v = scaled(batch.column(0), parts * width)
            at = (encode(v, shared.value)[0] + np.arange(parts) * entries).ravel()
            np.add.at(total, at, v.reshape(-1, width))
            count += np.bincount(at, minlength=len(count))
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(count[own]), *(pa.array(total[own, j]) for j in range(width))], ["at", "n", *(f"s{j}" for j in range(width))])

    sums = mapped(rows.select(vector), work, "at long, n long" + "".join(f", s{j} long" for j in range(width)))
    found = sums.groupBy("at").agg(F.sum("n"), *(F.sum(f"s{j}") for j in range(width))).toArrow()
    out = codebooks.reshape(-1, width).copy()
    at, n, *s = (c.to_numpy() for c in found.columns)
    out[at] = np.stack(s, axis=1) // n[:, None] if len(at) else out[at]
    return out.reshape(codebooks.shape)


def codebooks_of(rows: DataFrame, d: int, id_col: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after ``rounds`` of assignment and means over all rows."""
    if d % parts:
        raise ValueError(f"{d} components cannot be cut into {parts} equal parts")
    books = first_entries(rows, d, id_col, vector, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(rows, books, vector)
    return books


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS) -> DataFrame:
    """Per usable row: id, code (hex), error, label_error, codebooks_sha256.

    Rows whose vector is null, empty, or holds a null or non-finite component are dropped, and so are vectors of another
    number of components than that of the smallest id. That number must be a multiple of ``parts``, and scaled components
    must stay below 2**24; else it is an error. Fewer than 64 rows make fewer entries. Repeated rows give repeated rows; rows
    without an id or a label are coded like others, those without a label share one sum. No row gives none. Other columns are not read.
    """
    source = rows.select(F.col(id_col).alias("id"), F.col(vector).alias("v"), F.col(label).alias("l"))
    source, d = kept(source, "id", "v")
    books = codebooks_of(source, d, "id", "v", parts)
    shared = rows.sparkSession.sparkContext.broadcast(cells_of(books) if books.shape[1] else [])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, distances = encode(scaled(batch.column(1), d), shared.value)
                text = [c.tobytes().hex() for c in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(text), pa.array(distances.sum(axis=1))], ["id", "l", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    coded = staged(mapped(source, work, f"id {kinds['id']}, l {kinds['l']}, code string, error long"))
    out = summed(coded)
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def summed(coded: DataFrame) -> DataFrame:
    """Adds label_error: the errors of all rows of a label together; rows without a label share one sum."""
    sums = coded.groupBy("l").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return joined(coded, staged(sums), "l", "n")
