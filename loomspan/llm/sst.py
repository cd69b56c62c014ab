"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter, footer.

File: blocks, index, filter, footer. A block holds entries in key order; an entry has
the number of key bytes shared with the entry before, its other key bytes and its
value; every 16th entry shares none. A CRC-32 ends each block. The index has the last
key, place and size of each block; the filter has the keys; the footer of fixed size has
the places of both and the totals. A lookup reads footer, filter and index, finds the
block by binary search and reads that block alone.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .codec import codec
from .common import mapped, shared_dir, slices, staged, strings

MAGIC = b"LOOMSST1"
_FOOTER = struct.Struct("<QQQQQQI8s")  # index place, size; filter place, size; entries, ids; CRC of both; magic
RESTART = 16
READERS = 10_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def key_bytes(key: int) -> bytes:
    """Eight bytes in the order of the signed integers."""
    return (key + (1 << 63)).to_bytes(8, "big")


def _key_int(raw: bytes) -> int:
    return int.from_bytes(raw, "big") - (1 << 63)


def pack_ids(ids: np.ndarray) -> bytes:
    """A width byte, then ids of two or four bytes each."""
    wide = len(ids) and int(ids.max()) > 0xFFFF
    return b"\x04" + ids.astype("<u4").tobytes() if wide else b"\x02" + ids.astype("<u2").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u4" if value[0] == 4 else "<u2", offset=1).astype(np.uint32)


def _bloom_bits(keys: np.ndarray, bits: int) -> np.ndarray:
    x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    step = x * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)
    return np.stack([(x + np.uint64(k) * step) % np.uint64(bits) for k in range(6)])


class Writer:
    """Writes one file; keys must not fall. Entries with equal keys keep the order in which they are added."""

    def __init__(self, out, block: int = 1 << 16):
        self.out, self.block = out, block
        self.at = self.n_ids = self.entries = self.in_block = 0
        self.parts: list[bytes] = []
        self.size = 0
        self.last = b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[int] = []

    def add(self, key: int, ids: np.ndarray) -> None:
        raw, value = key_bytes(key), pack_ids(ids)
        if self.entries and raw < self.last:
            raise ValueError("keys must not fall")
        shared = 0
        if self.in_block % RESTART:
            while shared < 8 and raw[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(8 - shared) + _varint(len(value)) + raw[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.last, self.in_block, self.entries, self.n_ids = raw, self.in_block + 1, self.entries + 1, self.n_ids + len(ids)
        self.keys.append(key)
        if self.size >= self.block:
            self._end_block()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _end_block(self) -> None:
        if self.parts:
            data = b"".join(self.parts)
            data += zlib.crc32(data).to_bytes(4, "little")
            self.index.append((self.last, self.at, len(data)))
            self._put(data)
            self.parts, self.size, self.in_block = [], 0, 0

    def finish(self) -> None:
        self._end_block()
        index = b"".join(k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, 10 * len(self.keys))
        marks = np.zeros(bits, np.uint8)
        if self.keys:
            marks[_bloom_bits(np.array(self.keys, np.int64), bits).ravel()] = 1
        bloom = bits.to_bytes(8, "little") + np.packbits(marks).tobytes()
        place = self.at
        self._put(index)
        self._put(bloom)
        self._put(_FOOTER.pack(place, len(index), place + len(index), len(bloom), self.entries, self.n_ids, zlib.crc32(index + bloom), MAGIC))


class Reader:
    """Reads one file through an object with seek() and read()."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - _FOOTER.size)
        place, n, bloom_at, bloom_n, self.entries, self.n_ids, crc, magic = _FOOTER.unpack(source.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table, or cut off")
        source.seek(place)
        tail = source.read(n + bloom_n)
        if zlib.crc32(tail) != crc:
            raise ValueError("index or filter is damaged")
        self.index = [(tail[k : k + 8], *struct.unpack_from("<QQ", tail, k + 8)) for k in range(0, n, 24)]
        self.bits = int.from_bytes(tail[n : n + 8], "little")
        self.marks = np.frombuffer(tail, np.uint8, offset=n + 8)

    def _block(self, at: int, size: int) -> Iterator[tuple[int, bytes]]:
        self.source.seek(at)
        data = self.source.read(size)
        if zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "little"):
            raise ValueError(f"block at {at} is damaged")
        k, key = 0, b""
        while k < size - 4:
            shared, k = _read_varint(data, k)
            own, k = _read_varint(data, k)
            n, k = _read_varint(data, k)
            key = key[:shared] + data[k : k + own]
            k += own
            yield _key_int(key), data[k : k + n]
            k += n

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        for _, at, size in self.index:
            for key, value in self._block(at, size):
                yield key, unpack_ids(value)

    def may_have(self, key: int) -> bool:
        at = _bloom_bits(np.array([key], np.int64), self.bits).ravel().astype(np.int64)
        return bool((self.marks[at >> 3] >> (7 - (at & 7)) & 1).all())

    def get(self, key: int) -> list[np.ndarray]:
        """All values of a key, from the filter, the index and the blocks that can have it."""
        if not self.may_have(key):
            return []
        raw, out = key_bytes(key), []
        k = bisect.bisect_left(self.index, raw, key=lambda x: x[0])
        while k < len(self.index):
            out += [unpack_ids(v) for own, v in self._block(*self.index[k][1:]) if own == key]
            if self.index[k][0] > raw:
                break
            k += 1
        return out


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text", most: int = 64 << 20) -> DataFrame:
    """Write documents in ascending id order; returns the list of files: file, part, number, first_key, last_key, n_docs, n_ids, n_bytes.

    Range partitions are written by their tasks, each into files of about ``most``
    bytes with names of their own; a file that a lost task left is in no list. Files follow
    each other by part and number. Rows without an id count as id -2**63. Null texts have
    ``end_id`` alone. Rows with one id follow each other by a hash of the text; they can lie
    in several partitions, so an id that many rows have is no task's burden.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        writer = out = None
        rows = []
        part = TaskContext.get().partitionId()

        def end() -> None:
            writer.finish()
            out.close()
            rows.append((f"{folder}/{name}", part, len(rows), writer.keys[0], writer.keys[-1], writer.entries, writer.n_ids, writer.at))

        for batch in slices(batches, "t"):
            for key, ids in zip(batch.column(0).to_pylist(), own.encode(strings(batch, "t")), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.sst"
                    out = system.open_output_stream(f"{base}/{name}")
                    writer = Writer(out)
                writer.add(key, np.append(ids, end_id))
                if writer.at + writer.size >= most:
                    end()
                    writer = None
        if writer is not None:
            end()
        kinds = [pa.string()] + [pa.int64()] * 7
        columns = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "part", "number", "first_key", "last_key", "n_docs", "n_ids", "n_bytes"])

    # the place of a row in the input parts repeated rows, so the ranges can split them too
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("place"))
    rows = rows.withColumn("h", F.xxhash64("t"))
    dealt = rows.repartitionByRange("id", "h", "place").sortWithinPartitions("id", "h", "place").select("id", "t")
    return staged(mapped(dealt, work, "file string, part long, number long, first_key long, last_key long, n_docs long, n_ids long, n_bytes long"))


def read_shards(files: DataFrame, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Rows of all files: id, start (ids of all documents before), n_tokens, ids_crc32 (and ids).

    Up to READERS tasks read, each its share of the files.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("part", "number", "file", "n_bytes", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))  # one row a file
    readers = max(1, min(READERS, files.count()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids
        kinds = [pa.int64()] * 4 + [pa.list_(pa.uint32())] * keep_ids
        for batch in batches:
            for uri, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = _open(uri)
                rows, held = [], 0
                with system.open_input_file(place) as source:
                    for key, ids in Reader(source, size).scan():
                        rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), *([ids] if keep_ids else [])))
                        start += len(ids)
                        held += len(ids) if keep_ids else 1
                        if held >= 1 << 18:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return mapped(listed.repartitionByRange(readers, "part", "number").select("file", "n_bytes", "base"), work, schema)


def lookup(files: DataFrame, keys: list[int]) -> dict[int, list[np.ndarray]]:
    """Values of a few keys, each by binary search in the files whose range can have it."""
    out: dict[int, list[np.ndarray]] = {k: [] for k in keys}
    for key in keys:
        for r in files.where((F.col("first_key") <= key) & (F.col("last_key") >= key)).orderBy("part", "number").collect():
            system, place = _open(r.file)
            with system.open_input_file(place) as source:
                out[key] += Reader(source, r.n_bytes).get(key)
    return out


def round_trip(spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards below the shared folder and read them back: id, start, n_tokens, ids_crc32 of each document.

    A null text counts as the empty one, whose only id is ``end_id``. Repeated rows are stored each, those of one id in order of a hash of their
    texts; rows without an id come first. Only ``id_col`` and ``text`` are read. No row gives none.
    """
    return read_shards(write_shards(docs, path, f"{shared_dir(spark)}/sst", end_id, id_col, text), id_col)
