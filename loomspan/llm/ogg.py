"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, timestamps.

A payload is stored as 8-bit samples in one logical stream; a second stream, dealt
between its pages, holds an index: for each span of packets the first sample, the
number of samples and their CRC-32. Reading verifies every page's checksum and
sequence number, puts packets together again from lacing values across pages,
separates the streams by serial number and derives times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, strings

FRAME = 192  # samples a frame; payloads are padded to whole frames
PACKET = 10 * FRAME
INDEX_EVERY = 64  # packets that one index packet covers
RATE = 8000
SOUND, INDEX = 0x534E4431, 0x49445831  # serial numbers
_HEAD = struct.Struct("<4sBBqIIIB")
_SOUND_HEAD, _INDEX_HEAD = struct.Struct("<8sHII"), struct.Struct("<8sI")
_ENTRY = struct.Struct("<QII")
# Fixed values of the container: flags of a page.
CONTINUED, FIRST, LAST = 1, 2, 4

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC of a page: polynomial 04C11DB7, start 0, no reflection.

    zlib's CRC-32 is the same division on reflected bytes; with its inversions undone
    and bits reversed on the way in and out, it gives this one at C speed.
    """
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + checksum(page).to_bytes(4, "little") + page[26:]


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes((size % 255,))


def _pages(serial: int, packets: list[tuple[bytes, int]], number: int, final: bool) -> Iterator[tuple[int, bytes]]:
    """Pages of one stream that hold ``packets`` (data, granule at its end); yields the granule and the page."""
    lacing = b"".join(_lacing(len(p)) for p, _ in packets)
    body = b"".join(p for p, _ in packets)
    ends, at = {}, 0
    for p, granule in packets:
        at += len(p) // 255 + 1
        ends[at] = granule
    start = taken = 0
    known = sorted(ends)
    done = 0
    while start < len(lacing):
        own = lacing[start : start + 255]
        size = sum(own)
        stop = start + len(own)
        granule = -1
        while done < len(known) and known[done] <= stop:
            granule = ends[known[done]]
            done += 1
        flags = (CONTINUED if start and start not in ends else 0) | (LAST if final and stop == len(lacing) else 0)
        yield granule, _page(flags, granule, serial, number, own, body[taken : taken + size])
        start, taken, number = stop, taken + size, number + 1


def pad(raw: bytes) -> bytes:
    """Bytes 32 up to a positive multiple of a frame."""
    return raw + b" " * (FRAME - len(raw) if not raw else -len(raw) % FRAME)


def mux(payload: bytes) -> bytes:
    """Store a payload of whole frames. Equal payloads give equal files."""
    if not payload or len(payload) % FRAME:
        raise ValueError("a payload is a positive number of whole frames")
    sound = [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    index, reach = [], INDEX_EVERY * PACKET
    for k in range(0, len(payload), reach):
        span = payload[k : k + reach]
        index.append((_ENTRY.pack(k, len(span), zlib.crc32(span)), k + len(span)))
    out = [
        _page(FIRST, 0, SOUND, 0, *_one(_SOUND_HEAD.pack(b"pcm8mono", 1, RATE, FRAME))),
        _page(FIRST, 0, INDEX, 0, *_one(_INDEX_HEAD.pack(b"crcindex", RATE))),
    ]
    body = [*_pages(SOUND, sound, 1, True)]
    body = [(g if g >= 0 else 0, 0, k, p) for k, (g, p) in enumerate(body)]
    for k in range(1, len(body)):  # a page without a packet's end keeps its place
        body[k] = (max(body[k][0], body[k - 1][0]), *body[k][1:])
    body += [(g, 1, k, p) for k, (g, p) in enumerate(_pages(INDEX, index, 1, True))]
    return b"".join(out + [x[3] for x in sorted(body, key=lambda x: x[:3])])


def _one(packet: bytes) -> tuple[bytes, bytes]:
    return _lacing(len(packet)), packet


class OggError(ValueError):
    """The bytes are not a whole, undamaged file."""


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)  # granule at each packet's end, -1 where the page doesn't tell
    pages: int = 0
    last: bool = False
    open: list[bytes] = field(default_factory=list)


def demux(data: bytes) -> dict[int, Stream]:
    """Logical streams of a file by serial number; raises OggError on any damage."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) < at + _HEAD.size:
            raise OggError("the last page is cut off")
        magic, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError(f"no page begins at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise OggError("the last page is cut off")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"checksum of the page at byte {at}")
        if bool(flags & FIRST) == (serial in streams):
            raise OggError(f"stream {serial:#x} begins twice or never")
        s = streams.setdefault(serial, Stream(serial))
        if s.last or number != s.pages:
            raise OggError(f"stream {serial:#x} lacks page {s.pages}")
        if bool(flags & CONTINUED) != bool(s.open):
            raise OggError(f"stream {serial:#x} goes on with no packet open, or ends none")
        s.pages += 1
        s.last = bool(flags & LAST)
        part = at + 27 + n
        before = len(s.packets)
        size = 0
        for x in lacing:
            size += x
            if x < 255:
                s.packets.append(b"".join([*s.open, data[part : part + size]]))
                s.ends.append(-1)
                s.open, part, size = [], part + size, 0
        if size or (lacing and lacing[-1] == 255):
            s.open.append(data[part : part + size])
        if len(s.packets) > before:
            s.ends[-1] = granule
        at = end
    if any(s.open or not s.last for s in streams.values()):
        raise OggError("a stream has no end")
    return streams


@dataclass
class Sound:
    payload: bytes
    streams: dict[int, Stream]
    times: list[float]  # start of each sound packet in seconds


def read(data: bytes) -> Sound:
    """The payload of a stored file, checked against its index, which must cover all of it; OggError for any other file."""
    streams = demux(data)
    if set(streams) != {SOUND, INDEX}:
        raise OggError("not the two streams that are expected")
    sound, index = streams[SOUND], streams[INDEX]
    for stream, head, name in ((sound, _SOUND_HEAD, b"pcm8mono"), (index, _INDEX_HEAD, b"crcindex")):
        first = stream.packets[0] if stream.packets else b""
        if len(first) != head.size or head.unpack(first)[0] != name:
            raise OggError("unknown headers")
    payload = b"".join(sound.packets[1:])
    done = 0
    for entry in index.packets[1:]:
        if len(entry) != _ENTRY.size:
            raise OggError("an index packet of another size")
        first, n, crc = _ENTRY.unpack(entry)
        if first != done or zlib.crc32(payload[first : first + n]) != crc:
            raise OggError(f"samples from {first} on differ from the index")
        done += n
    if done != len(payload):
        raise OggError("the index does not cover the samples")
    if not sound.packets[1:] or sound.ends[-1] != len(payload):
        raise OggError("the last granule position differs from the samples")
    # within a page only the last packet's end is told; sizes give the others, backwards
    ends = sound.ends[1:]
    for k in range(len(ends) - 2, -1, -1):
        before = ends[k + 1] - len(sound.packets[k + 2])
        if ends[k] not in (-1, before):
            raise OggError("granule positions differ from packet sizes")
        ends[k] = before
    return Sound(payload, streams, [(e - len(p)) / RATE for e, p in zip(ends, sound.packets[1:], strict=True)])


def feature(sound: Sound) -> str:
    """Pages, packets, duration, start of the last packet, mean, power and sign changes of the samples."""
    x = np.frombuffer(sound.payload, np.uint8).astype(np.int64) - 128
    power = int((x * x).sum()) // len(x)
    turns = int(np.count_nonzero(np.diff(np.sign(x - int(x.sum()) // len(x)))))
    pages = sum(s.pages for s in sound.streams.values())
    return f"pages={pages};packets={len(sound.times)};ms={len(x) * 1000 // RATE};last_ms={int(sound.times[-1] * 1000)};mean={int(x.sum()) // len(x)};power={power};turns={turns}"


def text_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text's UTF-8 bytes as sound, read the stored bytes back, compute features.

    A null text counts as the empty one: one frame of bytes 32. Equal texts give equal
    values; repeated rows give repeated rows. With ``keep_media`` the column ``media``
    holds the stored bytes. Only ``id_col`` and ``text`` are read. No row gives none.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * keep_media

    def one(x: str) -> tuple:
        raw = x.encode()
        media = mux(pad(raw))
        sound = read(media)
        row = (len(raw), len(sound.payload), hashlib.sha256(sound.payload).hexdigest(), zlib.crc32(sound.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(sound))
        return (*row, media) if keep_media else row

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            columns = zip(*map(one, strings(batch, "t")), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), work, schema).withColumnRenamed("id", id_col)


def packets(media: DataFrame, id_col: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per packet of any Ogg column: serial, packet, granule (-1: not told), n_bytes; or ``error``.

    Damaged files and nulls give one row with ``error`` set and the rest null.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "serial", "packet", "granule", "n_bytes", "error"]
        for batch in batches:
            ids, rows = batch.column(0), []
            for k, data in enumerate(batch.column(1).to_pylist()):
                try:
                    if data is None:
                        raise OggError("null")
                    rows += [(k, s.serial, n, g, len(p), None) for s in demux(data).values() for n, (p, g) in enumerate(zip(s.packets, s.ends, strict=True))]
                except OggError as e:
                    rows.append((k, None, None, None, None, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], [pa.int64()] * 4 + [pa.string()], strict=True))], names)

    kind = media.schema[id_col].dataType.simpleString()
    out = mapped(media.select(F.col(id_col).alias("id"), F.col(column).alias("m")), work, f"id {kind}, serial long, packet long, granule long, n_bytes long, error string")
    return out.withColumnRenamed("id", id_col)
