"""Repeated byte strings by suffix arrays over the places where texts can repeat.

Every string of ``length`` bytes has one anchor, the leftmost of its smallest k-gram hashes. Hashes are
compared whole and depend on the k-gram's bytes alone, so equal strings have equal anchors wherever they stand. Neighbouring strings with one anchor make a segment. Only
segments whose anchor occurs again can hold a repeated string; those of one anchor that
are all equal (by 128 bits) are repeated as a whole. The others meet, distinct ones once, in
shards made by anchor: each shard's suffix array is refined by Larsson and Sadakane's
doubling in numpy, Kasai's walk gives common prefixes, all segments in parallel, and
adjacent suffixes that share ``length`` bytes are repeated. A group that needs
several shards is merged by binary search of each shard's strings in the others' suffix
arrays. A group of more than GROUP distinct segments is first split: each of its strings has half of
what its anchor leaves on one side of it, so the anchor grown by that half to the left, or to the
right, divides the strings, and what then is alone or all equal is decided; the rest goes the same way again.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, likely_among, mapped, slices, staged, strings

GRAM = 40  # bytes of an anchor
SHARD = 1 << 20  # bytes of text in a shard
GROUP = 20_000  # distinct segments of one anchor that meet in one task
SLICE = 1 << 18  # bytes of texts that are cut at once
_BASE = 0x9E6C63D0876A9A55  # odd, so powers have inverses


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


_POWERS = _Powers()


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    _POWERS.reach(len(raw) + 1)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw + np.uint64(1)) * _POWERS.up[: len(raw)], dtype=np.uint64)))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, the same for the same bytes anywhere."""
    h = (sums[ends] - sums[starts]) * _POWERS.down[starts]
    h = (h ^ (ends - starts).astype(np.uint64)) * np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0xD6E8FEB86659FD93)) ^ h >> np.uint64(29)


gram_hash = span_hash  # of anchors; tests put one with few values in its place


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, by doubling."""
    have, out = 1, x
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def leftmost_min(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value among each ``width`` neighbours, the leftmost of equal ones. It depends on these values alone."""
    low = sliding_min(x, width)
    own = x[: len(low)] == low  # the window's first value is smallest
    # where the next window has another minimum, or none follows, the window itself is searched; other windows have the place of the next one
    cut = np.flatnonzero(np.append(low[1:] != low[:-1], True) & ~own)
    place = np.arange(len(low))
    windows = np.lib.stride_tricks.sliding_window_view(x, width)
    for k in range(0, len(cut), 4096):
        some = cut[k : k + 4096]
        place[some] = some + windows[some].argmin(axis=1)
    own[cut] = True
    known = np.flatnonzero(own)
    return np.repeat(place[known], np.diff(known, prepend=-1))


def segments(parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, part number, start, size and the anchor's place of all segments of the parts."""
    gram = min(GRAM, length)
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"".join(parts), np.uint8)
    none = (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 4
    if len(raw) < length:
        return none
    sums = prefix_sums(raw)
    at = np.arange(len(raw) - gram + 1)
    h = gram_hash(sums, at, at + gram)
    anchor = leftmost_min(h, length - gram + 1)
    ends = np.cumsum(sizes)
    part = np.searchsorted(ends, np.arange(len(anchor)), side="right")
    inside = np.flatnonzero(np.arange(len(anchor)) + length <= ends[part])
    if not len(inside):
        return none
    anchor, part = anchor[inside], part[inside]
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
    first, last = inside[new], inside[np.append(new[1:], len(inside)) - 1]
    anchor, part = anchor[new], part[new]
    return h[anchor], part, first - (ends - sizes)[part], last - first + length, anchor - first


def _digests(parts: list[bytes], core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each part and the place of its anchor, in two."""
    d = np.frombuffer(b"".join([xxhash.xxh3_128_digest(p) for p in parts]), "<u8").reshape(-1, 2)
    return d[:, 0] + core.astype(np.uint64), d[:, 1].copy()


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and each suffix's place.

    Larsson and Sadakane: order by eight bytes, then double: only groups that are
    still tied are sorted again, by the rank of what follows.
    """
    n = len(text)
    key = _eights(text, ">u8")[:n].astype(np.uint64)
    order = np.argsort(key)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    del key, sorted_key
    place = np.arange(n, dtype=np.int32)  # a shard has far fewer than 2**31 bytes
    order = order.astype(np.int32)
    rank = np.empty(n + 1, np.int32)  # the first place of a suffix's group; what lies behind the text is smallest
    rank[n] = -1
    head = np.maximum.accumulate(np.where(new, place, 0))
    rank[order] = head
    width = 8
    tied = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(tied):
        own = order[tied]
        pair = head[tied].astype(np.int64) << 32 | rank[np.minimum(own + width, n)] + 1  # its group, then the rank of what follows
        by = np.argsort(pair)
        own, pair = own[by], pair[by]
        order[tied] = own
        start = np.concatenate(([True], pair[1:] != pair[:-1]))
        head[tied] = np.maximum.accumulate(np.where(start, tied, 0))
        rank[own] = head[tied]
        alone = start & np.append(start[1:], True)
        tied = tied[~alone]
        width *= 2
    where = np.empty(n, np.int32)
    where[order] = place
    return order, where


def _eights(text: np.ndarray, kind: str, more: int = 0) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the text."""
    return np.ndarray((len(text) + more + 1,), kind, text.tobytes() + bytes(more + 8), strides=(1,))


def common_prefixes(text: np.ndarray, order: np.ndarray, where: np.ndarray, starts: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """For each suffix, the bytes (``most`` at most) it shares with the suffix before it in order.

    Kasai's walk: from one suffix to the next the shared prefix shrinks by one byte
    at most. The runs (starts, counts) are walked side by side, one step for all, and
    grow by up to eight bytes at once.
    """
    n = len(text)
    eights = _eights(text, "<u8", most)
    out = np.zeros(n, np.int64)
    by = np.argsort(-counts, kind="stable")
    starts, counts = starts[by], counts[by]
    shared = np.zeros(len(starts), np.int64)
    for step in range(int(counts.max(initial=0))):
        live = int(np.searchsorted(-counts, -step, side="left"))
        at = starts[:live] + step
        w = where[at]
        before = order[w - 1].astype(np.int64)
        h = np.maximum(shared[:live] - 1, 0)
        h[w == 0] = 0
        limit = np.minimum(most, n - np.maximum(at, before))
        grow = np.flatnonzero((w > 0) & (h < limit))
        while len(grow):
            own = h[grow]
            differ = eights[at[grow] + own] ^ eights[before[grow] + own]
            same = np.full(len(grow), 8)
            odd = np.flatnonzero(differ)
            lowest = differ[odd] & (~differ[odd] + np.uint64(1))
            same[odd] = np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3  # the first byte that differs
            h[grow] = own = np.minimum(own + same, limit[grow])
            grow = grow[(same == 8) & (own < limit[grow])]
        out[at] = h
        shared = h
    return out


def repeated(parts: list[bytes], counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One shard: which strings of ``length`` bytes of the parts are repeated in it.

    Returns the shard's text, the start of each part, the starts of all strings in
    order of the suffix array, and marks by byte. A part with a count above one is
    repeated itself.
    """
    sizes = np.array([len(p) for p in parts], np.int64)
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)  # no UTF-8 text has this byte
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    order, where = suffix_array(text)
    windows = sizes - length + 1
    shared = common_prefixes(text, order, where, starts, windows, length)
    valid = np.zeros(len(text), bool)
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + windows, -1)
    valid = np.cumsum(edge[:-1]) > 0
    mark = np.zeros(len(text), bool)
    hit = np.flatnonzero(valid & (shared >= length))
    mark[hit] = True
    mark[order[where[hit] - 1]] = True
    part = np.repeat(np.arange(len(parts)), sizes + 1)
    mark |= counts[part] > 1
    return text, starts, order[valid[order]], mark & valid


class Shard:
    """A shard's text and the starts of its strings in the order of its suffix array."""

    def __init__(self, text: np.ndarray, order: np.ndarray, length: int):
        self.text, self.order, self.length = text, order, length
        # what is compared from each start: eight bytes at a time, the last time the string's last eight
        self.steps = [*range(0, max(length - 8, 0), 8), max(length - 8, 0)]
        self.cut = np.uint64(8 * max(0, 8 - length))
        self.eights = _eights(text, ">u8", 8)

    def _at(self, starts: np.ndarray, step: int) -> np.ndarray:
        return self.eights[starts + step].astype(np.uint64) >> self.cut

    def find(self, other: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Starts here and in ``other`` of equal strings, by binary search of the others' strings in this suffix array."""
        asked = other.order.astype(np.int64)
        low, high = np.zeros(len(asked), np.int64), np.full(len(asked), len(self.order), np.int64)
        live = np.arange(len(asked))
        for step in self.steps:  # narrow each range to the strings that go on alike
            want = other._at(asked[live], step)
            low[live], high[live] = self._bound(want, low[live], high[live], step, False), self._bound(want, low[live], high[live], step, True)
            live = live[low[live] < high[live]]
        return self.order[low[live]], asked[live]

    def _bound(self, want: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            own = self._at(self.order[mid], step)
            right = own <= want[live] if after else own < want[live]
            low[live] = np.where(right, mid + 1, low[live])
            high[live] = np.where(right, high[live], mid)
            live = live[low[live] < high[live]]
        return low


def _spans(mark: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the marked starts of a segment."""
    at = np.flatnonzero(mark)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    first, last = np.concatenate((at[:1], at[cut + 1])), np.append(at[cut], at[-1])
    return [(int(a), int(b) + length) for a, b in zip(first, last, strict=True)]


def _shards(rows: Iterator[tuple]) -> Iterator[list[list[tuple]]]:
    """Rows (anchor, x, y, n, text), sorted by anchor, cut into shards: whole groups together, long groups over several."""
    held: list[tuple] = []
    size = 0
    for _, group in itertools.groupby(rows, key=lambda r: r[0]):
        parts: list[list[tuple]] = [[]]
        own = 0
        for row in group:
            if own + len(row[4]) > SHARD and parts[-1]:
                parts.append([])
                own = 0
            parts[-1].append(row)
            own += len(row[4])
        if len(parts) > 1:
            yield parts
            continue
        if held and size + own > SHARD:
            yield [held]
            held, size = [], 0
        held.extend(parts[0])
        size += own
    if held:
        yield [held]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_SPAN_TYPE = "spans array<struct<a:int,b:int>>"


def sharded_spans(distinct: DataFrame, length: int) -> DataFrame:
    """anchor, x, y, spans: repeated byte ranges of each distinct segment (anchor, x, y, n, t), in shards by anchor."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in slices(batches, "t", SLICE):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for shards in _shards(rows()):
            done = [(shard, *repeated([r[4] for r in shard], np.array([r[3] for r in shard], np.int64), length)) for shard in shards]
            if len(done) > 1:
                sorted_ = [Shard(text, order, length) for _, text, _, order, _ in done]
                for i in range(len(done)):
                    for j in range(i):
                        mine, theirs = sorted_[i].find(sorted_[j])
                        done[i][4][mine] = True
                        done[j][4][theirs] = True
            for shard, _, starts, _, mark in done:
                spans = [_spans(mark[s : s + len(r[4])], length) for s, r in zip(starts.tolist(), shard, strict=True)]
                keys = [pa.array([r[k] for r in shard], pa.int64()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], _SPANS)], ["anchor", "x", "y", "spans"])

    dealt = distinct.select("anchor", "x", "y", "n", "t").repartition("anchor").sortWithinPartitions("anchor")
    return mapped(dealt, work, f"anchor long, x long, y long, {_SPAN_TYPE}")


def repeated_spans(distinct: DataFrame, length: int, width: int) -> DataFrame:
    """As sharded_spans, of segments (anchor, x, y, n, core, t) whose anchor is ``width`` bytes at ``core``; groups beyond GROUP are split first."""
    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("group"))
    large = sizes.where(F.col("group") > GROUP).select("anchor")
    large = staged(large)
    if large.isEmpty():
        return staged(sharded_spans(distinct, length))
    found = staged(sharded_spans(distinct.join(large, "anchor", "left_anti"), length))
    half = -(-(length - width) // 2)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["o_anchor", "o_x", "o_y", "off", "n", "anchor", "x", "y", "core", "t"]
        for batch in slices(batches, "t", SLICE):
            rows = []
            for anchor, x, y, n, core, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(t) >= core + width + half:  # strings with so much to the right of the anchor
                    off = max(0, core + width + half - length)
                    rows.append((anchor, x, y, off, n, b"r" + t[core : core + width + half], core - off, t[off:]))
                if core >= half:  # and to the left
                    rows.append((anchor, x, y, 0, n, b"l" + t[core - half : core + width], core - half, t[: core - half + length]))
            if not rows:
                continue
            *origin, off, n, key, core, t = zip(*rows, strict=True)
            key = np.array([xxhash.xxh3_64_intdigest(k, width) for k in key], np.uint64).view(np.int64)
            x, y = _digests(list(t), np.array(core))
            columns = [*origin, off, n, key, x.view(np.int64), y.view(np.int64), core]
            kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 4 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(t, pa.binary())], names)

    # a segment with its bytes is one of a few hundred bytes, so nothing here grows with a group but the number of rows
    whole = distinct.join(large, "anchor").select("anchor", "x", "y", "n", "core", "t")
    parts = staged(mapped(whole, split, "o_anchor long, o_x long, o_y long, off int, n long, anchor long, x long, y long, core int, t binary"))
    own = parts.groupBy("anchor", "x", "y").agg(F.sum("n").alias("n"), F.first("core").alias("core"), F.first("t").alias("t"))
    groups = parts.groupBy("anchor").agg(F.sum("n").alias("total"), *(f(c).alias(f"{c}_{k}") for c in ("x", "y") for k, f in (("low", F.min), ("high", F.max))))
    own = staged(own.join(groups.where("total > 1").select("anchor", F.expr("x_low <> x_high OR y_low <> y_high").alias("mixed")), "anchor"))
    equal = own.where("NOT mixed").select("anchor", "x", "y", F.array(F.struct(F.lit(0).alias("a"), F.length("t").alias("b"))).alias("spans"))
    deeper = repeated_spans(own.where("mixed").select("anchor", "x", "y", "n", "core", "t"), length, width + half)
    again = parts.select("o_anchor", "o_x", "o_y", "off", "anchor", "x", "y").join(equal.unionByName(deeper), ["anchor", "x", "y"])
    moved = F.transform("spans", lambda s: F.struct((s["a"] + F.col("off")).alias("a"), (s["b"] + F.col("off")).alias("b")))
    back = again.groupBy(F.col("o_anchor").alias("anchor"), F.col("o_x").alias("x"), F.col("o_y").alias("y")).agg(F.flatten(F.collect_list(moved)).alias("spans"))  # two lists at most
    return staged(found.unionByName(back))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the ranges cover; ranges that touch join."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    return b"".join(kept)


def whole_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without characters that they cut."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200, carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """Per row: extra (the id as it was and the columns ``carry``), t (the text; null where nothing is repeated, unless ``keep_text``),
    runs (covered byte ranges, may overlap), n_bytes, sha256 (of texts that stay whole).

    A null text counts as the empty one. Rows with one id and one text share their
    segments, and are repeated in each other.
    """
    extra = F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)))
    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), extra.alias("extra"))
    source = source.select("id", F.xxhash64("t").alias("th"), "t", "extra")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", SLICE):
            anchor, part, first, size, core = segments([x.encode() for x in strings(batch, "t")], length)
            take = pa.array(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(first << 32 | size << 16 | core)], ["id", "th", "anchor", "place"])

    long_ones = source.where(F.octet_length("t") >= length).select("id", "th", "t")
    rows = staged(mapped(long_ones, cut, "id long, th long, anchor long, place long"))
    again = staged(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = joined(likely_among(rows, "anchor", again, "anchor"), again, "anchor", "n")
    per_text = rows.groupBy("id", "th").agg(F.collect_set(F.struct("anchor", "place")).alias("rows"))  # bounded by the text's length

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "place", "x", "y"]
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in names]))
        for batch in slices(batches, "t"):
            n, sha, keep, found = [], [], [], []
            for text, own in zip(strings(batch, "t"), batch.column(3).to_pylist(), strict=True):
                raw = text.encode()
                n.append(len(raw)), keep.append(text if own is not None or keep_text else None)
                sha.append(None if own is not None else hashlib.sha256(raw).hexdigest())
                if own is None:
                    found.append(None)
                    continue
                places = [r["place"] for r in own]
                x, y = _digests([raw[p >> 32 : (p >> 32) + (p >> 16 & 0xFFFF)] for p in places], np.array(places) & 0xFFFF)
                found.append([dict(zip(names, v, strict=True)) for v in zip((r["anchor"] for r in own), places, x.view(np.int64).tolist(), y.view(np.int64).tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keep, pa.string()), pa.array(found, kind), pa.array(n, pa.int64()), pa.array(sha, pa.string()), batch.column(4)], ["id", "th", "t", "rows", "n_bytes", "sha256", "extra"])

    with_rows = source.join(per_text, ["id", "th"], "left").select("id", "th", "t", "rows", "extra")
    held = with_rows.schema["extra"].dataType.simpleString()
    kind = "array<struct<anchor:bigint,place:bigint,x:bigint,y:bigint>>"
    settled = staged(mapped(with_rows, settle, f"id long, th long, t string, rows {kind}, n_bytes long, sha256 string, extra {held}"))

    segs = settled.where("rows is not null").select("id", "th", F.explode("rows").alias("r")).select("id", "th", "r.*")
    groups = segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{k}") for c in ("x", "y") for k, f in (("low", F.min), ("high", F.max))))
    groups = staged(groups.select("anchor", "n", F.expr("x_low <> x_high OR y_low <> y_high").alias("mixed")))
    segs = staged(joined(segs, groups, "anchor", "n"))

    # distinct segments of anchors with several, each with the text of one place
    mixed = segs.where("mixed").groupBy("anchor", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "place")).alias("at"))
    wanted = mixed.select("anchor", "x", "y", "n", "at.*").groupBy("id", "th").agg(F.collect_list(F.struct("anchor", "x", "y", "n", "place")).alias("want"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "x", "y", "n", "core", "t"]
        for batch in slices(batches, "t", SLICE):
            out = []
            for x, want in zip(strings(batch, "t"), batch.column(1).to_pylist(), strict=True):
                raw = x.encode()
                for w in want:
                    first, size, core = w["place"] >> 32, w["place"] >> 16 & 0xFFFF, w["place"] & 0xFFFF
                    out.append((w["anchor"], w["x"], w["y"], w["n"], core, raw[first : first + size]))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    texts = settled.where("rows is not null").select("id", "th", "t").dropDuplicates(["id", "th"])
    distinct = staged(mapped(texts.join(wanted, ["id", "th"]).select("t", "want"), fetch, "anchor long, x long, y long, n long, core int, t binary"))
    found = repeated_spans(distinct, length, min(GRAM, length))
    first, size = F.shiftright("place", 32).cast("int"), F.shiftright("place", 16).bitwiseAND(0xFFFF).cast("int")
    moved = F.transform("spans", lambda s: F.struct((s["a"] + first).alias("a"), (s["b"] + first).alias("b")))
    parts = segs.where("mixed").join(found.where(F.size("spans") > 0), ["anchor", "x", "y"]).select("id", "th", moved.alias("spans"))
    whole = segs.where("NOT mixed").select("id", "th", F.array(F.struct(first.alias("a"), (first + size).alias("b"))).alias("spans"))
    hits = parts.unionByName(whole).groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("hits"))  # bounded by the text's length
    out = settled.join(hits, ["id", "th"], "left")
    none = F.array().cast("array<struct<a:int,b:int>>")
    return out.select("extra", "t", F.coalesce("hits", none).alias("runs"), "n_bytes", "sha256")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of ``length`` bytes that also starts anywhere else,
    in the same text or another, is removed; strings are judged on the input. Null and
    empty texts have no bytes. Repeated rows are each other's repeats. Only ``id_col`` and ``text`` are read. No row gives none.
    """

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            rows = []
            for x, spans, n, sha in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if sha is not None:
                    rows.append((n, 0, 0, sha))
                    continue
                runs = union_of([(s["a"], s["b"]) for s in spans])
                kept = without(x.encode(), runs)
                rows.append((n, n - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64()] * 3 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = repeats(docs, id_col, text, length).select("extra.id", "t", "runs", "n_bytes", "sha256")
    return mapped(found, finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 200) -> DataFrame:
    """The same rows and columns with the repeated bytes cut from ``text``; characters that a cut would split stay whole.

    A null text becomes the empty one; a text that is all repeats becomes empty.
    """

    @F.pandas_udf("string")
    def cut(t: pd.Series, runs: pd.Series) -> pd.Series:
        def one(x: str, spans: list) -> str:
            if not len(spans):
                return x
            raw = x.encode()
            return without(raw, whole_characters(raw, union_of([(s["a"], s["b"]) for s in spans]))).decode()

        return pd.Series([one(x, s) for x, s in zip(t, runs, strict=True)], dtype=object)

    carry = tuple(c for c in docs.columns if c not in (id_col, text))
    found = repeats(docs, id_col, text, length, carry, keep_text=True)
    columns = {id_col: F.col("extra.id"), text: cut("t", "runs")} | {c: F.col(f"extra.c{i}") for i, c in enumerate(carry)}
    return found.select(*(columns[c].alias(c) for c in docs.columns))
