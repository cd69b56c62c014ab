"""Near-duplicate texts by SetSketch registers.

A register holds the truncated logarithm of the smallest of exponentially spread
hashes of a set, so registers merge by maximum and equal registers tell of similar
sets. Bands of registers propose candidates; a joint likelihood of the registers
that are larger, smaller and equal, given both sizes, estimates the similarity and
drops what is far below the bound; the rest is confirmed on the full sets.

Texts with equal sets are one class from the start. In each bucket of a band, all
members meet the first one, the hub. What stays in other components than most is compared
with the rest: in small buckets directly. Large buckets whose members are mostly of
one component make a family, and its members meet by how they differ from a pivot, one
text of that component. Let D be the symmetric difference of a set and the pivot's. Two
sets x, y are similar enough exactly if their symmetric difference is at most
T = (1 - s) / (1 + s) * (|x| + |y|), that is, if Dx and Dy share at least
(|Dx| + |Dy| - T) / 2 elements. For x too far from the pivot to be linked with it this is more
than 0 for every y, so an equi-join on the rarest elements of each D, only as many as that
bound leaves, finds all such pairs; those that are near the pivot are linked with it. No
link is lost, and pairs that meet have something rare in common that the pivot has not (or lacks
what it has). Members of one component need no further link and never meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import FILTER_WORDS, joined, likely_among, mapped, slices, staged, strings
from .words import split

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.09, 4.0, 255
LOAD = 512  # texts that are compared with one copy of another text
SMALL = 32  # members of buckets in which components are compared directly
MARGIN = 0.13  # five standard deviations of the estimate

_LOWER = bytes(b + 32 if 65 <= b < 91 else b for b in range(256))
_draw = np.random.default_rng(20240229)
_FACTORS = _draw.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32) | np.uint32(1)
_SHIFTS = _draw.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's distinct ``width``-word shingles, made of exact keys of the words.

    A-Z count as a-z; words are runs without ASCII white space. Fewer words make one
    shingle of them all; no word makes an empty set.
    """
    return [s for s, _ in _sets(texts, width, False)]


def digested_sets(texts: list[str], width: int) -> list[tuple[np.ndarray, bytes]]:
    """As shingle_sets, each with 128 bits that tell its set: a cryptographic digest of the exact keys of all words of its shingles."""
    return _sets(texts, width, True)


def _sets(texts: list[str], width: int, digests: bool) -> list[tuple[np.ndarray, bytes]]:
    raw = [x.encode().translate(_LOWER) for x in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    found = split(b"\n".join(raw))
    keys = found.hash
    ends = np.searchsorted(found.start, np.cumsum(sizes + 1))
    shingles = np.zeros(len(keys), np.uint64)
    for k in range(width):
        part = keys[k:]
        shingles[: len(part)] = _mix(shingles[: len(part)], part)
    exact = np.stack([found.a, found.b, found.size.astype(np.uint64)], axis=1) if digests else None
    out, before = [], 0
    for end in ends.tolist():
        n = end - before
        at = np.zeros(1, np.int64)
        if n >= width:
            own = shingles[before : end - width + 1]
            hashes, at = np.unique(own, return_index=True) if digests else (np.unique(own), at)
        elif n:
            hashes = np.full(1, n, np.uint64)
            for k in keys[before:end]:
                hashes = _mix(hashes, k)
        else:
            hashes, at = np.empty(0, np.uint64), np.empty(0, np.int64)
        digest = b""
        if digests:
            words = exact[before + at[:, None] + np.arange(min(n, width))]  # of each shingle, in order of its hash
            digest = hashlib.blake2b(words.tobytes(), digest_size=16).digest()
        out.append((hashes, digest))
        before = end
    return out


def exact_set(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The set itself, of words and not of hashes."""
    w = text.encode().translate(_LOWER).split()  # bytes are split at ASCII white space
    if len(w) < width:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(width)), strict=False))


def _mix(h: np.ndarray, key: np.ndarray) -> np.ndarray:
    h = (h ^ key) * np.uint64(0x9FB21C651E98DF25) + np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a set: floor(1 - log_BASE(x)) of the smallest exponential x, cut to 0 .. TOP."""
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    short = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 2048):
        low = np.minimum(low, (short[k : k + 2048, None] * _FACTORS + _SHIFTS).min(axis=0))
    x = -np.log1p(-(low + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 201) -> np.ndarray:
    """Similarity of each pair of sketches (rows) that makes larger, smaller and equal registers most likely."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps)[None, :] * np.minimum(u / v, v / u)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    more, less = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    score = above * np.log(more + tiny) + below * np.log(less + tiny) + equal * np.log(np.maximum(1 - more - less, tiny))
    return j[np.arange(len(j)), score.argmax(axis=1)]


def sketched(docs: DataFrame, width: int, id_col: str, text: str) -> DataFrame:
    """id, n (set size), digest (of the set), sketch (null where the set is empty)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            sets, digests = zip(*digested_sets(strings(batch, "t"), width), strict=True)
            sketches = [sketch(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())], ["id", "n", "digest", "sketch"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text).alias("t"))
    return staged(mapped(rows, work, "id long, n long, digest binary, sketch binary"))


def banded(classes: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """rep, band: one row for each band of each class; with ``among`` (a bit for each value of the low bits of a band) only for those that may be there."""
    wanted = None if among is None else classes.sparkSession.sparkContext.broadcast(among)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        factor = np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS).astype(np.uint64)
            h = np.broadcast_to(names, rows.shape[:2]).copy()
            for k in range(ROWS):
                h = (h ^ rows[:, :, k]) * factor
                h ^= h >> np.uint64(29)
            rep, band = np.repeat(batch.column(0).to_numpy(), BANDS), h.ravel()
            if wanted is not None:
                low = band & np.uint64(len(wanted.value) * 64 - 1)
                may = wanted.value[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1) == 1
                rep, band = rep[may], band[may]
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(band.view(np.int64))], ["rep", "band"])

    return mapped(classes.select("rep", "sketch"), work, "rep long, band long")


def _marks(hubs: DataFrame) -> np.ndarray | None:
    """A bit for each value that the low bits of a wanted band have, 16 bits a band; None where there are too many bands for FILTER_WORDS words."""
    n = hubs.count()
    if n > 4 * FILTER_WORDS:
        return None
    words = min(FILTER_WORDS, max(64, 1 << (n // 4).bit_length()))
    low = F.col("band").bitwiseAND(F.lit(words * 64 - 1).cast("long"))
    bit = F.expr("shiftleft(1L, CAST(band & 63 AS INT))")
    rows = hubs.select(F.shiftright(low, 6).cast("int").alias("w"), bit.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # a row for each word at most
    out = np.zeros(words, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out.view(np.uint64)


def likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs a, b whose sizes allow ``least`` and whose estimate is not far below it; adds ``est``."""
    side = lambda s: classes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((F.col("n_a") >= least * F.col("n_b") - 1e-6) & (F.col("n_b") >= least * F.col("n_a") - 1e-6))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                s = [np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (4, 5)]
                est = estimate(*s, part.column(2).to_numpy(), part.column(3).to_numpy())
                keep = np.flatnonzero(est >= least - MARGIN)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(1).take(pa.array(keep)), pa.array(est[keep])], ["a", "b", "est"])

    return mapped(both.select("a", "b", "n_a", "n_b", "s_a", "s_b"), work, "a long, b long, est double")


def wanted(source: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``source`` whose id is among the distinct ``ids``; nearly all others are dropped in the scan, before texts are moved."""
    ids = staged(ids)
    return likely_among(source, "id", ids, "id").join(ids.hint("shuffle_hash"), "id")


def beside(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows a, salt, side, id, t of each pair (a, id): the text of ``a`` (side 0) before those that meet it (side 1).

    Columns beyond a and id are kept. Where many meet one text, it is repeated for each LOAD of
    them, so no task holds a whole group. Partitions have whole (a, salt), sorted.
    """
    more = [c for c in pairs.columns if c not in ("a", "id")]
    kinds = {f.name: f.dataType for f in pairs.schema.fields}
    load = staged(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LOAD).cast("int").alias("salts")))
    sides = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"), "id", *more)
    own = load.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"), F.col("a").alias("id"), *(F.lit(None).cast(kinds[c]).alias(c) for c in more))
    rows = sides.unionByName(own).hint("shuffle_hash").join(texts, "id")
    return rows.select("a", "salt", "side", "id", "t", *more).repartition("a", "salt").sortWithinPartitions("a", "salt", "side", "id", "t")


def met(batches: Iterator[pa.RecordBatch], make) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list, object]]]]:
    """Per batch of ``beside``: (row, what ``make`` gives for the texts of ``a``, what it gives for the row's own)."""
    key, held = None, []
    for batch in slices(batches, "t", 1 << 20):
        out = []
        made = make(strings(batch, "t"))
        for k, (a, salt, side) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            if (a, salt) != key:
                key, held = (a, salt), []
            if side == 0:
                held = [*held, made[k]]  # a repeated id has several texts
            else:
                out.append((k, held, made[k]))
        if out:
            yield batch, out


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs a, b confirmed on full sets of words: 100 * intersection >= ``percent`` * union."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(x: set, y: set) -> bool:
            both = len(x & y)
            return bool(both) and 100 * both >= percent * (len(x) + len(y) - both)

        for batch, rows in met(batches, lambda own: [exact_set(x, width) for x in own]):
            at = pa.array([k for k, hubs, own in rows if any(linked(x, own) for x in hubs)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(3).take(at)], ["a", "b"])

    return mapped(beside(pairs.select("a", F.col("b").alias("id")), texts), work, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node that has an edge; nodes are joined by edges exactly where labels are equal.

    Each node hooks onto its neighbour of the smallest hash; the graph of what
    remains is contracted, so a constant share of its nodes goes in each round.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
    edges = edges.where("a <> b").select("a", "b").distinct()
    labels: DataFrame | None = None
    while True:
        ends = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        hook = ends.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["v"].alias("to"))
        # a neighbour may hook on itself: two steps shorten the way for the next round
        again = hook.select(F.col("node").alias("to"), F.col("to").alias("then"))
        hook = staged(hook.join(again, "to").select("node", F.col("then").alias("to")))
        if labels is None:
            labels = hook.select("node", F.col("to").alias("label"))
        else:
            step = hook.select(F.col("node").alias("label"), F.col("to").alias("next"))
            labels = staged(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        to = lambda s: hook.select(F.col("node").alias(s), F.col("to").alias(f"{s}_to"))
        edges = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct()
        edges = staged(edges)
        if edges.isEmpty():
            return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept (whether the id is its component's smallest).

    Texts are linked where 100 * intersection >= ``percent`` * union of their shingle
    sets. Null, empty and wordless texts have an empty set and no link. Rows with one id
    are one node; rows without an id share the node -2**63. Only ``id_col`` and ``text`` are read. No row gives none.
    """
    least = percent / 100
    all_ = sketched(docs, width, id_col, text)
    classes = all_.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = staged(classes)
    bands = banded(classes)
    hubs = bands.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("n"))
    hubs = staged(hubs.where("hub < last").select("band", "hub", "n"))
    members = staged(joined(banded(classes, _marks(hubs)), hubs, "band", "n").select("band", "hub", "rep"))

    source = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts: DataFrame | None = None

    def fetch(ids: DataFrame) -> DataFrame:
        """Texts of these ids and all wanted before."""
        nonlocal texts
        ids = ids.distinct()
        if texts is not None:
            ids = ids.join(texts.select("id").distinct(), "id", "left_anti")
        more = staged(wanted(source, ids))
        texts = more if texts is None else texts.unionByName(more)
        return texts

    def confirm(pairs: DataFrame, edges: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
        """Adds what holds of the likely ``pairs``: first each text's most likely partner, then what is still apart."""
        fetch(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
        best = staged(pairs.groupBy("b").agg(F.max_by("a", F.struct("est", F.negate("a"))).alias("a")))
        edges = grown(edges, verified(best, texts, width, percent))
        labels = components(edges) if edges is not None else None
        rest = staged(apart(pairs.join(best, ["a", "b"], "left_anti"), labels))
        if not rest.isEmpty():
            before, edges = edges, grown(edges, verified(rest, texts, width, percent))
            labels = labels if edges is before else components(edges)
        return edges, labels

    pairs = members.where("hub < rep").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = staged(likely(pairs, classes, least))
    edges, labels = (None, None) if pairs.isEmpty() else confirm(pairs, None)

    # buckets that still hold several components
    label = F.coalesce("label", "rep")
    own = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left") if labels is not None else members.withColumn("label", F.lit(None).cast("long"))
    own = staged(own.select("band", "hub", "rep", label.alias("label")))
    mixed = own.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("size")).where("x < y and size > 2")
    own = staged(joined(own, staged(mixed.select("band", "size", F.col("size").alias("n"))), "band", "n"))
    few = own.where(F.col("size") <= SMALL)
    other = few.select("band", F.col("rep").alias("b"), F.col("label").alias("l_b"))
    close = few.withColumnRenamed("rep", "a").join(other, "band").where("a < b and label <> l_b").select("a", "b").distinct()
    large = own.where(F.col("size") > SMALL).select("band", "rep", "label")
    if not large.isEmpty():
        close = close.unionByName(by_difference(large, fetch, width, percent))
    found = staged(likely(close.distinct().join(pairs, ["a", "b"], "left_anti"), classes, least).dropDuplicates(["a", "b"]))
    if not found.isEmpty():
        edges, labels = confirm(found, edges)

    out = all_.join(classes.select("digest", "rep"), "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    if labels is not None:
        least_id = labels.groupBy("label").agg(F.min("node").alias("component"))
        by_rep = labels.join(least_id, "label").select(F.col("node").alias("rep"), "component")
        out = out.join(by_rep, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    else:
        out = out.withColumnRenamed("rep", "component")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def by_difference(large: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, percent: int) -> DataFrame:
    """Pairs a, b of members (band, rep, label) of large buckets that can be similar enough and have different labels.

    The label that most members of a bucket have names its family. ``fetch`` gives the texts of
    ids. See the module's head for why no pair that is similar enough is left out.

    Members of one label never meet. Labels meet first, as one row each; their members follow where one of
    two labels is the family's, or both have few members. A large label that meets others than the family's makes a
    family of its own, in which those others meet its members only.
    """
    sizes = large.groupBy("band", "label").agg(F.count(F.lit(1)).alias("k"))
    family = staged(sizes.groupBy("band").agg(F.max_by("label", F.struct("k", "label")).alias("family"), F.sum("k").alias("n")))
    members = staged(joined(large, family, "band", "n").select("family", "rep", "label").distinct())
    plain, index = rarest(differences(members, fetch, width), percent)
    labels = labels_met(index, members, percent)
    pairs = plain.unionByName(fitting(members_met(index, labels.where("NOT beyond")), percent))
    first = F.struct("size_x", "label_x") > F.struct("size_y", "label_y")
    beyond = labels.where("beyond").select("family", F.when(first, F.col("label_x")).otherwise(F.col("label_y")).alias("own"), F.when(first, F.col("label_y")).otherwise(F.col("label_x")).alias("other"))
    beyond = staged(beyond.distinct())
    if beyond.isEmpty():
        return pairs.distinct()
    side = lambda c: members.join(beyond.select("family", "own", F.col(c).alias("label")).distinct(), ["family", "label"]).select(F.col("own").alias("family"), "rep", "label")
    plain, index = rarest(differences(staged(side("own").unionByName(side("other")).distinct()), fetch, width), percent)
    return pairs.unionByName(plain).unionByName(fitting(members_of_family_met(index), percent)).distinct()


def differences(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int) -> DataFrame:
    """Members (family, rep, label) with ``more``, what of their set and the pivot's is in one only, the sizes n and n_pivot, and the pivot: a member of the family's label."""
    pivots = members.where("label = family").groupBy("family").agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep"))["rep"].alias("a"))
    texts = fetch(members.select(F.col("rep").alias("id")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in met(batches, lambda own: shingle_sets(own, width)):
            out = []
            for k, pivot, own in rows:
                # a repeated id has several texts: the pivot is the first of them
                more = np.setxor1d(own, pivot[0], assume_unique=True)
                out.append((k, len(own), len(pivot[0]), more.view(np.int64)))
            at, size, pivot_size, more = zip(*out, strict=True)
            own = [batch.column(i).take(pa.array(at)) for i in (0, 3, 5, 6)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(size, pa.int64()), pa.array(pivot_size, pa.int64()), pa.array(more, pa.list_(pa.int64()))], ["pivot", "rep", "family", "label", "n", "n_pivot", "more"])

    rows = beside(members.join(pivots, "family").select("a", F.col("rep").alias("id"), "family", "label"), texts)
    return staged(mapped(rows, work, "pivot long, rep long, family long, label long, n long, n_pivot long, more array<long>"))


def _far(percent: int) -> float:
    return (100 - percent) / (100 + percent)


def rarest(measured: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs a, b of members near the pivot and it; and an index of all members' rarest differences, as many as the bound leaves.

    The index has family, e, rep, label, n, d (how many differences), left (how many of them are as frequent at least), and
    tail: whether it is of another label than the family's and far from the pivot. Only what a tail has is in it.
    """
    far = _far(percent)
    d = F.size("more")
    tail = F.col("label") != F.col("family")
    near = d <= far * (F.col("n") + F.col("n_pivot")) + 1e-6
    plain = measured.where(tail & near).select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b"))
    each = measured.select("family", "rep", "label", "n", d.alias("d"), (tail & ~near).alias("tail"), F.explode("more").alias("e"))
    common = each.groupBy("family", "e").agg(F.count(F.lit(1)).alias("k"), F.max("tail").alias("some")).where("k > 1")
    order = Window.partitionBy("family", "rep", "n", "d").orderBy(F.desc_nulls_last("k"), "e")  # one set's own differences
    ranked = each.join(common, ["family", "e"], "left").withColumn("left", F.row_number().over(order).cast("long"))
    short = F.col("left") >= F.col("d") - F.floor(far * F.col("n") * (1 + 100 / percent) + 1e-6)
    return plain, staged(ranked.where("some").where(short).select("family", "e", "rep", "label", "n", "d", "left", "tail"))


def labels_met(index: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """family, e, label_x (of a tail), label_y (another) and their sizes in the family; beyond: whether neither is the family's and one is large.

    Labels of which no two members can fit, by the extremes of their members, do not meet.
    """
    sizes = members.groupBy("family", "label").agg(F.count(F.lit(1)).alias("size"))
    bounds = F.max("tail").alias("tail"), F.max("left").alias("left"), F.min("d").alias("d"), F.max("d").alias("d_most"), F.max("n").alias("n")
    own = staged(index.groupBy("family", "e", "label").agg(*bounds).join(sizes, ["family", "label"]))
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("label", "size", "left", "d", "d_most", "n")]
    x, y = own.where("tail").select("family", "e", *side("x")), own.select("family", "e", *side("y"))
    most = _far(percent) * (F.col("n_x") + F.col("n_y")) + 1e-6
    can = (2 * F.least("left_x", "left_y") >= F.col("d_x") + F.col("d_y") - most) & (F.col("d_x") - F.col("d_most_y") <= most) & (F.col("d_y") - F.col("d_most_x") <= most)
    beyond = (F.col("label_y") != F.col("family")) & (F.greatest("size_x", "size_y") > SMALL)
    met = x.join(y, ["family", "e"]).where(can & (F.col("label_x") != F.col("label_y")))
    return met.select("family", "e", "label_x", "label_y", "size_x", "size_y", beyond.alias("beyond"))


def members_met(index: DataFrame, labels: DataFrame) -> DataFrame:
    """Tails of label_x and members of label_y that have e."""
    x = index.where("tail").select("family", "e", *(F.col(c).alias(f"{c}_x") for c in ("rep", "label", "n", "d", "left")))
    y = index.withColumnRenamed("label", "label_y")
    return x.join(labels.select("family", "e", "label_x", "label_y"), ["family", "e", "label_x"]).join(y, ["family", "e", "label_y"])


def members_of_family_met(index: DataFrame) -> DataFrame:
    """Tails and members of the family's own label that share a difference."""
    x = index.where("tail").select("family", "e", *(F.col(c).alias(f"{c}_x") for c in ("rep", "n", "d", "left")))
    return x.join(index.where("label = family"), ["family", "e"])


def fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b whose differences leave room for enough in common."""
    most = _far(percent) * (F.col("n") + F.col("n_x")) + 1e-6
    needed = (F.col("d") + F.col("d_x") - most) / 2
    fits = (F.least("left", "left_x") >= needed) & (F.abs(F.col("d") - F.col("d_x")) <= most)
    return pairs.where(fits).select(F.least("rep", "rep_x").alias("a"), F.greatest("rep", "rep_x").alias("b"))


def grown(edges: DataFrame | None, new: DataFrame) -> DataFrame | None:
    """Old and new edges, or None while there is none."""
    new = staged(new)
    if new.isEmpty():
        return edges
    return new if edges is None else edges.unionByName(new)


def apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    if labels is None:
        return pairs
    to = lambda s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l_{s}"))
    both = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left")
    return both.where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select(*pairs.columns)
