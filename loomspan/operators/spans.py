"""Algebra of half-open byte spans, and edits.

Joins of spans meet on (file, bin): a span is listed once for each bin that it
touches, so that no file is joined with itself as a whole.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import mapped
from ..storage import unbounded

BIN = 4096


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width)))


def containing(inner: DataFrame, outer: DataFrame, how: str = "inner", strict: bool = False, width: int = BIN, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Each inner span with every outer one around it; the outer's columns have the prefix ``o_``."""
    o = unbounded(_renamed(outer, "o_").withColumn("_bin", _bins(F.col("o_start"), F.col("o_end"), width)))
    i = inner.withColumn("_at", F.floor(F.col("start") / width))
    on = (F.col("_bin") == F.col("_at")) & (F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end"))
    for c in by:
        on &= F.col(c) == F.col(f"o_{c}")
    if strict:
        on &= (F.col("o_start") < F.col("start")) | (F.col("end") < F.col("o_end"))
    return i.join(o, on, how).drop("_bin", "_at")


def innermost_cover(inner: DataFrame, outer: DataFrame, idx: str = "idx", strict: bool = False, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Each inner span with ``cover``: the ``idx`` of the smallest outer span around it, of equals the smallest; else null."""
    both = containing(inner, outer, "left", strict, by=by)
    size = F.struct((F.col("o_end") - F.col("o_start")).alias("n"), F.col(f"o_{idx}").alias("k"))
    return both.groupBy(*inner.columns).agg(F.min_by(f"o_{idx}", size).alias("cover"))


def parents(scopes: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Scopes with ``parent``: the smallest scope strictly around, -1 at the root."""
    own = scopes.drop("parent") if "parent" in scopes.columns else scopes
    return innermost_cover(own, own, strict=True, by=by).withColumn("parent", F.coalesce("cover", F.lit(-1))).drop("cover")


def overlapping(left: DataFrame, right: DataFrame, how: str = "left_semi", width: int = BIN, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Left spans that meet (``left_semi``) or miss (``left_anti``) every right one."""
    keys = ["start", "end", *by]
    l, r = left.select(*keys).distinct().withColumn("_bin", _bins(F.col("start"), F.col("end"), width)), _renamed(right.select(*keys).distinct(), "o_").withColumn("_obin", _bins(F.col("o_start"), F.col("o_end"), width))
    on = (F.col("_bin") == F.col("_obin")) & (F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end"))
    for c in by:
        on &= F.col(c) == F.col(f"o_{c}")
    return left.join(l.join(r, on, "left_semi").select(*keys).distinct(), keys, how).select(*left.columns)


def merged_runs(spans: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Maximal runs that the spans cover; touching ones join."""
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end")
    own = spans.withColumn("_new", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    own = own.withColumn("_run", F.sum("_new").over(upto))
    return own.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def at_offset(cuts: DataFrame, points: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Points with ``value`` of the last cut at or before them, by one sort of both."""
    both = cuts.select(key, at, F.col(value), F.lit(0).alias("_p"), F.lit(None).cast("long").alias("_id")).unionByName(
        points.select(key, at, F.lit(None).cast(cuts.schema[value].dataType).alias(value), F.lit(1).alias("_p"), F.col("point").cast("long").alias("_id"))
    )
    w = Window.partitionBy(key).orderBy(at, "_p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last(value, ignorenulls=True).over(w)).where("_p = 1").select(F.col(key), F.col("_id").alias("point"), "found")


def greedy(positions: Column, width: int | Column) -> Column:
    """Of sorted starts, those that a scan from left to right takes when each taken one covers ``width``."""
    w = F.lit(width) if isinstance(width, int) else width
    start = F.struct(F.lit(-1).cast("int").alias("e"), F.array().cast("array<int>").alias("o"))
    add = lambda a, x: F.when(x > a["e"], F.struct((x + w - 1).cast("int").alias("e"), F.array_append(a["o"], x).alias("o"))).otherwise(a)
    return F.aggregate(positions, start, add, lambda a: a["o"])


class Claims:
    """Spans that overlap no earlier one, held in order."""

    def __init__(self):
        self.held: list[tuple[int, int]] = []

    def take(self, start: int, end: int) -> bool:
        """Whether the span is free; it no longer is."""
        k = bisect.bisect_left(self.held, (end,))  # spans before this one begin before its end; the last of them ends last
        free = k == 0 or self.held[k - 1][1] <= start
        if free:
            bisect.insort(self.held, (start, end))
        return free


def claimed(edits: DataFrame, order: str = "seq") -> DataFrame:
    """Edits with ``applied``: in their order, each that overlaps no applied one; the rest are skipped.

    A file's edits come by in order, and only the spans that are applied so far are held, sorted.
    """
    names = ["file", order, "start", "end", "new_text"]
    dealt = edits.select(*names).repartition("file").sortWithinPartitions(*names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, claims = object(), Claims()
        for batch in batches:
            ok = []
            for f, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if f != file:
                    file, claims = f, Claims()
                ok.append(claims.take(start, end))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ok, pa.bool_())], [*names, "applied"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields)
    return mapped(dealt, work, f"{kinds}, applied boolean")


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """A text with byte edits applied from the last to the first; spans that don't fit are left out."""
    raw = text.encode()
    for start, end, new in sorted(edits, key=lambda e: (-e[0], -e[1])):
        if 0 <= start <= end <= len(raw):
            raw = raw[:start] + new.encode() + raw[end:]
    return raw.decode("utf-8", "replace")


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """file, text: every file with its edits applied; a file without edits stays."""
    per_file = unbounded(edits.groupBy("file").agg(F.collect_list(F.struct("start", "end", "new_text")).alias("edits")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [None if t is None else apply_edits(t, [(e["start"], e["end"], e["new_text"]) for e in own or ()]) for t, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["file", "text"])

    own = files.select("file", "text")
    done = mapped(own.join(per_file, "file").select("file", "text", "edits"), work, "file string, text string")
    return own.join(per_file.select("file"), "file", "left_anti").unionByName(done)


def minimal_edit(old: str, new: str) -> tuple[int, int, str] | None:
    """The one byte edit between common prefix and suffix; None for equal texts."""
    a, b = old.encode(), new.encode()
    if a == b:
        return None
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    while head and head < max(len(a), len(b)) and any(head < len(x) and x[head] & 0xC0 == 0x80 for x in (a, b)):
        head -= 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    while tail and b[len(b) - tail] & 0xC0 == 0x80:
        tail -= 1
    return head, len(a) - tail, b[head : len(b) - tail].decode()


def diffed(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, start, end, new_text: the smallest single edit that turns each old text into the new one."""
    both = old.select("file", F.col("text").alias("a")).join(new.select("file", F.col("text").alias("b")), "file").where("a <> b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, e, t = zip(*(minimal_edit(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)), strict=True) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(t, pa.string())], ["file", "start", "end", "new_text"])

    return mapped(both, work, "file string, start int, end int, new_text string")


def shifted(matches: DataFrame, by: str | Column) -> DataFrame:
    """Spans moved by an offset."""
    return matches.withColumn("start", F.col("start") + by).withColumn("end", F.col("end") + by)


def flow_score(flows: DataFrame, units: DataFrame) -> DataFrame:
    """file, idx, score of each unit: 1 for each flow span properly inside, and for structural ones 1 more for each span properly around it inside the unit."""
    inside = containing(flows.where("end > start"), units, strict=True).select("file", "start", "end", "class", F.col("o_idx").alias("idx"))
    other = inside.where(F.col("class").isin("structural", "hybrid"))
    pairs = containing(inside.withColumn("unit", F.col("idx")).drop("idx"), other.withColumnRenamed("idx", "unit"), "left", strict=True, by=("file", "unit"))
    depth = pairs.groupBy("file", "unit", "start", "end", "class").agg(F.count("o_start").alias("around"))
    counted = inside.groupBy("file", "idx", "start", "end", "class").agg(F.count(F.lit(1)).alias("copies"))
    rows = counted.join(depth.withColumnRenamed("unit", "idx"), ["file", "idx", "start", "end", "class"])
    # the pairs of equal spans were counted once for each copy
    points = F.col("copies") * F.when(F.col("class") == "structural", 1 + F.col("around") / F.col("copies")).otherwise(F.lit(1.0))
    scored = rows.groupBy("file", "idx").agg(F.sum(points).cast("long").alias("score"))
    return units.select("file", "idx").join(scored, ["file", "idx"], "left").select("file", "idx", F.coalesce("score", F.lit(0)).alias("score"))
