"""Hard negatives of anchors: norm-bucketed search with Cauchy-Schwarz bounds.

Candidates are sorted by norm, longest first, and cut into buckets of BUCKET rows, each one
packed row of a table. Buckets are dealt to stripes at random, so that each stripe has all norms; anchors, a
hundredth of the rows, are packed as well and sent to every stripe. A cell, one stripe and one
group of anchors, is the unit of work: its buckets are held (a bounded number), its anchors pass by in blocks. A block goes
through the buckets from the longest on. An inner product is at most the product of both norms,
so a bucket is skipped for an anchor once that product is below its running kth score, or
below the lower limits of all its windows. Cells' best rows are merged by one ranking.

The first search gives each anchor its positives, the second its negatives in the window of each positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, staged
from .vectors import kept, scaled

BUCKET = 1024  # candidates
STRIPE = 8  # buckets of a stripe, about
BLOCK = 256  # anchors that meet a bucket at once
GROUP = 1 << 16  # anchors of a group, about
LARGEST_SQUARE = 1 << 50  # of a scaled vector's length; products then fit in a double exactly, and with a place in 64 bits
_NONE = np.iinfo(np.int64).min
_PACK = "bucket long, reach double, n int, ids binary, labels binary, vectors binary"


def packed(rows: DataFrame, d: int, size: int) -> DataFrame:
    """Rows id, l, v sorted by norm, longest first, and cut into packs of ``size``: bucket, reach (its largest norm), n, ids, labels, vectors.

    Within a pack rows are in order of id. Norms and packs follow from whole numbers.
    """
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * 256), F.lit(2.0)))
    ranged = rows.select("id", "l", "v", norm2.alias("q")).repartitionByRange(F.desc("q"), "id").sortWithinPartitions(F.desc("q"), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def pack(own: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            nonlocal first
            i, label, v, q = own
            if q.max() >= LARGEST_SQUARE:
                raise ValueError("vectors of this length cannot be multiplied exactly")
            order = np.lexsort((label, i))
            columns = [[first], [float(np.sqrt(q.max()))], [len(i)], *([x[order].tobytes()] for x in (i, label, v.astype("<i4")))]
            first += 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 3], strict=True)], ["bucket", "reach", "n", "ids", "labels", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), scaled(batch.column(2), d), batch.column(3).to_numpy()))
            count += batch.num_rows
            if count >= size:
                all_ = tuple(np.concatenate(x) for x in zip(*held, strict=True))
                for k in range(0, count - size + 1, size):
                    yield pack(tuple(x[k : k + size] for x in all_))
                rest = count % size
                held, count = ([tuple(x[count - rest :] for x in all_)] if rest else []), rest
        if count:
            yield pack(tuple(np.concatenate(x) for x in zip(*held, strict=True)))

    return staged(mapped(ranged, work, _PACK))


def _unpacked(row: dict, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["vectors"], "<i4").reshape(-1, d).astype(np.float64)


class Best:
    """The first ``k`` of what each of ``n`` askers has met: scores, and numbers that break ties (smaller first)."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), _NONE)
        self.id, self.row = np.zeros((2, n, k), np.int64)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def offer(self, who: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Scores (askers x candidates, _NONE where a candidate does not count) of candidates in order of id."""
        k = self.score.shape[1]
        better = np.flatnonzero((score >= self.kth[who][:, None]).any(axis=1) & (score > _NONE).any(axis=1))
        if not len(better):
            return
        who, score = who[better], score[better]
        n = score.shape[1]
        # one number for score and place: among equal scores, the first place is the largest
        key = np.where(score > _NONE, score * n + (n - 1 - np.arange(n)), _NONE)
        take = min(k, n)
        at = np.argpartition(key, n - take, axis=1)[:, n - take :]
        s = np.concatenate((self.score[who], np.take_along_axis(score, at, axis=1)), axis=1)
        i = np.concatenate((self.id[who], ids[at]), axis=1)
        r = np.concatenate((self.row[who], rows[at]), axis=1)
        order = np.lexsort((r, i, -np.maximum(s, -(1 << 62))), axis=1)[:, :k]
        self.score[who], self.id[who], self.row[who] = (np.take_along_axis(x, order, axis=1) for x in (s, i, r))


def celled(buckets: DataFrame, blocks: DataFrame, anchors: int, more: dict[str, str]) -> DataFrame:
    """Every bucket and block in the cells where they meet, sorted: a cell's buckets from the longest on, then its blocks.

    Each cell has STRIPE buckets and GROUP anchors, about, however many there are of either.
    """
    stripes = max(1, -(-buckets.count() // STRIPE))
    groups = max(1, -(-anchors // GROUP))
    deal = lambda n: F.pmod(F.xxhash64("bucket"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = [c.split()[0] for c in _PACK.split(", ")]
    left = buckets.select(deal(stripes).alias("stripe"), every(groups).alias("group"), F.lit(0).alias("kind"), *own, *(F.lit(None).cast(k).alias(c) for c, k in more.items()))
    right = blocks.select(every(stripes).alias("stripe"), deal(groups).alias("group"), F.lit(1).alias("kind"), *own, *more)
    return left.unionByName(right).repartition("stripe", "group").sortWithinPartitions("stripe", "group", "kind", F.desc("reach"), "bucket")


def met(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[dict, list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]]:
    """Each block of a cell with the cell's buckets: (norm bound, row numbers, ids, labels, vectors) from the longest on."""
    cell, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["stripe"], row["group"]) != cell:
                cell, held = (row["stripe"], row["group"]), []
            if row["kind"] == 0:
                rows = row["bucket"] * BUCKET + np.arange(row["n"])
                held.append((row["reach"], rows, *_unpacked(row, d)))
            else:
                yield row, held


def _longest(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def positives_of(cells: DataFrame, d: int, k: int) -> DataFrame:
    """anchor, a_row, score, id, row: in each cell, the first ``k`` rows of each anchor's label other than itself."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in met(batches, d):
            ids, labels, v = _unpacked(block, d)
            own = np.frombuffer(block["rows"], "<i8")
            norms, best = _longest(v), Best(len(ids), k)
            for reach, rows, b_ids, b_labels, b_v in held:
                live = np.flatnonzero(norms * reach + 1 >= best.kth)
                if not len(live):
                    break
                score = np.rint(v[live] @ b_v.T).astype(np.int64)
                score[(labels[live][:, None] != b_labels) | (own[live][:, None] == rows)] = _NONE
                best.offer(live, score, b_ids, rows)
            at, j = np.nonzero(best.score > _NONE)
            columns = ids[at], own[at], best.score[at, j], best.id[at, j], best.row[at, j]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "a_row", "score", "id", "row"])

    return mapped(cells, work, "anchor long, a_row long, score long, id long, row long")


def negatives_of(cells: DataFrame, d: int, k: int, low: int, high: int) -> DataFrame:
    """anchor, a_row, p_row, positive, p_score, score, id, row: in each cell, the first ``k`` rows of other labels in each window.

    The window of a positive of score p has scores s with low * p <= 100 * s <= high * p.
    """
    names = ["anchor", "a_row", "p_row", "positive", "p_score", "score", "id", "row"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in met(batches, d):
            ids, labels, v = _unpacked(block, d)
            own, of, p_id, p_row, p_score = (np.frombuffer(block[c], "<i8") for c in ("rows", "of", "p_id", "p_row", "p_score"))
            least, most = -(-low * p_score // 100), high * p_score // 100
            norms, best = _longest(v), Best(len(of), k)
            for reach, rows, b_ids, b_labels, b_v in held:
                bound = norms[of] * reach + 1
                live = np.flatnonzero((bound >= least) & (bound >= best.kth) & (least <= most))
                if not len(live):
                    if not (bound >= least).any():
                        break
                    continue
                anchors, place = np.unique(of[live], return_inverse=True)
                score = np.rint(v[anchors] @ b_v.T).astype(np.int64)
                score[labels[anchors][:, None] == b_labels] = _NONE
                for part in range(0, len(live), BLOCK):
                    ask = live[part : part + BLOCK]
                    s = score[place[part : part + BLOCK]]
                    best.offer(ask, np.where((s >= least[ask][:, None]) & (s <= most[ask][:, None]), s, _NONE), b_ids, rows)
            at, j = np.nonzero(best.score > _NONE)
            columns = ids[of[at]], own[of[at]], p_row[at], p_id[at], p_score[at], best.score[at, j], best.id[at, j], best.row[at, j]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return mapped(cells, work, ", ".join(f"{c} long" for c in names))


def first_of(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key by score, id and row, numbered from 1; Spark cuts each task's rows to ``k`` before they move."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blocks_of(buckets: DataFrame, d: int, every: int) -> DataFrame:
    """The anchors of each bucket as blocks, with ``rows``: their own row numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, v = _unpacked(row, d)
                for k, at in enumerate(np.array_split(own := np.flatnonzero(ids % every == 0), max(1, -(-len(own) // BLOCK)))):
                    if not len(at):
                        continue
                    columns = [[row["bucket"] << 4 | k], [row["reach"]], [len(at)], *([x.tobytes()] for x in (ids[at], labels[at], v[at].astype("<i4"), row["bucket"] * BUCKET + at))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 4], strict=True)], ["bucket", "reach", "n", "ids", "labels", "vectors", "rows"])

    return mapped(buckets, work, f"{_PACK}, rows binary")


_ASKED = {c: "binary" for c in ("rows", "of", "p_id", "p_row", "p_score")}


def asking(blocks: DataFrame, positives: DataFrame) -> DataFrame:
    """Blocks with the positives of their anchors: of (place of the anchor in the block), p_id, p_row, p_score."""
    # rows of one bucket: BUCKET anchors at most, with a few positives each
    asked = positives.groupBy(F.expr(f"a_row div {BUCKET}").alias("pack")).agg(F.collect_list(F.struct("a_row", "id", "row", "score")).alias("asked"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                asked = np.array([(x["a_row"], x["id"], x["row"], x["score"]) for x in row["asked"]], np.int64).reshape(-1, 4)
                own = np.frombuffer(row["rows"], "<i8")
                asked = asked[np.isin(asked[:, 0], own)]
                if not len(asked):
                    continue
                columns = [row[c] for c in ("bucket", "reach", "n", "ids", "labels", "vectors", "rows")] + [np.searchsorted(own, asked[:, 0]).astype("<i8").tobytes(), *(asked[:, j].tobytes() for j in (1, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, [pa.int64(), pa.float64(), pa.int32(), *[pa.binary()] * 8], strict=True)], ["bucket", "reach", "n", "ids", "labels", "vectors", *_ASKED])

    joined = blocks.withColumn("pack", F.expr("shiftright(bucket, 4)")).join(asked, "pack").select(*blocks.columns, "asked")
    return mapped(joined, work, f"{_PACK}, " + ", ".join(f"{c} {k}" for c, k in _ASKED.items()))


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; their positives are the first ``positives`` other rows of their
    label, their negatives the first ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score. Higher inner products of floor(256 * x) come first, then smaller ids. A negative
    positive_score has an empty window, one of 0 holds scores of 0.

    Rows without an id or a label take no part, nor do vectors that are null, empty, hold a null or non-finite component, or have
    another number of components than that of the smallest id; a vector of length 2**17 or more is an error. Repeated rows
    count each: a row's twin is another row. No row gives none. Other columns are not read.
    """
    own = F.col(label) if isinstance(label, str) else label
    source = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"), own.cast("long").alias("l")).where("id IS NOT NULL AND l IS NOT NULL")
    source, d = kept(source, "id", "v")
    buckets = packed(source, d, BUCKET)
    blocks = staged(blocks_of(buckets, d, every))
    anchors = blocks.agg(F.sum("n")).first()[0] or 0
    first = first_of(positives_of(celled(buckets, blocks, anchors, {"rows": "binary"}), d, positives), ["a_row"], positives)
    asked = staged(asking(blocks, staged(first.select("a_row", "id", "row", "score"))))
    found = first_of(negatives_of(celled(buckets, asked, anchors, _ASKED), d, negatives, low, high), ["a_row", "p_row"], negatives)
    return found.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"),
    )
