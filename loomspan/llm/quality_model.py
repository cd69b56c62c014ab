"""A quality classifier: random Fourier features of text statistics, ridge scores, isotonic calibration.

Statistics of each text (shares of symbols, upper case, repeats, word lengths ...) are
worked out once and written. Random Fourier features turn them into DIM numbers whose inner
products approximate a Gaussian kernel. Each partition sums its part of the normal equations
by fold; the driver solves a system of DIM + 1 unknowns. Scores of each fold by what the
others taught, counted in bins, are calibrated by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, staged, strings
from .quality import Texts, _without

DIM = 256  # random features
FOLDS = 4  # of texts, by hash, so that copies of one text share a fold
RIDGE = 1e-4  # of the number of rows
BINS = 4096  # of raw scores from LOW to HIGH that calibration counts
LOW, HIGH = -1.0, 2.0
_CLIP = 6.0  # standard deviations
_ENDS = b".!?"
_MARKS = b",;:'\"()-"


def _share(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    return x / np.maximum(of, 1)


def _distinct(t: Texts) -> np.ndarray:
    doc, words = t.words
    own = np.unique(np.stack([doc.astype(np.uint64), words.hash], axis=1), axis=0)[:, 0] if len(doc) else doc
    return np.bincount(own.astype(np.int64), minlength=len(t))


def _sizes(t: Texts, least: int, most: int) -> np.ndarray:
    doc, words = t.words
    return np.bincount(doc[(words.size >= least) & (words.size <= most)], minlength=len(t))


STATISTICS = {
    "words": lambda t: np.log1p(t.n_words),
    "word_length": lambda t: np.log1p(_share(t.word_chars, t.n_words)),
    "symbols": lambda t: np.sqrt(_share(t.n_symbols, t.n_words)),
    "upper": lambda t: _share(t.cased[:, 0], t.cased[:, 1]),
    "letters": lambda t: _share(t.cased[:, 1], t.word_chars),
    "digits": lambda t: np.sqrt(_share(_without(t, b"0123456789"), t.word_chars)),
    "ends": lambda t: np.sqrt(_share(_without(t, _ENDS), t.n_words)),
    "shouts": lambda t: np.sqrt(_share(_without(t, b"!"), t.n_words)),
    "marks": lambda t: np.sqrt(_share(_without(t, _MARKS), t.n_words)),
    "stutter": lambda t: np.sqrt(_share(t.stutter, t.n_words)),
    "repeats": lambda t: np.sqrt(_share(t.n_repeat_words, t.n_words)),
    "distinct": lambda t: _share(_distinct(t), t.n_words),
    "short_words": lambda t: _share(_sizes(t, 1, 2), t.n_words),
    "long_words": lambda t: _share(_sizes(t, 13, 1 << 40), t.n_words),
    "lines": lambda t: np.log1p(t.lines[:, 0]),
    "line_length": lambda t: np.log1p(_share(t.n_words, t.lines[:, 0])),
    "repeated_lines": lambda t: _share(t.n_dup_lines, t.lines[:, 0]),
}
"""Numbers of each text; all are 0 for a text without words."""


def statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns ``keep`` as k0, k1 ..., fold (by the text), and each statistic. Null texts count as empty; written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            t = Texts(strings(batch, "t"))
            columns = [pa.array(make(t).astype(np.float32)) for make in STATISTICS.values()]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(2 + len(keep))] + columns, ["id", "fold", *(f"k{i}" for i in range(len(keep))), *STATISTICS])

    fold = F.pmod(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.lit(FOLDS)).cast("int").alias("fold")
    source = docs.select(F.col(id_col).alias("id"), fold, *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return staged(mapped(source, work, kinds + "".join(f", {s} float" for s in STATISTICS)))


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, random features, ridge weights, and the calibration's points (empty: nothing was learned)."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """rows x (DIM + 1): random Fourier features and a constant."""
        z = np.clip((x - self.mean) / self.scale, -_CLIP, _CLIP) @ self.frequencies + self.phases
        return np.concatenate((np.cos(z) * np.sqrt(2 / DIM), np.ones((len(x), 1))), axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated score of rows of statistics, 0 to 1; 0.5 where nothing was learned."""
        if not len(self.at):
            return np.full(len(x), 0.5)
        return np.round(np.clip(np.interp(self.features(x) @ self.weights, self.at, self.value), 0, 1), 6)


def pooled(at: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of good / n on ``at`` (ascending) by pooling adjacent violators: mean place and value of each pool."""
    pools: list[list[float]] = []  # sum of places, good, n
    for x, g, k in zip(at.tolist(), good.tolist(), n.tolist(), strict=True):
        pools.append([x * k, g, k])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.stack([batch.column(first + k).to_numpy() for k in range(len(STATISTICS))], axis=1).astype(np.float64)


_UPPER = np.triu_indices(DIM + 1)
_ENTRIES = len(_UPPER[0])


def sums(labelled: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By fold: sums of feature products, of features times labels, and rows, added up in each partition first.

    ``labelled``: fold, y, statistics. A partition gives FOLDS * (DIM + 2)**2 / 2 numbers at most, however many rows it has.
    """
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, _ENTRIES + DIM + 2))
        for batch in batches:
            fold, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float64)
            z = shared.value.features(_matrix(batch, 2))
            for f in range(FOLDS):
                own, target = z[fold == f], y[fold == f]
                total[f] += np.concatenate(((own.T @ own)[_UPPER], own.T @ target, [len(own)]))
        for f in np.flatnonzero(total[:, -1]).tolist():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], f, np.int32)), pa.array(np.arange(total.shape[1], dtype=np.int32)), pa.array(total[f])], ["fold", "k", "v"])

    rows = mapped(labelled.select("fold", "y", *STATISTICS), work, "fold int, k int, v double").groupBy("fold", "k").agg(F.sum("v").alias("v")).toArrow()
    total = np.zeros((FOLDS, _ENTRIES + DIM + 2))
    total[rows.column(0).to_numpy(), rows.column(1).to_numpy()] = rows.column(2).to_numpy()
    products = np.zeros((FOLDS, DIM + 1, DIM + 1))
    for f in range(FOLDS):
        products[f][_UPPER] = total[f, :_ENTRIES]
        products[f] += np.triu(products[f], 1).T
    return products, total[:, _ENTRIES:-1], total[:, -1]


def ridge(products: np.ndarray, targets: np.ndarray, n: float) -> np.ndarray:
    """Weights of the normal equations; the constant is not shrunk."""
    penalty = np.full(DIM + 1, max(RIDGE * n, 1e-3))
    penalty[-1] = 1e-9
    return np.linalg.solve(products + np.diag(penalty), targets)


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", seed: int = 20240301) -> QualityModel:
    """A model from all rows of ``statistics`` that ``labels`` (id, 0 or 1) names.

    Standardisation counts all rows; null ids and labels teach nothing, repeated labels count each. Labels
    other than 0 count as 1. Without labels nothing is learned; with one kind only, scores are that kind.
    """
    d = len(STATISTICS)
    found = stats.agg(*(F.avg(s).alias(f"m_{s}") for s in STATISTICS), *(F.stddev_pop(s).alias(f"s_{s}") for s in STATISTICS)).first()
    mean, scale = (np.array([x or 0.0 for x in part]) for part in (found[:d], found[d:]))
    draw = np.random.default_rng(seed)
    model = QualityModel(np.round(mean, 9), np.round(np.maximum(scale, 1e-3), 9), draw.standard_normal((d, DIM)) / np.sqrt(d), draw.uniform(0, 2 * np.pi, DIM), np.zeros(DIM + 1), np.empty(0), np.empty(0))
    known = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.when(F.col(label) != 0, 1).otherwise(0).alias("y"))
    labelled = staged(stats.join(known, "id").select("fold", "y", *STATISTICS))
    products, targets, n = sums(labelled, model)
    if not n.sum():
        return model
    others = [ridge(products.sum(0) - products[f], targets.sum(0) - targets[f], n.sum() - n[f]) for f in range(FOLDS)]
    at, good, rows = binned(labelled, model, np.array(others))
    return QualityModel(model.mean, model.scale, model.frequencies, model.phases, ridge(products.sum(0), targets.sum(0), n.sum()), *pooled(at, good, rows))


def binned(labelled: DataFrame, model: QualityModel, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres of bins of scores by the weights of the other folds, labels 1 there, and rows there: BINS at most."""
    shared = labelled.sparkSession.sparkContext.broadcast((model, others))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, weights = shared.value
        count = np.zeros((2, BINS), np.int64)
        for batch in batches:
            raw = (m.features(_matrix(batch, 2)) * weights[batch.column(0).to_numpy()]).sum(axis=1)
            at = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            y = batch.column(1).to_numpy()
            count += np.stack([np.bincount(at, y, BINS).astype(np.int64), np.bincount(at, minlength=BINS)])
        own = np.flatnonzero(count[1])
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(count[0, own]), pa.array(count[1, own])], ["bin", "good", "n"])

    rows = mapped(labelled.select("fold", "y", *STATISTICS), work, "bin int, good long, n long").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toArrow()
    order = np.argsort(rows.column(0).to_numpy())
    centre = LOW + (rows.column(0).to_numpy()[order] + 0.5) * (HIGH - LOW) / BINS
    return centre, rows.column(1).to_numpy()[order], rows.column(2).to_numpy()[order]


def scored(stats: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``statistics`` as id, k0, k1 ..., score. Each row is scored by its statistics alone."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    carried = [c for c in stats.columns if c not in STATISTICS and c != "fold"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_matrix(batch, len(carried)))
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(carried))] + [pa.array(score)], [*carried, "score"])

    kinds = ", ".join(f"{c} {stats.schema[c].dataType.simpleString()}" for c in carried)
    return mapped(stats.select(*carried, *STATISTICS), work, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", label: str = "quality", least: float = 0.3) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 where score >= ``least``).

    ``held_out`` makes a boolean column of the id column's name; held-out ids teach nothing. Null and empty texts have
    statistics of 0 and are scored by them; rows without an id are scored and teach nothing; repeated rows
    give repeated rows with one score, no row gives none. Only ``id_col`` and ``text`` of ``docs`` are read.
    """
    stats = statistics(docs.withColumn("_held", held_out(id_col)), id_col, text, ("_held",))
    model = fit(stats, labels.where(~held_out(id_col)), id_col, label)
    out = scored(stats, model)
    return out.select(F.col("id").alias(id_col), F.col("k0").alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))
