"""Quality rules as a short-circuit cascade, ordered by rejections per cost.

A sample tells each rule's cost and how much it rejects; rules then run in the
order of rejections per second, each only on the texts that all rules before it
passed. The order changes the time taken, never a verdict.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as exact
from .common import mapped, slices, strings

_SPACES = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"


class Texts:
    """A batch of texts with measures that are worked out when first asked for."""

    def __init__(self, texts: list[str]):
        self.texts, self._known = texts, {}

    def __len__(self) -> int:
        return len(self.texts)

    def __getattr__(self, name: str) -> np.ndarray:
        make = _MEASURES.get(name)
        if make is None:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = make(self)
        return self._known[name]

    def only(self, rows: np.ndarray) -> Texts:
        """The chosen texts, with all that is known of them so far."""
        if len(rows) == len(self):
            return self
        out = Texts([self.texts[k] for k in rows.tolist()])
        out._known = {k: v[rows] for k, v in self._known.items() if k not in ("raw", "words")}
        if "raw" in self._known:
            out._known["raw"] = [self.raw[k] for k in rows.tolist()]
        if "words" in self._known:
            doc, words = self.words
            number = np.full(len(self), -1)
            number[rows] = np.arange(len(rows))
            own = number[doc] >= 0
            out._known["words"] = number[doc[own]], exact.Words(*(x[own] for x in words))
        return out


def _raw(t: Texts) -> list[bytes]:
    return [x.encode() for x in t.texts]


def _without(t: Texts, letters: bytes) -> np.ndarray:
    return np.array([len(r) - len(r.translate(None, letters)) for r in t.raw], np.int64)


def _words(t: Texts) -> tuple[np.ndarray, exact.Words]:
    """Text number of each word of the batch, and the words."""
    sizes = np.array([len(r) for r in t.raw], np.int64)
    found = exact.split(b"\n".join(t.raw))
    return np.searchsorted(np.cumsum(sizes + 1), found.start, side="right"), found


def _same(words: exact.Words, x: np.ndarray | slice, y: np.ndarray | slice) -> np.ndarray:
    """Whether the words at ``x`` are those at ``y``."""
    return (words.a[x] == words.a[y]) & (words.b[x] == words.b[y]) & (words.size[x] == words.size[y])


def _n_words(t: Texts) -> np.ndarray:
    return np.bincount(t.words[0], minlength=len(t))


def _repeat_words(t: Texts, width: int = 5) -> np.ndarray:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    doc, words = t.words
    key = words.hash
    n = len(doc) - width + 1
    if n < 1:
        return np.zeros(len(t), np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + key[k : k + n]
        h ^= h >> np.uint64(29)
    whole = np.flatnonzero(doc[:n] == doc[width - 1 :])
    h = (h[whole] + doc[whole].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xA0761D6478BD642F)
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    pairs = np.flatnonzero(same)  # equal hashes: the words decide
    x, y = whole[order[pairs]], whole[order[pairs + 1]]
    for k in range(width):
        same[pairs] &= _same(words, x + k, y + k)
    same[pairs] &= doc[x] == doc[y]
    twice = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(order) else np.zeros(0, bool)
    at = whole[order[twice]]
    mark = np.zeros(len(doc) + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + width, -1)
    inside = np.cumsum(mark[:-1]) > 0
    return np.bincount(doc[inside], minlength=len(t))


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    n, dup = [], []
    for x in t.raw:
        own = [line for line in x.split(b"\n") if line.strip(_SPACES)]
        n.append(len(own))
        dup.append(len(own) - len(set(own)))
    return np.array([n, dup], np.int64).T.reshape(-1, 2)


def _stutter(t: Texts) -> np.ndarray:
    """Words equal to the word before."""
    doc, words = t.words
    same = _same(words, slice(1, None), slice(None, -1)) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][same], minlength=len(t))


def _cased(t: Texts) -> np.ndarray:
    upper = _without(t, bytes(range(65, 91)))
    return np.stack([upper, upper + _without(t, bytes(range(97, 123)))], axis=1)


_MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "raw": _raw, "words": _words, "n_words": _n_words, "n_symbols": lambda t: _without(t, _SYMBOLS), "lines": _lines,
    "word_chars": lambda t: np.array([len(x) for x in t.texts], np.int64) - _without(t, _SPACES),
    "n_repeat_words": _repeat_words, "stutter": _stutter, "cased": _cased, "n_dup_lines": lambda t: t.lines[:, 1],
}


@dataclass(frozen=True)
class QualityRule:
    """``rejects`` tells for each text of a batch whether the rule turns it away."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


#: The base rules are fixed; the others turn away symbol soup, shouting, stutter, boiler-plate lines and odd word lengths.
BASE = (
    QualityRule("few_words", lambda t: t.n_words < 10),
    QualityRule("repeated_windows", lambda t: 100 * t.n_repeat_words > 20 * t.n_words),
)
DEFAULT = (
    *BASE,
    QualityRule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    QualityRule("shouting", lambda t: (2 * t.cased[:, 0] > t.cased[:, 1]) & (t.cased[:, 1] >= 40)),
    QualityRule("stutter", lambda t: 4 * t.stutter > t.n_words),
    QualityRule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.lines[:, 0]),
    QualityRule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 20 * t.n_words)),
)


def sampled(docs: DataFrame, rows: int, files: int = 4) -> DataFrame:
    """About ``rows`` rows, drawn evenly from ``files`` files spread over the table (from all of it, if it isn't made of files).

    Only these files are read, and nothing is shuffled.
    """
    every = sorted(docs.inputFiles())
    if len(every) > files:
        chosen = [every[k * len(every) // files] for k in range(files)]
        # a local path begins with one slash there, with three in the list
        docs = docs.where(F.col("_metadata.file_path").isin([*chosen, *(x.replace("file:///", "file:/", 1) for x in chosen)]))
    n = docs.count()
    return docs.sample(min(1.0, rows / n), seed=7) if n else docs


def measure(docs: DataFrame, rules: tuple[QualityRule, ...], text: str = "text", sample_rows: int = 2000) -> dict[str, tuple[float, float]]:
    """Cost (seconds a text) and selectivity (share rejected) of each rule on about ``sample_rows`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1 << 20):
            texts = strings(batch, "t")
            for rule in rules:
                t, began = Texts(texts), time.perf_counter()  # nothing measured before: each rule pays for all it needs
                rejected = int(np.count_nonzero(rule.rejects(t)))
                yield pa.RecordBatch.from_arrays([pa.array([rule.name]), pa.array([time.perf_counter() - began]), pa.array([rejected]), pa.array([len(texts)])], ["rule", "s", "rejected", "n"])

    found = mapped(sampled(docs, sample_rows).select(F.col(text).alias("t")), work, "rule string, s double, rejected long, n long")
    rows = found.groupBy("rule").agg(F.sum("s").alias("s"), F.sum("rejected").alias("rejected"), F.sum("n").alias("n")).collect()
    return {r.rule: (r.s / r.n, r.rejected / r.n) for r in rows}


def ordered(rules: tuple[QualityRule, ...], seen: dict[str, tuple[float, float]]) -> tuple[QualityRule, ...]:
    """Rules by falling rejections per cost; unmeasured ones last, ties in the order given."""
    return tuple(sorted(rules, key=lambda r: -(seen[r.name][1] / max(seen[r.name][0], 1e-12)) if r.name in seen else 1.0))


def cascade(t: Texts, rules: tuple[QualityRule, ...]) -> np.ndarray:
    """Which texts pass all rules; each rule sees only what those before it passed."""
    alive = np.arange(len(t))
    for rule in rules:
        if not len(alive):
            break
        passed = np.flatnonzero(~rule.rejects(t))
        alive, t = alive[passed], t.only(passed)
    return alive


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[QualityRule, ...] = DEFAULT, sample_rows: int = 2000) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text counts as the empty one; it has no words and fails. Words are runs
    without ASCII white space, told apart exactly. Repeated rows give repeated rows, no
    row gives none. Only ``id_col`` and ``text`` are read. Upper case is judged on ASCII
    letters. The counts returned are worked out once for all rows; what else the rules
    need, only for the texts that get that far.
    """
    order = ordered(rules, measure(docs, rules, text, sample_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            t = Texts(strings(batch, "t"))
            counts = [pa.array(np.asarray(getattr(t, k), np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
            kept = np.zeros(len(t), bool)
            kept[cascade(t, order)] = True
            failed = BASE[0].rejects(t) | BASE[1].rejects(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(failed), pa.array(kept & ~failed)], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), work, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[QualityRule, ...] = DEFAULT, sample_rows: int = 2000) -> DataFrame:
    """The rows whose text passes the cascade, with all their columns.

    A null text counts as the empty one and goes with ``few_words``. Each row is judged
    by its text alone, so repeated rows stay or go together and ties do not arise.
    """
    order = ordered(rules, measure(docs, rules, text, sample_rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            yield batch.take(pa.array(cascade(Texts(strings(batch, text)), order)))

    return mapped(docs, work, docs.schema)
