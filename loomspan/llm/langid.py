"""Languages of texts as mixtures: expectation-maximisation over words, a set chosen by penalised likelihood.

Each language has a model of byte trigrams inside words, counted over all labelled
texts. A word's likelihood under a language is the product over its trigrams; a
text is a mixture of languages. EM estimates the proportions over all languages; sets
of those whose shares are largest then grow by one language at a time, EM runs again on
each set, and a set is taken as long as its likelihood, at the proportions that are
best for it, rises by more than the penalty of one more language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, strings

BUCKETS = 1 << 14
MOST_LANGUAGES = 1024  # that a model may have; the driver holds BUCKETS numbers of each
_SLICE = 1 << 20
_WIDE = 8  # languages beyond which slices shrink in proportion, as there are numbers for each word and language
# ASCII that is no letter ends a word; bytes above 127 belong to words
_FOLD = bytes(b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32 for b in range(256))


def _features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words, the first feature of each word, and the text of each word."""
    parts = [x.encode().translate(_FOLD) for x in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    raw = np.frombuffer(b"  " + b"  ".join(parts) + b"  ", np.uint8)
    inside = raw != 32
    at = np.flatnonzero(inside)
    x = raw.astype(np.uint32)
    h = (x[at - 1] * np.uint32(0x01000193) ^ x[at] * np.uint32(0x9E3779B1)) + x[at + 1] * np.uint32(0x85EBCA6B)
    h = ((h ^ h >> np.uint32(15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(18)
    first = np.flatnonzero(~inside[at - 1])
    begins = np.cumsum(sizes + 2) - sizes
    return h.astype(np.int64), first, np.searchsorted(begins, at[first], side="right") - 1


@dataclass(frozen=True)
class LanguageModel:
    """Languages in ascending order and the logarithms of their trigram probabilities."""

    languages: tuple[str, ...]
    logs: np.ndarray  # languages x BUCKETS, float32


def counts_by_language(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, bucket, n: trigram counts over all labelled rows, at most BUCKETS rows a language from each partition."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, "t", _SLICE):
            texts, own = strings(batch, "t"), batch.column(1).to_pylist()
            names = sorted({x for x in own if x is not None})
            number = np.array([names.index(x) if x is not None else 0 for x in own], np.int64)
            h, first, doc = _features(texts)
            if not len(first):
                continue
            of = np.repeat(number[doc], np.diff(np.append(first, len(h))))
            n = np.bincount(of * BUCKETS + h, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for k, name in enumerate(names):
                total[name] = total.get(name, 0) + n[k]
        for name, n in total.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b])], ["lang", "bucket", "n"])

    found = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    return mapped(found, work, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", smooth: float = 0.5) -> LanguageModel:
    """A model from all rows with a language; the driver holds BUCKETS numbers a language.

    Rows without a language, without text or without letters teach nothing; no row makes a
    model without languages. More than MOST_LANGUAGES are an error.
    """
    table: dict[str, np.ndarray] = {}
    for r in counts_by_language(docs, text, lang).toLocalIterator():
        table.setdefault(r.lang, np.zeros(BUCKETS))[r.bucket] = r.n
        if len(table) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = tuple(sorted(table))
    logs = [np.log((table[k] + smooth) / (table[k].sum() + smooth * BUCKETS)) for k in names]
    return LanguageModel(names, np.array(logs, np.float32).reshape(len(names), BUCKETS))


def mixture(texts: list[str], model: LanguageModel, rounds: int = 6, penalty: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions (texts x languages) over the chosen set, zero outside of it; those over all languages; how many words each text has.

    A set of any size can be chosen. Each language costs ``penalty * log(words + 1)``. Ties
    go to the language that comes first in order, and to the smaller set.
    """
    n, k = len(texts), len(model.languages)
    h, first, doc = _features(texts)
    words = np.bincount(doc, minlength=n)
    share, every = np.zeros((n, k)), np.zeros((n, k))
    if not len(first) or not k:
        return share, every, words
    like = np.stack([np.add.reduceat(model.logs[i][h], first) for i in range(k)], axis=1)
    top = like.max(axis=1, keepdims=True)
    like = np.exp(like - top).astype(np.float64) + 1e-12  # per word, relative to its best language
    has = np.flatnonzero(words)
    every[has] = full = _em(like, words[has], np.full((len(has), k), 1.0 / k), rounds)[0]
    rank = np.argsort(-full, axis=1, kind="stable")
    gain = np.full(len(has), -np.inf)
    live, starts = np.arange(len(has)), np.cumsum(words[has]) - words[has]
    for size in range(1, k + 1):
        own = rank[live, :size]
        counts = words[has][live]
        at = np.repeat(starts[live] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))  # the words of these texts
        p = np.take_along_axis(full[live], own, axis=1) + 1e-12
        p, score = _em(like[at[:, None], np.repeat(own, counts, axis=0)], counts, p / p.sum(axis=1, keepdims=True), rounds if size > 1 else 0)
        score -= penalty * size * np.log(counts + 1)
        better = score > gain[live]
        live, own, p = live[better], own[better], p[better]
        if not len(live):
            break
        gain[live] = score[better]
        share[has[live]] = 0
        share[has[live][:, None], own] = p
    return share, every, words


def _em(like: np.ndarray, counts: np.ndarray, p: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` of expectation and maximisation, and the log-likelihood there; texts have ``counts`` words."""
    of, starts = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    for _ in range(rounds):
        r = p[of] * like
        r /= r.sum(axis=1, keepdims=True)
        p = np.add.reduceat(r, starts, axis=0) / counts[:, None]
    return p, np.add.reduceat(np.log((p[of] * like).sum(axis=1)), starts)


def _slice(model: LanguageModel) -> int:
    return max(1, _SLICE * _WIDE // max(_WIDE, len(model.languages)))


_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, the columns ``keep``, lang_pred, score, langs (map of the chosen set's proportions).

    ``und`` with score 0 where the text is null or has no letter, or no language was
    learned. The score is the proportion of the predicted language among all languages,
    before a set is chosen, so it is below 1 where words could be of another; ties go to the
    language that comes first in order. Repeated rows give repeated rows, no row gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    names = ["_id", *(f"_k{i}" for i in range(len(keep))), "lang_pred", "score", "langs"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "_t", _slice(m)):
            texts = strings(batch, "_t")
            share, every, _ = mixture(texts, m)
            pred, score, sets = [], [], []
            for x, row, of_all in zip(texts, share, every, strict=True):
                if not len(row) or not row.any() or not has_letter(x):
                    pred.append("und"), score.append(0.0), sets.append([])
                    continue
                k = int(row.argmax())
                pred.append(m.languages[k]), score.append(min(1.0, float(of_all[k])))
                sets.append([(m.languages[i], float(row[i])) for i in np.flatnonzero(row).tolist()])
            columns = [batch.column(i) for i in range(1 + len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.map_(pa.string(), pa.float64()))], names)

    source = docs.select(F.col(id_col).alias("_id"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_t"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    out = mapped(source, work, f"{kinds}, lang_pred string, score double, langs map<string,double>")
    for i, c in enumerate(keep):
        out = out.withColumnRenamed(f"_k{i}", c)
    return out.withColumnRenamed("_id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose main language has a proportion of at least ``least``, with all their columns.

    Null texts and texts without a letter go, and so does every row where no language was
    learned. Each row is judged by its text alone: repeated rows stay or go together.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, _slice(shared.value)):
            texts = strings(batch, text)
            share, _, _ = mixture(texts, shared.value)
            sure = share.max(axis=1, initial=0.0) >= least
            yield batch.filter(pa.array([bool(s) and has_letter(x) for s, x in zip(sure, texts, strict=True)]))

    return mapped(docs, work, docs.schema)
