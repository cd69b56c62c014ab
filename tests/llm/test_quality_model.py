import collections
import random

import numpy as np
import pytest

from loomspan.llm import quality_model as qm
from loomspan.llm.queries import kept_out

from .cases import SCHEMA, documents


def good_text(r):
    return ". ".join(" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(5, 12))).capitalize() for _ in range(r.randint(2, 9))) + "."


def bad_text(r):
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(r.randint(10, 60))]
    return r.choice([lambda: " ".join(w + "$$$" for w in words), lambda: " ".join(w.upper() + "!!" for w in words), lambda: " ".join(w for w in words for _ in range(9))])()


@pytest.fixture(scope="module")
def made():
    r = random.Random(3)
    return [(k, good_text(r) if k % 4 else bad_text(r), int(k % 4 > 0)) for k in range(600)]


def test_scores_tell_good_from_bad_on_held_out_rows(spark, made):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t, _ in made], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(k, y) for k, _, y in made] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = qm.classify(docs, labels, kept_out).collect()
    truth = {k: y for k, _, y in made}
    held = [r for r in got if r.held_out]
    assert len(got) == 600 and 60 < len(held) < 200
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    # what is held out teaches nothing, and only labels teach
    import zlib

    other = spark.createDataFrame([(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, _, y in made], "doc_id long, quality int")
    again = {r.doc_id: r.score for r in qm.classify(docs, other, kept_out).collect()}
    assert max(abs(again[r.doc_id] - r.score) for r in got) <= 2e-6


def test_partition_sums_equal_the_whole(spark, made):
    docs = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, text string").repartition(5)
    stats = qm.statistics(docs)
    labels = spark.createDataFrame([(k, y) for k, _, y in made], "doc_id long, quality int")
    model = qm.fit(stats, labels)
    rows = stats.join(labels, stats.id == labels.doc_id).collect()
    x = np.array([[r[s] for s in qm.STATISTICS] for r in rows], np.float64)
    y = np.array([r.quality for r in rows], np.float64)
    z = model.features(x)
    assert np.allclose(qm.ridge(z.T @ z, z.T @ y, len(y)), model.weights, atol=1e-4)
    assert (np.diff(model.value) > 0).all() and (np.diff(model.at) > 0).all()


def test_features_approximate_a_gaussian_kernel():
    r = np.random.default_rng(1)
    d = len(qm.STATISTICS)
    model = qm.QualityModel(np.zeros(d), np.ones(d), r.standard_normal((d, qm.DIM)) / np.sqrt(d), r.uniform(0, 2 * np.pi, qm.DIM), np.zeros(qm.DIM + 1), np.empty(0), np.empty(0))
    x = r.standard_normal((40, d))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x) ** 2).sum(axis=2) / (2 * d))
    assert np.abs(z @ z.T - exact).mean() < 0.06


def test_pooling_equals_brute_force():
    r = random.Random(5)
    for _ in range(50):
        n = [r.randint(1, 5) for _ in range(r.randint(1, 12))]
        good = [r.randint(0, k) for k in n]
        at, value = qm.pooled(np.arange(len(n), dtype=float), np.array(good), np.array(n))
        # the isotonic fit at i: max over starts of min over ends of the mean between
        mean = lambda a, b: sum(good[a : b + 1]) / sum(n[a : b + 1])
        want = [max(min(mean(a, b) for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]
        assert np.allclose(value, list(dict.fromkeys(round(x, 12) for x in want)))
    assert [len(x) for x in qm.pooled(np.empty(0), np.empty(0), np.empty(0))] == [0, 0]


def test_odd_documents_and_labels(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    labels = spark.createDataFrame([(r[0], r[0] % 2) for r in documents() if r[0] is not None], "doc_id long, quality int")
    got = qm.classify(docs, labels, kept_out).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in documents())
    by = collections.defaultdict(set)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        by[next(x[1] for x in documents() if x[0] == r.doc_id) or ""].add(r.score)
    assert all(len(x) == 1 for x in by.values())  # the text alone decides
    none = labels.where("false")
    assert {(r.score, r.predicted) for r in qm.classify(docs, none, kept_out).collect()} == {(0.5, 1)}
    assert qm.classify(docs.where("false"), labels, kept_out).collect() == []
    assert {r.score for r in qm.classify(docs, labels.selectExpr("doc_id", "1 AS quality"), kept_out).collect()} == {1.0}
