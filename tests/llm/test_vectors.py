import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import negatives, vacode

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v double, l int, code string"


def vectors(n, d, seed, labels=4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((3, d))
    return [(int(k), [float(np.float32(x)) for x in (centres[k % 3] + r.standard_normal(d)) / math.sqrt(d)], int(r.integers(labels))) for k in range(n)]


def odd_rows():
    rows = vectors(330, 32, 1)
    rows += [(400, None, 1), (401, [], 1), (402, [*rows[0][1][:31], None], 1), (403, [float("nan")] * 32, 1), (404, [*rows[0][1][:31], float("-inf")], 1)]
    rows += [(405, rows[1][1][:16], 2), (406, [0.0] * 32, 0), (407, [-x for x in rows[0][1]], 0)]
    rows += [(500 + k, rows[100][1], k % 3) for k in range(40)]  # copies of an anchor
    rows += [rows[100], rows[100], rows[5], (None, rows[3][1], 1), (600, rows[4][1], None), (None, None, None)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0, 7, "clash") for r in rows], SCHEMA)


def whole(rows, d):
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) == d]
    return [(r[0], np.floor(np.array(r[1], np.float64) * 256).astype(np.int64), r[2]) for r in good]


def brute_codes(rows, d, parts=16, entries=64, rounds=2):
    rows = sorted(whole(rows, d), key=lambda r: (r[0] is None, r[0], r[1].tolist()))
    v = np.array([r[1] for r in rows]).reshape(len(rows), parts, -1)
    books = v[:entries].copy()

    def nearest():
        distances = np.array([[((x[p] - books[:, p]) ** 2).sum(axis=1) for p in range(parts)] for x in v])
        return distances.argmin(axis=2), distances.min(axis=2)

    for _ in range(rounds):
        at, _ = nearest()
        for p in range(parts):
            for k in range(len(books)):
                if (at[:, p] == k).any():
                    own = v[at[:, p] == k, p]
                    books[k, p] = [int(s) // len(own) for s in own.sum(axis=0)]
    at, distance = nearest()
    by_label = collections.Counter()
    for r, e in zip(rows, distance.sum(axis=1).tolist(), strict=True):
        by_label[r[2]] += e
    sha = hashlib.sha256(",".join(str(x) for p in range(parts) for k in range(len(books)) for x in books[k, p].tolist()).encode()).hexdigest()
    return collections.Counter((r[0], "".join(f"{x:02x}" for x in a), e, by_label[r[2]], sha) for r, a, e in zip(rows, at.tolist(), distance.sum(axis=1).tolist(), strict=True))


@pytest.mark.parametrize("n", [None, 20])
def test_codes_equal_brute_force(spark, n):
    rows = odd_rows()[:n]
    got = vacode.vector_codes(table(spark, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_codes(rows, 32)


def test_filtering_finds_the_nearest_entry_and_drops_most():
    r = np.random.default_rng(2)
    entries = np.floor(r.standard_normal((64, 8)) * 40).astype(np.int64)
    entries[7] = entries[3]
    asked = np.concatenate((np.floor(r.standard_normal((500, 8)) * 40).astype(np.int64), entries))
    cells = vacode.Cells(entries)
    exact = ((asked[:, None] - entries) ** 2).sum(axis=2)
    lower, upper = cells.bounds(asked)
    assert (lower <= exact).all() and (exact <= upper).all()
    entry, distance = cells.nearest(asked)
    assert entry.tolist() == exact.argmin(axis=1).tolist() and distance.tolist() == exact.min(axis=1).tolist()
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.5
    one = vacode.Cells(entries[:1])
    assert one.nearest(asked)[0].max() == 0


def test_codes_stand_for_vectors():
    r = np.random.default_rng(3)
    v = np.floor(r.standard_normal((200, 32)) * 30).astype(np.int64)
    books = np.ascontiguousarray(v[:64].reshape(64, 16, 2).swapaxes(0, 1))
    codes, distances = vacode.encode(v, vacode.cells_of(books))
    back = vacode.decode(codes, books)
    assert ((v - back) ** 2).sum(axis=1).tolist() == distances.sum(axis=1).tolist() and (back[:64] == v[:64]).all()


def test_vectors_of_other_shapes_are_told(spark):
    rows = spark.createDataFrame([(0, [0.5] * 17, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError):
        vacode.vector_codes(rows)
    far = spark.createDataFrame([(0, [1e9] * 16, 1)], "vec_id long, embedding array<double>, label int")
    for f in (vacode.vector_codes, negatives.hard_negatives):
        with pytest.raises(Exception, match="exactly"):
            f(far).collect()


def test_nothing_to_code_or_mine(spark):
    none = table(spark, [])
    unusable = table(spark, [(1, None, 1), (2, [], 2), (3, [float("nan")] * 16, 3)])
    for rows in (none, unusable):
        assert vacode.vector_codes(rows).collect() == [] and negatives.hard_negatives(rows).collect() == []


def brute_negatives(rows, d, every=100, positives=5, negatives=10, low=30, high=90):
    rows = [r for r in whole(rows, d) if r[0] is not None and r[2] is not None]
    out = []
    for a, (i, v, label) in enumerate(rows):
        if i % every:
            continue
        ranked = sorted(((-int(v @ w), j, k) for k, (j, w, _) in enumerate(rows) if k != a))
        mine = [(s, j) for s, j, k in ranked if rows[k][2] == label][:positives]
        for s, j in mine:
            window = [(t, m) for t, m, k in ranked if rows[k][2] != label and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, n + 1, m, -s, -t) for n, (t, m) in enumerate(window[:negatives])]
    return collections.Counter(out)


@pytest.mark.parametrize("sizes", [(1024, 8, 256), (16, 2, 4)])
def test_negatives_equal_brute_force(spark, sizes):
    rows = odd_rows()
    got = negatives.hard_negatives(table(spark, rows), every=10)
    want = brute_negatives(rows, 32, every=10)
    assert len(want) > 500 and collections.Counter(tuple(r) for r in got.collect()) == want


def test_small_packs_and_many_cells(spark):
    """Cells of few buckets and anchors: what is pruned in each, and merged over all, is the same."""
    rows = [(i, [x * (1 + i % 7) for x in v], label) for i, v, label in vectors(400, 16, 9, labels=3)]
    d = 16
    source = table(spark, rows).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").cast("long").alias("l"))
    buckets = negatives.packed(source, d, 16)
    assert buckets.agg(F.sum("n"), F.max("n")).first() == (400, 16)
    order = [r.reach for r in buckets.orderBy("bucket").collect()]
    assert order == sorted(order, reverse=True)
    assert negatives.celled(buckets, negatives.blocks_of(buckets, d, 10), 1 << 17, {"rows": "binary"}).select("stripe", "group").distinct().count() > 4


def test_the_best_are_kept_in_order():
    r = random.Random(4)
    best = negatives.Best(3, 4)
    seen = [[] for _ in range(3)]
    for _ in range(20):
        ids = np.array(sorted(r.sample(range(1000), 6)))
        score = np.array([[r.choice([negatives._NONE, -5, 0, 3, 9]) for _ in range(6)] for _ in range(2)])
        who = np.array(sorted(r.sample(range(3), 2)))
        best.offer(who, score, ids, ids)
        for w, row in zip(who.tolist(), score.tolist(), strict=True):
            seen[w] += [(-s, i) for s, i in zip(row, ids.tolist(), strict=True) if s != negatives._NONE]
    for w in range(3):
        want = sorted(seen[w])[:4]
        assert [(-s, i) for s, i in zip(best.score[w].tolist(), best.id[w].tolist(), strict=True)] == want
