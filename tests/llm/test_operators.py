import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from loomspan.llm import codec, langid, neardup, ogg, packing, quality, sharding, sst, suffix, urlfilter
from loomspan.llm.common import shared_dir

from .cases import SCHEMA, documents, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(codec.tokenizer_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TEXTS = [r[1] or "" for r in documents()]


def test_packing_places_every_piece_once(docs, library):
    rows = packing.pack_documents(docs, codec.tokenizer_path(), 256, 1).collect()
    want = collections.Counter()
    for r in documents():
        ids = [*ids_of(library, r[1]), 1]
        want.update((r[0], p // 256, p, len(ids[p : p + 256]), crc(ids[p : p + 256])) for p in range(0, len(ids), 256))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 256) * 11 / 9 + 1


def test_plans_use_every_length_as_often_as_it_occurs():
    r = random.Random(3)
    for capacity in (10, 100, 4096):
        counts = collections.Counter(r.randint(1, capacity) for _ in range(2000))
        runs = packing.plan(dict(counts), capacity)
        used = collections.Counter()
        for run in runs:
            assert sum(run.lengths) <= capacity
            for length in run.lengths:
                used[length] += run.n
        assert used == counts
        assert sum(x.n for x in runs) <= -(-sum(k * n for k, n in counts.items()) // capacity) * 1.08 + 2
    assert packing.plan({}, 10) == []


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, codec.tokenizer_path()).collect() == []


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def linked(rows, width, percent=80):
    sets = [(r[0] if r[0] is not None else -(1 << 63), shingles(r[1], width)) for r in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                up[y] = x
    return {(i, len(s), top(i)) for i, s in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, docs, width):
    more = [(100 + k, " ".join(w if (j * 7 + k) % 23 else "new%d" % k for j, w in enumerate(words(90, 50 + k % 3).split()))) for k in range(40)]
    rows = [(r[0], r[1]) for r in documents()] + more
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == linked(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("kind", ["replaced", "removed"])
def test_large_graded_groups_equal_brute_force(spark, kind):
    r = random.Random(11)
    base = [f"{w}{k}" for k, w in enumerate(words(140, 77).split())]
    rows = [(0, " ".join(base))]
    for k in range(1, 130):
        share = r.choice([0.01, 0.03, 0.05, 0.1, 0.12, 0.15, 0.2])
        own = [w if r.random() > share else r.choice(["new", "other", f"own{k}"]) for w in base]
        rows.append((k, " ".join(own if kind == "replaced" else [w for w in base if r.random() > share * 1.5])))
    rows += [(200 + k, f"{rows[k][1]} {words(3, k)}") for k in range(40)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    want = linked(rows, 2)
    assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == want and len({c for _, _, c in want}) > 3


def two_groups(n, seed=5, third=0):
    """Two groups of near copies, n texts each, with a similarity of about 0.67 between the groups; ``third`` more texts, each far from all but alike in what they change."""
    r = random.Random(seed)
    base = [f"{w}{k}" for k, w in enumerate(words(240, 31).split())]
    other = [w if k % 10 else f"else{k}" for k, w in enumerate(base)]
    rows = []
    for k in range(2 * n):
        rows.append((k, " ".join([*(base, other)[k % 2], f"own{k}", f"more{k}"])))
    for k in range(third):
        own = [w if j % 7 != 3 else f"third{j}" for j, w in enumerate(base)]
        for at in r.sample(range(240), 30):
            own[at] = f"own{k}y{at}"
        rows.append((2 * n + k, " ".join(own)))
    return rows


def test_two_large_groups_meet_in_proportion_to_their_size(spark, monkeypatch, third=40):
    made = []
    fitting = neardup.fitting
    monkeypatch.setattr(neardup, "fitting", lambda pairs, percent: (made.append(pairs.count()), fitting(pairs, percent))[1])
    counts = []
    for n in (60, 180):
        rows = two_groups(n, third=third)
        made.clear()
        got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
        assert {(x.doc_id, x.n_shingles, x.component_id) for x in got} == linked(rows, 2)
        counts.append(sum(made))
    assert counts[1] <= 3.5 * max(counts[0], 100)


def test_digests_tell_sets_by_their_words():
    a, b = "x y z x y", "x y z x y z x"
    (s, d), (t, e), (_, f) = neardup.digested_sets([a, b, "x y z"], 2)
    assert (s == t).all() and d == e != f and neardup.digested_sets(["", "one"], 2)[0][0].size == 0


def exact_links(rows, width, percent=80):
    """All links of a table: candidates share one of the rarest shingles that the bound leaves, exact sets decide."""
    sets = {i: shingles(t, width) for i, t in rows}
    n = collections.Counter(x for s in sets.values() for x in s)
    index, links = collections.defaultdict(list), set()
    for i, s in sorted(sets.items(), key=lambda x: (len(x[1]), x[0])):
        prefix = sorted(s, key=lambda x: (n[x], x))[: len(s) - -(-percent * len(s) // 100) + 1]
        seen = {j for x in prefix for j in index[x] if 100 * len(sets[j]) >= percent * len(s)}
        links |= {(min(i, j), max(i, j)) for j in seen if 100 * len(s & sets[j]) >= percent * len(s | sets[j])}
        for x in prefix:
            index[x].append(i)
    return links


def test_no_link_of_a_whole_table_is_lost(spark):
    folder = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(folder)
    component = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, width=2).collect()}
    links = exact_links([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 2)
    kept = sum(component[a] == component[b] for a, b in links)
    print(f"links {len(links)}, in one component {kept}, recall {kept / len(links):.6f}")
    assert kept == len(links) > 100
    up = {i: i for i in component}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        up[y] = x
    assert {i: top(i) for i in component} == component


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).collect() == []


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(5)
    a, b = r.integers(0, 1 << 63, 800, np.uint64), r.integers(0, 1 << 63, 200, np.uint64)
    one, two = np.concatenate((a, b)), a
    assert (neardup.merge(neardup.sketch(a), neardup.sketch(b)) == neardup.sketch(one)).all()
    j = neardup.estimate(neardup.sketch(one)[None], neardup.sketch(two)[None], np.array([1000]), np.array([800]))
    assert abs(j[0] - 0.8) < 0.12


def naive_mixture(text, model, penalty=2.0):
    """EM word by word over all languages, then again on each set of the largest, as long as the penalised likelihood rises."""
    h, first, _ = langid._features([text])
    words = [h[a:b] for a, b in zip(first, [*first[1:], len(h)])]
    logs = [[sum(model.logs[i][w].astype(float)) for i in range(len(model.languages))] for w in words]
    like = [[np.exp(x - max(row)) + 1e-12 for x in row] for row in logs]

    def em(own, p, rounds):
        for _ in range(rounds):
            total = dict.fromkeys(own, 0.0)
            for row in like:
                z = sum(p[i] * row[i] for i in own)
                for i in own:
                    total[i] += p[i] * row[i] / z
            p = {i: x / len(like) for i, x in total.items()}
        return p, sum(np.log(sum(p[i] * row[i] for i in own)) for row in like)

    every = range(len(model.languages))
    full, _ = em(every, dict.fromkeys(every, 1 / len(every)), 6)
    rank = sorted(every, key=lambda i: (-full[i], i))
    best, gain = {}, -np.inf
    for size in range(1, len(rank) + 1):
        own = rank[:size]
        z = sum(full[i] + 1e-12 for i in own)
        p, score = em(own, {i: (full[i] + 1e-12) / z for i in own}, 6 if size > 1 else 0)
        score -= penalty * size * np.log(len(like) + 1)
        if score <= gain:
            break
        best, gain = p, score
    return best, full


def test_mixtures_equal_naive_em(spark):
    names = ["l0", "l1", "l2", "l3", "l4"]
    letters = {x: "abcdefghijklmno"[3 * i : 3 * i + 5] for i, x in enumerate(names)}  # neighbours share letters
    some = lambda x, n, seed: " ".join("".join(random.Random(f"{x}{seed}{k}").choices(letters[x], k=5)) for k in range(n))
    model = langid.fit(spark.createDataFrame([(k, some(x, 300, 0), x) for k, x in enumerate(names)], "doc_id long, text string, lang string"))
    texts = [" ".join(some(x, n, 7) for x, n in zip(names, ns)) for ns in ([40], [20, 20], [30, 0, 9], [9, 9, 9, 9, 9], [1], [3, 2], [60, 1, 1])]
    share, every, _ = langid.mixture(texts + ["", "1 2"], model)
    for k, x in enumerate(texts):
        best, full = naive_mixture(x, model)
        assert np.allclose(every[k], [full[i] for i in range(5)], atol=1e-4)
        assert np.allclose(share[k], [best.get(i, 0) for i in range(5)], atol=1e-4)
    assert not share[len(texts) :].any()


def test_language_of_odd_rows(spark, docs):
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(documents()) and all((r.lang_pred == "und") == (not any(map(str.isalpha, x or ""))) for r, x in zip(got, [r[1] for r in documents()]))
    assert all(0 <= r.score <= 1 for r in got) and langid.keep_identified(docs, model).columns == docs.columns


def test_operators_on_nothing(spark, empty):
    path = codec.tokenizer_path()
    model = langid.LanguageModel(("a",), np.zeros((1, langid.BUCKETS), np.float32))
    pages = spark.createDataFrame([], "page_id long, url string")
    for out in (
        langid.identify(empty, model), langid.keep_identified(empty, model), quality.judge(empty), quality.keep_good(empty), ogg.text_media(empty),
        codec.encode_documents(empty, path, codec.build_lexicon(empty, path)), suffix.remove_repeats(empty), suffix.cut_repeats(empty), sharding.assign_shards(empty), urlfilter.judge_urls(pages, []),
    ):
        assert out.collect() == []


def test_language_of_held_out_texts_and_odd_ones(spark):
    rows = [(k, " ".join(random.Random(k).choice(v) for _ in range(60)), lang) for k in range(60) for lang, v in (("de", ["schön", "und", "nicht", "haben"]), ("en", ["the", "with", "that", "have"]))]
    model = langid.fit(spark.createDataFrame(rows[:100], "doc_id long, text string, lang string"))
    odd = [(900, None), (901, ""), (902, "123 !!"), (903, "und nicht"), (904, " ".join(["the with that have"] * 20 + ["schön und nicht haben"] * 20))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(r[0] * 2 + (r[2] == "en"), r[1]) for r in rows[100:]] + odd, "doc_id long, text string"), model).collect()}
    assert all(got[r[0] * 2 + (r[2] == "en")].lang_pred == r[2] for r in rows[100:])
    assert [got[k].lang_pred for k in (900, 901, 902, 903)] == ["und", "und", "und", "de"] and got[900].score == 0
    assert set(got[904].langs) == {"de", "en"} and abs(got[904].score - 0.5) < 0.1 and abs(got[904].langs["de"] - 0.5) < 0.1
    nothing = langid.fit(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(odd, "doc_id long, text string"), nothing).collect()] == ["und"] * 5


def test_texts_of_many_languages_keep_each(spark):
    names = [f"l{k}" for k in range(6)]
    vocabulary = {x: ["".join(random.Random(f"{x}{k}").choices("abcdefghijklmnopqrstuvwxyz"[4 * i : 4 * i + 5], k=6)) for k in range(40)] for i, x in enumerate(names)}
    some = lambda x, n: random.Random(n).choices(vocabulary[x], k=n)
    model = langid.fit(spark.createDataFrame([(k, " ".join(some(x, 400)), x) for k, x in enumerate(names)], "doc_id long, text string, lang string"))
    shares = {0: [84, 40, 40, 36], 1: [100] * 6, 2: [120, 80], 3: [200]}
    docs = spark.createDataFrame([(k, " ".join(w for x, n in zip(names, ns) for w in some(x, n))) for k, ns in shares.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    for k, ns in shares.items():
        assert set(got[k].langs) == set(names[: len(ns)]) and abs(got[k].score - max(ns) / sum(ns)) < 0.03
    assert {r.doc_id for r in langid.keep_identified(docs, model).collect()} == {2, 3}


def test_urls_equal_brute_force(spark):
    rules = [urlfilter.Rule("block", "net", "/"), urlfilter.Rule("allow", "example.net", "/en/"), urlfilter.Rule("block", "example.com", "/de/"), urlfilter.Rule("allow", "org", "/fr/")]
    r = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://net", "http://NET/", "https://a.Example.NET/en/x?q", "x://example.net/en", "http://notexample.com/de/", "http://b.example.com/de/#f", "http://org/fr/://"]
    urls += ["".join(r.choice(["http://", "a.", "example", ".net", ".com", "/de/", "/en/", "/", "?", "#", "org", "/fr/"]) for _ in range(6)) for _ in range(400)]

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
        host, path = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]
        fit = [x for x in rules if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fit, key=lambda x: (len(x.host + x.path), len(x.host), x.verdict), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    rows = [(k, u) for k, u in enumerate(urls)]
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {k: judge(u) for k, u in rows}


def test_urls_without_rules_and_with_odd_letters(spark):
    pages = spark.createDataFrame([(1, "http://É.Net/x", "c"), (1, "http://É.Net/x", "c"), (2, None, "c"), (3, "http://" + "a." * 3000 + "net/" + "y" * 5000, "c")], "page_id long, url string, host string")
    rules = [urlfilter.Rule("block", "É.NET", "/"), urlfilter.Rule("block", "É.NET", "/")]
    got = sorted((r.page_id, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, rules).collect())
    assert got == [(1, "É.net/", "block"), (1, "É.net/", "block"), (2, None, "allow"), (3, None, "allow")]
    assert {(r.rule, r.verdict) for r in urlfilter.judge_urls(pages, []).collect()} == {(None, "allow")}


def test_url_filter_has_no_false_negatives(spark):
    keys = spark.range(3000).selectExpr("concat('k', id) as key")
    found = urlfilter.blocked_bloom(keys, "key", 256)
    from pyspark.sql import functions as F

    assert keys.where(urlfilter.may_contain(F.col("key"), found)).count() == 3000
    assert keys.selectExpr("concat('x', key) as key").where(urlfilter.may_contain(F.col("key"), found)).count() < 600


def test_url_filter_grows_with_its_rules(spark):
    n = 100_000
    keys = spark.range(n).selectExpr("concat('k', id) as key")
    blocks = urlfilter.size_for(n)
    table = urlfilter.block_table(keys, "key", blocks)
    assert blocks > 8192 and urlfilter.possible(keys, "key", table, blocks, True).count() == n
    assert urlfilter.possible(keys.selectExpr("concat('x', key) as key"), "key", table, blocks, True).count() < n / 20


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_a_table_of_blocks_changes_no_verdict(spark, broadcast_rows):
    rules = [urlfilter.Rule(v, h, p) for v, h, p in (("block", "net", "/"), ("allow", "a.net", "/x/"), ("block", "b.org", ""))]
    urls = [None, "", "http://net/", "http://a.net/x/1", "http://a.net/x/1", "http://c.a.net/y", "http://b.org", "http://org/", "http://q.b.org/z?x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = urlfilter.judge_urls(pages, rules, literal_blocks=0, broadcast_rows=broadcast_rows).collect()
    assert sorted(got) == sorted(urlfilter.judge_urls(pages, rules).collect()) and len(got) == len(urls)


def base_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_equal_brute_force(docs):
    got = quality.judge(docs).collect()
    want = collections.Counter((r[0], *base_counts(r[1])) for r in documents())
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_twice_written_words_are_turned_away(spark):
    from loomspan.llm import queries

    word = words(60, 3).split()
    rows = [(0, " ".join(w for w in word for _ in range(2))), (1, " ".join(word)), (2, " ".join(w for k, w in enumerate(word) for _ in range(1 + (k % 8 == 0))))]
    kept = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0: False, 1: True, 2: True} and "4 * stutter > n_words" in queries.ORACLE["op5_quality_rules"]


def test_the_sample_has_rows_of_tables_of_many_files(spark, tmp_path):
    for k in range(9):
        spark.range(k * 50, k * 50 + 50).selectExpr("id AS doc_id", "concat('some words of text number ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/t", mode="append")
    table = spark.read.parquet(f"{tmp_path}/t")
    assert len(table.inputFiles()) == 9
    assert 0 < quality.sampled(table, 1000).count() <= 200 and set(quality.measure(table, quality.DEFAULT)) == {r.name for r in quality.DEFAULT}


def test_the_order_of_rules_changes_no_verdict():
    t = quality.Texts(TEXTS)
    want = quality.cascade(t, quality.DEFAULT).tolist()
    for seed in range(5):
        rules = random.Random(seed).sample(quality.DEFAULT, len(quality.DEFAULT))
        assert quality.cascade(quality.Texts(TEXTS), tuple(rules)).tolist() == want
    seen = {"a": (1.0, 0.5), "b": (0.1, 0.2), "c": (1.0, 0.0)}
    rules = tuple(quality.QualityRule(n, None) for n in "cab")
    assert [r.name for r in quality.ordered(rules, seen)] == ["b", "a", "c"]


def slow_checksum(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = (c << 1 ^ (0x04C11DB7 if c >> 31 else 0)) & 0xFFFFFFFF
    return c


def test_media_round_trip(docs):
    for x in (b"", b"a", b"OggS" * 40, bytes(range(256))):
        assert ogg.checksum(x) == slow_checksum(x)
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in ogg.text_media(docs).collect())
    want = collections.Counter()
    for r in documents():
        raw = (r[1] or "").encode()
        p = ogg.pad(raw)
        assert len(p) % 192 == 0 and p and p.startswith(raw)
        want[(r[0], len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))] += 1
    assert got == want


def test_media_damage_is_found(spark):
    media = ogg.mux(ogg.pad(words(9000, 9).encode()))
    sound = ogg.read(media)
    assert sound.payload == ogg.pad(words(9000, 9).encode()) and len(sound.streams) == 2 and len(sound.times) > 31
    assert sound.times == [k * ogg.PACKET / ogg.RATE for k in range(len(sound.times))]
    for at in range(0, len(media), 997):
        with pytest.raises(ogg.OggError):
            ogg.read(media[:at] + bytes((media[at] ^ 1,)) + media[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.read(media[:-5])
    rows = ogg.packets(spark.createDataFrame([(1, media), (2, b"junk"), (3, None)], "doc_id long, media binary")).collect()
    assert {r.doc_id for r in rows if r.error} == {2, 3} and sum(r.doc_id == 1 for r in rows) > 30


def test_sound_files_of_another_kind_are_told():
    def file(sound, index, samples=(b"x" * 192,)):
        pages = [ogg._page(ogg.FIRST, 0, s, 0, *ogg._one(head)) for s, head in ((ogg.SOUND, sound), (ogg.INDEX, index))]
        at = np.cumsum([len(x) for x in samples]).tolist()
        body = [p for _, p in ogg._pages(ogg.SOUND, list(zip(samples, at, strict=True)), 1, True)]
        entry = ogg._ENTRY.pack(0, 96, zlib.crc32(b"x" * 96))
        return b"".join(pages + body + [p for _, p in ogg._pages(ogg.INDEX, [(entry, 96)], 1, True)])

    good = ogg._SOUND_HEAD.pack(b"pcm8mono", 1, ogg.RATE, ogg.FRAME), ogg._INDEX_HEAD.pack(b"crcindex", ogg.RATE)
    for heads in ((b"", good[1]), (b"short", good[1]), (good[0], b"other"), good):  # the last: an index of half of the samples
        with pytest.raises(ogg.OggError):
            ogg.read(file(*heads))
    assert ogg.read(ogg.mux(b"y" * 1920)).payload == b"y" * 1920


def test_long_packets_span_pages():
    pages = list(ogg._pages(9, [(b"x" * 200_000, 1), (b"", 2), (b"y" * 255, 3)], 0, True))
    data = b"".join(p for _, p in pages)
    first = bytes((data[5] | ogg.FIRST,))
    page = data[:5] + first + data[6:22] + b"\0" * 4 + data[26 : len(pages[0][1])]
    data = page[:22] + ogg.checksum(page).to_bytes(4, "little") + page[26:] + data[len(page) :]
    s = ogg.demux(data)[9]
    assert [len(p) for p in s.packets] == [200_000, 0, 255] and s.ends[-1] == 3


def test_ids_and_decoded_texts_equal_the_librarys(docs, library):
    path = codec.tokenizer_path()
    got = codec.encode_documents(docs, path, codec.build_lexicon(docs, path)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = collections.Counter()
    for r in documents():
        ids = ids_of(library, r[1])
        want[(r[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want


def test_merging_equals_the_library_on_random_text(library):
    own = codec.WordCodec(codec.tokenizer_path(), most=200, most_pieces=100)
    r = random.Random(2)
    letters = "abcdeéÄ'’ 1²½_-.,\n\t­ßȺ"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(200))) for _ in range(600)] + TEXTS
    for k in range(0, len(texts), 50):
        for x, ids in zip(texts[k : k + 50], own.encode(texts[k : k + 50]), strict=True):
            assert ids.tolist() == ids_of(library, x), x


def test_transducer_finds_its_words_only(tmp_path):
    r = random.Random(4)
    lexicon = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))).encode(): np.array([k, k + 1]) for k in range(400)}
    (tmp_path / "words").write_bytes(codec.Transducer.build(lexicon).to_bytes())
    t = codec.Transducer.mapped(str(tmp_path / "words"))
    keys = sorted(lexicon)
    assert t.places(keys).tolist() == list(range(len(keys)))
    assert t.places([b"", b"abcabcabca", b"d"]).tolist() == [-1, -1, -1]
    assert t.out_ids[t.out_start[3] : t.out_start[4]].tolist() == lexicon[keys[3]].tolist()
    assert len(t.final) < sum(map(len, keys)) / 3
    assert codec.Transducer.build({}).places([b"a"]).tolist() == [-1]


def brute_repeats(rows, length):
    raw = [(r[1] or "").encode() for r in rows]
    seen = collections.Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    out = []
    for r, x in zip(rows, raw, strict=True):
        mark = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        runs = sum(1 for k in range(len(x)) if mark[k] and not (k and mark[k - 1]))
        out.append((r[0], len(x), sum(mark), runs, hashlib.sha256(bytes(b for b, m in zip(x, mark, strict=True) if not m)).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("length", [20, 200])
def test_repeats_equal_brute_force(docs, length, monkeypatch):
    got = suffix.remove_repeats(docs, length=length).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(documents(), length)


def test_repeats_over_several_shards_and_large_groups(spark, monkeypatch):
    passage = words(12, 31)
    rows = [(k, f"{words(4, 300 + k % 37)} {passage} {words(3, 700 + k)}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_repeats(rows, 30)
    monkeypatch.setattr(suffix, "GROUP", 5)  # most anchors of the passage are beyond it
    for shard in (suffix.SHARD, 300):  # groups in one shard, and in several
        monkeypatch.setattr(suffix, "SHARD", shard)
        got = suffix.remove_repeats(df, length=30).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_shards_of_one_group_meet_by_binary_search():
    passage = words(12, 31).encode()
    parts = [words(4, k).encode() + passage + words(3, k).encode() for k in range(12)]
    n = np.ones(6, np.int64)
    a, b = (suffix.repeated(p, n, 40) for p in (parts[:6], parts[6:]))
    mine, theirs = suffix.Shard(a[0], a[2], 40).find(suffix.Shard(b[0], b[2], 40))
    assert {a[0][k : k + 40].tobytes() for k in mine} == {b[0][k : k + 40].tobytes() for k in theirs} >= {passage[:40]}


@pytest.mark.parametrize("bits", [1, 3, 64])
def test_anchors_depend_on_the_string_alone(monkeypatch, bits):
    """Equal strings in slices of any size have one anchor, also where many hashes tie."""
    cut = np.uint64(64 - bits)
    monkeypatch.setattr(suffix, "gram_hash", lambda *a: suffix.span_hash(*a) >> cut)
    r = random.Random(bits)
    shared = bytes(r.choice(b"abc") for _ in range(260))
    slices = [[shared], [b"x" * 40, shared + b"tail"], [bytes(r.choice(b"ab") for _ in range(1 << 18)) + shared, b"y" * 300]]
    seen = collections.defaultdict(set)
    for parts in slices:
        for anchor, part, first, size, core in zip(*(x.tolist() for x in suffix.segments(parts, 200)), strict=True):
            for k in range(size - 199):
                assert core >= k and core - k <= 160
                seen[parts[part][first + k : first + k + 200]].add((anchor, core - k))
    assert all(len(x) == 1 for x in seen.values())
    assert sum(shared[k : k + 200] in seen for k in range(61)) == 61


def test_leftmost_minima():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(1, 300))
        width = int(r.integers(1, n + 1))
        x = r.integers(0, int(r.choice([1, 2, 9, 10_000])), n).astype(np.uint64)
        assert suffix.leftmost_min(x, width).tolist() == [k + int(x[k : k + width].argmin()) for k in range(n - width + 1)]


def test_a_repeat_is_found_from_short_to_very_long_texts(spark):
    r = random.Random(11)
    shared = "".join(r.choice("abcdefgh ") for _ in range(200))
    long_one = "".join(map(str, np.random.default_rng(3).integers(0, 10**9, 300_000).tolist())) + shared
    got = {x.doc_id: x.n_removed for x in suffix.remove_repeats(spark.createDataFrame([(0, shared), (1, long_one), (2, "z" + shared[1:])], "doc_id long, text string")).collect()}
    assert got == {0: 200, 1: 200, 2: 0}


def test_suffix_arrays_and_common_prefixes():
    r = random.Random(8)
    for n in (1, 2, 50, 400):
        text = np.frombuffer(bytes(r.choice(b"ab") for _ in range(n)), np.uint8)
        order, where = suffix.suffix_array(text)
        raw = text.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda k: raw[k:])
        got = suffix.common_prefixes(text, order, where, np.array([0]), np.array([n]), 1000)
        for k in range(1, n):
            a, b = raw[order[k - 1] :], raw[order[k] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert got[order[k]] == same


def test_cut_texts_stay_whole_characters(docs):
    out = suffix.cut_repeats(docs, length=20)
    assert out.columns == docs.columns and out.count() == len(documents())
    assert suffix.whole_characters("éé".encode(), [(1, 3)]) == []
    assert suffix.whole_characters("aéb".encode(), [(0, 2)]) == [(0, 1)]


def test_tables_round_trip_in_order(spark, docs, library, tmp_path):
    rows = [r for r in documents() if r[0] is not None]
    files = sst.write_shards(spark.createDataFrame(rows, SCHEMA), codec.tokenizer_path(), f"{shared_dir(spark)}/t", 2, most=1000)
    got = sst.read_shards(files).orderBy("start").collect()
    at = 0
    for r, g in zip(sorted(rows, key=lambda r: (r[0])), got, strict=True):
        ids = [*ids_of(library, r[1]), 2]
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (r[0], at, len(ids), crc(ids))
        at += len(ids)
    assert files.count() > 2
    found = sst.lookup(files, [7, 12, 999])
    assert [x.tolist() for x in found[12]] == [[*ids_of(library, rows[12][1]), 2]] and len(found[7]) == 2 and found[999] == []


def test_an_id_that_many_rows_have_is_split(spark, library):
    rows = [(7, words(3, k % 5)) for k in range(200)] + [(None, "same text")] * 200 + [(9, "last")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one partition
    try:
        files = sst.write_shards(df, codec.tokenizer_path(), f"{shared_dir(spark)}/t", 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sst.read_shards(files).orderBy("start").collect()
    assert files.select("part").distinct().count() > 2
    want = collections.Counter(((-(1 << 63) if i is None else i), len(ids_of(library, t)) + 1) for i, t in rows)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in got) == want and [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    order = lambda: [(r.start, r.ids_crc32) for r in sst.read_shards(sst.write_shards(df, codec.tokenizer_path(), f"{shared_dir(spark)}/t", 2)).orderBy("start").collect()]
    assert order() == order()


def test_tables_of_nothing(spark, empty):
    assert sst.round_trip(spark, empty, codec.tokenizer_path()).collect() == []


def test_damaged_tables_are_found(tmp_path):
    path = tmp_path / "x.sst"
    with open(path, "wb") as f:
        w = sst.Writer(f, block=64)
        for k in range(-5, 300):
            w.add(k * 3, np.array([k + 9, 70_000 if k == 7 else 1]))
        w.finish()
    data = path.read_bytes()
    with open(path, "rb") as f:
        r = sst.Reader(f, len(data))
        assert [k for k, _ in r.scan()] == [k * 3 for k in range(-5, 300)]
        assert r.get(21)[0].tolist() == [16, 70_000] and r.get(22) == [] and r.get(-15)[0].tolist() == [4, 1]
    path.write_bytes(data[:10] + bytes((data[10] ^ 1,)) + data[11:])
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(sst.Reader(f, len(data)).scan())


def slow_jump(key, n):
    b = j = 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_moves_rows_into_the_new_shard_only(docs):
    keys = np.arange(-500, 3000)
    for n in (1, 2, 7, 40):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert a.tolist() == [slow_jump(int(k) & (1 << 64) - 1, n) for k in keys]
        moved = a != b
        assert (b[moved] == n).all() and abs(moved.mean() - 1 / (n + 1)) < 0.05
    rows = sharding.assign_shards(docs, 4).collect()
    by = collections.defaultdict(list)
    text = {r[0]: r[1] or "" for r in documents()}
    for r in rows:
        by[r.shard].append(r.slot)
        raw = text[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        key = np.array([r.doc_id or 0])
        assert (r.shard, r.grown_shard) == (sharding.jump(key, 4)[0], sharding.jump(key, 5)[0]) and r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(rows) == len(documents())
