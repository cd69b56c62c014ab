import collections
import re

import corpus_pipeline
from loomspan.llm import langid

from .cases import words
from .test_operators import base_counts, crc, ids_of, library, linked, naive_mixture  # noqa: F401

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark):
    base, passage = words(120, 1), words(60, 2)
    near = base.split()
    near[119] = "changed"
    rows = [(0, base), (1, base), (2, " ".join(near)), (3, f"{words(50, 3)} {passage}"), (4, f"{words(50, 4)} {passage}"), (5, "short"), (6, None), (7, "*** " * 40), (8, words(30, 5)), (9, "same word here again and more " * 9)]
    rows += [(10, "Über " + words(25, 6)), (10, "Über " + words(25, 6)), (None, words(40, 7)), (11, "LOUD WORDS ALL AROUND THE HOUSE " * 2 + "AND SO ON FOR LONG"), (12, "twice twice said said is is what what we we do do not not want want here here")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)


def good(text):
    n_words, chars, symbols, dup, repeat = base_counts(text)
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    upper, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    stutter = sum(a == b for a, b in zip(w, w[1:]))
    bad = n_words < 10 or 100 * repeat > 20 * n_words or 10 * symbols > n_words or (2 * upper > letters and letters >= 40)
    return not (bad or 4 * stutter > n_words or 2 * dup > lines or chars < 2 * n_words or chars > 20 * n_words)


def without_repeats(texts, length=200):
    """Texts without the bytes of strings that start twice; characters that a cut would split stay."""
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(x[p : p + length] for x in raw for p in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept, at = [], 0
        for c in x.decode():
            n = len(c.encode())
            if not all(gone[at : at + n]):
                kept.append(c)
            at += n
        out.append("".join(kept))
    return out


def test_each_stage_equals_brute_force(spark, tmp_path, library):  # noqa: F811
    now = docs(spark)
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        after = now.collect()
        key = lambda r: (r.doc_id is None, r.doc_id, r.text)
        if name != "packing":
            assert now.columns == columns
        if name == "quality":
            assert sorted(map(key, after)) == sorted(key(r) for r in before if good(r.text)) and 5 < len(after) < len(before)
        if name == "language":
            model = langid.fit(spark.createDataFrame(before, COLUMNS))
            want = [key(r) for r in before if max(naive_mixture(r.text, model)[0].values(), default=0) >= 0.5]
            assert sorted(map(key, after)) == sorted(want)
        if name == "near_duplicates":
            ids = {}
            for r in before:
                ids.setdefault((r.doc_id, r.text), len(ids))
            by = {k: i for i, k in ids.items()}
            groups = collections.defaultdict(set)
            for i, _, c in linked([(i, t) for (_, t), i in ids.items()], 5):
                groups[c].add(by[i])
            first = lambda group: min(group, key=lambda r: (r[0] is not None, r[0] or 0))
            assert sorted((r.doc_id is None, r.doc_id, r.text) for r in after) == sorted((i is None, i, t) for i, t in map(first, groups.values()))
        if name == "repeats":
            want = without_repeats([r.text for r in before])
            assert sorted((r.text, r.n_chars) for r in after) == sorted((t, len(t)) for t in want) and any(len(a) < len(b.text) for a, b in zip(want, before))
        if name == "packing":
            pieces = collections.Counter()
            for r in before:
                ids = [*ids_of(library, r.text), 1]
                for p in range(0, len(ids), 4096):
                    pieces[(r.doc_id, p // 4096, p, crc(ids[p : p + 4096]))] += 1
            assert collections.Counter((r.doc_id, r.piece, r.start, r.ids_crc32) for r in after) == pieces
            places = collections.defaultdict(list)
            for r in after:
                places[r.sequence_id].append((r.offset, r.length))
            for own in places.values():
                assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_stages_on_nothing(spark, tmp_path):
    now = spark.createDataFrame([], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert now.count() == 0


def test_near_duplicates_are_dropped_by_row(spark):
    texts = [words(120, k) for k in range(20, 24)]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in texts]
    rows = [(None, texts[0]), (None, near[0]), (1, texts[1]), (2, near[1]), (2, texts[2]), (2, texts[2]), (3, texts[3]), (3, near[3]), (None, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    alone = [(1, texts[1]), (2, texts[2]), (None, None), (4, "")]
    pairs = [{(None, texts[0]), (None, near[0])}, {(3, texts[3]), (3, near[3])}]
    assert len(got) == 6 and set(alone) < set(got) and all(len(p & set(got)) == 1 for p in pairs)
