import json
import random
import zipfile

from pyspark.sql import functions as F

from loomspan import model, queries
from loomspan.functions import paths, text as texts
from loomspan.operators import graph, relations, rules, similarity, spans, tape
from loomspan.plans.rules import load
from loomspan.sources import files as sources
from loomspan.sources import ignore, sinks, trees


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


SPAN = "file string, start int, end int"


def test_innermost_spans(spark):
    df = frame(spark, SPAN, ("a", 0, 10), ("a", 2, 5), ("a", 20, 22), ("a", 2, 5), ("b", 0, 10))
    assert rows(tape.innermost(df)) == [("a", 2, 5), ("a", 20, 22), ("b", 0, 10)]


def test_span_joins_equal_brute_force(spark):
    r = random.Random(3)
    data = [("f%d" % r.randrange(2), k, a := r.randrange(60), a + r.randrange(0, 30)) for k in range(60)]
    df = frame(spark, "file string, idx int, start int, end int", *data)
    around = lambda x, y: x[0] == y[0] and y[2] <= x[2] and x[3] <= y[3] and (y[2] < x[2] or x[3] < y[3])
    want = sorted((x[1], min(((y[3] - y[2], y[1]) for y in data if around(x, y)), default=(0, -1))[1]) for x in data)
    assert sorted((x.idx, x.parent) for x in spans.parents(df).collect()) == want
    some = df.where("idx < 20")
    meets = {x[1] for x in data if any(y[0] == x[0] and y[1] < 20 and x[2] < y[3] and y[2] < x[3] for y in data)}
    assert {x.idx for x in spans.overlapping(df, some).collect()} == meets
    assert {x.idx for x in spans.overlapping(df, some, "left_anti").collect()} == {x[1] for x in data} - meets


def test_claims_edits_and_diffs(spark):
    e = frame(spark, "file string, seq int, start int, end int, new_text string", ("a", 0, 0, 2, "X"), ("a", 1, 1, 3, "Y"), ("a", 2, 4, 5, "Z"))
    assert [x.applied for x in spans.claimed(e).orderBy("seq").collect()] == [True, False, True]
    f = frame(spark, "file string, text string", ("a", "éabc"), ("b", "same"), ("c", None))
    assert dict(rows(spans.edited(f, spans.claimed(e).where("applied")))) == {"a": "XabZ", "b": "same", "c": None}
    assert spans.apply_edits("abc", [(1, 9, "x"), (0, 1, "")]) == "bc"
    for old, new in (("abcd", "abxd"), ("é", "è"), ("aa", "aaa"), ("x", "")):
        assert spans.apply_edits(old, [spans.minimal_edit(old, new)]) == new
    assert spans.minimal_edit("a", "a") is None
    assert rows(spans.diffed(f, frame(spark, "file string, text string", ("a", "éXbc"), ("b", "same")))) == [("a", 2, 3, "X")]


def test_claims_equal_brute_force(spark):
    r = random.Random(5)
    data = [(f"f{r.randrange(3)}", k, a := r.randrange(40), a + r.choice([0, 1, 3, 9]), "x") for k in range(120)]
    taken, want = [], set()
    for f, k, a, b, _ in data:
        if not any(f == g and x < b and a < y for g, x, y in taken):
            taken.append((f, a, b))
            want.add(k)
    got = spans.claimed(frame(spark, "file string, seq int, start int, end int, new_text string", *data)).collect()
    assert {x.seq for x in got if x.applied} == want and len(got) == 120


def test_flow_scores(spark):
    flows = frame(spark, "file string, start int, end int, class string", ("a", 1, 9, "structural"), ("a", 2, 8, "structural"), ("a", 3, 4, "hybrid"), ("a", 0, 10, "structural"), ("a", 5, 6, "structural"))
    units = frame(spark, "file string, idx int, start int, end int", ("a", 0, 0, 10), ("a", 1, 20, 30))
    assert rows(spans.flow_score(flows, units)) == [("a", 0, 1 + 2 + 1 + 3), ("a", 1, 0)]


def test_clauses_close_negate_and_stratify(spark):
    a, c = relations.atom, relations.clause
    p = relations.Program(
        c(a("path", "?x", "?y"), a("edge", "?x", "?y")), c(a("path", "?x", "?z"), a("path", "?x", "?y"), a("edge", "?y", "?z")),
        c(a("marked", "?x"), a("keep", "?x"), a("edge", "?x", "?x", negated=True)),
        c(a("sees", "?x"), a("marked", "?x")),  # positive, so it runs before anything is marked
        c(a("finding", "?x"), a("marked", "?x")),
    )
    out = p.evaluate({"edge": frame(spark, "a string, b string", ("a", "b"), ("b", "c"), ("c", "a")), "keep": frame(spark, "k string", ("a",))})
    assert len(rows(out["path"])) == 9 and rows(out["marked"]) == [("a",)] == rows(out["finding"])
    assert "sees" not in out or rows(out["sees"]) == []


def test_recursion_goes_to_its_end_with_nulls_and_circles(spark):
    a, c = relations.atom, relations.clause
    n = 110
    path = relations.Program(c(a("far", "?x", "?y"), a("edge", "?x", "?y")), c(a("far", "?x", "?z"), a("far", "?x", "?y"), a("far", "?y", "?z")))
    edges = frame(spark, "a int, b int", *((k, k + 1) for k in range(n)))
    assert path.evaluate({"edge": edges})["far"].count() == n * (n + 1) // 2
    swap = relations.Program(c(a("p", "?x", "?y"), a("e", "?x", "?y")), c(a("p", "?y", "?x"), a("p", "?x", "?y")))
    got = swap.evaluate({"e": frame(spark, "a string, b string", ("u", None), (None, None), ("v", "w"))})["p"]
    assert rows(got) == sorted([("u", None), (None, "u"), (None, None), ("v", "w"), ("w", "v")], key=str)
    ring = relations.closure(frame(spark, "p int, c int", *((k, (k + 1) % 200) for k in range(200)), (None, 3)), "p", "c")
    assert ring.count() == 200 * 200 and ring.agg(F.max("depth")).first()[0] == 200


def test_builtins(spark):
    a, c = relations.atom, relations.clause
    p = relations.Program(
        c(a("down", "?x", "?y"), a("n", "?x"), a("$pred", "?x", "?y")), c(a("ok", "?x"), a("n", "?x"), a("$ge0", "?x")),
        c(a("not_one", "?x"), a("n", "?x"), a("$pred", "?x", 0, negated=True)), c(a("odd", "?q"), a("n", "?x")), c(a("wrong", "?x"), a("n", "?x", "?y")),
        builtins=relations.PLAIN,
    )
    out = p.evaluate({"n": frame(spark, "n int", (-1,), (0,), (1,), (5,))})
    assert rows(out["down"]) == [(1, 0), (5, 4)] and rows(out["ok"]) == [(0,), (1,), (5,)]
    assert rows(out["not_one"]) == [(-1,), (0,), (5,)] and "odd" not in out and "wrong" not in out


def test_dead_imports(spark):
    columns = "file string, local string, spec string, member string, start int, end int, pstart int, pend int, star boolean"
    i = frame(spark, columns, ("f", "a", "'x/a'", "", 0, 11, 0, 0, False), ("f", "b", "'x/b'", "", 12, 24, 0, 0, False), ("f", "*", "'y'", "", 25, 30, 0, 0, True), ("f", "_", "'z'", "", 31, 40, 0, 0, False))
    u = frame(spark, "file string, name string, start int, end int", ("f", "a", 50, 51), ("f", "b", 13, 14))
    found, edits = graph.dead_imports(i, u, u.limit(0))
    assert rows(found.select("file", "start", "end")) == [("f", 12, 24)] and rows(edits)[0][-1] == ""


def test_renames_and_moves(spark):
    atoms = frame(spark, SPAN + ", name string", ("a", 5, 11, "Helper"))
    bound = frame(spark, SPAN + ", target_ref string, via_alias boolean", ("b", 40, 46, "path:a::Helper", False), ("b", 20, 26, "path:a::Helper", True))
    alias = frame(spark, model.RELATIONS["alias"], ("path:c", 0, 0, "path:a::Helper", "", 0, 0))
    goal = frame(spark, "ref string, new_text string", ("path:a::Helper", "Aid"))
    assert rows(graph.rename_edits(goal, atoms, bound, alias)) == [("a", 5, 11, "Aid"), ("b", 40, 46, "Aid")]
    alias = frame(spark, model.RELATIONS["alias"], ("path:c", 1, 9, "path:a", "./a", 3, 8), ("path:a", 1, 9, "path:a", "./a", 3, 8))
    out = graph.move_edits(frame(spark, SPAN, ("a", 0, 9)), frame(spark, SPAN + ", text string", ("d", 4, 4, "moved")), alias, frame(spark, "file string, spec string, new_spec string", ("c", "./a", "./d"), ("a", "./a", "./d")), frame(spark, "file string", ("a",)))
    assert rows(out) == [("a", 0, 9, ""), ("c", 3, 8, "./d"), ("d", 4, 4, "moved")]


def test_scopes_shadow(spark):
    scopes = frame(spark, "file string, idx int, parent int, start int, end int, hole boolean", ("f", 0, -1, 0, 100, False), ("f", 1, 0, 10, 50, False), ("f", 2, 1, 20, 30, True))
    atoms = frame(spark, "file string, name string, scope_idx int", ("f", "x", -1), ("f", "g.x", 1), ("f", "h.y", 2))
    own = graph.declared_in(scopes, atoms)
    assert rows(own)[2][1] == 1  # the hole passes its name on
    points = frame(spark, SPAN + ", leaf string", ("f", 25, 26, "x"), ("f", 60, 61, "x"), ("f", 25, 26, "zz"))
    full = own.union(scopes.where("idx = 0").select("file", "idx", F.lit("x"), F.lit("path:f::root")))
    got = {(r.start, r.leaf): r.ref for r in graph.shadowed(scopes, full, points).collect()}
    assert got == {(25, "x"): "path:f::g.x", (60, "x"): "path:f::root", (25, "zz"): None}


def test_references_and_chains(spark):
    links = frame(spark, "ref string, target string", ("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"))
    assert dict(rows(graph.canonical(frame(spark, "ref string", ("a",), ("c",), ("x",)), links))) == {"a": "c", "c": "c", "x": "y"}
    uses = frame(spark, "file string, use_id int, ref string", ("f", 0, "m"))
    seg = frame(spark, "file string, use_id int, idx int, name string", ("f", 0, 1, "p"), ("f", 0, 2, "nope"))
    assert rows(graph.chained(uses, seg, frame(spark, "ref string, name string, target string", ("m", "p", "m.p")))) == [("f", 0, 0, "m"), ("f", 0, 1, "m.p")]
    circle = relations.closure(frame(spark, "p string, c string", ("a", "b"), ("b", "a")), "p", "c")
    assert rows(circle) == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2)]


def test_reachability_follows_long_chains_and_circles(spark):
    links = frame(spark, "a string, b string", *((f"f{k}", f"f{k + 1}") for k in range(67)), ("f67", "f0"), ("g", "f3"))
    got = rows(graph.reached(frame(spark, "a string", ("f0",)), links, "a", "b"))
    assert got == sorted(((f"f{k}", k) for k in range(68)), key=str)


def test_dotted_uses_are_followed_to_their_end(spark):
    seg = frame(spark, "file string, use_id int, idx int, name string", *(("f", 0, k, "p") for k in range(1, 13)), ("f", 1, 1, "p"), ("f", 1, 3, "p"))
    members = frame(spark, "ref string, name string, target string", *((f"m{k}", "p", f"m{k + 1}") for k in range(20)))
    uses = frame(spark, "file string, use_id int, ref string", ("f", 0, "m0"), ("f", 1, "m0"))
    want = [("f", 0, k, f"m{k}") for k in range(13)] + [("f", 1, 0, "m0"), ("f", 1, 1, "m1")]
    assert rows(graph.chained(uses, seg, members)) == sorted(want, key=str)


def test_similarity(spark):
    u = frame(spark, "unit string, terms array<string>", ("a", ["x", "y", "z"]), ("b", ["x", "y", "w"]), ("e", []), ("g", ["x", "", "y"]))
    f = similarity.features(u)
    assert {x.feature for x in f.where("unit = 'g'").collect()} == {"u:x", "u:y"}
    s = {(x.a, x.b): (x.jaccard, x.weighted) for x in similarity.pair_scores(f, frame(spark, "a string, b string", ("a", "b"), ("a", "e"), ("e", "e"))).collect()}
    assert s == {("a", "b"): (3 / 9, 3 / 9), ("a", "e"): (0, 0), ("e", "e"): (1, 1)}
    h = similarity.simhash(f.where("unit = 'g'"), similarity.fnv_hash, 64).collect()[0].simhash
    hashes = [r[0] & (1 << 64) - 1 for r in f.where("unit = 'g'").select(similarity.fnv_hash("feature")).collect()]
    want = sum(1 << b for b in range(64) if sum(1 if x >> b & 1 else -1 for x in hashes) > 0)
    assert h & (1 << 64) - 1 == want


def test_pairs_with_an_empty_turn_have_a_score(spark, tmp_path):
    turns = (("c", 0, "one two"), ("c", 1, "one two"), ("c", 2, ""), ("c", 3, ""))
    frame(spark, "conv_id string, turn int, text string", *turns).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [r.score for r in queries.blended_similarity(spark, str(tmp_path)).orderBy("a").collect()]
    one = similarity.simhash(similarity.features(frame(spark, "unit string, terms array<string>", ("u", ["one", "two"])))).first().simhash
    assert got == [1.0, round(1 - (one & (1 << 64) - 1).bit_count() / 64, 9), 1.0]


def test_paths_and_references(spark):
    assert rows(frame(spark, "p string", ("src/a.go",), ("a.go",), ("src/x/a.py",)).where(paths.matches_glob(F.col("p"), "src/**/*.go"))) == [("src/a.go",)]
    refs = ["Go:net/http::Get", "a/b.py::f", "./x", "name", "/abs", "x::y"]
    got = [tuple(r[0]) for r in frame(spark, "r string", *[(r,) for r in refs]).select(paths.parse_reference(F.col("r"))).collect()]
    assert got == [("go", "net/http", "Get"), ("path", "./a/b.py", "f"), ("path", "./x", ""), ("", "name", ""), ("path", "/abs", ""), ("path", "./x", "y")]
    one = frame(spark, "t string", ("if é\nfoo = bar(foo) // foo_x",))
    assert one.select(texts.occurrences(F.col("t"), "foo")).first()[0] == [6, 16]
    assert one.select(texts.line_of(F.col("t"), F.lit(6)), texts.column_of(F.col("t"), F.lit(8))).first()[:] == (2, 3)
    assert frame(spark, "a array<string>", (["f", "(", "x", ",", "y", ")"],)).select(texts.emitted(F.col("a"))).first()[0] == "f(x, y)"
    assert paths.rebased_import("./b", "x/a.js", "y/z/a.js") == "../../x/b"


def test_ignore_rules(spark):
    r = ignore.collect("tmp/\n", {"": "*.log\n!keep.log\n/only\n", "sub": "x*\n"}, {"": "gen/** linguist-generated\n"})
    files = frame(spark, "file string", *[(f,) for f in ("a.log", "keep.log", "only", "deep/only", "sub/xy", "xy", "gen/a", "tmp/z", "node_modules/q/r", "src/vendor/a", "./b.log")])
    assert {x.file for x in ignore.explored(files, r).collect()} == {"keep.log", "deep/only", "xy"}
    assert ignore.skip_dir("tmp", ignore.collect("tmp/\n")) and not ignore.skip_dir("tmp", ignore.collect("tmp/\n", {"": "!tmp/keep\n"}))


def test_rules_find_and_fix(spark):
    f = frame(spark, "file string, text string", ("a.go", "x = interface{}\ny = foo(1)"), ("b.py", "foo(2)"))
    pack = load('(rule no-foo warning "foo" (rewrite (path "*.go" (take f (seq (capture f "foo") "("))) (seq "bar" (slot f)))) (rule any-foo note "seen" "foo")')
    assert [x.rule_id for x in rules.findings(f, load('(rule any-foo note "seen" "foo")')).collect()] == ["any-foo"] * 2
    new, left = rules.fixed(f, load('(rule no-foo warning "foo" (rewrite "foo" "bar"))'))
    assert dict(rows(new)) == {"a.go": "x = interface{}\ny = bar(1)", "b.py": "bar(2)"} and left.count() == 0
    assert dict(rows(rules.fixed(f, pack)[0])) == {"a.go": "x = interface{}\ny = barfoo(1)", "b.py": "foo(2)"}
    at = sinks.located(rules.findings(f, load('(rule any-foo note "seen" "foo")')), f)
    assert sorted((x.file, x.line, x.col, x.snippet) for x in at.collect()) == [("a.go", 2, 5, "foo"), ("b.py", 1, 1, "foo")]
    doc = json.loads(sinks.sarif(at))
    assert len(doc["runs"][0]["results"]) == 2 and "--> a.go:2:5" in sinks.rustc_lines(at).orderBy("value").first()[0]


def test_scan_commit_and_archives(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.py").write_text("x")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/c.txt", "hello")
    root = str(tmp_path)
    found = sources.scan(spark, sources.Source(root, glob="*.py"), ignore.collect())
    assert rows(found) == [("src/a.py", "def f():\n    return 1\n", 22)]
    assert rows(sources.scan(spark, sources.Source(root, paths=("node_modules/b.py",)), ignore.collect())) == [("node_modules/b.py", "x", 1)]
    assert sources.archives(spark, f"{root}/z.zip").first().text == "hello"
    new = found.select("file", F.replace("text", F.lit("1"), F.lit("2")).alias("text"))
    assert [x.written for x in sinks.commit(found, new, root, dry_run=True).collect()] == [False]
    assert [x.written for x in sinks.commit(found, new, root, backup=".orig").collect()] == [True]
    assert (tmp_path / "src" / "a.py").read_text().endswith("2\n") and (tmp_path / "src" / "a.py.orig").exists()
    nodes = trees.nodes(found, "python").where("type = 'FunctionDef'").first()
    assert (nodes.start, nodes.depth) == (0, 0)
    html = trees.html_nodes("<div>é<p>x</p><br>y</div>")
    assert [(r[2], r[3], r[4], r[5]) for r in html] == [("div", 0, 26, 0), ("p", 7, 15, 1), ("br", 15, 19, 1)]


def test_layers_and_overlays(spark):
    one = frame(spark, "file string, text string", ("a", "1"), ("b", "1"))
    two = frame(spark, "file string, text string", ("a", "2"), ("b", None))
    assert rows(sources.layered([one, two])) == [("a", "2")]
    assert rows(sources.overlaid(one, two.where("file = 'a'"))) == [("a", "2"), ("b", "1")]


def test_tape_helpers(spark):
    cells = frame(spark, SPAN + ", type string, target string, seq int", ("f", 0, 2, "", "", 0), ("f", 0, 2, "id", "t", 1), ("f", 3, 4, "op", "", 2))
    assert rows(tape.merged(cells)) == [("f", 0, 2, "id", "t"), ("f", 3, 4, "op", None)]
    painted = tape.painted(frame(spark, SPAN + ", cls string", ("f", 1, 2, "ident"), ("f", 5, 6, "ident")), frame(spark, SPAN + ", cls string", ("f", 0, 9, "string"), ("f", 5, 6, "type")))
    assert rows(painted) == [("f", 1, 2, "string"), ("f", 5, 6, "type")]
    host = frame(spark, SPAN, ("f", 0, 3), ("f", 4, 8))
    assert rows(tape.spliced(host, frame(spark, SPAN, ("f", 4, 8)), frame(spark, SPAN, ("f", 5, 6)))) == [("f", 0, 3), ("f", 5, 6)]
    assert rows(tape.spans(frame(spark, "file string, text string", ("f", "é ab\n(x)")))) == [("f", 0, "é", 0, 2), ("f", 1, "ab", 3, 5), ("f", 2, "(", 6, 7), ("f", 3, "x", 7, 8), ("f", 4, ")", 8, 9)]


def test_store(spark):
    s = model.Store(spark)
    row = model.relation(spark, "used_name", [("f", "x")])
    s.insert("used_name", row), s.insert("used_name", row)
    assert s["used_name"].count() == 1
    s.append("used_name", row)
    assert s["used_name"].count() == 2
    s.drop_file("f")
    assert s["used_name"].count() == 0 and "edit" not in s


def test_streams_read_one_file_and_a_folder_of_parts(spark, tmp_path):
    """stream_pattern_matches, stream_event_counts: a table of several parts was not found."""
    turns = frame(spark, "conv_id long, turn long, role string, text string", (1, 0, "user", "the end, the"), (2, 1, "user", "then"), (3, 0, "user", "in the"))
    events = frame(spark, "event_id long, ts timestamp, user_id long, event_type string", (1, None, 1, "view"), (2, None, 1, "click"), (3, None, 2, "view"))
    for name, table in (("conversations", turns), ("events", events)):
        table.repartition(3).write.parquet(f"{tmp_path}/parts/{name}.parquet")
        table.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        (tmp_path / "one").mkdir(exist_ok=True)
        next((tmp_path / name).glob("part-*")).rename(tmp_path / "one" / f"{name}.parquet")
    for kind in ("parts", "one"):
        assert rows(queries.QUERIES["stream_pattern_matches"](spark, f"{tmp_path}/{kind}")) == [("1/0", 0), ("1/0", 3), ("3/0", 1)]
        assert rows(queries.QUERIES["stream_event_counts"](spark, f"{tmp_path}/{kind}")) == [("click", 1), ("view", 2)]
