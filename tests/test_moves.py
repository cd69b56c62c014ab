import pytest

from loomspan.operators import reimport


def edits(spark, files, imports, moves, root=""):
    f = spark.createDataFrame([(x,) for x in files], "file string")
    i = spark.createDataFrame([(file, spec, 5 * k, 5 * k + 5) for k, (file, spec) in enumerate(imports)], "file string, spec string, start int, end int")
    m = spark.createDataFrame(moves, "old string, new string")
    got = {r.start: r.new_text for r in reimport.import_edits(i, f, m, root).collect()}
    return [got.get(5 * k) for k in range(len(imports))]


def test_paths_in_every_style(spark):
    files = ["app.py", "pkga/helpers.py", "pkg/a/c.py", "pkg/a/mod.py", "lib/s/index.ts", "lib/s/rank/index.ts", "Image.zig", "color.zig", "m/old/f.go", "m/old/sub/g.go", "src/x/foo.rs", "src/main.rs"]
    imports = [
        ("app.py", "pkga.helpers"), ("pkg/a/c.py", ".mod"), ("lib/s/index.ts", "./rank"), ("Image.zig", "color.zig"), ("app.py", "os.path"), ("m/old/f.go", "ex.com/r/m/old/sub"),
        ("src/main.rs", "src::x::foo"), ("app.py", "pkg.a.c"), (None, "pkga.helpers"), ("app.py", None), ("lib/s/index.ts", "../../outside/of/it"),
    ]
    moves = [("pkga/helpers.py", "pkgb/utils.py"), ("pkg/a/mod.py", "pkg/b/mod_f.py"), ("lib/s/rank/index.ts", "lib/s/rank/index_f.ts"), ("Image.zig", "formats/Image_f.zig"), ("m/old", "m/new/deep"), ("src/x", "src/y"), ("nothing", "here")]
    want = ["pkgb.utils", "..b.mod_f", "./rank/index_f", "../color.zig", None, "ex.com/r/m/new/deep/sub", "src::y::foo", None, None, None, None]
    assert edits(spark, files, imports, moves, "ex.com/r") == want


def test_a_folder_that_moves_keeps_what_is_inside(spark):
    files = ["a/b/__init__.py", "a/b/x.py", "a/b/y.py", "a/z.py", "top.py"]
    imports = [("a/b/x.py", ".y"), ("a/b/x.py", "..z"), ("a/z.py", ".b"), ("top.py", "a.b"), ("top.py", "a.b.x")]
    assert edits(spark, files, imports, [("a/b", "q/r/b")]) == [None, "....a.z", "..q.r.b", "q.r.b", "q.r.b.x"]
    assert edits(spark, files, imports, []) == [None] * 5
    # a move of a file goes before that of its folder
    assert edits(spark, files, imports, [("a/b", "q/r/b"), ("a/b/y.py", "a/b/w.py")])[0] == "....a.b.w"


@pytest.mark.parametrize(
    "args,want",
    [
        (("path", "./x", "a/f.ts", "a/x.ts", "a/b/x.ts", ""), "./b/x"), (("path", "../x.ts", "a/f.ts", "x.ts", "c/y.ts", ""), "../c/y.ts"), (("dots", "..m", "p/q/f.py", "p/m.py", "n.py", ""), "...n"),
        (("root", "ex/m", "f.go", "", "", "ex/m"), "ex/m"), (("slash", "lib/x", "f.ts", "lib/x.ts", "y/z.ts", ""), "y/z"), (("dotted", "a.b", "f.py", "a/b/__init__.py", "c/__init__.py", ""), "c"),
        (("dotted", "a.b", "f.py", "a/b/__init__.py", "c/d.py", ""), "c.d"),
    ],
)
def test_respelling(args, want):
    assert reimport.respelled(*args) == want


def test_the_longest_move_counts(spark):
    paths = spark.createDataFrame([("a/b/c.py",), ("a/b",), ("a/bc",), ("x",), ("a/b/c.py",)], "path string")
    moves = spark.createDataFrame([("a", "z"), ("a/b", "y/b"), ("a/b", "zz"), ("a/b/c.py", "c.py")], "old string, new string")
    assert {(r.path, r.to) for r in reimport.moved_paths(paths, moves).collect()} == {("a/b/c.py", "c.py"), ("a/b", "y/b"), ("a/bc", "z/bc"), ("x", "x")}


def plan(spark, texts, moves):
    from loomspan.operators import extract, qualify

    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    t = extract.relations(extract.extracted(files))
    return qualify.PythonMoves(spark.createDataFrame(moves, "file string, name string, to string"), files, t)


def test_a_chain_moves_with_its_imports(spark):
    texts = {
        "a/m.py": '"""Doc."""\nfrom __future__ import annotations\n\nimport os\nfrom .n import k as key, gone\nfrom other import thing\n\n\ndef low(x):\n    return os.path.join(key, x)\n\n\ndef top(x):\n    return low(x) + thing\n\n\ndef stays():\n    return top(1)\n',
        "a/n.py": "k = 1\ngone = 2\n", "b/low.py": "import os\n", "b/top.py": '"""Top."""\nfrom a.n import (\n    gone,\n)\n',
        "c/user.py": "from a.m import (\n    low,\n    stays,\n    top as t,\n)\nprint(low, stays, t)\n", "c/all.py": "from a.m import low, top\nlow(top)\n",
    }
    moves = [("a/m.py", "low", "b/low.py"), ("a/m.py", "top", "b/top.py"), ("a/n.py", "gone", "b/top.py")]
    p = plan(spark, texts, moves)
    assert {(r.file, r.name, r.reason) for r in p.rejects().collect()} == set()
    done = {r.file: r.text for r in p.applied().collect()}
    assert done["b/low.py"] == "from a.n import k as key\nimport os\ndef low(x):\n    return os.path.join(key, x)\n"
    assert done["b/top.py"].startswith('"""Top."""\nfrom b.low import low\nfrom other import thing\n') and "from a.n" not in done["b/top.py"] and "gone = 2" in done["b/top.py"]
    assert done["a/m.py"].startswith('"""Doc."""\nfrom __future__ import annotations\nfrom b.top import gone\nfrom b.top import top\n') and "from .n import k as key\n" in done["a/m.py"] and "def low" not in done["a/m.py"]
    assert done["c/user.py"] == "from b.low import low\nfrom b.top import top as t\nfrom a.m import (\n    stays,\n)\nprint(low, stays, t)\n"
    assert done["c/all.py"] == "from b.low import low\nfrom b.top import top\nlow(top)\n"
    for text in done.values():
        compile(text, "x", "exec")


def test_moves_that_clash_or_circle_are_turned_back(spark):
    texts = {
        "m.py": "from x import helper\n\n\ndef a():\n    return helper()\n\n\ndef b():\n    return a()\n\n\ndef c():\n    return b()\n\n\ndef d():\n    return 1\n", "n.py": "def d():\n    return 2\n\n\ndef c2():\n    return 3\n",
        "h.py": "from y import helper\n", "o.py": "",
    }
    got = {(r.name, r.to): r.reason for r in plan(spark, texts, [("m.py", "d", "n.py"), ("m.py", "a", "h.py"), ("m.py", "b", "o.py"), ("m.py", "c", "o.py")]).rejects().collect()}
    # a cannot follow its helper, so b, which needs a and is needed by nothing that stays, is free to go with c
    assert got == {("d", "n.py"): "n.py has d already", ("a", "h.py"): "h.py has helper already"}
    got = {r.name: r.reason for r in plan(spark, texts, [("m.py", "a", "h.py"), ("m.py", "b", "o.py")]).rejects().collect()}
    assert got == {"a": "h.py has helper already", "b": "a circle of imports through a"}


def test_imports_in_go_heads_only(spark):
    from loomspan.operators import refactor

    raw = 'package p\n\nvar s = `\nimport (\n\t"z"\n)\n`\n'
    assert refactor.merged_import(raw, "b") == raw.replace("package p\n", 'package p\n\nimport "b"\n', 1)
    assert refactor.merged_import('package p\nimport "a" // c\n', "b") == 'package p\nimport (\n\t"a" // c\n\t"b"\n)\n'
    assert refactor.merged_import('// x\npackage p\n\nimport (\n\t// "b" is not here\n\t"a"\n\tz "c"\n)\n', "b") == '// x\npackage p\n\nimport (\n\t// "b" is not here\n\t"a"\n\t"b"\n\tz "c"\n)\n'
    assert refactor.merged_import('package p\nimport ("a"; "b")\n', "b") == 'package p\nimport ("a"; "b")\n'
    files = spark.createDataFrame([("f", "package p\n"), ("g", None), ("h", "package h\n")], "file string, text string")
    wanted = spark.createDataFrame([("f", "b", None), ("f", "a", "x"), ("g", "b", ""), ("none", "b", "")], "file string, spec string, alias string")
    assert {r.file: r.text for r in refactor.merged_imports(files, wanted).collect()} == {"f": 'package p\n\nimport (\n\tx "a"\n\t"b"\n)\n', "g": None, "h": "package h\n"}


def test_taken_spans_may_overlap(spark):
    from loomspan.operators import graph, refactor

    edits = spark.createDataFrame([("f", 0, 5, 7, "x"), ("f", 1, 10, 12, "y"), ("f", 2, 11, 13, "z")], "file string, seq int, start int, end int, new_text string")
    taken = spark.createDataFrame([("f", 0, 4), ("f", 3, 6)], "file string, start int, end int")
    assert [r.seq for r in refactor.unoccupied(edits, taken).collect()] == [1]
    a, b = (spark.createDataFrame(rows, "k int, v string") for rows in ([(1, "a")], [(1, "b"), (2, "b"), (2, "b")]))
    assert {(r.k, r.v) for r in graph.merged_results(a, b, ["k"]).collect()} == {(1, "a"), (2, "b")}


def test_staged_tables_are_discarded(spark):
    import os

    from loomspan import storage

    before, storage._STAGED[:] = storage._STAGED[:], []
    table = storage.staged(spark.range(5))
    folder = storage._STAGED[0].removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(folder)
    assert storage.discard_staged(spark) == 1 and not os.path.exists(folder) and storage._STAGED == []
    storage._STAGED[:] = before


def test_build_files_explain_imports(spark):
    from loomspan.plans import builds

    assert list(builds.go_mod('module "a/b" // x\nrequire c v1\nrequire (\n d v2\n)\nreplace d v2 => ../e\nexclude f v1\nreplace (\n g => h v3\n)\nbad\nrequire x\n')) == [
        ("module", "a/b", None, None), ("require", "c", "v1", None), ("require", "d", "v2", None), ("replace", "d", "../e", None), ("replace", "g", "h", "v3"),
    ]
    assert list(builds.cargo_lock("not [ toml")) == [] and list(builds.cargo_lock("")) == []
    files = spark.createDataFrame([("go.mod", "module r\nreplace o => ./in/o\n"), ("a/b/go.mod", "module r/a/b\n"), ("a/b/c/x.go", ""), ("empty/go.mod", None)], "file string, text string")
    imports = spark.createDataFrame([("a/b/c/x.go", "r/a/b/c"), ("a/b/c/x.go", "r/q"), ("m.go", "r"), ("m.go", "o/p"), ("m.go", "r/a/b"), ("m.go", "fmt")], "file string, spec string")
    got = {(r.file, r.spec): (r.kind, r.module, r.path) for r in builds.go_packages(imports, files).collect()}
    assert got == {
        ("a/b/c/x.go", "r/a/b/c"): ("tree", "r/a/b", "a/b/c"), ("a/b/c/x.go", "r/q"): ("std", None, None), ("m.go", "r"): ("tree", "r", ""), ("m.go", "o/p"): ("tree", "o", "in/o/p"), ("m.go", "r/a/b"): ("tree", "r", "a/b"), ("m.go", "fmt"): ("std", None, None),
    }


def test_neighbourhoods_read_each_file_once(spark):
    from loomspan.operators import neighbourhood

    texts = {"a/m.py": "import b.n\n", "a/other.py": "import z\n", "b/n.py": "from c import q\n", "c/q.py": "import a.m\n", "c/__init__.py": "", "z.py": "", "far.py": "", "g/x.go": "package g\n", "g/y.go": "package g\n", "g/z.py": ""}
    files = spark.createDataFrame(list(texts.items()), "file string, text string")
    read = []

    def reading(own):
        read.extend(r.file for r in own.collect())
        return files.join(own, "file")

    got = {(r.file, r.round) for r in neighbourhood.loaded(files.select("file"), spark.createDataFrame([("a/m.py",), ("g/x.go",), ("none",)], "file string"), reading).collect()}
    assert {f for f, _ in got} == {"a/m.py", "b/n.py", "c/__init__.py", "g/x.go", "g/y.go"} and sorted(read) == sorted(f for f, _ in got)
    assert dict(got)["b/n.py"] == 1 and dict(got)["g/y.go"] == 1
    assert neighbourhood.loaded(files.select("file"), files.select("file").limit(0), reading).count() == 0
