import random

import pytest

from loomspan.operators import binding, extract, refactor, similarity
from loomspan.plans import providers
from loomspan.plans.walker import Walker
from loomspan.sources import sinks, trees

from .test_operators import frame, rows


def names(path, text):
    _, f = extract.facts_of(path, text)
    raw = text.encode()
    for full, a, b, _ in f.atoms:
        assert raw[a:b].decode() == full.rsplit(".", 1)[-1]
    for name, a, b, prefix in f.uses:
        assert raw[a:b].decode() == name and all(raw[s:e].decode() == n for n, s, e in prefix)
    return f, [a[0] for a in f.atoms]


def test_python_declarations():
    text = '''import os.path as p, sys
from .près import b as c
from x import *
class Shop(Base):
    """Öffnet."""
    open: bool = True
    class Till:
        def count(self, q):
            if q: return help(os.path.join(self.v))
            elif c.z.w and q: pass
            return 1
@deco
def top(a: Kind) -> Other: return a
type Money = list[int]
x, (y, z) = 1, (2, 3)
'''
    f, atoms = names("m.py", text)
    assert atoms == ["Shop", "Shop.open", "Shop.Till", "Shop.Till.count", "top", "Money", "x", "y", "z"]
    assert [i[:3] for i in f.imports] == [("p", "os.path", ""), ("sys", "sys", ""), ("c", ".près", "b"), ("*", "x", "*")]
    assert [i[-1] for i in f.imports] == [False, False, False, True]
    used = [".".join([*(n for n, _, _ in u[3]), u[0]]) for u in f.uses]
    assert used == ["Base", "bool", "q", "help", "os.path.join", "self", "c.z.w", "q", "deco", "Kind", "Other", "a", "list", "int"]
    assert [x[2] for x in f.flows] == ["structural", "hybrid", "hybrid"]
    assert f.docs[0] == ("Shop", "class Shop(Base)", "Öffnet.") and f.docs[3][1] == "def top(a: Kind) -> Other"
    assert extract.facts_of("bad.py", "def (")[1].atoms == [] and extract.facts_of("x.txt", "class A")[1].atoms == []


def test_go_declarations():
    text = '''package shop
import (
	"fmt"
	web "net/http"
)
type Till[K any] struct {
	Key, Size int // both
	note string
}
type Opener = interface {
	Open(by string) error
	Close()
}
type Level int
const Low, High = 1, 2
var (
	Default = 3
	other Level
)
func (t *Till[K]) Count(k int) int {
	if k > 1 { return fmt.Sprint(k) } else if k < 0 { return web.Get(t.Key) }
	for i := range t.Size { helper(i) }
	return 0
}
func helper(a int) {}
'''
    f, atoms = names("b.go", text)
    assert atoms == ["Till", "Till.Key", "Till.Size", "Till.note", "Opener", "Opener.Open", "Opener.Close", "Level", "Low", "High", "Default", "other", "Till.Count", "helper"]
    assert [a[0] for a in f.atoms if not a[3]] == ["Till.note", "other", "helper"] and f.package[0] == "shop"
    assert [i[:2] for i in f.imports] == [("", "fmt"), ("web", "net/http")] and [x[2] for x in f.flows] == ["structural", "hybrid", "structural"]
    assert {".".join([*(n for n, _, _ in u[3]), u[0]]) for u in f.uses} >= {"fmt.Sprint", "web.Get", "t.Key", "helper"}


@pytest.mark.parametrize(
    "path, text, want",
    [
        ("A.java", "package p;\nclass Box {\n  static class Lid { int size = 3; String say() { return call(size); } }\n  enum Hue { RED, TEAL; int n; }\n  List<String> all;\n}\nrecord Two(int a, int b) {}\n", ["Box", "Box.Lid", "Box.Lid.size", "Box.Lid.say", "Box.Hue", "Box.Hue.RED", "Box.Hue.TEAL", "Box.Hue.n", "Box.all", "Two", "Two.a", "Two.b"]),
        ("a.ts", "export enum Hue { Red = 1, Teal }\nexport interface Opens { open(): number; label?: string }\nclass Box { size = 1; go(x) { return f(x) } }\nfunction top(q) { return q }\nexport const c = 1\n", ["Hue", "Hue.Red", "Hue.Teal", "Opens", "Opens.open", "Opens.label", "Box", "Box.size", "Box.go", "top", "c"]),
        ("l.rs", "pub struct Box { pub a: u8, b: Vec<u8> }\nenum Hue { Red, Teal(u8) }\nimpl<T> Opens for Box { fn open(&self) { help(self.a); } }\nimpl Box { pub fn new() -> Box { x() } }\nfn help() {}\n", ["Box", "Box.a", "Box.b", "Hue", "Hue.Red", "Hue.Teal", "Box.open", "Box.new", "help"]),
        ("k.kt", "package p\nclass Box { val size = 1\n fun open(): Int { return size } }\nfun Box.more() = 1\nfun top() {}\nval z = 2\n", ["Box", "Box.size", "Box.open", "Box.more", "top", "z"]),
    ],
)
def test_declarations_of_languages_with_braces(path, text, want):
    assert names(path, text)[1] == want


def test_extraction_takes_any_text():
    r = random.Random(3)
    pieces = ["{", "}", "(", ")", "class", "func", "type", "import", '"x"', "a", "b", ".", ",", ";", "\n", "é", "impl", "enum", "=", "package"]
    for k in range(300):
        text = " ".join(r.choice(pieces) for _ in range(r.randrange(30)))
        for end in ("go", "java", "kt", "ts", "rs", "py"):
            names(f"f{k}.{end}", text)


def test_a_walker_binds_names_across_files(spark):
    files = frame(
        spark, "file string, text string",
        ("pkg/base.py", "class Kind:\n    pass\n\ndef _hid(): pass\ndef shown(): pass\n"),
        ("pkg/use.py", "from .base import Kind as K\nimport pkg.base as base\nfrom pkg.base import *\n\ndef go(x):\n    return K(base.shown, shown, _hid, x)\n"),
        ("pkg/none.py", None),
    )
    w = Walker(files)
    got = {(r.start, r.target_ref, r.way, r.via_alias) for r in w.store["binds"].where("file = 'pkg/use.py'").collect()}
    text = files.where("file = 'pkg/use.py'").first().text
    at = lambda s: text.index(s, text.index("return"))
    assert got == {(at("K("), "path:pkg/base.py::Kind", "import", True), (at("base"), "path:pkg/base.py", "dotted", False), (at("shown"), "path:pkg/base.py::shown", "dotted", False), (at(" shown") + 1, "path:pkg/base.py::shown", "star", False)}
    new = {r.file: r.text for r in w.applied(w.rename(frame(spark, "ref string, new_text string", ("path:pkg/base.py::Kind", "Sort")))).collect()}
    assert "class Sort:" in new["pkg/base.py"] and "import Sort as K" in new["pkg/use.py"] and "return K(" in new["pkg/use.py"]


def test_python_imports_go_up_and_into_packages(spark):
    files = frame(spark, "file string, lang string", ("a/b/c.py", "python"), ("a/b/__init__.py", "python"), ("a/d.py", "python"), ("e.py", "python"))
    imports = frame(spark, "file string, spec string, member string", ("a/b/c.py", ".", "x"), ("a/b/c.py", "..d", ""), ("a/b/c.py", "a.b", "c"), ("a/d.py", "e", "*"), ("a/d.py", "gone", ""))
    want = {("a/b/c.py", "..d", "", "a/d.py"), ("a/b/c.py", ".", "x", "a/b/__init__.py"), ("a/b/c.py", "a.b", "c", "a/b/c.py"), ("a/d.py", "e", "*", "e.py")}
    assert set(rows(providers.resolved(imports, files))) == want


def test_edits_of_imports_and_layout(spark):
    files = frame(spark, "file string, text string", ("f", 'import "é/a"\nimport "b"\nuse(b)\n'), ("g", ""))
    sites = frame(spark, "file string, start int, end int, key string, locals array<string>, keep boolean", ("f", 0, 13, "é/a", ["a"], False), ("f", 14, 24, "b", ["b"], False), ("g", 0, 0, "k", ["k"], True))
    assert rows(refactor.pruned_imports(files, sites)) == [("f", 0, 13, "")]
    assert refactor.pruned_imports(files, sites, frame(spark, "file string, start int, end int", ("f", 25, 31))).count() == 2
    assert refactor.pruned_imports(files, sites, only=("b",)).count() == 0
    for text in ("package p\n", 'package p\n\nimport "a"\n', 'package p\n\nimport (\n\t"a"\n\t"c"\n)\n', "x"):
        done = refactor.merged_import(text, "b")
        assert done.count('"b"') == 1 and refactor.merged_import(done, "b") == done
    units = frame(spark, "file string, section string, unit string", ("g", "import", "i\n"), ("f", "body", "end\n"), ("f", "nowhere", "x"))
    got = rows(refactor.layout_edits(files, frame(spark, "file string, end int"), frame(spark, "file string, end int", ("f", 24)), units))
    assert got == [("f", 32, 32, "end\n"), ("g", 0, 0, "i\n")]


def test_tree_queries_and_fields(spark):
    nodes = trees.nodes(frame(spark, "file string, text string", ("f", "def a(x):\n    return g(x)\nclass B:\n    def c(self): pass\n")), "python")
    got = trees.query(nodes, "(ClassDef body: (FunctionDef) @m)")
    assert got.count() == 1 and set(got.columns) == {"file", "start", "end", "m_start", "m_end"}
    assert trees.query(nodes, "(FunctionDef (Return value: (Call func: (Name) @f)))").first().f_start == 21
    assert trees.query(nodes, "(_ (Pass))").count() == 1
    with pytest.raises(ValueError):
        trees.shape("(a")


def test_formatters_and_hashes(spark, tmp_path):
    found = frame(spark, "file string, start int, rule_id string, level string, message string, line int, col int, end_line int, end_col int, snippet string", ("f", 0, "r", "note", "m", 1, 1, 1, 2, "x"))
    for name in sinks.FORMATTERS:
        sinks.write_as(name, found, str(tmp_path / name))
    with pytest.raises(ValueError):
        sinks.write_as("none", found, str(tmp_path / "none"))
    u = frame(spark, "unit string, terms array<string>", ("a", ["x", "y", "z", "x"]), ("b", ["x", "y", "w"]), ("e", []), ("n", None), ("g", ["x", "", "y"]))
    f = similarity.features(u)
    one = {r.unit: r.simhash & (1 << 64) - 1 for r in similarity.simhash(f).collect()}
    units = {r.unit: similarity.counted(r.terms or []) for r in u.collect()}
    assert {k: int(similarity.fingerprint([c])[0]) for k, c in units.items() if c} == one
    pairs = frame(spark, "a string, b string", ("a", "b"), ("a", "e"), ("e", "n"), ("g", "a"))
    got = {(r.a, r.b): r for r in similarity.similarities(u, pairs).collect()}
    for r in similarity.pair_scores(f, pairs).collect():
        assert abs(got[r.a, r.b].jaccard - r.jaccard) < 1e-12 and abs(got[r.a, r.b].weighted - r.weighted) < 1e-12


def test_counts_that_differ_are_an_error(spark):
    assert binding.expected(spark.range(3), 3).first().n == 3
    with pytest.raises(Exception, match="expected 4 matches, found 3"):
        binding.expected(spark.range(3), 4).collect()


def test_packs_claim_and_extract():
    from loomspan.operators.tape import SOURCE, compiled
    from loomspan.operators.sequence import lex_tokens
    from loomspan.plans import claims, matcher
    from loomspan.plans.sexp import PatternError

    pack = claims.load('''
(def call () (seq (capture name (regex "^[a-z]")) "("))
(under (path "*.x")
  (as-language "x") (as-family "f" one two)
  (as-import (seq "use" (capture path any) "as" (capture alias any)))
  (as-atom (seq "let" (capture name any) "," (capture name any)))
  (as-atom private (seq "def" (capture name any) "{" (capture name any)))
  (under (seq "{" (* any) "}") (as-scope (this)) (as-use (call)) (as-use (seq (capture name any) "." (capture name any) "("))))''')
    text = 'use "a/b" as c let p, q def T { m { c.go(x) go(1) } }'
    f, paints = claims.facts(pack, matcher.File("d/e.x", text.encode(), lex_tokens(text, compiled(SOURCE))))
    assert [a[0] for a in f.atoms] == ["p", "q", "T.m"] and [a[3] for a in f.atoms] == [True, True, False]
    assert [i[:3] for i in f.imports] == [("c", "a/b", "")] and text[f.imports[0][8] : f.imports[0][9]] == "a/b"
    assert [(".".join([*(n for n, _, _ in u[3]), u[0]])) for u in f.uses] == ["c.go", "go"] and paints == []
    assert claims.facts(pack, matcher.File("d/e.y", text.encode(), lex_tokens(text, compiled(SOURCE))))[0].atoms == []
    assert sorted(pack.families()) == [("x", "f", "one"), ("x", "f", "two")]
    for bad in ("(as-nothing)", '(as-atom "a" "b")', "x"):
        with pytest.raises(PatternError):
            claims.load(bad)
