import itertools
import random

import pytest

from loomspan.plans import twig
from loomspan.sources import syntax, trees

GO = """package main
import (
  "fmt"
  x "a/b"
)
// doc
type T struct { A int; B map[string]int }
type I interface { F(a int) error }
var v, w int = 1, 2
func (t *T) Name(a int, b ...string) (int, error) {
  if err := f(a); err != nil { return 0, err } else if a > 3 { g() } else { h() }
  for i := 0; i < 10; i++ { fmt.Println(i, x.Y[i], []int{1,2}, T{A: 1}) }
  for _, k := range m { s += k }
  switch a { case 1, 2: f()
  default: g() }
  go func() { z <- 1 }()
  return a + b*c == d && !e, nil
}
"""
JAVA = """package a.b.c;
@Ann(x = 1) public class A<T> extends B implements C, D {
  private final Map<String, List<Integer>> m = new HashMap<>();
  public A(int a) { this.a = a; }
  @Override public <R> List<R> f(String s, int... k) throws E {
    String[] q = {"a"};
    for (int i = 0; i < n; i++) { g(i); }
    for (String e : list) h(e);
    if (a > b) return null; else if (c) { d(); }
    try { a(); } catch (E e) { b(); } finally { c(); }
    Runnable r = () -> { run(); };
    list.forEach(x -> x.y(1).z());
    return a ? b : c;
  }
  enum E2 { P, Q; int f() { return 1; } }
}
"""
TS = """import { a, b as c } from "./x";
export class A<T> extends B implements C {
  private x: number = 1;
  y?: string
  async f(a: number, b = 2): Promise<void> { await g(a); return }
}
export type U = { a: string } | "b"
export const f = async (a: number): string => { return `x` }
let o = { k: 1, "s": [1, 2], f(x) { return 1 } , ...rest }
for (const k of ks) { h(k) }
function w<T>(a: T): T { return a?.b ?? c!.d }
a.b()
  .c()
"""
TEXTS = [(GO, "go"), (JAVA, "java"), (TS, "typescript")]


def faults(text, lang):
    return [(r[2], r[3]) for r in syntax.rows(text, lang) if r[2] in ("ERROR", "MISSING")]


def outline(text, lang):
    """Types of nodes that are more than leaves, nested."""
    rows = syntax.rows(text, lang)
    inner = {r[1] for r in rows}
    return [(r[5], r[6], r[2], text[r[3] : r[4]]) for r in rows if r[0] in inner]


@pytest.mark.parametrize("text,lang", TEXTS)
def test_whole_files_have_no_fault(text, lang):
    assert faults(text, lang) == []


@pytest.mark.parametrize("text,lang", TEXTS)
def test_damaged_files_keep_every_leaf_inside_its_parents(text, lang):
    r = random.Random(len(text))
    for _ in range(150):
        x = text
        for _ in range(r.randint(1, 4)):
            a = r.randrange(len(x))
            x = x[:a] + r.choice(["", "", "{", "}", ")", "(", "=", "x ", '"', "/*"]) + x[min(len(x), a + r.choice([1, 1, 2, 8, 40])) :]
        rows = syntax.rows(x, lang)
        inner = {q[1] for q in rows}
        assert "".join(x.split()) == "".join("".join(x[q[3] : q[4]] for q in rows if q[0] not in inner).split())
        for q in rows[1:]:
            p = rows[q[1]]
            assert p[0] < q[0] and p[3] <= q[3] <= q[4] <= p[4] and q[5] == p[5] + 1


def test_operators_bind_by_their_level():
    find = lambda text: [(f, t, s) for _, f, t, s in outline(text, "typescript") if t.endswith("_expression")]
    assert find("a = b ? c + d * e : f || g && h")[:6] == [
        ("", "assignment_expression", "a = b ? c + d * e : f || g && h"), ("right", "conditional_expression", "b ? c + d * e : f || g && h"), ("consequence", "binary_expression", "c + d * e"),
        ("right", "binary_expression", "d * e"), ("alternative", "binary_expression", "f || g && h"), ("right", "binary_expression", "g && h"),
    ]
    assert find("a - b - c")[1] == ("left", "binary_expression", "a - b")
    assert [x[1:] for x in find("new A<B>(1).c[d](!e)")] == [("unary_expression", "new A<B>(1).c[d](!e)"), ("call_expression", "A<B>(1).c[d](!e)"), ("index_expression", "A<B>(1).c[d]"), ("member_expression", "A<B>(1).c"), ("call_expression", "A<B>(1)"), ("unary_expression", "!e")]


@pytest.mark.parametrize(
    "text,lang,want",
    [
        ("func f() { g( }", "go", [("MISSING", 13)]), ("func f() { g() ) }", "go", [("ERROR", 15)]), ("}", "go", [("ERROR", 0)]), ("func f() { a = }", "go", [("MISSING", 14)]),
        ("class A { int f() { return 1 } }", "java", [("MISSING", 28)]), ("class A { void f() { if (a { b(); } } }", "java", [("MISSING", 26), ("MISSING", 26)]), ("let a = [1, 2", "typescript", [("MISSING", 13)]), ("", "go", []), ("// only", "java", []),
    ],
)
def test_faults_have_a_place(text, lang, want):
    got = faults(text, lang)
    if "if (a {" in text:  # the block is read as an object of the call: what matters is that it is told where
        assert got and all(20 < at < len(text) for _, at in got)
    else:
        assert got == want


def test_nesting_beyond_the_stack_is_one_error():
    assert faults("(" * 5000, "go") == [("ERROR", 0)]


def brute(step, nodes, k):
    """All ways in which the node ``k`` matches a step without quantifiers, by trying all choices of children."""
    _, _, type_, start, end, _, _ = nodes[k]
    kids = [q for q in nodes if q[1] == k]
    if step.type == "[":
        return [sorted([*w, *((n, start, end) for n in step.captures)]) for c in step.children for w in brute(c, nodes, k)]
    if step.anonymous != (not syntax.is_named(type_)) or step.type not in ("_", type_) or any(q[6] in step.absent for q in kids):
        return []
    out = []
    for chosen in itertools.combinations(range(len(kids)), len(step.children)):
        fine = True
        for j, (c, want) in enumerate(zip(chosen, step.children, strict=True)):
            before = kids[(chosen[j - 1] + 1 if j else 0) : c]
            fine &= not want.field or kids[c][6] == want.field
            fine &= not (want.after and any(syntax.is_named(q[2]) for q in before))
        if step.last:
            fine &= not any(syntax.is_named(q[2]) for q in kids[(chosen[-1] + 1 if chosen else 0) :])
        if fine:
            for ways in itertools.product(*(brute(want, nodes, kids[c][0]) for c, want in zip(chosen, step.children, strict=True))):
                out.append(sorted(x for w in ways for x in w))
    return [sorted([*w, *((n, start, end) for n in step.captures)]) for w in out]


QUERIES = [
    "(call_expression function: (_) @f arguments: (arguments (_) @a))", "(block . (_) @first)", "(block (_) @last .)", "(_ (identifier) @a . (identifier) @b)", "(if_statement !alternative condition: (_) @c)",
    '(binary_expression left: (_) @l operator: "+" right: (_) @r)', "[(return_statement) (call_expression)] @x", "(_ (_ (identifier) @i)) @o", '(_ "," @c)',
]


@pytest.mark.parametrize("source", QUERIES)
def test_tree_queries_equal_brute_force(source):
    query = twig.parse(source)
    for text, lang in TEXTS:
        nodes = syntax.rows(text, lang)
        got = twig.Twig(query)
        for _, _, type_, a, b, depth, name in nodes:
            got.push(type_, a, b, depth, name)
        got.close()
        flat = sorted((s, e, sorted((n, *x) for n, v in w.items() for x in v)) for s, e, _, w in got.out)
        assert flat == sorted((q[3], q[4], w) for q in nodes for w in brute(query.steps[0], nodes, q[0]))


def ways(source, text, lang):
    query, out = twig.parse(source), twig.Twig(twig.parse(source))
    for _, _, type_, a, b, depth, name in syntax.rows(text, lang):
        out.push(type_, a, b, depth, name)
    out.close()
    return [{k: [text[a:b] for a, b in v] for k, v in w.items()} for _, _, _, w in sorted(out.out, key=lambda m: m[:3]) if twig.holds(query.predicates, w, text.encode())]


def test_quantifiers_and_predicates():
    text = "func f() { a(1, 2); b(); c(); return }"
    call = "(expression_statement (call_expression function: (identifier) @f))"
    assert ways(f"(block {call}+)", text, "go") == [{"f": ["a", "b", "c"]}]
    assert ways(f"(block {call}* . (return_statement) @r)", text, "go") == [{"f": ["a", "b", "c"], "r": ["return"]}]
    assert ways("(block (if_statement)? @i (return_statement) @r)", text, "go") == [{"r": ["return"]}]
    assert ways("(arguments (number)+ @n)", text, "go") == [{"n": ["1", "2"]}]
    assert ways('(call_expression function: (identifier) @f) (#any-of? @f "a" "c")', text, "go") == [{"f": ["a"]}, {"f": ["c"]}]
    assert ways('(call_expression function: (identifier) @f) (#not-match? @f "^[ab]$")', text, "go") == [{"f": ["c"]}]
    assert ways("(arguments . (number) @a . (number) @b .)", text, "go") == [{"a": ["1"], "b": ["2"]}]
    for wrong in ("", "(", "(a", "(a))", "(a) (#what? @a)", ")"):
        with pytest.raises(ValueError):
            twig.parse(wrong)


def test_nodes_in_tables(spark):
    files = spark.createDataFrame([("é.go", "// é\nfunc f() { g(\"é\") }"), ("null.go", None), ("empty.go", "")], "file string, text string")
    nodes = trees.nodes(files, "go")
    got = {(r.file, r.text, r.start, r.type) for r in trees.leaves(nodes, files).collect()}
    assert {("é.go", "// é", 0, "comment"), ("é.go", '"é"', 19, "string"), ("é.go", ")", 23, ")")} <= got and {f for f, *_ in got} == {"é.go"}
    assert sorted((r.file, r.start) for r in twig.join(nodes, "(call_expression)").collect()) == [("é.go", 17)]
    assert twig.search(files, "go", "(call_expression) @c").count() == 1
    with pytest.raises(ValueError):
        twig.join(nodes, '(identifier) @i (#eq? @i "g")')


def test_edits_that_break_a_file_are_turned_back(spark):
    before = spark.createDataFrame([("a", "func f() { g() }"), ("b", "func f( {"), ("c", "func f() {}")], "file string, text string")
    after = spark.createDataFrame([("a", "func f() { g( }"), ("b", "// moved\nfunc f( {"), ("c", "func g() {}"), ("d", "func h() {"), ("e", None)], "file string, text string")
    assert {(r.file, r.type, r.n_before, r.n_after, r.start) for r in trees.rejected(before, after, "go").collect()} == {("a", "MISSING", 0, 1, 13), ("d", "MISSING", 0, 1, 10)}
    assert {r.file for r in trees.validated(before, after, "go").collect()} == {"b", "c", "e"}


def test_strings_hold_what_python_says():
    import ast
    import io
    import tokenize
    import warnings

    from loomspan.functions import literals

    r, n = random.Random(1), 0
    pieces = ["a", "é", "😀", " ", "\\n", "\\\\", "\\'", '\\"', "\\x41", "\\101", "\\0", "\\u00e9", "\\U0001f600", "\\N{BULLET}", "\\q", "\\\n", "'", '"', "\\7", "{x}"]
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for _ in range(3000):
            quote, prefix = r.choice(['"', "'", '"""', "'''"]), r.choice(["", "r", "u"])
            literal = prefix + quote + "".join(r.choice(pieces) for _ in range(r.randint(0, 6))) + quote
            try:
                tree = ast.parse(literal, mode="eval").body
            except SyntaxError:
                continue
            parts = [t for t in tokenize.generate_tokens(io.StringIO(literal).readline) if t.type == tokenize.STRING]
            if not isinstance(tree, ast.Constant) or not isinstance(tree.value, str) or len(parts) != 1:
                continue
            text, places = literals.content(literal, "python")
            assert text == tree.value and len(places) == len(text), literal
            assert all(x == literal[p] or literal[p] == "\\" for x, p in zip(text, places, strict=True))
            n += 1
    assert n > 1000


@pytest.mark.parametrize(
    "literal,lang,text,places",
    [
        ('"a\\u0041\\s"', "java", "aA ", [1, 2, 8]), ('"""\n    a\n      b  \n    """', "java", "a\n  b\n", [8, 9, 14, 15, 16, 19]), ("`a\\n\r\n`", "go", "a\\n\n", [1, 2, 3, 5]), ("'\\u{1F600}\\0'", "typescript", "😀\0", [1, 10]),
        ('"\\ud83d\\ude00"', "typescript", "😀", [1]), ('"open', "go", "open", [1, 2, 3, 4]), ('"\\q"', "go", "q", [1]), ("\"it's\"", "go", "it's", [1, 2, 3, 4]), ('""', "go", "", []),
    ],
)
def test_strings_of_other_languages(literal, lang, text, places):
    from loomspan.functions import literals

    assert literals.content(literal, lang) == (text, places)
    assert literals.content("x", lang) is None


def test_a_search_ends_early(spark, tmp_path):
    from pyspark.sql import functions as F

    from loomspan.operators import early

    for k in range(12):
        spark.range(k * 10, k * 10 + 10).select(F.format_string("f%04d", "id").alias("file"), F.when(F.col("id") % 5 == 0, "hit").otherwise("no").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/part={k:02d}")
    table = spark.read.parquet(str(tmp_path))
    read = []

    def find(part):
        read.append(part.count())
        return part.where("text = 'hit'").select("file", "text")

    assert sorted(r.file for r in early.first_matches(table, find, 3).collect()) == ["f0000", "f0005", "f0010"]
    assert sum(read) == 50  # one stored file, then four
    read.clear()
    assert early.first_matches(table, find, 1000).count() == 24 and sum(read) == 120
    assert early.first_matches(table, find, 0).count() == 0
    assert early.first_matches(spark.createDataFrame([("a", "hit"), ("b", "hit")], "file string, text string"), find, 1).count() == 1
