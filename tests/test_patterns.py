import random
import re

import pytest
from pyspark.sql import functions as F

from loomspan.operators import sequence, tape
from loomspan.plans import matcher as M
from loomspan.plans import pattern as P
from loomspan.plans.automaton import Program, Token
from loomspan.plans.rules import costly, load, plan
from loomspan.plans.sexp import Expander, PatternError, read_one, show


def toks(text):
    return [Token(m[0], m.start(), m.end(), m[0].strip('"') if m[0][0] == '"' else m[0], inner=int(m[0][0] == '"')) for m in re.finditer(tape.SOURCE, text)]


def scan(source, text):
    return Program(P.parse(source)).scan(toks(text), text.encode())


GO = """package main
func f() { _ = g(a, b); _, x := h(1); y = k(2); _ = p.q(z); _ := r[int](3) }
"""


def test_captures_inside_alternatives_take_their_way():
    source = '(seq (capture target (not (regex "^[0-9]"))) (alt "=" (capture op ":=")) (alt (seq (capture call any) "(" (* any) ")") (seq (capture owner any) "." (capture call any) "(")))'
    found = scan(source, GO)
    assert [(m.sites["target"][0].text, m.sites["call"][-1].text) for m in found] == [("_", "g"), ("x", "h"), ("y", "k"), ("_", "q")]
    assert [len(m.sites.get("op", [])) for m in found] == [0, 1, 0, 0] and [len(m.sites.get("owner", [])) for m in found] == [0, 0, 0, 1]


def test_unified_names_have_one_text():
    swap = '(seq (unify p any) "," (unify q any) "=" (unify q any) "," (unify p any))'
    assert [m.first for m in scan(swap, "a, b = b, a; a, b = a, b; (x, y = y, x)")] == [0, 17]
    assert scan(swap, "a, b = b, c") == []


def test_unified_names_keep_threads_apart():
    """A thread is only given up for another that can go on alike: not for one that has bound another text."""
    source = '(seq "a" (* any) (unify x (regex "^[pq]$")) (* any) "=" (unify x any))'
    for text, want in (("a p q = q", "q"), ("a p q = p", "p"), ("a q p p = q", "q")):
        assert [m.sites["x"][0].text for m in scan(source, text)] == [want]
    assert scan(source, "a p q = r") == []


def test_runs_equal_all_ways_tried():
    """The best of all ways through a pattern, found by trying them all."""
    def ways(pat, at, toks_, bound):
        if isinstance(pat, P.Seq):
            if not pat.items:
                yield at, bound
            else:
                for mid, own in ways(pat.items[0], at, toks_, bound):
                    yield from ways(P.Seq(pat.items[1:]), mid, toks_, own)
        elif isinstance(pat, P.Alt):
            for x in pat.items:
                yield from ways(x, at, toks_, bound)
        elif isinstance(pat, P.Bind):
            for end, own in ways(pat.body, at, toks_, bound):
                text = toks_[at]
                if pat.unify and any(n == pat.name for n, _ in own):
                    if (pat.name, text) in own:
                        yield end, own
                else:
                    yield end, (*own, (pat.name, text))
        elif isinstance(pat, P.Filler):
            for end in range(at, len(toks_) + 1):
                yield end, bound
        elif at < len(toks_) and (pat.kind == "any" or (toks_[at] == pat.value) != pat.negated):
            yield at + 1, bound

    r = random.Random(9)
    for _ in range(60):
        text = [r.choice("abc=") for _ in range(r.randrange(1, 9))]
        for source in ('(seq (unify x any) (* any) "=" (unify x any))', '(seq (alt "a" (capture y any)) (* any) (alt (seq "b" "c") (capture y "b")))', '(seq (capture k any) (* any) (unify u any) (* any) (unify u any))'):
            pat = P.parse(source)
            every = list(ways(pat, 0, text, ()))
            best = min(((-len(b), end) for end, b in every), default=None)
            m = Program(pat).run([Token(t, k, k + 1, t) for k, t in enumerate(text)], 0, "".join(text).encode())
            assert (m and (-sum(map(len, m.sites.values())), m.last)) == best, (source, text)


def test_gaps_stop_at_the_barrier_and_take_most_sites_then_the_shortest():
    assert len(scan('(seq "a" (* "b") "c")', "a x b y c")) == 1
    assert scan('(seq "a" (* "b") "c")', "a x func y c") == []
    m = scan('(seq "a" (* (capture x "b")) "c")', "a b b c b c")[0]
    assert len(m.sites["x"]) == 3 and m.last == 6
    assert [m.end for m in scan('(seq "a" (* any) "c")', "a c c a x c")] == [3, 11]


def test_optional_plus_until_and_rep():
    assert [m.last for m in scan('(seq "a" (? "b") "c")', "a c a b c")] == [2, 5]
    assert len(scan('(seq "a" (+ "b") "c")', "a c a b c")) == 1
    assert scan('(seq "a" (until ";"))', "a x y ; z")[0].last == 4
    assert len(scan('(rep 3 "a")', "a a a a a a a")) == 2
    with pytest.raises(PatternError):
        P.parse('(rep * "a")')


def test_lookbehind_groups_and_regex_groups():
    assert [m.first for m in scan('(seq (assert_not_behind (seq "x" ".")) "f")', "f x . f y . f")] == [0, 6]
    m = scan('(capture msg (regex "^failed to\\\\s+(.*)" 1))', 'e("failed to open")')[0]
    assert m.sites["msg"][0].text == "open" and m.sites["msg"][0].start == 13
    assert scan('(regex "(?P<head>..)$")', "abcd")[0].sites["head"][0].text == "cd"
    assert scan('(capture g (group (seq "a" "b")))', "x a b")[0].sites["g"][0].text == "a b"


def test_checks():
    for bad in ('(seq (capture a any) (unify a any))', '(capture a (* any))', '(not any)', '(not (ref "go:x::y"))', "(alt)", "(nope)", '(regex "(")', "(seq", "seq)"):
        with pytest.raises(PatternError):
            P.parse(bad)
    assert P.names(P.parse('(seq (capture b any) (capture _ any) (regex "(?P<n>x)") (unify a any))')) == ["b", "n", "a"]


def test_macros_expand():
    e = Expander('(def pair (a b) "two" (seq a "," b))')
    assert show(e.expand(read_one('(let x "p" (pair x (get x)))'))) == '(seq "p" "," "p")'
    assert show(e.expand(read_one('((fn (v) (seq v v)) any)'))) == "(seq any any)"
    assert show(e.expand(read_one('(progn (def two (p) (rep 2 p)) (two "k"))'))) == '(seq "k" "k")'
    with pytest.raises(PatternError):
        Expander("(def loop (x) (loop x))").expand(read_one("(loop any)"))
    for text in ('(seq (capture a (not (regex "x" ))) (* any) (assert_not_behind "q"))', '(alt "a\\"b" (ref "go:x::Y"))'):
        pat = P.parse(text)
        assert P.parse(P.to_sexp(pat)) == pat
    assert P.from_json('["seq", "a", ["capture", "x", "any"]]') == P.parse('(seq "a" (capture x any))')


@pytest.mark.parametrize("seed", range(3))
def test_lowered_patterns_equal_the_automaton(spark, seed):
    r = random.Random(seed)
    rows = [(str(k), [r.choice("abcd,") for _ in range(r.randrange(40))]) for k in range(30)] + [("e", []), ("n", None)]
    df = spark.createDataFrame(rows, "file string, tokens array<string>")
    for source in ('(seq "a" (capture x any) "b")', '(alt (seq "a" "b") (seq (capture y "a") "c"))', "(seq (unify u any) (unify u any))", '(seq (assert_not_behind "a") "b")', '(seq "a" (? ",") (not (regex "[ab]")))', '(rep 2 (alt "a" "b"))'):
        pat = P.parse(source)
        assert sequence.lowerable(pat)
        got = sorted((x.file, x.first, x.last, sorted((k, v) for k, v in x.sites.items() if v)) for x in sequence.lowered(df, pat).collect())
        want = []
        for file, own in rows:
            tokens = [Token(t, k, k + 1, t) for k, t in enumerate(own or [])]
            want += [(file, m.first, m.last, sorted((k, [s.text for s in v]) for k, v in m.sites.items() if v)) for m in Program(pat).scan(tokens, "".join(own or []).encode())]
        assert got == sorted(want), source
    assert not sequence.lowerable(P.parse('(seq "a" (* any) "b")'))


def test_fused_patterns_equal_single_ones(spark):
    files = tape.lexed(spark.createDataFrame([("a.go", GO), ("b.go", "x = é(1)\n_ = é(2)"), ("c", None)], "file string, text string"))
    pats = [P.parse('(seq "_" (* any) "(")'), P.parse('(seq "=" (capture f any))')]
    both = sorted(map(str, sequence.grep(files, pats).drop("pattern").collect()))
    each = sorted(str(x) for p in pats for x in sequence.grep(files, [p]).drop("pattern").collect())
    assert both == each and len(both) > 4
    raw = "x = é(1)\n_ = é(2)".encode()
    for m in sequence.grep(files, pats).where("file = 'b.go'").collect():
        assert raw[m.start : m.end].decode() == m.text
    shown = sequence.shown(sequence.grep(files, [pats[1]]), ["f", "none"]).where("file = 'b.go'").orderBy("start").collect()
    assert [(x.f, x.none) for x in shown] == [("é", ""), ("é", "")]


def test_references_resolve(spark):
    text = "import e\ne.New(1)\nf.New(2)"
    files = tape.lexed(spark.createDataFrame([("a.go", text)], "file string, text string"))
    targets = spark.createDataFrame([("a.go", 11, 14, "go:errors::New")], "file string, start int, end int, target string")
    m = sequence.grep(files, [P.parse('(seq (capture F (ref "go:errors::New")) "(")')], targets).collect()
    assert len(m) == 1 and m[0].sites["F"][0].text == "e.New"
    assert sequence.grep(files, [P.parse('(ref "go:errors::New")')]).count() == 0


def file(path, text, **more):
    return M.File(path, text.encode(), toks(text), **more)


def test_matchers():
    f = file("src/a.go", "f(a) { b; g(c) } h(d)")
    find = lambda s, f=f: [f.text[m.start : m.end].decode() for m in M.find(M.parse(s), f)]
    assert find('(under (seq "{" (* any) "}") (seq (regex "^[a-z]$") "("))') == ["g("]
    assert find('(take x (seq (capture x any) "("))') == ["f", "g", "h"]
    assert find('(or "f" "h" (or "g"))') == ["f", "h", "g"]
    assert find('(path "*.go" "f")') == ["f"] and find('(path "*.py" "f")') == []
    assert find('(and (path "src/**") (not (path "*.py")) "b")') == ["b"]
    assert find('(lang go "f")') == [] and find('(lang go "f")', file("a", "f", lang="go")) == ["f"]
    nodes = [M.Node("call", 0, 4, {"name": (0, 1)}), M.Node("block", 5, 16)]
    with_nodes = file("a.go", "f(a) { b; g(c) } h(d)", nodes=nodes)
    assert M.find(M.parse("(node call)"), with_nodes)[0].sites["name"][0].text == "f"
    assert find('(seq "g" "(")', with_nodes) == ["{ b; g(c) }"[:11]]
    m = M.find(M.parse('(as-language sql (regex "select") (seq "from" (capture t any)))'), file("a", 'q("select x from tt")'), {"sql": lambda s: [Token(x[0], x.start(), x.end(), x[0]) for x in re.finditer(tape.WORDS, s)]})
    assert [x.sites["t"][0].text for x in m] == ["tt"]
    for bad in ('(or (path "a") "b")', '(and "a" "b")', '(lang go (lang py "x"))'):
        with pytest.raises(PatternError):
            M.parse(bad)


def test_gates_are_hoisted():
    gate = M.gate_of(M.parse('(or (path "*.go" "a") (and (path "x/**") "b"))'))
    assert gate.opens("x/y") and gate.opens("k/a.go") and not gate.opens("k/a.py")
    assert M.gate_of(M.parse('(or (path "*.go" "a") "b")')) is None


def test_plans_share_regions():
    pack = load('(rule a error "A" "x") (rule b error "B" (under "r" "x")) (rule c note "C" (under "r" "y")) (rule d note "D" (take v (capture v any))) (rewrite "k" "l") (builtin dead-imports)')
    p = plan(pack)
    assert p.fused == [0, 4] and list(p.under.values()) == [[1, 2]] and p.rest == [3] and p.builtins == [5]
    assert costly(load('(rule s warning "S" (seq (* any) "x"))')) and not costly(load('(rule s warning "S" "x")'))
    assert [r.id for r in pack.merged(load('(rule a note "again" "x") (rule z note "Z" "x")')).rules] == ["a", "b", "c", "d", "", "dead-imports", "z"]
