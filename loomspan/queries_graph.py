"""Queries on symbol graphs: extraction, the ladder of binds, navigation, renames, moves, imports, and host relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import model
from .functions import paths
from .operators import binding, extract, graph, refactor, relations, rules, spans, tape
from .plans import claims, providers
from .plans.walker import Walker
from .registry import FILES, IV, SPANS, event_files, files, intervals, query, turns
from .sources import files as sources
from .sources import trees
from .storage import read_table, staged, unbounded

# --- source trees made of the tables -----------------------------------------

_N = "(SELECT count(*) FROM supplier)"
_NEXT = f"((s_suppkey + 1) % {_N})"


def _str(c) -> F.Column:
    return F.col(c).cast("string")


def _python_files(spark, sf_dir) -> DataFrame:
    """One module for each supplier, with a class that has a field for each of its parts, and one that all import from."""
    s, p = read_table(spark, sf_dir, "supplier"), read_table(spark, sf_dir, "part")
    n = s.count()
    fields = p.groupBy((F.col("p_partkey") % n).alias("s_suppkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: F.concat(F.lit("    p"), k.cast("string"), F.lit(": int = 1\n"))), "").alias("fields"))
    k, nxt = _str("s_suppkey"), ((F.col("s_suppkey") + 1) % n).cast("string")
    text = F.concat(
        F.lit("from geo.base import Place, helper as h, Unused\nimport geo.s"), nxt, F.lit(" as other\n\n\nclass S"), k, F.lit('(Place):\n    """Supplier '), k, F.lit('."""\n'), F.coalesce("fields", F.lit("")),
        F.lit("\n    def total(self, q):\n        if q:\n            return h(other.S"), nxt, F.lit(")\n        elif self:\n            return Place\n        return top"), k, F.lit("\n\n\n# the top of it\ndef top"), k, F.lit("():\n    return S"), k, F.lit("\n"),
    )
    own = s.join(unbounded(fields), "s_suppkey", "left").select(F.concat(F.lit("geo/s"), k, F.lit(".py")).alias("file"), text.alias("text"))
    base = spark.createDataFrame([("geo/base.py", "class Place:\n    pass\n\n\ndef helper(a):\n    return a\n\n\nclass Unused:\n    pass\n")], "file string, text string")
    return own.unionByName(base)


def _go_files(spark, sf_dir) -> DataFrame:
    """One file for each supplier in seven packages, each with one file that declares what the others use."""
    s = read_table(spark, sf_dir, "supplier")
    k, p = _str("s_suppkey"), (F.col("s_suppkey") % 7).cast("string")
    text = F.concat(
        F.lit("package p"), p, F.lit("\n\n// S"), k, F.lit(" is a supplier.\ntype S"), k, F.lit(" struct {\n\tKey, Size int\n}\n\nfunc (s *S"), k,
        F.lit(") Total() int {\n\tif s.Key > 0 {\n\t\treturn shared(s.Key)\n\t} else if s.Key < 0 {\n\t\treturn 0\n\t}\n\tfor i := range s.Size {\n\t\tshared(i)\n\t}\n\treturn 1\n}\n"),
    )
    own = s.select(F.concat(F.lit("p"), p, F.lit("/s"), k, F.lit(".go")).alias("file"), text.alias("text"))
    common = s.select(p.alias("p")).distinct().select(F.concat(F.lit("p"), "p", F.lit("/shared.go")).alias("file"), F.concat(F.lit("package p"), "p", F.lit("\n\nfunc shared(a int) int {\n\treturn a\n}\n")).alias("text"))
    return own.unionByName(common)


def _java_files(spark, sf_dir) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    k = _str("n_nationkey")
    text = F.concat(F.lit("package a.b;\n\nimport java.util.List;\n\npublic class N"), k, F.lit(" {\n  public enum Tone { RED, BLUE }\n  private static class Kept {\n    int value = 3;\n    String label() { return shown(value); }\n  }\n  List<String> items;\n}\n\nrecord Pair"), k, F.lit("(int left, int right) {}\n"))
    return n.select(F.concat(F.lit("src/a/b/N"), k, F.lit(".java")).alias("file"), text.alias("text"))


def _ts_files(spark, sf_dir) -> DataFrame:
    r = read_table(spark, sf_dir, "region")
    k = _str("r_regionkey")
    text = F.concat(F.lit("import { a as b } from './x';\n\nexport enum Tone"), k, F.lit(" { Red = 1, Blue = 2 }\nexport interface W"), k, F.lit(" { run(): number; label: string }\nexport function top"), k, F.lit("(q) { return b(q) }\n"))
    return r.select(F.concat(F.lit("web/r"), k, F.lit(".ts")).alias("file"), text.alias("text"))


def _rust_files(spark, sf_dir) -> DataFrame:
    r = read_table(spark, sf_dir, "region")
    k = _str("r_regionkey")
    text = F.concat(F.lit("use std::fmt::{Display, Result as R};\n\npub struct P"), k, F.lit(" { pub a: u8 }\nimpl<T> Display for P"), k, F.lit(" { fn show(&self) -> R { helper(self.a) } }\nenum E"), k, F.lit(" { One, Two(u8) }\nfn helper() {}\n"))
    return r.select(F.concat(F.lit("src/r"), k, F.lit(".rs")).alias("file"), text.alias("text"))


_PYF = "(SELECT *, 'geo/s'||s_suppkey||'.py' AS file FROM supplier)"
_GOF = "(SELECT *, 'p'||(s_suppkey % 7)||'/s'||s_suppkey||'.go' AS file FROM supplier)"


def _facts(files: DataFrame) -> dict[str, DataFrame]:
    return extract.relations(staged(extract.extracted(files)))


# --- extraction --------------------------------------------------------------


@query(f"SELECT file, unnest(['S'||s_suppkey, 'S'||s_suppkey||'.total', 'top'||s_suppkey]) AS name FROM {_PYF} UNION ALL SELECT 'geo/s'||(p_partkey % {_N})||'.py', 'S'||(p_partkey % {_N})||'.p'||p_partkey FROM part UNION ALL SELECT 'geo/base.py', unnest(['Place', 'helper', 'Unused'])")
def extract_python_atoms(spark, sf_dir):
    return _facts(_python_files(spark, sf_dir))["atom"].select("file", "name")


@query(f"SELECT file, unnest(['Place', 'h', 'other.S'||{_NEXT}, 'Place', 'top'||s_suppkey, 'S'||s_suppkey]) AS name, unnest(['S'||s_suppkey, 'S'||s_suppkey||'.total', 'S'||s_suppkey||'.total', 'S'||s_suppkey||'.total', 'S'||s_suppkey||'.total', 'top'||s_suppkey]) AS scope FROM {_PYF}")
def extract_python_uses(spark, sf_dir):
    """Uses with their qualifiers, but for types, parameters and what the common module does."""
    t = _facts(_python_files(spark, sf_dir))
    seg = t["use_seg"].groupBy("file", "use_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda x: x["name"]).alias("prefix"))
    u = t["use"].where("name NOT IN ('int', 'q', 'self', 'a') AND file <> 'geo/base.py'").join(seg, ["file", "use_id"], "left")
    return u.select("file", F.concat_ws(".", F.coalesce("prefix", F.array().cast("array<string>")), F.array("name")).alias("name"), "scope")


@query(f"SELECT file, unnest(['Place', 'h', 'Unused', 'other']) AS local, unnest(['geo.base', 'geo.base', 'geo.base', 'geo.s'||{_NEXT}]) AS spec, unnest(['Place', 'helper', 'Unused', '']) AS member, unnest([false, true, false, true]) AS has_alias FROM {_PYF}")
def extract_python_imports(spark, sf_dir):
    return _facts(_python_files(spark, sf_dir))["import"].select("file", "local", "spec", "member", "has_alias")


@query(f"SELECT file, unnest(['structural', 'hybrid']) AS class FROM {_PYF}")
def extract_python_flow(spark, sf_dir):
    return _facts(_python_files(spark, sf_dir))["flow"].select("file", "class")


@query(f"SELECT file, unnest(['S'||s_suppkey, 'S'||s_suppkey||'.total', 'top'||s_suppkey]) AS name, unnest(['class S'||s_suppkey||'(Place)', 'def total(self, q)', 'def top'||s_suppkey||'()']) AS signature, unnest(['Supplier '||s_suppkey||'.', '', '']) AS doc FROM {_PYF}")
def extract_docs(spark, sf_dir):
    return _facts(_python_files(spark, sf_dir))["doc"].where("file <> 'geo/base.py'")


@query(f"SELECT file, unnest(['S'||s_suppkey, 'S'||s_suppkey||'.Key', 'S'||s_suppkey||'.Size', 'S'||s_suppkey||'.Total']) AS name, true AS exported FROM {_GOF} UNION ALL SELECT DISTINCT 'p'||(s_suppkey % 7)||'/shared.go', 'shared', false FROM supplier")
def extract_go_atoms(spark, sf_dir):
    return _facts(_go_files(spark, sf_dir))["atom"].select("file", "name", "exported")


@query(f"SELECT file, 'p'||(s_suppkey % 7) AS package, unnest(['structural', 'hybrid', 'structural']) AS class FROM {_GOF}")
def extract_go_flow(spark, sf_dir):
    """Branches of an else-if chain count once."""
    t = _facts(_go_files(spark, sf_dir))
    return t["flow"].join(t["package"].select("file", F.col("name").alias("package")), "file").select("file", "package", "class")


@query("SELECT 'src/a/b/N'||n_nationkey||'.java' AS file, unnest(['N'||n_nationkey, 'N'||n_nationkey||'.Tone', 'N'||n_nationkey||'.Tone.RED', 'N'||n_nationkey||'.Tone.BLUE', 'N'||n_nationkey||'.Kept', 'N'||n_nationkey||'.Kept.value', 'N'||n_nationkey||'.Kept.label', 'N'||n_nationkey||'.items', 'Pair'||n_nationkey, 'Pair'||n_nationkey||'.left', 'Pair'||n_nationkey||'.right']) AS name FROM nation")
def extract_java_atoms(spark, sf_dir):
    return _facts(_java_files(spark, sf_dir))["atom"].select("file", "name")


@query("SELECT 'web/r'||r_regionkey||'.ts' AS file, unnest(['Tone'||r_regionkey, 'Tone'||r_regionkey||'.Red', 'Tone'||r_regionkey||'.Blue', 'W'||r_regionkey, 'W'||r_regionkey||'.run', 'W'||r_regionkey||'.label', 'top'||r_regionkey]) AS name FROM region UNION ALL SELECT 'src/r'||r_regionkey||'.rs', unnest(['P'||r_regionkey, 'P'||r_regionkey||'.a', 'P'||r_regionkey||'.show', 'E'||r_regionkey, 'E'||r_regionkey||'.One', 'E'||r_regionkey||'.Two', 'helper']) FROM region")
def extract_brace_atoms(spark, sf_dir):
    return _facts(_ts_files(spark, sf_dir).unionByName(_rust_files(spark, sf_dir)))["atom"].select("file", "name")


@query("SELECT 'web/r'||r_regionkey||'.ts' AS file, 'b' AS local, './x' AS spec, 'a' AS member, true AS has_alias FROM region UNION ALL SELECT 'src/r'||r_regionkey||'.rs', unnest(['Display', 'R']), unnest(['std::fmt::Display', 'std::fmt::Result']), '', unnest([false, true]) FROM region UNION ALL SELECT 'src/a/b/N'||n_nationkey||'.java', 'List', 'java.util.List', '', false FROM nation")
def extract_brace_imports(spark, sf_dir):
    own = _ts_files(spark, sf_dir).unionByName(_rust_files(spark, sf_dir)).unionByName(_java_files(spark, sf_dir))
    return _facts(own)["import"].select("file", "local", "spec", "member", "has_alias")


@query(f"SELECT file, 3 AS scopes, 2 AS roots, 1 AS nested FROM {_PYF}")
def extract_scopes(spark, sf_dir):
    s = _facts(_python_files(spark, sf_dir))["scope"].where("file <> 'geo/base.py'")
    return s.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("scopes"), F.count_if(F.col("parent") < 0).cast("int").alias("roots"), F.count_if(F.col("parent") >= 0).cast("int").alias("nested"))


@query(f"SELECT file, 'S'||s_suppkey||' is a supplier.' AS doc FROM {_GOF}")
def docs_before_declarations(spark, sf_dir):
    own = _go_files(spark, sf_dir)
    points = _facts(own)["atom"].where(r"name RLIKE '^S[0-9]+$'").select("file", F.col("start").alias("at"))
    return refactor.comments_before(own, points).select("file", "doc")


@query("SELECT CAST(page_id AS VARCHAR) AS file, 'title in head' AS type, len(regexp_extract_all(html, '<title>')) AS n FROM pages WHERE regexp_matches(html, '<title>')")
def syntax_tree_query(spark, sf_dir):
    """Nodes by the shape of the tree around them: a title directly below a head."""
    pages = read_table(spark, sf_dir, "pages").withColumn("file", _str("page_id"))
    found = trees.query(trees.nodes(pages, "html", text="html"), "(head (title) @t)")
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.lit("title in head").alias("type"), "n")


@query("SELECT CAST(page_id AS VARCHAR) AS file, len(regexp_extract_all(html, '<title>')) AS titles FROM pages")
def syntax_node_index(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages").withColumn("file", _str("page_id"))
    index = trees.indexed(trees.nodes(pages, "html", text="html"))
    return pages.select("file").join(index, "file", "left").select("file", F.coalesce(F.size(F.col("nodes")["title"]), F.lit(0)).cast("long").alias("titles"))


_PACK = """
(under (path "**/*.go")
  (as-language "go") (as-family "go" package_scoped nested) (as-layout package import body) (as-atomic "interface{}") (as-docstring comment-before)
  (as-package (seq "package" (capture pkg any)))
  (as-keyword (regex "^(func|return|if|else|for|range|type|struct|package)$"))
  (as-number (regex "^[0-9]+$"))
  (as-atom public (seq "func" "(" any "*" (capture name any) ")" (capture name any) "("))
  (as-atom private (seq "func" (capture name (regex "^[a-z]")) "("))
  (as-decl (seq "struct" "{" (* any) "}"))
  (under (seq "func" (* any) "return")
    (as-scope (this))
    (as-use (seq (capture name any) "." (capture name any))))
  (as-flow structural (seq "for" (* any) "{")))
(under (path "*.none") (as-language "none") (as-family "go" include_export))
"""


@query(f"SELECT file, 'S'||s_suppkey||'.Total' AS name, true AS exported FROM {_GOF} UNION ALL SELECT DISTINCT 'p'||(s_suppkey % 7)||'/shared.go', 'shared', false FROM supplier")
def extract_by_pack(spark, sf_dir):
    """Declarations by the verbs of a pack: the receiver's type and the method's name make one name."""
    return extract.relations(staged(extract.packed(_go_files(spark, sf_dir), _PACK)))["atom"].select("file", "name", "exported")


@query(f"SELECT file, 's.Key' AS name FROM {_GOF}")
def extract_uses_by_pack(spark, sf_dir):
    """Uses inside the places of a pack, with what qualifies them."""
    t = extract.relations(staged(extract.packed(_go_files(spark, sf_dir), _PACK)))
    return t["use"].join(t["use_seg"].select("file", "use_id", F.col("name").alias("prefix")), ["file", "use_id"]).select("file", F.concat_ws(".", "prefix", "name").alias("name"))


@query(f"SELECT file, 'p'||(s_suppkey % 7) AS package, 1 AS scopes, 1 AS holes, 1 AS flows FROM {_GOF} UNION ALL SELECT DISTINCT 'p'||(s_suppkey % 7)||'/shared.go', 'p'||(s_suppkey % 7), 1, 0, 0 FROM supplier")
def extract_scopes_by_pack(spark, sf_dir):
    t = extract.relations(staged(extract.packed(_go_files(spark, sf_dir), _PACK)))
    n = lambda rows, name: rows.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias(name))
    out = t["package"].select("file", F.col("name").alias("package"))
    for rows, name in ((t["scope"].where("NOT hole"), "scopes"), (t["scope"].where("hole"), "holes"), (t["flow"], "flows")):
        out = out.join(n(rows, name), "file", "left")
    return out.fillna(0)


@query(f"SELECT file, unnest(['keyword', 'number']) AS cls, unnest([12, 4]) AS n FROM {_GOF} UNION ALL SELECT DISTINCT 'p'||(s_suppkey % 7)||'/shared.go', 'keyword', 3 FROM supplier")
def painted_by_pack(spark, sf_dir):
    paint = extract.relations(staged(extract.packed(_go_files(spark, sf_dir), _PACK)))["paint"]
    return paint.groupBy("file", "cls").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT 'go' AS lang, 'go' AS family, ['include_export', 'nested', 'package_scoped'] AS flags UNION ALL SELECT 'none', 'go', ['include_export', 'nested', 'package_scoped']")
def claims_of_a_pack(spark, sf_dir):
    """The flags of a family, from the claims of all its languages."""
    own = claims.load(_PACK)
    assert own.of("as-layout", "a/b.go") == [("package", "import", "body")] and own.of("as-atomic", "x.py") == [] and own.of("as-docstring", "b.go") == [("comment-before",)]
    return binding.family_flags(spark.createDataFrame(own.families(), "lang string, family string, flag string"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'x.md' ELSE 'n'||p_partkey END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'a/b' WHEN p_partkey % 3 = 1 THEN 'a' ELSE '' END AS shared FROM part")
def names_and_prefixes(spark, sf_dir):
    """The last part of quoted names, and the folders that two paths share."""
    k = F.col("p_partkey")
    name = F.when(k % 2 == 0, "Type.'x.md'").otherwise(F.concat(F.lit("A.B.n"), _str("p_partkey")))
    other = F.when(k % 3 == 0, "a/b/d").when(k % 3 == 1, "a/c/d").otherwise("b/c/d")
    return read_table(spark, sf_dir, "part").select("p_partkey", paths.atom_name(name).alias("name"), paths.common_prefix(F.lit("a/b/c"), other).alias("shared"))


# --- binds -------------------------------------------------------------------


@query(f"""SELECT file, unnest(['path:'||file||'::S'||s_suppkey, 'path:'||file||'::S'||s_suppkey||'.total', 'path:'||file||'::S'||s_suppkey||'.total', 'path:'||file||'::S'||s_suppkey||'.total', 'path:'||file||'::S'||s_suppkey||'.total', 'path:'||file||'::S'||s_suppkey||'.total', 'path:'||file||'::top'||s_suppkey]) AS from_ref,
  unnest(['path:geo/base.py::Place', 'path:geo/base.py::helper', 'path:geo/s'||{_NEXT}||'.py', 'path:geo/s'||{_NEXT}||'.py::S'||{_NEXT}, 'path:geo/base.py::Place', 'path:'||file||'::top'||s_suppkey, 'path:'||file||'::S'||s_suppkey]) AS target_ref,
  unnest([false, true, false, false, false, false, false]) AS via_alias, unnest(['import', 'import', 'dotted', 'dotted', 'import', 'root', 'root']) AS way FROM {_PYF}""")
def resolve_python_modules(spark, sf_dir):
    """From text to binds: extraction, import resolution, scopes, the ladder, dotted names."""
    return Walker(_python_files(spark, sf_dir)).store["binds"].where("file <> 'geo/base.py'").select("file", "from_ref", "target_ref", "via_alias", "way")


@query(f"SELECT file, 'path:'||file||'::S'||s_suppkey||'.Total' AS from_ref, 'path:p'||(s_suppkey % 7)||'/shared.go::shared' AS target_ref, unnest(['peer', 'peer']) AS way FROM {_GOF}")
def resolve_package_peers(spark, sf_dir):
    return Walker(_go_files(spark, sf_dir)).store["binds"].where("way = 'peer'").select("file", "from_ref", "target_ref", "way")


def _ladder(spark, sf_dir) -> tuple[binding.Ladder, DataFrame, DataFrame]:
    """Files that have one name for each way of the ladder, and dotted ones."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("f"), _str("s_suppkey")).alias("file"))
    e = lambda *cols: s.select("file", *(F.lit(v).alias(n) if isinstance(v, (str, int, bool)) else v.alias(n) for n, v in cols))
    flags = spark.createDataFrame([("x", f) for f in ("package_scoped", "nested", "include_export")], "lang string, flag string")
    facts = binding.facts(e(("lang", "x"), ("package", F.concat(F.lit("p"), (F.col("s_suppkey") % 5).cast("string")))), flags)
    header = F.concat(F.lit("hdr"), (F.col("s_suppkey") % 3).cast("string"))
    imports = e(("local", "imp"), ("target", "path:old::imp"), ("member", "imp"), ("alias", True), ("seq", 0))
    imports = imports.unionByName(e(("local", "imp"), ("target", "path:lib::imp"), ("member", "imp"), ("alias", True), ("seq", 1))).unionByName(e(("local", "hdr"), ("target", F.concat(F.lit("path:"), header)), ("member", ""), ("alias", False), ("seq", 2)))
    atoms = e(("name", "T.spn"), ("start", 20), ("end", 23)).unionByName(e(("name", "T.m"), ("start", 0), ("end", 1)))
    visible = e(("scope_idx", 1), ("leaf", "scp"), ("ref", "near"), ("seq", 0)).unionByName(e(("scope_idx", 1), ("leaf", "scp"), ("ref", "far"), ("seq", 1))).unionByName(e(("scope_idx", -1), ("leaf", "rot"), ("ref", "root"), ("seq", 0))).unionByName(e(("scope_idx", -1), ("leaf", "scp"), ("ref", "outer"), ("seq", 0)))
    declares = e(("scope_idx", -1), ("leaf", "per"), ("ref", F.concat("file", F.lit("::per"))))
    headers = s.select(header.alias("file")).distinct()
    named = headers.select("file", F.explode(F.array(*map(F.lit, ("inc", "T.ich", "imp")))).alias("name"))
    named = named.unionByName(e(("name", "T.m.typ"))).unionByName(e(("name", "T.hed")))
    named = named.unionByName(spark.createDataFrame([("lib", "imp.b"), ("lib", "imp.b.leaf"), ("lib", "c"), ("stars", "str"), ("stars", "_prv"), ("none", "str")], "file string, name string"))
    named = named.select("file", "name", F.concat(F.lit("path:"), "file", F.lit("::"), "name").alias("ref"), F.lit(0).alias("seq"))
    stars = e(("base", "path:none"), ("seq", 0)).unionByName(e(("base", "path:stars"), ("seq", 1)))
    names = [("imp", "", 0), ("spn", "", 20), ("scp", "", 30), ("rot", "", 40), ("per", "", 50), ("inc", "", 60), ("typ", "T.m", 70), ("hed", "T.m", 80), ("ich", "T.m", 90), ("str", "", 100), ("_prv", "", 110), ("non", "", 120)]
    use = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("start"), F.lit(p + 3).alias("end"), F.lit(sc).alias("scope"), F.lit(1).alias("scope_idx"), F.lit(0).alias("n_prefix"), F.lit(k).alias("use_id")) for k, (n, sc, p) in enumerate(names))))
    uses = s.select("file", use.alias("u")).select("file", "u.*")
    # imp.b.leaf, imp.c.gone, nowhere.x
    long = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(p).alias("start"), F.lit(p + 1).alias("end"), F.lit("").alias("scope"), F.lit(1).alias("scope_idx"), F.lit(2).alias("n_prefix"), F.lit(k).alias("use_id")) for n, p, k in (("leaf", 202, 100), ("gone", 302, 101), ("x", 402, 102)))))
    uses = uses.unionByName(s.select("file", long.alias("u")).select("file", "u.*"))
    seg = F.explode(F.array(*(F.struct(F.lit(k).alias("use_id"), F.lit(i).alias("idx"), F.lit(n).alias("name"), F.lit(p).alias("start"), F.lit(p + 1).alias("end")) for k, i, n, p in ((100, 0, "imp", 200), (100, 1, "b", 201), (101, 0, "imp", 300), (101, 1, "c", 301), (102, 0, "nowhere", 400)))))
    return binding.Ladder(facts, imports, atoms, visible, declares, named, stars), uses, s.select("file", seg.alias("g")).select("file", "g.*")


@query("""WITH s AS (SELECT s_suppkey AS k, 'f'||s_suppkey AS file, 'hdr'||(s_suppkey % 3) AS h, s_suppkey % 5 AS p FROM supplier)
  SELECT file, 0 AS start, 'path:'||file AS from_ref, 'path:lib::imp' AS target_ref, true AS via_alias, 'import' AS way FROM s
  UNION ALL SELECT file, 20, 'path:'||file, 'path:'||file||'::T.spn', false, 'span' FROM s UNION ALL SELECT file, 30, 'path:'||file, 'near', false, 'scope' FROM s UNION ALL SELECT file, 40, 'path:'||file, 'root', false, 'root' FROM s
  UNION ALL SELECT file, 50, 'path:'||file, (SELECT min(o.file) FROM s o WHERE o.p = s.p AND o.file <> s.file)||'::per', false, 'peer' FROM s
  UNION ALL SELECT file, 60, 'path:'||file, 'path:'||h||'::inc', false, 'include' FROM s UNION ALL SELECT file, 70, 'path:'||file||'::T.m', 'path:'||file||'::T.m.typ', false, 'type' FROM s
  UNION ALL SELECT file, 80, 'path:'||file||'::T.m', 'path:'||file||'::T.hed', false, 'head' FROM s UNION ALL SELECT file, 90, 'path:'||file||'::T.m', 'path:'||h||'::T.ich', false, 'include_head' FROM s
  UNION ALL SELECT file, 100, 'path:'||file, 'path:stars::str', false, 'star' FROM s""")
def resolve_ladder(spark, sf_dir):
    """Each way of the ladder, in its order; a name that two ways know goes to the earlier one."""
    ladder, uses, _ = _ladder(spark, sf_dir)
    return ladder.bare(uses).select("file", "start", "from_ref", "target_ref", "via_alias", "way")


@query("""SELECT 'f'||s_suppkey AS file, unnest([200, 201, 202, 300, 301, 302]) AS start, unnest(['path:lib::imp', 'path:lib::imp.b', 'path:lib::imp.b.leaf', 'path:lib::imp', 'path:lib::c', 'path:lib::c::gone']) AS target_ref FROM supplier""")
def resolve_dotted(spark, sf_dir):
    """Segment by segment through what is known, then by name alone; an unknown first segment gives nothing."""
    ladder, uses, segments = _ladder(spark, sf_dir)
    return ladder.dotted(uses, segments).select("file", "start", "target_ref")


@query("SELECT 'f'||s_suppkey AS file, CASE s_suppkey % 4 WHEN 0 THEN 'path:f'||s_suppkey WHEN 1 THEN 'path:f'||s_suppkey||'::A.run' WHEN 2 THEN 'path:f'||s_suppkey||'::run' ELSE 'path:f'||s_suppkey||'::gone' END AS from_ref FROM supplier")
def use_sources(spark, sf_dir):
    """Where a use stands: its file, the only declaration of that leaf, the one of that very name, or the scope as written."""
    s = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), _str("s_suppkey")).alias("file"), (F.col("s_suppkey") % 4).alias("m"))
    uses = s.select("file", F.when(F.col("m") == 0, "").when(F.col("m") == 3, "gone").otherwise("run").alias("scope"))
    names = F.when(F.col("m") == 1, F.array(F.lit("A.run"))).when(F.col("m") == 2, F.array(F.lit("A.run"), F.lit("run"))).otherwise(F.array(F.lit("B.stop")))
    return binding.used_from(uses, s.select("file", F.explode(names).alias("name"))).select("file", "from_ref")


@query("SELECT o_custkey AS file, min(o_orderkey) FILTER (o_orderstatus = 'F') AS with_prefix, min(o_orderkey) AS any_use FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') > 0")
def best_use_per_span(spark, sf_dir):
    """Of the uses of one span, the first with a prefix."""
    o = read_table(spark, sf_dir, "orders")
    uses = o.select(F.col("o_custkey").alias("file"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("n_prefix"), F.lit("").alias("scope"), F.col("o_orderkey").alias("use_id"))
    first = uses.groupBy("file").agg(F.min("use_id").alias("any_use"))
    return binding.best_use(uses).where("n_prefix > 0").join(first, "file").select("file", F.col("use_id").alias("with_prefix"), "any_use")


@query(f"SELECT file, flag AS scope, min(idx) AS idx FROM (SELECT *, min(s) OVER (PARTITION BY file, flag) AS lo FROM {IV}) WHERE s = lo GROUP BY ALL")
def first_atom_in_scope(spark, sf_dir):
    own = intervals(spark, sf_dir)
    number = F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2)
    atoms = own.select("file", number.alias("scope_idx"), "start", "end", F.lpad(_str("idx"), 3, "0").alias("name"), "idx", "flag")
    return binding.first_atoms(atoms).select("file", F.col("flag").alias("scope"), F.col("idx").cast("long").alias("idx"))


@query("SELECT 'l'||n_nationkey AS lang, 'f'||n_regionkey AS family, f.flags FROM nation JOIN (SELECT n_regionkey AS r, list_sort(list(DISTINCT 'k'||(n_nationkey % 4))) AS flags FROM nation GROUP BY n_regionkey) f ON f.r = n_regionkey")
def family_flags(spark, sf_dir):
    """What any language of a family states holds for all of them."""
    return binding.family_flags(_claims(spark, sf_dir))


def _claims(spark, sf_dir) -> DataFrame:
    n = read_table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("l"), _str("n_nationkey")).alias("lang"), F.concat(F.lit("f"), _str("n_regionkey")).alias("family"), F.concat(F.lit("k"), (F.col("n_nationkey") % 4).cast("string")).alias("flag"))


@query("SELECT 'l'||a.n_nationkey AS a, 'l'||b.n_nationkey AS b, a.n_regionkey = b.n_regionkey AS same FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 5) % 25")
def family_pairs(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("l"), _str("n_nationkey")).alias("a"), F.concat(F.lit("l"), ((F.col("n_nationkey") * 7 + 5) % 25).cast("string")).alias("b"))
    return binding.same_family(n, _claims(spark, sf_dir))


@query("SELECT 'path:f'||o_custkey||'::x'||o_orderkey AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'path:f'||o_custkey||'::x'||o_orderkey WHEN o_orderkey % 3 = 1 THEN 'path:other::x'||o_orderkey END AS found FROM orders")
def definition_by_name(spark, sf_dir):
    """An atom of that reference, else one of that name anywhere, else none."""
    o = read_table(spark, sf_dir, "orders")
    ref = F.concat(F.lit("path:f"), _str("o_custkey"), F.lit("::x"), _str("o_orderkey"))
    far = F.concat(F.lit("path:other::x"), _str("o_orderkey"))
    k = F.col("o_orderkey") % 3
    atoms = o.where(k < 2).select(F.when(k == 0, ref).otherwise(far).alias("ref"), F.lit(0).alias("start"))
    return binding.atoms_named(o.select(ref.alias("ref")), atoms)


@query("SELECT 'o'||o_orderkey AS ref, CASE WHEN o_orderkey % 2 = 0 THEN 'n'||n_nationkey ELSE 'r'||n_regionkey END AS target, true AS exact FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def navigation(spark, sf_dir):
    """Orders followed to their customer, nation, region, until an atom has the reference: even ones stop at the nation."""
    t = lambda n: read_table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), _str(c))
    even = F.col("o_orderkey") % 2 == 0
    tag = F.when(even, "e").otherwise("u")
    links = t("orders").select(name("o", "o_orderkey").alias("ref"), F.concat(tag, name("c", "o_custkey")).alias("target"))
    for k in ("e", "u"):
        links = links.unionByName(t("customer").select(F.concat(F.lit(k), name("c", "c_custkey")).alias("ref"), (name("n", "c_nationkey") if k == "e" else F.concat(F.lit("u"), name("n", "c_nationkey"))).alias("target")))
    links = links.unionByName(t("nation").select(F.concat(F.lit("u"), name("n", "n_nationkey")).alias("ref"), name("r", "n_regionkey").alias("target"))).unionByName(t("nation").select(name("n", "n_nationkey").alias("ref"), F.lit("beyond").alias("target")))
    atoms = t("nation").select(name("n", "n_nationkey").alias("ref")).unionByName(t("region").select(name("r", "r_regionkey").alias("ref")))
    return binding.navigated(t("orders").select(name("o", "o_orderkey").alias("ref")), atoms, links)


@query(f"SELECT file, 'top'||s_suppkey AS name FROM {_PYF}")
def deps_in_a_hole(spark, sf_dir):
    """What the method of each class uses of its own file, if the class moved without it."""
    w = Walker(_python_files(spark, sf_dir))
    holes = w.store["scope"].join(binding.first_atoms(w.store["atom"]).select("file", F.col("scope_idx").alias("idx"), "name"), ["file", "idx"]).where(r"name RLIKE '^S[0-9]+$'")
    return binding.local_deps(w.store["binds"], w.store["atom"], holes.select("file", "start", "end", F.concat(F.lit("path:"), "file", F.lit("::"), "name").alias("ref"))).select("file", "name")


@query("SELECT count(*) AS n FROM nation")
def match_count_assertion(spark, sf_dir):
    return binding.expected(read_table(spark, sf_dir, "nation"), 25, "nations")


# --- the walker --------------------------------------------------------------


@query(f"SELECT file, 'dead-imports' AS rule_id FROM {_PYF}")
def dead_imports_of_modules(spark, sf_dir):
    """The one import of each module that nothing uses."""
    found, _ = Walker(_python_files(spark, sf_dir)).dead_imports()
    return found.where("file <> 'geo/base.py'").select("file", "rule_id")


@query(f"SELECT 'geo/base.py' AS file, 1 AS edits UNION ALL SELECT file, 3 FROM {_PYF}")
def rename_across_modules(spark, sf_dir):
    w = Walker(_python_files(spark, sf_dir))
    edits = w.rename(spark.createDataFrame([("path:geo/base.py::Place", "Spot")], "ref string, new_text string"))
    return edits.groupBy("file").agg(F.count(F.lit(1)).cast("int").alias("edits"))


@query(f"SELECT file, 1 AS places, 0 AS left_over FROM {_PYF} UNION ALL SELECT 'geo/base.py', 1, 0")
def rename_applied(spark, sf_dir):
    """After the edits, the old name stands nowhere, and each class names the new one in its head or is it."""
    w = Walker(_python_files(spark, sf_dir))
    new = w.applied(w.rename(spark.createDataFrame([("path:geo/base.py::Place", "Spot")], "ref string, new_text string")))
    return new.select("file", (F.size(F.split("text", r"\(Spot\)|class Spot:")) - 1).alias("places"), (F.size(F.split("text", "Place")) - 1).alias("left_over"))


@query(f"SELECT file, 'path:geo/base.py::Place' AS target FROM {_PYF}")
def definition_at_byte(spark, sf_dir):
    """The base class of each module's class, from the byte where it is named."""
    own = _python_files(spark, sf_dir)
    points = own.where("file <> 'geo/base.py'").select("file", (F.instr("text", "(Place)") + 1).alias("at"))
    return Walker(own).definition_at(points).select("file", "target")


@query(f"SELECT file, 'S'||s_suppkey AS name, 0 AS depth, 1 AS ordinal FROM {_PYF} UNION ALL SELECT file, 'S'||s_suppkey||'.total', 1, CAST(2 + (SELECT count(*) FROM part WHERE p_partkey % {_N} = s_suppkey) AS INTEGER) FROM {_PYF} UNION ALL SELECT file, 'top'||s_suppkey, 0, CAST(3 + (SELECT count(*) FROM part WHERE p_partkey % {_N} = s_suppkey) AS INTEGER) FROM {_PYF}")
def outline_of_modules(spark, sf_dir):
    return Walker(_python_files(spark, sf_dir)).outline().where("file <> 'geo/base.py'").where(r"NOT name RLIKE '[.]p[0-9]+$'").select("file", "name", "depth", "ordinal")


@query(f"SELECT file, name FROM (SELECT file, unnest(['S'||s_suppkey, 'S'||s_suppkey||'.Key', 'S'||s_suppkey||'.Size', 'S'||s_suppkey||'.Total']) AS name FROM {_GOF}) WHERE starts_with(file, 'p3/')")
def listed_atoms(spark, sf_dir):
    """Exported atoms below a folder."""
    return graph.listed(_facts(_go_files(spark, sf_dir))["atom"], "p3").select("file", "name")


@query("SELECT DISTINCT 'p'||(s_suppkey % 7)||'/s'||s_suppkey||'.go' AS file FROM supplier WHERE s_suppkey % 7 <> 2 UNION SELECT DISTINCT 'p'||(s_suppkey % 7)||'/shared.go' FROM supplier WHERE s_suppkey % 7 <> 2")
def store_of_relations(spark, sf_dir):
    """A store keeps relations as sets; files are dropped from all of them."""
    t = _facts(_go_files(spark, sf_dir).where("file NOT LIKE 'p2/s_%' OR file = 'p2/shared.go'"))
    s = model.Store(spark)
    s.insert("file", t["file"])
    s.insert("file", t["file"].where("file LIKE 'p3/%'"))
    s.append("atom", t["atom"])
    s.drop_file("p2/shared.go")
    return s["file"].join(s["atom"].select("file").distinct(), "file").select("file")


@query("SELECT 'path'||n_nationkey AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'first' ELSE 'second' END AS side, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS note FROM nation")
def merged_results(spark, sf_dir):
    """The first side wins where both have a file; a column that one side lacks is null there."""
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("path"), _str("n_nationkey")).alias("file"), "n_nationkey", "n_name")
    a = n.where("n_nationkey % 2 = 0").select("file", F.lit("first").alias("side"), F.col("n_name").alias("note"))
    b = n.select("file", F.lit("second").alias("side"))
    return graph.merged_results(a, b.union(b), ["file"])


@query("SELECT r_regionkey AS region, n_nationkey AS nation, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name DESC, n_nationkey) AS INTEGER) AS place FROM nation JOIN region ON r_regionkey = n_regionkey")
def sorted_results(spark, sf_dir):
    """Rows in a total order, numbered in each region."""
    from pyspark.sql import Window

    n = read_table(spark, sf_dir, "nation")
    own = refactor.sorted_result(n.withColumn("back", F.col("n_name")), "n_regionkey", "n_name", "n_nationkey")
    order = Window.partitionBy("n_regionkey").orderBy(F.desc("n_name"), "n_nationkey")
    return own.select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.row_number().over(order).alias("place"))


@query(f"SELECT '.' AS parent, s AS path, 'folder' AS kind, CAST(row_number() OVER (ORDER BY s) AS INTEGER) AS ordinal FROM (SELECT DISTINCT source AS s FROM documents) UNION ALL SELECT source, file, 'file', CAST(row_number() OVER (PARTITION BY source ORDER BY file) AS INTEGER) FROM (SELECT *, split_part(file, '/', 1) AS source FROM {FILES})")
def scope_children(spark, sf_dir):
    return refactor.scope_children(files(spark, sf_dir).select(F.col("file").alias("path"))).select("parent", "path", "kind", "ordinal")


# --- imports -----------------------------------------------------------------


@query("SELECT 'path'||n_nationkey AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'a/b' ELSE 'c' END AS key FROM nation")
def pruned_import_sites(spark, sf_dir):
    """Of two imports the one whose name the text does not use."""
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("path"), _str("n_nationkey")).alias("file"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    body = F.when(F.col("even"), "use(c.x)\n").otherwise("use(b.y)\n")
    own = n.select("file", F.concat(F.lit('import "a/b"\nimport "c"\n'), body).alias("text"))
    site = lambda a, b, key, name: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(key).alias("key"), F.array(F.lit(name)).alias("locals"), F.lit(False).alias("keep"))
    sites = n.select("file", F.explode(F.array(site(0, 13, "a/b", "b"), site(13, 24, "c", "c"))).alias("s")).select("file", "s.*")
    gone = refactor.pruned_imports(own, sites)
    return gone.join(sites, ["file", "start", "end"]).select("file", "key")


@query("SELECT 'path'||n_nationkey AS file, 'b' AS name, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['x/y', 'z/*'] ELSE ['z/*'] END) AS key FROM nation")
def needed_imports(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("path"), _str("n_nationkey")).alias("file"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    declared = n.select("file", F.lit("b").alias("name"), F.when(F.col("even"), "call(y.z)").otherwise("yy.call()").alias("text"))
    imports = n.select("file", F.explode(F.array(F.struct(F.lit("x/y").alias("spec"), F.lit("y").alias("local"), F.lit(False).alias("star")), F.struct(F.lit("z/*").alias("spec"), F.lit("*").alias("local"), F.lit(True).alias("star")))).alias("i")).select("file", "i.*")
    return refactor.needed_imports(declared, imports)


@query("""SELECT 'path'||n_nationkey AS file, 'import "new"'||chr(10)||'new.call()'||chr(10) AS text FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'path'||n_nationkey, 'import "old"'||chr(10)||'import "new"'||chr(10)||'new.call(); old.keep()'||chr(10) FROM nation WHERE n_nationkey % 2 = 1""")
def import_hygiene(spark, sf_dir):
    """A rewrite brings the import it needs and takes the line of one that only it used."""
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("path"), _str("n_nationkey")).alias("file"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    own = n.select("file", F.concat(F.lit('import "old"\n'), F.when(F.col("even"), "old.call()\n").otherwise("old.call(); old.keep()\n")).alias("text"))
    edits = n.select("file", F.lit(13).alias("start"), F.lit(23).alias("end"), F.lit("new.call()").alias("new_text"))
    imports = n.select("file", F.lit("old").alias("spec"), F.lit("").alias("local"), F.lit(0).alias("start"), F.lit(12).alias("end"), F.lit(False).alias("star"))
    wanted = n.select("file", F.lit("new").alias("spec"), F.lit('import "new"').alias("line"))
    return spans.edited(own, refactor.with_hygiene(own, edits, imports, wanted)).select("file", "text")


_HEADS = {
    0: ('import (\n\t"a/x"\n\t// kept\n\t"z/y"\n)\n', 'import (\n\t"a/x"\n\t// kept\n\t"m/w"\n\t"z/y"\n)\n'),
    1: ('import "a/x" // why\n', 'import (\n\t"a/x" // why\n\t"m/w"\n)\n'), 2: ("", '\nimport "m/w"\n'), 3: ('import (\n\t"m/w"\n)\n', 'import (\n\t"m/w"\n)\n'), 4: ('import "z/y"\n', 'import (\n\t"m/w"\n\t"z/y"\n)\n'),
}
_GO_BODY = '\nvar s = `\nimport (\n\t"z"\n)\nimport "q"\n`\n'


def _chr(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'") + "'"


@query(f"SELECT 's'||s_suppkey||'.go' AS file, 'package p'||s_suppkey||chr(10)||CASE s_suppkey % 5 {' '.join(f'WHEN {k} THEN {_chr(new)}' for k, (_, new) in _HEADS.items())} END||{_chr(_GO_BODY)} AS text FROM supplier")
def merged_import_lines(spark, sf_dir):
    """An import more in heads of all kinds, none in what looks like imports inside a string."""
    k = F.col("s_suppkey")
    head = F.lit("")
    for j, (old, _) in _HEADS.items():
        head = F.when(k % 5 == j, old).otherwise(head)
    own = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.lit(".go")).alias("file"), F.concat(F.lit("package p"), k.cast("string"), F.lit("\n"), head, F.lit(_GO_BODY)).alias("text"))
    return refactor.merged_imports(own, own.select("file", F.lit("m/w").alias("spec"), F.lit("").alias("alias")))


@query(f"SELECT file, spec, member, base FROM (SELECT file, unnest(['geo.base', 'geo.base', 'geo.base', 'geo.s'||{_NEXT}]) AS spec, unnest(['Place', 'helper', 'Unused', '']) AS member, unnest(['geo/base.py', 'geo/base.py', 'geo/base.py', 'geo/s'||{_NEXT}||'.py']) AS base FROM {_PYF})")
def provider_python(spark, sf_dir):
    t = _facts(_python_files(spark, sf_dir))
    return providers.resolved(t["import"], t["file"])


@query("SELECT 'src/a/b/N'||n_nationkey||'.java' AS file, 'a.b.N'||((n_nationkey + 1) % 25) AS spec, 'src/a/b/N'||((n_nationkey + 1) % 25)||'.java' AS base FROM nation UNION ALL SELECT 'web/r'||r_regionkey||'.ts', './r'||((r_regionkey + 1) % 5), 'web/r'||((r_regionkey + 1) % 5)||'.ts' FROM region UNION ALL SELECT 'p'||(s_suppkey % 7)||'/s'||s_suppkey||'.go', 'mod/p'||((s_suppkey + 1) % 7), 'p'||((s_suppkey + 1) % 7)||'/'||(SELECT min(f) FROM (SELECT 's'||o.s_suppkey||'.go' AS f FROM supplier o WHERE o.s_suppkey % 7 = (supplier.s_suppkey + 1) % 7 UNION ALL SELECT 'shared.go')) FROM supplier")
def provider_other_languages(spark, sf_dir):
    n, r, s = (read_table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    imports = n.select(F.concat(F.lit("src/a/b/N"), _str("n_nationkey"), F.lit(".java")).alias("file"), F.concat(F.lit("a.b.N"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("spec"))
    imports = imports.unionByName(r.select(F.concat(F.lit("web/r"), _str("r_regionkey"), F.lit(".ts")).alias("file"), F.concat(F.lit("./r"), ((F.col("r_regionkey") + 1) % 5).cast("string")).alias("spec")))
    imports = imports.unionByName(s.select(F.concat(F.lit("p"), (F.col("s_suppkey") % 7).cast("string"), F.lit("/s"), _str("s_suppkey"), F.lit(".go")).alias("file"), F.concat(F.lit("mod/p"), ((F.col("s_suppkey") + 1) % 7).cast("string")).alias("spec")))
    every = _java_files(spark, sf_dir).unionByName(_ts_files(spark, sf_dir)).unionByName(_go_files(spark, sf_dir))
    lang = F.when(F.col("file").endswith(".java"), "java").when(F.col("file").endswith(".ts"), "typescript").otherwise("go")
    return providers.resolved(imports.withColumn("member", F.lit("")), every.select("file", lang.alias("lang")), "mod").select("file", "spec", "base")


# --- renames and moves -------------------------------------------------------


@query("SELECT 'T'||n_nationkey AS receiver, CASE WHEN n_regionkey = 0 THEN 'our' ELSE 'foreign' END AS side FROM nation WHERE n_regionkey < 3")
def method_rename_partition(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    atoms = n.where("n_regionkey < 3").select(F.concat(F.lit("path:f::*T"), _str("n_nationkey"), F.lit("[K].run")).alias("ref"), F.concat(F.lit("*T"), _str("n_nationkey"), F.lit("[K].run")).alias("name"), "n_regionkey")
    atoms = atoms.unionByName(n.where("n_regionkey = 3").select(F.concat(F.lit("path:f::stop"), _str("n_nationkey")).alias("ref"), F.concat(F.lit("U.stop"), _str("n_nationkey")).alias("name"), "n_regionkey"))
    return refactor.partitioned_rename(atoms, atoms.where("n_regionkey = 0"), "run")


@query("SELECT 'path:f'||n_nationkey||'::A.run' AS ref, 'f'||n_nationkey||' has A.go already' AS reason FROM nation WHERE n_nationkey % 3 = 0")
def rename_clashes(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    file = F.concat(F.lit("f"), _str("n_nationkey"))
    atoms = n.where("n_nationkey % 3 = 0").select(file.alias("file"), F.lit("A.go").alias("name")).union(n.select(file, F.lit("go")))
    goals = n.select(F.concat(F.lit("path:"), file, F.lit("::A.run")).alias("ref"), F.lit("go").alias("new_text"))
    return refactor.rename_clashes(goals, atoms).select("ref", "reason")


@query("""SELECT 'd/f'||n_nationkey||CASE WHEN n_nationkey % 6 = 2 THEN '_test.go' ELSE '.go' END AS file, CASE n_nationkey % 6 WHEN 0 THEN 'a member of a type can''t move alone' WHEN 1 THEN 'unexported: run' WHEN 2 THEN 'a test outside of tests: TestRun' WHEN 3 THEN 'methods stay: Run.go' WHEN 4 THEN 'still depends on Other' END AS reason FROM nation WHERE n_nationkey % 6 <> 5""")
def move_rejects(spark, sf_dir):
    """One reason after the other, and a move that nothing speaks against."""
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 6
    file = F.concat(F.lit("d/f"), _str("n_nationkey"), F.when(k == 2, "_test.go").otherwise(".go"))
    name = F.when(k == 0, "A.run").when(k == 1, "run").when(k == 2, "TestRun").when(k == 3, "Run").when(k == 4, "Dep").otherwise("Free")
    m = n.select("n_nationkey", k.alias("k"), file.alias("file"), name.alias("name"), F.lit(10).alias("start"), F.lit(50).alias("end"), F.concat(F.lit("e"), _str("n_nationkey"), F.lit("/to.go")).alias("to"))
    atoms = m.select("file", "name", F.lit(11).alias("start"), F.lit(14).alias("end"))
    atoms = atoms.union(m.where("k = 3").select("file", F.lit("Run.go"), F.lit(60), F.lit(62))).union(m.where("k = 4").select("file", F.lit("Other"), F.lit(70), F.lit(75)))
    binds = m.where("k = 4").select("file", F.lit(20).alias("start"), F.lit(25).alias("end"), F.concat(F.lit("path:"), "file", F.lit("::Other")).alias("target_ref"))
    facts = m.select("file", F.lit(True).alias("package_scoped"))
    aliases = m.limit(0).select(F.lit("").alias("ref"), F.lit("").alias("target"))
    return refactor.move_rejects(m.select("file", "name", "start", "end", "to"), atoms, binds, facts, aliases).select("file", "reason")


@query("SELECT 'd/f'||n_nationkey||'.py' AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'a circle of imports through other' ELSE 'a circle of imports: the new file imports the old one' END AS reason FROM nation WHERE n_nationkey % 4 < 2")
def move_circles(spark, sf_dir):
    """Moves after which old and new file would import each other."""
    n = read_table(spark, sf_dir, "nation")
    k = F.col("n_nationkey") % 4
    m = n.select(k.alias("k"), F.concat(F.lit("d/f"), _str("n_nationkey"), F.lit(".py")).alias("file"), F.lit("run").alias("name"), F.lit(10).alias("start"), F.lit(50).alias("end"), F.concat(F.lit("e/t"), _str("n_nationkey"), F.lit(".py")).alias("to"))
    own = F.concat(F.lit("path:"), "file", F.lit("::run"))
    other = F.concat(F.lit("path:"), "file", F.lit("::other"))
    atoms = m.select("file", "name", F.lit(11).alias("start"), F.lit(14).alias("end")).union(m.select("file", F.lit("other"), F.lit(80), F.lit(85)))
    binds = m.where("k < 2").select("file", F.lit(60).alias("start"), F.lit(63).alias("end"), own.alias("target_ref")).union(m.where("k = 0").select("file", F.lit(20), F.lit(25), other))
    aliases = m.where("k % 2 = 1").select(F.concat(F.lit("path:"), "to").alias("ref"), F.concat(F.lit("path:"), "file").alias("target"))
    return refactor.move_rejects(m.select("file", "name", "start", "end", "to"), atoms, binds, m.select("file", F.lit(False).alias("package_scoped")), aliases).select("file", "reason")


@query(f"SELECT file, 'top'||s_suppkey AS name, 'def top'||s_suppkey||'():'||chr(10)||'    return S'||s_suppkey||chr(10) AS text FROM {_PYF} UNION ALL SELECT file, 'S'||s_suppkey||'.total', 'def total(self, q):'||chr(10)||'    if q:'||chr(10)||'        return h(other.S'||{_NEXT}||')'||chr(10)||'    elif self:'||chr(10)||'        return Place'||chr(10)||'    return top'||s_suppkey||chr(10) FROM {_PYF}")
def declaration_texts(spark, sf_dir):
    """Whole declarations, as they are moved: without the blanks that they stand behind."""
    own = _python_files(spark, sf_dir).where("file <> 'geo/base.py'")
    t = _facts(own)
    atoms = t["atom"].where(r"name LIKE 'top%' OR name LIKE '%.total'")
    return refactor.declarations(atoms, t["scope"], own).select("file", "name", "text")


@query(f"SELECT 'geo/moved.py' AS file, CAST({_N} AS INTEGER) AS declared, CAST({_N} AS INTEGER) AS qualified UNION ALL SELECT file, 0, 0 FROM {_PYF}")
def moved_declarations(spark, sf_dir):
    """The top function of each module moves to one file; the class that it leaves is named through the module."""
    own = _python_files(spark, sf_dir).where("file <> 'geo/base.py'").unionByName(spark.createDataFrame([("geo/moved.py", "")], "file string, text string"))
    t = _facts(own)
    atoms = t["atom"].where("name LIKE 'top%'")
    declared = staged(refactor.declarations(atoms, t["scope"], own))
    moves = declared.select("file", "name", F.lit("geo/moved.py").alias("to"))
    names = declared.select("file", "name", F.regexp_replace("name", "^top", "S").alias("left"))
    stem = declared.select("file", F.regexp_extract("file", r"([^/]*)\.py$", 1).alias("qualifier"))
    edits = refactor.moved_declarations(moves, declared, own, names, stem)
    new = spans.edited(own, edits)
    count = lambda regex: F.size(F.split("text", regex)) - 1
    return new.select("file", count(r"def top[0-9]").alias("declared"), count(r"return s[0-9]+\.S[0-9]").alias("qualified"))


@query("""SELECT 'pkg'||k||'/package.json' AS file, CAST(10 AS INTEGER) AS start, CAST(20 + strlen(k) AS INTEGER) AS "end", './src/new'||k||'.js' AS new_text FROM (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 3 AS r FROM supplier) WHERE r = 0
  UNION ALL SELECT 'pkg'||k||'/package.json', CAST(29 + strlen(k) AS INTEGER), CAST(39 + strlen(k) AS INTEGER), 'types/deep/t.d.ts' FROM (SELECT CAST(s_suppkey AS VARCHAR) AS k, s_suppkey % 3 AS r FROM supplier) WHERE r < 2""")
def manifest_edits(spark, sf_dir):
    """One table of many moves, of files and of folders, and all manifests at once; names that are no paths stay."""
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("pkg"), _str("s_suppkey")).alias("p"), _str("s_suppkey").alias("k"))
    own = s.select(F.concat("p", F.lit("/package.json")).alias("file"), F.concat(F.lit('{"main": "./lib/x'), "k", F.lit('.js", "t": "lib/t.d.ts", "name": "lib"}')).alias("text"))
    moves = s.where("s_suppkey % 3 = 0").select(F.concat("p", F.lit("/lib/x"), "k", F.lit(".js")).alias("old"), F.concat("p", F.lit("/src/new"), "k", F.lit(".js")).alias("new"))
    folders = s.where("s_suppkey % 3 < 2").select(F.concat("p", F.lit("/lib/t.d.ts")).alias("old"), F.concat("p", F.lit("/types/deep/t.d.ts")).alias("new"))
    return refactor.manifest_edits(own, moves.union(folders))


@query("SELECT 'f'||n_nationkey AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'package p'||chr(10)||'import \"a\"'||chr(10)||'import \"b\"'||chr(10)||'body'||chr(10) ELSE 'package p'||chr(10)||'import \"b\"'||chr(10)||'body'||chr(10) END AS text FROM nation")
def layout_edits(spark, sf_dir):
    """A new import line behind the last import, or where imports would begin."""
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), _str("n_nationkey")).alias("file"), (F.col("n_nationkey") % 2 == 0).alias("even"))
    own = n.select("file", F.concat(F.lit("package p\n"), F.when(F.col("even"), 'import "a"\n').otherwise(""), F.lit("body\n")).alias("text"))
    packages = n.select("file", F.lit("p").alias("name"), F.lit(9).alias("end"))
    imports = n.where("even").select("file", F.lit(20).alias("end"))
    units = n.select("file", F.lit("import").alias("section"), F.lit('import "b"\n').alias("unit"))
    return spans.edited(own, refactor.layout_edits(own, packages, imports, units))


@query("SELECT 'new/f'||n_nationkey AS file, 'b'||chr(10) AS text FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey < 3")
def applied_plan(spark, sf_dir):
    """Edits, then moves; files that an edit empties are gone."""
    n = read_table(spark, sf_dir, "nation").where("n_regionkey < 3").select("n_nationkey", F.concat(F.lit("old/f"), _str("n_nationkey")).alias("file"))
    own = n.select("file", F.lit("a\n").alias("text"))
    even = F.col("n_nationkey") % 2 == 0
    edits = n.select("file", F.lit(0).alias("start"), F.when(even, 1).otherwise(2).alias("end"), F.when(even, "b").otherwise("").alias("new_text"))
    moves = n.select("file", F.regexp_replace("file", "^old", "new").alias("to"))
    return refactor.applied_plan(own, edits, moves)


@query(f"""WITH RECURSIVE o AS (SELECT file, idx, s, e, flag, row_number() OVER (PARTITION BY file ORDER BY idx, s, e) AS k FROM {IV}),
  t AS (SELECT file, list([s, e]) AS taken FROM o WHERE flag = 'R' GROUP BY file),
  r AS (SELECT DISTINCT o.file, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS idx, coalesce(t.taken, []) AS taken, false AS ok FROM o LEFT JOIN t ON t.file = o.file
  UNION ALL SELECT o.file, o.k, CAST(o.idx AS BIGINT), CASE WHEN o.flag <> 'R' AND len(list_filter(r.taken, lambda x: x[1] < o.e AND o.s < x[2])) = 0 THEN list_append(r.taken, [o.s, o.e]) ELSE r.taken END, o.flag <> 'R' AND len(list_filter(r.taken, lambda x: x[1] < o.e AND o.s < x[2])) = 0 FROM r JOIN o ON o.file = r.file AND o.k = r.k + 1)
  SELECT file, CAST(idx AS INTEGER) AS seq FROM r WHERE ok""")
def edits_off_occupied_spans(spark, sf_dir):
    """Edits in order, each where nothing is taken yet: returned lines of an order are taken from the start, and every edit takes its own span."""
    own = intervals(spark, sf_dir)
    edits = own.where("flag <> 'R'").select("file", F.col("idx").alias("seq"), "start", "end", F.lit("x").alias("new_text"))
    done = refactor.unoccupied(edits, own.where("flag = 'R'").select("file", "start", "end"))
    return done.select("file", F.col("seq").cast("int").alias("seq"))


@query(f"SELECT file, CAST(start + 7 AS INTEGER) AS start, CAST(\"end\" + 7 AS INTEGER) AS \"end\" FROM {SPANS} WHERE text = 'the'")
def shifted_matches(spark, sf_dir):
    own = rules.search(turns(spark, sf_dir).select("file", "text"), '"the"', regex=tape.WORDS)
    return spans.shifted(own, 7).select("file", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))


@query("SELECT doc_id AS file, CAST(strlen(text) AS INTEGER) AS start, CAST(strlen(text) AS INTEGER) AS \"end\", '!' AS new_text FROM documents WHERE doc_id % 2 = 0")
def smallest_edits(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    new = d.withColumn("text", F.when(F.col("file").cast("long") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return spans.diffed(d, new).select(F.col("file").cast("bigint").alias("file"), "start", "end", "new_text")


@query("SELECT 'f'||n_nationkey AS file, CASE WHEN n_nationkey % 3 = 1 THEN 5 ELSE 0 END AS start, CASE WHEN n_nationkey % 3 = 1 THEN chr(10)||'import y' ELSE 'import y'||chr(10) END AS new_text FROM nation WHERE n_nationkey % 3 > 0")
def ensured_imports(spark, sf_dir):
    """Behind the last import, or at the start where there is none; a file that has the import gets no edit."""
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), _str("n_nationkey")).alias("file"), (F.col("n_nationkey") % 3).alias("k"))
    imports = n.where("k < 2").select("file", F.when(F.col("k") == 0, "y").otherwise("x").alias("spec"), F.lit(5).alias("end"))
    wanted = n.select("file", F.lit("y").alias("spec"), F.lit("import y").alias("line"))
    return graph.ensured_import(n.select("file"), imports, wanted).select("file", "start", "new_text")


# --- graph operators on their own --------------------------------------------


@query("SELECT 'f'||o_custkey AS file, 'n'||(o_orderkey % 10) AS local, CASE WHEN o_orderkey % 10 < 5 THEN 'path:b'||(o_custkey % 7)||'::T.n'||(o_orderkey % 10) ELSE 'path:b'||(o_custkey % 7)||'::n'||(o_orderkey % 10) END AS target FROM orders")
def import_targets(spark, sf_dir):
    """An atom of that name, else one with that leaf, else the name as it stands."""
    o = read_table(spark, sf_dir, "orders")
    file, base, name = F.concat(F.lit("f"), _str("o_custkey")), F.concat(F.lit("b"), (F.col("o_custkey") % 7).cast("string")), F.concat(F.lit("n"), (F.col("o_orderkey") % 10).cast("string"))
    imports = o.select(file.alias("file"), name.alias("local"), F.concat(F.lit("./"), base).alias("spec"), name.alias("member"), F.col("o_orderkey").alias("start"), F.lit(False).alias("star"), F.lit(False).alias("has_alias"))
    specs = imports.select("file", "spec", F.substring("spec", 3, 10).alias("base")).distinct()
    atoms = spark.range(70).select(F.concat(F.lit("b"), (F.col("id") % 7).cast("string")).alias("file"), F.concat(F.when(F.col("id") / 7 < 5, "T.").otherwise(""), F.lit("n"), F.floor(F.col("id") / 7).cast("string")).alias("name"))
    return graph.import_targets(imports, specs, atoms).select("file", "local", "target")


@query("SELECT 'f'||s_suppkey AS file, 'n'||g AS name, CASE WHEN g < 5 THEN 'path:b1::n'||g ELSE 'path:b0::n'||g END AS target FROM supplier, generate_series(0, 9) t(g)")
def star_targets(spark, sf_dir):
    """The last star import that has a name wins; private names stay private."""
    s = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), _str("s_suppkey")).alias("file"))
    stars = s.select("file", F.explode(F.array(F.struct(F.lit("b0").alias("base"), F.lit(0).alias("seq")), F.struct(F.lit("b1").alias("base"), F.lit(1).alias("seq")))).alias("x")).select("file", "x.*")
    atoms = spark.range(10).select(F.lit("b0").alias("file"), F.concat(F.lit("n"), _str("id")).alias("name")).union(spark.range(5).select(F.lit("b1"), F.concat(F.lit("n"), _str("id")))).union(spark.range(1).select(F.lit("b1"), F.lit("_p")))
    return graph.star_targets(stars, atoms)


@query("SELECT o_custkey AS file, o_orderkey AS use_id, CAST(unnest(CASE WHEN c_custkey IS NULL THEN [0] ELSE [0, 1, 2] END) AS INTEGER) AS idx, unnest(CASE WHEN c_custkey IS NULL THEN ['c'||o_custkey] ELSE ['c'||o_custkey, 'n'||c_nationkey, 'r'||n_regionkey] END) AS ref FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def dotted_chains(spark, sf_dir):
    """customer.nation.region, segment by segment."""
    t = lambda n: read_table(spark, sf_dir, n)
    o = t("orders")
    uses = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("use_id"), F.concat(F.lit("c"), _str("o_custkey")).alias("ref"))
    seg = uses.select("file", "use_id", F.posexplode(F.array(F.lit("nation"), F.lit("region"), F.lit("gone"))).alias("idx", "name")).withColumn("idx", F.col("idx") + 1)
    members = t("customer").select(F.concat(F.lit("c"), _str("c_custkey")).alias("ref"), F.lit("nation").alias("name"), F.concat(F.lit("n"), _str("c_nationkey")).alias("target"))
    members = members.union(t("nation").select(F.concat(F.lit("n"), _str("n_nationkey")), F.lit("region"), F.concat(F.lit("r"), _str("n_regionkey"))))
    return graph.chained(uses, seg, members)


@query(f"SELECT p.file, p.idx, arg_min(b.idx, [b.e - b.s, b.idx]) AS hit FROM {IV} p LEFT JOIN {IV} b ON b.file = p.file AND b.s <= p.s AND p.s < b.e GROUP BY p.file, p.idx, p.s, p.e")
def tightest_hit_at_byte(spark, sf_dir):
    own = intervals(spark, sf_dir)
    hits = graph.tightest(own.select("file", "start", "end", "idx"), own.select("file", F.col("start").alias("at")).distinct())
    return own.select("file", "idx", F.col("start").alias("at"), "end").distinct().join(hits, ["file", "at"], "left").select("file", "idx", F.col("cover").alias("hit"))


@query(f"SELECT file, idx FROM {IV} a WHERE flag = 'N' AND NOT EXISTS (SELECT 1 FROM {IV} b WHERE b.flag = 'R' AND b.file = a.file AND b.s <= a.s AND a.e <= b.e)")
def uses_outside_imports(spark, sf_dir):
    own = intervals(spark, sf_dir)
    return graph.outside(own.where("flag = 'N'"), own.where("flag = 'R'")).select("file", "idx")


@query(f"SELECT file, s AS start, arg_max(idx, [CASE flag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, idx]) AS idx FROM {IV} GROUP BY file, s, e")
def best_atom_per_span(spark, sf_dir):
    """Of atoms with one span the most qualified, then the longest name: flags are dots, numbers digits."""
    own = intervals(spark, sf_dir)
    dots = F.when(F.col("flag") == "A", 0).when(F.col("flag") == "N", 1).otherwise(2)
    name = F.concat(F.repeat(F.lit("."), dots), F.repeat(F.lit("x"), F.col("idx")))
    return graph.best_atom(own.withColumn("name", name)).select("file", "start", "idx")


@query("SELECT 'f'||s_suppkey AS file, 25 AS start, CASE WHEN s_suppkey % 2 = 0 THEN 'inner' ELSE 'outer' END AS ref FROM supplier")
def shadowed_names(spark, sf_dir):
    """The innermost declaration that is visible at a point."""
    s = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), _str("s_suppkey")).alias("file"), (F.col("s_suppkey") % 2 == 0).alias("even"))
    scope = lambda i, p, a, b: F.struct(F.lit(i).alias("idx"), F.lit(p).alias("parent"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    scopes = s.select("file", F.explode(F.array(scope(0, -1, 0, 100), scope(1, 0, 10, 50), scope(2, 1, 20, 30))).alias("s")).select("file", "s.*")
    declares = s.select("file", F.lit(0).alias("scope_idx"), F.lit("x").alias("leaf"), F.lit("outer").alias("ref")).union(s.where("even").select("file", F.lit(1), F.lit("x"), F.lit("inner")))
    points = s.select("file", F.lit(25).alias("start"), F.lit(26).alias("end"), F.lit("x").alias("leaf"))
    return graph.shadowed(scopes, declares, points).select("file", "start", "ref")


@query("SELECT 'f'||s_suppkey AS file, unnest([-1, -1, 1]) AS scope_idx, unnest(['a', 'b', 'c']) AS leaf FROM supplier")
def declared_scopes(spark, sf_dir):
    """A hole passes the names declared in it on to what is around."""
    s = read_table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), _str("s_suppkey")).alias("file"))
    scopes = s.select("file", F.explode(F.array(F.struct(F.lit(0).alias("idx"), F.lit(-1).alias("parent"), F.lit(True).alias("hole")), F.struct(F.lit(1).alias("idx"), F.lit(0).alias("parent"), F.lit(False).alias("hole")))).alias("s")).select("file", "s.*")
    atoms = s.select("file", F.explode(F.array(F.struct(F.lit("a").alias("name"), F.lit(-1).alias("scope_idx")), F.struct(F.lit("T.b").alias("name"), F.lit(0).alias("scope_idx")), F.struct(F.lit("c").alias("name"), F.lit(1).alias("scope_idx")))).alias("a")).select("file", "a.*")
    return graph.declared_in(scopes, atoms).select("file", "scope_idx", "leaf")


@query("SELECT o_custkey AS file, 'flowchart TD'||chr(10)||'  '||string_agg('n'||o_orderkey||'_'||o_orderstatus, ' --> ' ORDER BY o_orderkey) AS diagram FROM orders GROUP BY o_custkey")
def flow_diagrams(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.lit(0).alias("idx"), F.col("o_orderkey").alias("start"), F.col("o_orderstatus").alias("class"))
    return graph.flow_diagram(o).select("file", "diagram")


@query("SELECT 'h' AS file, CAST(9 * r_regionkey AS INTEGER) AS start, '' AS new_text FROM region UNION ALL SELECT 'd', CAST(r_regionkey AS INTEGER), 'moved' FROM region UNION ALL SELECT 'c'||n_nationkey, 3, './d' FROM nation WHERE n_nationkey <> 4")
def move_edits(spark, sf_dir):
    r, n = read_table(spark, sf_dir, "region"), read_table(spark, sf_dir, "nation")
    holes = r.select(F.lit("h").alias("file"), (F.col("r_regionkey") * 9).cast("int").alias("start"), (F.col("r_regionkey") * 9 + 5).cast("int").alias("end"))
    places = r.select(F.lit("d").alias("file"), F.col("r_regionkey").cast("int").alias("start"), F.col("r_regionkey").cast("int").alias("end"), F.lit("moved").alias("text"))
    alias = n.select(F.concat(F.lit("path:c"), _str("n_nationkey")).alias("ref"), F.lit(1).alias("start"), F.lit(9).alias("end"), F.lit("path:a").alias("target"), F.lit("./a").alias("spec"), F.lit(3).alias("pstart"), F.lit(8).alias("pend"))
    specs = n.select(F.concat(F.lit("c"), _str("n_nationkey")).alias("file"), F.lit("./a").alias("spec"), F.lit("./d").alias("new_spec"))
    return graph.move_edits(holes, places, alias, specs, spark.createDataFrame([("c4",)], "file string")).select("file", "start", "new_text")


@query(f"WITH f AS (SELECT file, doc_id, split_part(file, '/', 1) AS source, lang FROM {FILES}) SELECT file FROM f WHERE doc_id % 50 = 0 UNION SELECT b.file FROM f a JOIN f b ON b.source = a.source AND b.lang = a.lang AND b.doc_id = a.doc_id + 20 WHERE a.doc_id % 50 = 0")
def one_hop_files(spark, sf_dir):
    """Loaded files and the targets of their imports."""
    f = files(spark, sf_dir)
    imports = f.select("file", F.concat(F.lit("./"), (F.col("doc_id") + 20).cast("string"), F.lit("."), "lang").alias("spec"))
    return graph.one_hop(f.where("doc_id % 50 = 0").select("file"), graph.resolved_specs(imports, f), f)


# --- host relations ----------------------------------------------------------


def _program(head: str, args: tuple[str, ...], *body, tables: dict[str, DataFrame]) -> DataFrame:
    a = relations.atom
    program = relations.Program(relations.clause(a(head, *args), *body), builtins=relations.PLAIN)
    return program.evaluate(tables)[head]


@query("SELECT n_nationkey AS n, CAST(n_nationkey - 1 AS BIGINT) AS before, 'path:f'||n_nationkey AS file_ref, 'path:f'||n_nationkey||'::x' AS atom_ref, 'f'||n_nationkey||'.x' AS joined FROM nation WHERE n_nationkey > 0")
def datalog_builtins_of_names(spark, sf_dir):
    a = relations.atom
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("f"), _str("n_nationkey")).alias("f"))
    out = _program("out", ("?n", "?p", "?r", "?x", "?j"), a("n", "?n", "?f"), a("$gt0", "?n"), a("$pred", "?n", "?p"), a("$ge0", "?p"), a("$file_ref", "?f", "?r"), a("$atom_ref", "?f", "x", "?x"), a("$concat", "?f", ".", "x", "?j"), a("$leaf_eq", "?j", "a.b.x"), a("$neq", "?f", "f99"), a("$not_private", "?f"), tables={"n": n})
    return out.toDF("n", "before", "file_ref", "atom_ref", "joined")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n, CASE WHEN n_regionkey = 0 THEN 'b' ELSE 'l' END AS name, CASE WHEN n_regionkey < 2 THEN 5 ELSE 1 END AS start, CASE WHEN n_regionkey < 2 THEN 9 ELSE 2 END AS \"end\", CASE WHEN n_regionkey = 2 THEN 3 ELSE 7 END AS picked FROM nation WHERE n_regionkey < 4")
def datalog_builtins_of_imports(spark, sf_dir):
    """Names and spans of imports: the alias or the path's last part; the whole span or the path's; the target's span unless it is empty."""
    a = relations.atom
    r = F.col("n_regionkey")
    i = read_table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("n"), F.when(r == 0, "").otherwise("l").alias("local"), F.lit("'a/b'").alias("spec"),
        F.when(r < 2, 5).otherwise(0).alias("s"), F.when(r < 2, 9).otherwise(0).alias("e"), F.lit(1).alias("ps"), F.when(r < 4, 2).otherwise(1).alias("pe"), F.when(r == 2, 0).otherwise(7).alias("ts"), F.when(r == 2, 0).otherwise(9).alias("te"),
    )
    out = _program("out", ("?n", "?name", "?a", "?b", "?p"), a("i", "?n", "?l", "?spec", "?s", "?e", "?ps", "?pe", "?ts", "?te"), a("$import_name", "?l", "?spec", "?name"), a("$is_named", "?name"), a("$import_span", "?s", "?e", "?ps", "?pe", "?a", "?b"), a("$span_ok", "?a", "?b"), a("$pick_span", 3, 4, "?ts", "?te", "?p", "?q"), tables={"i": i})
    return out.toDF("n", "name", "start", "end", "picked")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n, CASE n_regionkey WHEN 0 THEN 'e' WHEN 1 THEN 's' ELSE 'e' END AS export, CASE n_regionkey WHEN 0 THEN 'e' ELSE 's' END AS source, CASE WHEN n_regionkey = 0 THEN 'path:b::e' ELSE 'path:b::s' END AS target, 'f'||n_nationkey AS file FROM nation")
def datalog_builtins_of_reexports(spark, sf_dir):
    a = relations.atom
    r = F.col("n_regionkey")
    i = read_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.when(r == 1, "").otherwise("e").alias("e"), F.when(r == 0, "").otherwise("s").alias("s"), F.concat(F.lit("path:f"), _str("n_nationkey")).alias("ref"))
    out = _program("out", ("?n", "?x", "?y", "?t", "?f"), a("i", "?n", "?e", "?s", "?ref"), a("$reexport_names", "?e", "?s", "?x", "?y"), a("$reexport_target", "b", "?y", "?t"), a("$path_file", "?ref", "?f"), a("$ref_file", "?ref", "?f"), tables={"i": i})
    return out.toDF("n", "export", "source", "target", "file")


@query("SELECT 'f'||n_nationkey AS file, 0 AS start, 5 AS \"end\", '' AS new_text FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'f'||n_nationkey, 3, 8, './new'||n_nationkey FROM nation WHERE n_regionkey IN (1, 2)")
def datalog_move(spark, sf_dir):
    """A move as clauses: holes are cut, specs that change are rewritten outside of the moved files."""
    a, c = relations.atom, relations.clause
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("f"), _str("n_nationkey")).alias("file"), "n_regionkey", _str("n_nationkey").alias("k"))
    holes = n.where("n_regionkey = 0").select("file", F.lit(0).alias("start"), F.lit(5).alias("end"))
    rewrites = n.select("file", F.lit("./old").alias("spec"), F.when(F.col("n_regionkey") == 4, "./old").otherwise(F.concat(F.lit("./new"), "k")).alias("new_spec"))
    alias = n.select("file", F.lit("./old").alias("spec"), F.lit(3).alias("pstart"), F.lit(8).alias("pend"))
    host = relations.host_tables(holes=holes, rewrites=rewrites, moved=n.where("n_regionkey IN (0, 3)").select("file"))
    program = relations.Program(
        c(a("edit", "?f", "?s", "?e", ""), a("$move_hole", "?f", "?s", "?e")),
        c(a("edit", "?f", "?s", "?e", "?new"), a("alias", "?f", "?spec", "?s", "?e"), a("$rewrite_spec", "?f", "?spec", "?new"), a("$move_file", "?f", negated=True), a("$span_ok", "?s", "?e")),
        builtins=relations.PLAIN,
    )
    return program.evaluate(host | {"alias": alias})["edit"].toDF("file", "start", "end", "new_text")


@query("SELECT 'f'||s_suppkey AS file, 'path:b'||(s_suppkey % 7)||'::x' AS target, 'f'||((s_suppkey + 1) % (SELECT count(*) FROM supplier)) AS peer FROM supplier")
def datalog_host_tables(spark, sf_dir):
    """Host relations that tables answer: resolved specs, members, peers, sources, visible names."""
    a = relations.atom
    s = read_table(spark, sf_dir, "supplier")
    n = s.count()
    own = s.select(F.concat(F.lit("f"), _str("s_suppkey")).alias("file"), F.concat(F.lit("b"), (F.col("s_suppkey") % 7).cast("string")).alias("base"), F.concat(F.lit("f"), ((F.col("s_suppkey") + 1) % n).cast("string")).alias("peer"))
    host = relations.host_tables(
        specs=own.select(F.lit("./b").alias("spec"), "file", "base"), peers=own.select("file", "peer"), imported=own.select("base", F.lit("x").alias("member"), F.concat(F.lit("path:"), "base", F.lit("::x")).alias("ref")),
        visible=own.select("file", F.lit(0).alias("scope_idx"), F.lit("x").alias("leaf"), F.lit("seen").alias("ref")), members=own.select(F.lit("seen").alias("ref"), F.lit("y").alias("name"), F.lit("hopped").alias("target")).distinct(),
        sources=own.select("file", F.lit("").alias("scope"), F.concat(F.lit("path:"), "file").alias("ref")), renames=spark.createDataFrame([("hopped", "new")], "ref string, new_text string"),
    )
    out = _program("out", ("?f", "?t", "?p"), a("file", "?f"), a("$mod_resolve", "./b", "?f", "?base"), a("$import_member", "?base", "x", "?t"), a("$pkg_peer", "?f", "?p"), a("$visible_at", "?f", 0, "x", "?r"), a("$hop", "?r", "y", "?h"), a("$rename_leaf", "?h", "?new"), a("$use_from", "?f", "", "?from"), tables=host | {"file": own.select("file")})
    return out.toDF("file", "target", "peer")


@query(f"SELECT file, CAST(start AS INTEGER) AS start, 'articles' AS rule_id FROM {SPANS} WHERE text = 'the'")
def datalog_rule_sites(spark, sf_dir):
    """Matches of a rule's pattern as a relation that clauses read."""
    a, c = relations.atom, relations.clause
    found = rules.search(turns(spark, sf_dir).select("file", "text"), '"the"', regex=tape.WORDS)
    host = relations.host_tables(sites=found.select(F.lit(0).alias("rule"), "file", "start", "end"))
    program = relations.Program(c(a("finding", "?f", "?s", "articles"), a("$rule", 0, "?f", "?s", "?e"), a("$span_ok", "?s", "?e")), builtins=relations.PLAIN)
    return program.evaluate(host)["finding"].toDF("file", "start", "rule_id")


@query("SELECT user_id AS file, count(*) AS n FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE event_type = 'view' AND b = 'click' GROUP BY user_id")
def datalog_pack_rows(spark, sf_dir):
    """What a pack's matcher finds, its captures as columns, in the body of a clause."""
    a, c = relations.atom, relations.clause
    rows = rules.captured(event_files(spark, sf_dir), '(seq (capture a "view") (capture b "click"))', ["a", "b"], regex=tape.WORDS)
    program = relations.Program(c(a("pair", "?f", "?s"), a("$as", "?f", "?s", "?e", "view", "click")), builtins=relations.PLAIN)
    out = program.evaluate({"$as": rows.select("file", "start", "end", "a", "b")})["pair"].toDF("file", "start")
    return out.groupBy(F.col("file").cast("bigint").alias("file")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file, size FROM {FILES} WHERE size <= 3000 OR file = (SELECT min(file) FROM {FILES})")
def guarded_and_named(spark, sf_dir):
    """Small files, and one that is named whatever its size."""
    f = files(spark, sf_dir)
    name = f.agg(F.min("file")).first()[0]
    big = f.withColumn("size", F.when(F.col("size") <= 3000, F.col("size")).otherwise(F.col("size") + sources.LARGE))
    return sources.guarded(big, (name,)).join(f.select("file", F.col("size").alias("own")), "file").select("file", F.col("own").cast("int").alias("size"))
