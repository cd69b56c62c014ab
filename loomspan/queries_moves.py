"""Queries on moves of many files and folders at once: paths, import paths, whole texts after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import extract, neighbourhood, qualify, refactor, reimport
from .plans import builds
from .registry import query
from .storage import read_table, staged

# --- trees whose imports and moves follow from keys ---------------------------

_N = "(SELECT count(*) FROM supplier)"


def _keyed(spark, sf_dir) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    n = s.count()
    return s.select(F.col("s_suppkey").alias("k"), *(((F.col("s_suppkey") + d) % n).alias(c) for c, d in (("a", 1), ("b", 2), ("c", 5))))


def _python_tree(spark, sf_dir) -> DataFrame:
    """Modules in five folders; each imports one by its whole name, one from beside or another folder by dots, one with an alias, and one from outside."""
    at = lambda c: F.concat(F.lit("d"), (F.col(c) % 5).cast("string"), F.lit("."), F.lit("s"), F.col(c).cast("string"))
    beside = F.when(F.col("c") % 5 == F.col("k") % 5, F.concat(F.lit(".s"), F.col("c").cast("string"))).otherwise(F.concat(F.lit(".."), at("c")))
    text = F.concat(F.lit("import old."), at("a"), F.lit(" as a\nfrom "), beside, F.lit(" import T\nfrom .."), at("b"), F.lit(" import U as u\nimport os\n\nx = 'old.d1.s1'\n"))
    file = F.concat(F.lit("old/"), F.replace(at("k"), F.lit("."), F.lit("/")), F.lit(".py"))
    return _keyed(spark, sf_dir).select("k", file.alias("file"), text.alias("text"))


def _python_moves(tree: DataFrame) -> DataFrame:
    """Two folders move, one of them deeper below its parent, and every seventh file by itself."""
    k = F.col("k")
    own = tree.where(k % 7 == 0).select(F.col("file").alias("old"), F.concat(F.lit("top/t"), k.cast("string"), F.lit(".py")).alias("new"))
    return own.union(tree.sparkSession.createDataFrame([("old/d1", "new/e1"), ("old/d3", "old/deep/d3")], "old string, new string"))


def _after(tree: DataFrame, moves: DataFrame, root: str = "") -> DataFrame:
    """file, text once all is moved and all imports are rewritten."""
    own = tree.select("file", "text")
    imports = extract.relations(staged(extract.extracted(own)))["import"]
    edits = reimport.import_edits(reimport.marked(imports, own), own, moves, root)
    to = reimport.moved_paths(own.select(F.col("file").alias("path")), moves).select(F.col("path").alias("file"), "to")
    return refactor.applied_plan(own, edits, to)


_PY = "CASE WHEN k % 7 = 0 THEN 'top/t'||k WHEN k % 5 = 1 THEN 'new/e1/s'||k WHEN k % 5 = 3 THEN 'old/deep/d3/s'||k ELSE 'old/d'||(k % 5)||'/s'||k END"
_TS = "CASE WHEN k % 6 = 0 THEN 'lib/u'||k WHEN k % 4 = 3 THEN 'web/x/y/d3/s'||k ELSE 'web/d'||(k % 4)||'/s'||k END"


def _common(d: str, t: str) -> str:
    """SQL for how many leading folders two lists share."""
    return f"coalesce(list_sum(list_transform(range(1, least(len({d}), len({t}) - 1) + 1), lambda i: CASE WHEN {d}[1:i] = {t}[1:i] THEN 1 ELSE 0 END)), 0)"


def _placed(new: str) -> str:
    """SQL tables: t (k, its new path without ending, the folders of it) and s (k and its neighbours)."""
    return f"""t AS (SELECT k, p, string_split(p, '/') AS l FROM (SELECT k, {new} AS p FROM (SELECT s_suppkey AS k FROM supplier))),
  s AS (SELECT k, p, l[:-2] AS d, (k + 1) % {_N} AS a, (k + 2) % {_N} AS b, (k + 5) % {_N} AS c FROM t)"""


def _dots(d: str, t: str) -> str:
    return f"repeat('.', CAST(len({d}) - {_common(d, t)} + 1 AS INTEGER))||array_to_string({t}[CAST({_common(d, t)} + 1 AS INTEGER):], '.')"


def _slashes(d: str, t: str) -> str:
    return f"CASE WHEN len({d}) = {_common(d, t)} THEN './' ELSE repeat('../', CAST(len({d}) - {_common(d, t)} AS INTEGER)) END||array_to_string({t}[CAST({_common(d, t)} + 1 AS INTEGER):], '/')"


@query(f"SELECT 'old/d'||(s_suppkey % 5)||'/s'||s_suppkey||'.py' AS path, {_PY.replace('k ', 's_suppkey ').replace('||k', '||s_suppkey')}||'.py' AS \"to\" FROM supplier")
def moved_paths(spark, sf_dir):
    """Where each file is after all moves: the longest old path that holds it decides."""
    tree = _python_tree(spark, sf_dir)
    return reimport.moved_paths(tree.select(F.col("file").alias("path")), _python_moves(tree))


@query(f"""WITH {_placed(_PY)} SELECT s.p||'.py' AS file, 'import '||replace(x.p, '/', '.')||' as a'||chr(10)||'from '||{_dots('s.d', 'z.l')}||' import T'||chr(10)||'from '||{_dots('s.d', 'y.l')}||' import U as u'||chr(10)||'import os'||chr(10)||chr(10)||'x = ''old.d1.s1'''||chr(10) AS text
  FROM s JOIN t x ON x.k = s.a JOIN t y ON y.k = s.b JOIN t z ON z.k = s.c""")
def python_imports_after_moves(spark, sf_dir):
    """Whole and dotted import paths after many moves; strings and other modules stay."""
    tree = _python_tree(spark, sf_dir)
    return _after(tree, _python_moves(tree))


def _ts_tree(spark, sf_dir) -> DataFrame:
    """Files in four folders with an index each: imports by relative path, every second with its ending, and of a folder by its index."""
    k = F.col("k")
    at = lambda c: F.concat(F.lit("../d"), (F.col(c) % 4).cast("string"), F.lit("/s"), F.col(c).cast("string"))
    text = F.concat(F.lit("import { a } from '"), at("a"), F.when(k % 2 == 0, ".ts").otherwise(""), F.lit("'\nimport * as b from \""), at("b"), F.lit("\"\nimport i from '../d"), (F.col("c") % 4).cast("string"), F.lit("'\nimport r from 'react'\n"))
    keyed = _keyed(spark, sf_dir)
    own = keyed.select("k", F.concat(F.lit("web/d"), (k % 4).cast("string"), F.lit("/s"), k.cast("string"), F.lit(".ts")).alias("file"), text.alias("text"))
    index = keyed.select((k % 4).alias("j")).distinct().select(F.lit(-1).cast("long").alias("k"), F.concat(F.lit("web/d"), F.col("j").cast("string"), F.lit("/index.ts")).alias("file"), F.lit("export default 1\n").alias("text"))
    return own.unionByName(index)


@query(f"""WITH {_placed(_TS)}, i AS (SELECT j, CASE j WHEN 2 THEN ['web', 'two', 'start'] WHEN 3 THEN ['web', 'x', 'y', 'd3'] ELSE ['web', 'd'||j] END AS l FROM (SELECT unnest(range(4)) AS j))
  SELECT s.p||'.ts' AS file, 'import {{ a }} from '''||CASE WHEN s.k % 2 = 0 AND NOT kept THEN {_slashes('s.d', 'x.l')}||'.ts' WHEN NOT kept THEN {_slashes('s.d', 'x.l')} ELSE '../d'||(a % 4)||'/s'||a||CASE WHEN s.k % 2 = 0 THEN '.ts' ELSE '' END END||''''||chr(10)
  ||'import * as b from "'||CASE WHEN stays AND y.p = 'web/d'||(b % 4)||'/s'||b THEN '../d'||(b % 4)||'/s'||b ELSE {_slashes('s.d', 'y.l')} END||'"'||chr(10)||'import i from '''||CASE WHEN stays AND c % 4 IN (0, 1) THEN '../d'||(c % 4) ELSE {_slashes('s.d', 'i.l')} END||''''||chr(10)||'import r from ''react'''||chr(10) AS text
  FROM (SELECT *, p = 'web/d'||(k % 4)||'/s'||k AS stays FROM s) s JOIN (SELECT *, p = 'web/d'||(k % 4)||'/s'||k AS kept_ FROM t) x ON x.k = s.a JOIN t y ON y.k = s.b JOIN i ON i.j = c % 4, LATERAL (SELECT stays AND kept_ AS kept)
  UNION ALL SELECT CASE j WHEN 2 THEN 'web/two/start' WHEN 3 THEN 'web/x/y/d3/index' ELSE 'web/d'||j||'/index' END||'.ts', 'export default 1'||chr(10) FROM i""")
def typescript_imports_after_moves(spark, sf_dir):
    """Relative import paths after many moves: endings stay where they were written, a folder stands for its index as long as there is one."""
    tree, k = _ts_tree(spark, sf_dir), F.col("k")
    own = tree.where((k >= 0) & (k % 6 == 0)).select(F.col("file").alias("old"), F.concat(F.lit("lib/u"), k.cast("string"), F.lit(".ts")).alias("new"))
    moves = own.union(spark.createDataFrame([("web/d3", "web/x/y/d3"), ("web/d2/index.ts", "web/two/start.ts")], "old string, new string"))
    return _after(tree, moves)


@query(f"""SELECT 'cmd/m'||k||'/main.go' AS file, 'package main'||chr(10)||chr(10)||'import ('||chr(10)||chr(9)||'"fmt"'||chr(10)||chr(9)||'x "ex.com/m/'||CASE WHEN a % 3 = 1 THEN 'core/q'||a ELSE 'pkg/p'||a END||'"'||chr(10)||chr(9)||'"ex.com/m/pkg/p'||b||'x"'||chr(10)||')'||chr(10)||chr(10)||'var _ = "ex.com/m/pkg/p'||a||'"'||chr(10) AS text
  FROM (SELECT s_suppkey AS k, (s_suppkey + 1) % {_N} AS a, (s_suppkey + 2) % {_N} AS b FROM supplier)
  UNION ALL SELECT CASE WHEN s_suppkey % 3 = 1 THEN 'core/q'||s_suppkey ELSE 'pkg/p'||s_suppkey END||'/f.go', 'package p'||chr(10) FROM supplier""")
def go_imports_after_moves(spark, sf_dir):
    """Packages move, a table of as many moves as folders: paths from the module's root follow, those of other modules and strings stay."""
    keyed, c = _keyed(spark, sf_dir), lambda n: F.col(n).cast("string")
    text = F.concat(F.lit('package main\n\nimport (\n\t"fmt"\n\tx "ex.com/m/pkg/p'), c("a"), F.lit('"\n\t"ex.com/m/pkg/p'), c("b"), F.lit('x"\n)\n\nvar _ = "ex.com/m/pkg/p'), c("a"), F.lit('"\n'))
    tree = keyed.select(F.concat(F.lit("cmd/m"), c("k"), F.lit("/main.go")).alias("file"), text.alias("text")).union(keyed.select(F.concat(F.lit("pkg/p"), c("k"), F.lit("/f.go")), F.lit("package p\n")))
    moves = keyed.where("k % 3 = 1").select(F.concat(F.lit("pkg/p"), c("k")).alias("old"), F.concat(F.lit("core/q"), c("k")).alias("new"))
    return _after(tree, moves, "ex.com/m")


# --- declarations that move ---------------------------------------------------


def _modules(spark, sf_dir) -> DataFrame:
    """For each supplier a module of three functions that call each other in a chain, two files to move to, and one that uses them."""
    k = F.col("k").cast("string")
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    s = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    mod = c("import os\nfrom lib.base import helper as h, other\n\n\ndef low", k, "():\n    return h(os.sep)\n\n\ndef top", k, "():\n    return low", k, "() + other()\n\n\ndef rest", k, "():\n    return top", k, "()\n")
    low = F.when(F.col("k") % 10 == 4, c("low", k, " = 1\n")).when(F.col("k") % 4 == 0, F.lit('"""Low."""\nx = 1\n')).otherwise(F.lit(""))
    use = c("from mod.m", k, " import low", k, ", top", k, " as t\n\nx = t() + low", k, "()\n")
    rows = F.array(*(F.struct(c(a, k, ".py").alias("file"), F.lit(b).alias("text") if isinstance(b, str) else b.alias("text")) for a, b in (("mod/m", mod), ("lib/low", low), ("lib/top", ""), ("app/u", use))))
    own = s.select(F.explode(rows).alias("r")).select("r.*")
    return own.unionByName(spark.createDataFrame([("lib/base.py", "def helper(a):\n    return a\n\n\ndef other():\n    return 1\n")], "file string, text string"))


def _module_moves(spark, sf_dir):
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("k"))
    one = lambda rows, name: rows.select(F.concat(F.lit("mod/m"), "k", F.lit(".py")).alias("file"), F.concat(F.lit(name), "k").alias("name"), F.concat(F.lit(f"lib/{name}"), "k", F.lit(".py")).alias("to"))
    return one(s.where("s_suppkey % 2 = 0"), "low").union(one(s.where("s_suppkey % 3 = 0"), "top"))


_MOVED = "(SELECT s_suppkey AS k, s_suppkey % 2 = 0 AND s_suppkey % 10 <> 4 AS l, s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 AND s_suppkey % 10 <> 4 AS t FROM supplier)"
_LF = "chr(10)"


@query("""SELECT 'mod/m'||s_suppkey||'.py' AS file, 'low'||s_suppkey AS name, 'lib/low'||s_suppkey||'.py has low'||s_suppkey||' already' AS reason FROM supplier WHERE s_suppkey % 10 = 4
  UNION ALL SELECT 'mod/m'||s_suppkey||'.py', 'top'||s_suppkey, 'a circle of imports through low'||s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND NOT (s_suppkey % 2 = 0 AND s_suppkey % 10 <> 4)""")
def moves_turned_back(spark, sf_dir):
    """Moves onto a name that is taken, and those that, as another was turned back or never asked for, would make two files import each other."""
    files = _modules(spark, sf_dir)
    t = extract.relations(staged(extract.extracted(files)))
    return qualify.PythonMoves(_module_moves(spark, sf_dir), files, t).rejects().select("file", "name", "reason")


@query(f"""SELECT 'mod/m'||k||'.py' AS file, CASE WHEN l AND NOT t THEN 'from lib.low'||k||' import low'||k||{_LF} WHEN t THEN 'from lib.top'||k||' import top'||k||{_LF} ELSE '' END
    ||'import os'||{_LF}||'from lib.base import helper as h, other'||{_LF}||{_LF}||{_LF}||CASE WHEN l THEN '' ELSE 'def low'||k||'():'||{_LF}||'    return h(os.sep)'||{_LF} END||{_LF}||{_LF}
    ||CASE WHEN t THEN '' ELSE 'def top'||k||'():'||{_LF}||'    return low'||k||'() + other()'||{_LF} END||{_LF}||{_LF}||'def rest'||k||'():'||{_LF}||'    return top'||k||'()'||{_LF} AS text FROM {_MOVED}
  UNION ALL SELECT 'lib/low'||k||'.py', CASE WHEN k % 10 = 4 THEN 'low'||k||' = 1'||{_LF} ELSE CASE WHEN k % 4 = 0 THEN '\"\"\"Low.\"\"\"'||{_LF} ELSE '' END||CASE WHEN l THEN 'from lib.base import helper as h'||{_LF}||'import os'||{_LF} ELSE '' END||CASE WHEN k % 4 = 0 THEN 'x = 1'||{_LF} ELSE '' END
    ||CASE WHEN l THEN 'def low'||k||'():'||{_LF}||'    return h(os.sep)'||{_LF} ELSE '' END END FROM {_MOVED}
  UNION ALL SELECT 'lib/top'||k||'.py', CASE WHEN t THEN 'from lib.base import other'||{_LF}||'from lib.low'||k||' import low'||k||{_LF}||'def top'||k||'():'||{_LF}||'    return low'||k||'() + other()'||{_LF} ELSE '' END FROM {_MOVED}
  UNION ALL SELECT 'app/u'||k||'.py', CASE WHEN l THEN 'from lib.low'||k||' import low'||k||{_LF} ELSE '' END||CASE WHEN t THEN 'from lib.top'||k||' import top'||k||' as t'||{_LF} WHEN l THEN 'from mod.m'||k||' import top'||k||' as t'||{_LF} ELSE 'from mod.m'||k||' import low'||k||', top'||k||' as t'||{_LF} END||{_LF}||'x = t() + low'||k||'()'||{_LF} FROM {_MOVED}
  UNION ALL SELECT 'lib/base.py', 'def helper(a):'||{_LF}||'    return a'||{_LF}||{_LF}||{_LF}||'def other():'||{_LF}||'    return 1'||{_LF}""")
def declarations_moved_with_imports(spark, sf_dir):
    """Whole files after a chain of declarations moved: imports come along, users import from the new place, what is left behind is imported back."""
    files = _modules(spark, sf_dir)
    t = extract.relations(staged(extract.extracted(files)))
    return qualify.PythonMoves(_module_moves(spark, sf_dir), files, t).applied()


@query(f"""SELECT 'old/p'||k||'/a.go' AS file, 'package p'||k||{_LF}||{_LF}||'import "ex.com/m/new/q'||k||'"'||{_LF}||{_LF}||{_LF}||{_LF}||'func Keep() int {{'||{_LF}||'  return q'||k||'.Move(1)'||{_LF}||'}}'||{_LF} AS text FROM (SELECT s_suppkey AS k FROM supplier)
  UNION ALL SELECT 'new/q'||k||'/b.go', 'package q'||k||{_LF}||{_LF}||'import ('||{_LF}||chr(9)||'"ex.com/m/old/p'||k||'"'||{_LF}||chr(9)||'f "fmt"'||{_LF}||')'||{_LF}||{_LF}||'func Move(a int) int {{'||{_LF}||'  f.Println(a)'||{_LF}||'  return p'||k||'.Keep()'||{_LF}||'}}'||{_LF} FROM (SELECT s_suppkey AS k FROM supplier)
  UNION ALL SELECT 'cmd/c'||k||'/main.go', 'package main'||{_LF}||{_LF}||'import ('||{_LF}||chr(9)||'"ex.com/m/new/q'||k||'"'||{_LF}||chr(9)||'"ex.com/m/old/p'||k||'"'||{_LF}||')'||{_LF}||{_LF}||'func main() {{'||{_LF}||'  q'||k||'.Move(p'||k||'.Keep())'||{_LF}||'}}'||{_LF} FROM (SELECT s_suppkey AS k FROM supplier)""")
def go_declarations_moved(spark, sf_dir):
    """A function moves to another package: qualified where it is used, what it uses of its old package qualified in it; imports are merged, and one that only it used goes along."""
    k = F.col("s_suppkey").cast("string")
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    s = read_table(spark, sf_dir, "supplier")
    a = c("package p", k, '\n\nimport f "fmt"\n\nfunc Move(a int) int {\n  f.Println(a)\n  return Keep()\n}\n\nfunc Keep() int {\n  return Move(1)\n}\n')
    main = c('package main\n\nimport "ex.com/m/old/p', k, '"\n\nfunc main() {\n  p', k, ".Move(p", k, ".Keep())\n}\n")
    rows = F.array(F.struct(c("old/p", k, "/a.go").alias("file"), a.alias("text")), F.struct(c("new/q", k, "/b.go").alias("file"), c("package q", k, "\n").alias("text")), F.struct(c("cmd/c", k, "/main.go").alias("file"), main.alias("text")))
    files = s.select(F.explode(rows).alias("r")).select("r.*")
    moves = s.select(c("old/p", k, "/a.go").alias("file"), F.lit("Move").alias("name"), c("new/q", k, "/b.go").alias("to"))
    return qualify.go_moves(moves, files, extract.relations(staged(extract.extracted(files))), "ex.com/m")


# --- build and lock files -----------------------------------------------------


@query("""SELECT 'm'||k||'/cmd/main.go' AS file, x.spec AS spec, x.kind AS kind, x.module AS module, x.version AS version, x.path AS path FROM (SELECT k, unnest([
    {'spec': 'ex.com/m'||k||'/pkg', 'kind': 'tree', 'module': 'ex.com/m'||k, 'version': NULL, 'path': 'm'||k||'/pkg'}, {'spec': 'ex.com/m'||k||'/sub/x/y', 'kind': 'tree', 'module': 'ex.com/m'||k||'/sub/x', 'version': NULL, 'path': 'shared/x/y'},
    {'spec': 'dep.org/a/v2/b', 'kind': 'module', 'module': 'dep.org/a/v2', 'version': 'v2.'||k||'.0', 'path': NULL}, {'spec': 'dep.org/old/c', 'kind': 'module', 'module': 'dep.org/new', 'version': 'v1.0.'||k, 'path': NULL},
    {'spec': 'net/http', 'kind': 'std', 'module': NULL, 'version': NULL, 'path': NULL}, {'spec': 'gone.org/z', 'kind': 'unknown', 'module': NULL, 'version': NULL, 'path': NULL}]) AS x FROM (SELECT s_suppkey AS k FROM supplier))""")
def go_imports_by_build_files(spark, sf_dir):
    """A go.mod in each of many folders: own modules, replacements by folders and by modules, requirements, all by the longest path."""
    k = F.col("s_suppkey").cast("string")
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    s = read_table(spark, sf_dir, "supplier")
    mod = c("// of ", k, "\nmodule ex.com/m", k, "\n\ngo 1.22\n\nrequire (\n\tdep.org/a v1.0.0 // indirect\n\tdep.org/a/v2 v2.", k, ".0\n\tdep.org/old v0.1.0\n)\n\nreplace dep.org/old => dep.org/new v1.0.", k, "\nreplace ex.com/m", k, "/sub/x => ../shared/x\n")
    files = s.select(c("m", k, "/go.mod").alias("file"), mod.alias("text")).union(s.select(c("m", k, "/cmd/main.go"), F.lit("package main\n")))
    specs = F.array(c("ex.com/m", k, "/pkg"), c("ex.com/m", k, "/sub/x/y"), *(F.lit(x) for x in ("dep.org/a/v2/b", "dep.org/old/c", "net/http", "gone.org/z")))
    return builds.go_packages(s.select(c("m", k, "/cmd/main.go").alias("file"), F.explode(specs).alias("spec")), files)


@query("""SELECT 'c'||k||'/src/lib.rs' AS file, x.spec AS spec, x.crate AS crate, x.version AS version, x.kind AS kind FROM (SELECT k, unnest([
    {'spec': 'serde_json::value', 'crate': 'serde_json', 'version': '1.0.'||k, 'kind': 'locked'}, {'spec': 'memchr', 'crate': 'memchr', 'version': CASE WHEN k % 2 = 0 THEN '2.7.4' END, 'kind': CASE WHEN k % 2 = 0 THEN 'locked' ELSE 'ambiguous' END},
    {'spec': 'app::x', 'crate': 'app', 'version': '0.1.0', 'kind': 'own'}, {'spec': 'rand::Rng', 'crate': 'rand', 'version': NULL, 'kind': 'unlocked'}]) AS x FROM (SELECT s_suppkey AS k FROM supplier))""")
def crates_by_lock_files(spark, sf_dir):
    """Locked versions of crates: the only one, or that which the tree's own package depends on."""
    k = F.col("s_suppkey").cast("string")
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    s = read_table(spark, sf_dir, "supplier")
    package = lambda name, version, more: c(f'[[package]]\nname = "{name}"\nversion = "', version, f'"\n{more}\n')
    away = 'source = "registry+https://example.org/index"\n'
    lock = c("version = 3\n\n", package("serde-json", c("1.0.", k), away), package("memchr", "2.7.4", away), package("memchr", "1.0.2", away), package("app", "0.1.0", ""), 'dependencies = ["serde-json"', F.when(F.col("s_suppkey") % 2 == 0, ', "memchr 2.7.4"').otherwise(""), "]\n")
    files = s.select(c("c", k, "/Cargo.lock").alias("file"), lock.alias("text"))
    specs = F.array(*(F.lit(x) for x in ("serde_json::value", "memchr", "app::x", "rand::Rng", "crate::y", "super::z")))
    return builds.locked_crates(s.select(c("c", k, "/src/lib.rs").alias("file"), F.explode(specs).alias("spec")), files)


# --- neighbourhoods -----------------------------------------------------------


@query(f"""WITH RECURSIVE e AS (SELECT s_suppkey AS k, (s_suppkey + 1) % {_N} AS j FROM supplier WHERE s_suppkey % 4 <> 3 UNION ALL SELECT s_suppkey, (s_suppkey + 20) % {_N} FROM supplier WHERE s_suppkey % 5 = 2),
  r AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 25 = 0 UNION SELECT e.j FROM r JOIN e ON e.k = r.k)
  SELECT unnest(['p'||k||'/a.go', 'p'||k||'/b.go']) AS file FROM r""")
def loaded_neighbourhood(spark, sf_dir):
    """Files that seeds lead to by imports and as peers: what only a peer imports is reached through it; no other file is read."""
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey")
    n = s.count()
    k, at = F.col("s_suppkey").cast("string"), lambda d: ((F.col("s_suppkey") + d) % n).cast("string")
    line = lambda d: c('\nimport "m/p', at(d), '"\n')
    rows = F.array(
        F.struct(c("p", k, "/a.go").alias("file"), c("package p", k, F.when(F.col("s_suppkey") % 4 != 3, line(1)).otherwise("\n")).alias("text")),
        F.struct(c("p", k, "/b.go").alias("file"), c("package p", k, F.when(F.col("s_suppkey") % 5 == 2, line(20)).otherwise("\n")).alias("text")),
    )
    files = s.select(F.explode(rows).alias("r")).select("r.*")
    seeds = s.where("s_suppkey % 25 = 0").select(c("p", k, "/a.go").alias("file"))
    found = neighbourhood.loaded(files.select("file"), seeds, lambda own: files.join(own, "file"), lambda texts, index: neighbourhood.imports_of(texts, index, "m"))
    return found.select("file")
