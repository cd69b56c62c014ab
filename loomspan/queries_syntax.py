"""Queries on syntax trees of languages with braces, whole and broken, on sources whose shape varies with keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import literals
from .operators import early, rules, tape
from .plans import twig
from .registry import query
from .sources import sinks, trees
from .storage import read_table, shared_dir, unbounded

# --- sources of many shapes --------------------------------------------------
# For supplier k: 1 + k % 3 functions, each with ifs k % 4 deep, k % 5 calls with a string that looks like code, and a return;
# a comment that looks like code in every second file; a bracket too many in every eleventh; the last brace missing in every seventh.

#: By language, what stands before all functions, before and after a function's number, around a test, after a call, and behind all functions.
_TEXTS = {
    "go": ("package p\n\n", "func F", "(x int) int {\n", "if x > 1 { ", "", ""),
    "java": ("class A {\n", "int f", "(int x) {\n", "if (x > 1) { ", ";", "}\n"),
    "typescript": ("", "function f", "(x: number): number {\n", "if (x > 1) { ", ";", ""),
}
_COMMENT = "//func/not(a){if(x{\n"


def _sources(spark, sf_dir, lang: str, broken: bool = True) -> DataFrame:
    head, name, params, test, end, tail = _TEXTS[lang]
    k = F.col("s_suppkey")
    many = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    body = lambda i: F.concat(
        F.lit(name), i.cast("string"), F.lit(params), many(test, k % 4), F.lit(f"g(x, 1){end}"), many(" }", k % 4), F.lit("\n"), many(f'h("if({{"){end}\n', k % 5), F.lit(f"return x + y * 2{end}\n}}\n")
    )
    text = F.concat(
        F.when(k % 2 == 0, _COMMENT).otherwise(""), F.when((k % 11 == 0) & F.lit(broken), ")\n").otherwise(""), F.lit(head),
        F.array_join(F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), body), ""), F.lit(tail),
    )
    text = F.when((k % 7 == 0) & F.lit(broken), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    return unbounded(read_table(spark, sf_dir, "supplier").select(F.concat(F.lit(f"{lang}/"), k.cast("string")).alias("file"), text.alias("text")))


def _sql(lang: str, broken: bool = True) -> str:
    head, name, params, test, end, tail = (x.replace("\n", "'||chr(10)||'") for x in _TEXTS[lang])
    line, comment = f"'h(\"if({{\"){end}'||chr(10)", _COMMENT.replace("\n", "'||chr(10)||'")
    body = f"'{name}'||i||'{params}'||repeat('{test}', k % 4)||'g(x, 1){end}'||repeat(' }}', k % 4)||chr(10)||repeat({line}, k % 5)||'return x + y * 2{end}'||chr(10)||'}}'||chr(10)"
    text = f"CASE WHEN k % 2 = 0 THEN '{comment}' ELSE '' END||{f"CASE WHEN k % 11 = 0 THEN ')'||chr(10) ELSE '' END||" if broken else ''}'{head}'||array_to_string(list_transform(range(k % 3 + 1), lambda i: {body}), '')||'{tail}'"
    cut = "CASE WHEN k % 7 = 0 THEN text[:-3] ELSE text END" if broken else "text"
    return f"(SELECT '{lang}/'||k AS file, k, {cut} AS text FROM (SELECT k, {text} AS text FROM (SELECT s_suppkey AS k FROM supplier)))"


_SHAPES = "SELECT k, 1 + k % 3 AS m, k % 4 AS d, k % 5 AS c FROM (SELECT s_suppkey AS k FROM supplier)"
_TYPES = ("function_declaration", "method_declaration", "class_declaration", "if_statement", "call_expression", "binary_expression", "return_statement", "block", "string", "comment", "ERROR", "MISSING")


def _counts(lang: str) -> str:
    declares = "method_declaration" if lang == "java" else "function_declaration"
    of = {
        declares: "m", "class_declaration": "1" if lang == "java" else "0", "if_statement": "m * d", "call_expression": "m * (1 + c)", "binary_expression": "m * (d + 2)", "return_statement": "m", "block": "m * (1 + d)",
        "string": "m * c", "comment": "CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END", "ERROR": "CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END", "MISSING": "CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END",
    }
    return " UNION ALL ".join(f"SELECT '{lang}/'||k AS file, '{t}' AS type, CAST({n} AS BIGINT) AS n FROM s" for t, n in of.items())


def _nodes_sql(lang: str) -> str:
    return f"WITH s AS ({_SHAPES}) SELECT * FROM ({_counts(lang)}) WHERE n > 0"


def _node_counts(spark, sf_dir, lang: str) -> DataFrame:
    nodes = trees.nodes(_sources(spark, sf_dir, lang), lang)
    return nodes.where(F.col("type").isin(*_TYPES)).groupBy("file", "type").agg(F.count(F.lit(1)).alias("n"))


@query(_nodes_sql("go"))
def syntax_nodes_go(spark, sf_dir):
    """Nodes by type; what a string or a comment holds is none."""
    return _node_counts(spark, sf_dir, "go")


@query(_nodes_sql("java"))
def syntax_nodes_java(spark, sf_dir):
    return _node_counts(spark, sf_dir, "java")


@query(_nodes_sql("typescript"))
def syntax_nodes_typescript(spark, sf_dir):
    return _node_counts(spark, sf_dir, "typescript")


_LEAVES = "//[^\\n]*|\"[^\"]*\"|[A-Za-z_]\\w*|\\d+|[^\\w\\s]"


@query(f"SELECT file, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS text FROM (SELECT file, regexp_extract_all(text, '{_LEAVES}') AS l FROM {_sql('java')})")
def tape_of_leaves(spark, sf_dir):
    """A tape cut from the leaves of trees, of broken files as well: every leaf once, in order."""
    own = _sources(spark, sf_dir, "java")
    return trees.leaves(trees.nodes(own, "java"), own).select("file", "pos", "text")


@query(f"""SELECT file, 'MISSING' AS type, CAST(strlen(rtrim(text, ' '||chr(10))) AS INTEGER) AS start, CASE WHEN starts_with(file, 'java') THEN 'body' ELSE 'block' END AS parent
  FROM (SELECT * FROM {_sql('go')} UNION ALL SELECT * FROM {_sql('java')}) WHERE k % 7 = 0
  UNION ALL SELECT file, 'ERROR', CAST(strpos(chr(10)||text, chr(10)||')') - 1 AS INTEGER), 'source_file' FROM (SELECT * FROM {_sql('go')} UNION ALL SELECT * FROM {_sql('java')}) WHERE k % 11 = 0""")
def syntax_faults(spark, sf_dir):
    """What cannot stand where it is, and what is not there, each with its place."""
    own = [trees.faults(trees.nodes(_sources(spark, sf_dir, lang), lang)) for lang in ("go", "java")]
    return own[0].unionByName(own[1]).select("file", "type", "start", "parent")


@query(f"SELECT 'go/'||k AS file, CAST(m AS BIGINT) AS n, CAST(m * (c + CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS calls FROM ({_SHAPES}) WHERE c > 0 OR d = 0")
def twig_runs_before_a_return(spark, sf_dir):
    """A quantifier and an anchor: runs of calls directly before a return."""
    found = twig.search(_sources(spark, sf_dir, "go"), "go", "(block (expression_statement (call_expression function: (identifier) @f))+ . (return_statement))")
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(F.col("captures")["f"])).alias("calls"))


@query(f"SELECT 'typescript/'||k AS file, CAST(m * c AS BIGINT) AS n FROM ({_SHAPES}) WHERE c > 0")
def twig_predicates(spark, sf_dir):
    """Predicates on texts: calls of h whose only argument is a string with a brace."""
    found = twig.search(_sources(spark, sf_dir, "typescript"), "typescript", '(call_expression function: (identifier) @f arguments: (arguments . (string) @s .)) (#eq? @f "h") (#match? @s "[{]") (#not-eq? @s "g")')
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'java/'||k AS file, CAST(m * (d - 1) AS BIGINT) AS inner_ifs FROM ({_SHAPES}) WHERE d > 1")
def twig_join_of_nodes(spark, sf_dir):
    """Over a table of nodes: ifs directly in the block of an if without another branch."""
    nodes = trees.nodes(_sources(spark, sf_dir, "java"), "java")
    found = twig.join(nodes, "(if_statement !alternative body: (block (if_statement) @inner))")
    return twig.captured(found, "inner").groupBy("file").agg(F.count(F.lit(1)).alias("inner_ifs"))


@query(f"SELECT 'go/'||k AS file, CAST(m * (d + 1) AS BIGINT) AS n FROM ({_SHAPES})")
def twig_alternatives(spark, sf_dir):
    """Alternatives: ifs and returns, by one name."""
    found = twig.search(_sources(spark, sf_dir, "go"), "go", "[(if_statement) (return_statement value: (binary_expression right: (_)))] @x")
    return twig.captured(found, "x").groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT 'go/'||k AS file, x.type AS type, x.parent AS parent, CAST(0 AS BIGINT) AS n_before, CAST(1 AS BIGINT) AS n_after
  FROM (SELECT k, unnest([{{'type': 'MISSING', 'parent': 'block', 'is': k % 7 = 0}}, {{'type': 'ERROR', 'parent': 'source_file', 'is': k % 11 = 0}}]) AS x FROM (SELECT s_suppkey AS k FROM supplier)) WHERE x."is" """)
def staged_results_rejected(spark, sf_dir):
    """Edits that break a file, told by the faults that it had not before."""
    before = _sources(spark, sf_dir, "go", broken=False)
    return trees.rejected(before, _sources(spark, sf_dir, "go"), "go").select("file", "type", "parent", "n_before", "n_after")


@query(f"SELECT file, md5(replace(text, 'g(x', 'gg(x')) AS digest FROM {_sql('go', broken=False)} WHERE k % 5 <> 2")
def staged_results_validated(spark, sf_dir):
    """Of edits that rename a call, those of every fifth file also take an operand away; they are turned back."""
    before = _sources(spark, sf_dir, "go", broken=False)
    harm = F.split("file", "/")[1].cast("long") % 5 == 2
    after = before.withColumn("text", F.when(harm, F.replace("text", F.lit("y * 2"), F.lit("y *"))).otherwise(F.replace("text", F.lit("g(x"), F.lit("gg(x"))))
    return trees.validated(before, after, "go").select("file", F.md5("text").alias("digest"))


# --- strings and searches that end early --------------------------------------

_ESCAPED = "p_name||' '||p_brand"


@query(f"""SELECT lang||'/'||p_partkey AS file, replace(t, ' ', chr(9))||'A'||chr(233) AS text, CAST(1 + length(t) + len(regexp_extract_all(t, ' ')) + 6 AS INTEGER) AS last, true AS whole FROM (SELECT p_partkey, {_ESCAPED} AS t FROM part), (SELECT unnest(['go', 'java', 'python', 'typescript']) AS lang)
  UNION ALL SELECT 'raw/'||p_partkey, replace(t, ' ', '\\t'), CAST(length(t) + len(regexp_extract_all(t, ' ')) AS INTEGER), false FROM (SELECT p_partkey, {_ESCAPED} AS t FROM part)""")
def string_contents(spark, sf_dir):
    """What literals hold and where in the source their last character stands; raw ones are left open, and hold what is there."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.replace(F.concat_ws(" ", "p_name", "p_brand"), F.lit(" "), F.lit("\\t")).alias("t"))
    out = None
    for lang, prefix, body, suffix in (*((x, '"', "\\u0041é", '"') for x in ("go", "java", "python", "typescript")), ("raw", "`", "", "")):
        own = p.select(F.concat(F.lit(f"{lang}/"), F.col("p_partkey").cast("string")).alias("file"), F.concat(F.lit(prefix), "t", F.lit(body + suffix)).alias("literal"))
        read = "go" if lang == "raw" else lang
        own = own.select("file", literals.string_content(F.col("literal"), read).alias("c"), literals.is_string(F.col("literal"), read).alias("whole"))
        own = own.select("file", F.col("c.text").alias("text"), F.element_at("c.places", -1).alias("last"), "whole")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"SELECT CAST(file AS BIGINT) AS file, n FROM (SELECT doc_id AS file, len(regexp_extract_all(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)')) > 0 AS hit, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS w) WHERE w = 'the') AS n FROM documents) WHERE n > 0 ORDER BY file LIMIT 5")
def first_files_that_match(spark, sf_dir):
    """The first five files that match, with their matches; stored files behind them are not read."""
    d = read_table(spark, sf_dir, "documents").withColumn("file", F.format_string("%012d", "doc_id"))
    find = lambda part: rules.search(part.select("file", "text"), '"the"', regex=tape.WORDS)
    found = early.first_matches(d, find, 5)
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select(F.col("file").cast("long").alias("file"), "n")


@query(f"SELECT 'go/'||k AS file, 'h(\"if({{\")' AS text, CAST(m * c AS BIGINT) AS n FROM ({_SHAPES}) WHERE c > 0")
def matches_widened_to_calls(spark, sf_dir):
    """A match that opens a bracket takes the span of the smallest node around it: the whole call."""
    own = _sources(spark, sf_dir, "go", broken=False)
    found = rules.search(own, '(seq "h" "(")', nodes=trees.nodes(own, "go"))
    spans = found.select("file", "start", "end").join(own, "file")
    text = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    return spans.select("file", text.alias("text")).groupBy("file", "text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS k, p_name AS name FROM part")
def sink_by_formatter(spark, sf_dir):
    """Rows through a formatter by its name, read back."""
    out = f"{shared_dir(spark)}/rows"
    rows = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"))
    sinks.write_as("table", rows, out)
    return spark.read.parquet(out)
