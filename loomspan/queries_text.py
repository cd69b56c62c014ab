"""Queries on texts: sources and sinks, tapes, patterns and matchers through the engine, columns on paths and text."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import paths, text as texts
from .operators import rules, sequence, similarity, tape
from .plans import pattern as P
from .plans.rules import load_folder
from .plans.sexp import Expander
from .registry import FILES, IV, PIECES, SEQ, SEQB, SPANS, TURN, event_files, files, intervals, query, scanned, sequences, turns
from .sources import files as sources
from .sources import ignore, sinks, trees
from .storage import dealt, read_table, shared_dir
from .streaming import files as streams

# --- sources and sinks -------------------------------------------------------


def _folder(spark) -> str:
    """A fresh folder of this machine: these queries write files one by one."""
    path = shared_dir(spark).removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


_PLACES = "(SELECT 'r'||n_regionkey||'/'||lower(n_name)||'.txt' AS file, n_name||' lies in '||r_name||chr(10) AS text, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _places(spark, sf_dir) -> DataFrame:
    n, r = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    both = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    name = F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("/"), F.lower("n_name"), F.lit(".txt"))
    return both.select(name.alias("file"), F.concat("n_name", F.lit(" lies in "), "r_name", F.lit("\n")).alias("text"), "n_regionkey")


def _committed(spark, sf_dir) -> str:
    root, new = _folder(spark), _places(spark, sf_dir).select("file", "text")
    sinks.commit(new.limit(0), new, root).collect()
    return root


@query(f"SELECT file, true AS changed, true AS written, 0 AS left_over FROM {_PLACES}")
def sink_commit(spark, sf_dir):
    """Written once; a second run finds nothing to change."""
    root, new = _folder(spark), _places(spark, sf_dir).select("file", "text")
    first = spark.createDataFrame(sinks.commit(new.limit(0), new, root).collect(), "file string, changed boolean, written boolean")
    again = sinks.commit(new, new, root).where("changed").count()
    return first.withColumn("left_over", F.lit(again).cast("int"))


@query(f"SELECT file, text, CAST(strlen(text) AS BIGINT) AS size FROM {_PLACES}")
def scan_folder(spark, sf_dir):
    return sources.scan(spark, sources.Source(f"file://{_committed(spark, sf_dir)}"))


@query(f"SELECT file, text FROM {_PLACES} WHERE n_regionkey = 1")
def scan_named_paths(spark, sf_dir):
    names = [r.file for r in _places(spark, sf_dir).where("n_regionkey = 1").collect()]  # the paths that a user names
    return sources.scan(spark, sources.Source(f"file://{_committed(spark, sf_dir)}", tuple(names))).select("file", "text")


@query(f"SELECT file, text FROM {_PLACES} WHERE file NOT LIKE 'r2/%' AND NOT ends_with(file, '_1.txt')")
def scan_with_ignore_rules(spark, sf_dir):
    rules_ = ignore.collect(gitignores={"": "r2/\n*_1.txt\n"})
    return sources.scan(spark, sources.Source(f"file://{_committed(spark, sf_dir)}"), rules_).select("file", "text")


@query("SELECT CASE WHEN regionkey = 0 THEN 'node_modules/' WHEN regionkey = 1 THEN 'a/__pycache__/' ELSE 'a/' END||nationkey AS file FROM (SELECT n_regionkey AS regionkey, n_nationkey AS nationkey FROM nation) WHERE regionkey > 1")
def skipped_folders(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    folder = F.when(F.col("n_regionkey") == 0, "node_modules/").when(F.col("n_regionkey") == 1, "a/__pycache__/").otherwise("a/")
    return ignore.explored(n.select(F.concat(folder, F.col("n_nationkey").cast("string")).alias("file")), ignore.builtins())


@query("SELECT 'r'||n_nationkey AS folder, n_nationkey % 3 <> 2 AS skipped FROM nation")
def skipped_walks(spark, sf_dir):
    """Folders that a walk need not enter: every third is ignored, but something below it is not."""
    own = ignore.parse_gitignore("r*/\n" + "".join(f"!r{k}/keep.txt\n" for k in range(2, 25, 3)))
    folders = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), F.col("n_nationkey").cast("string")).alias("folder"))
    return ignore.skipped(folders, own)


@query("SELECT o_orderkey AS file, o_custkey % 3 <> 0 AS generated FROM orders WHERE o_custkey % 3 < 2")
def generated_files(spark, sf_dir):
    """Attributes mark files as generated; a later line takes the mark back."""
    own = ignore.parse_gitattributes("*.gen linguist-generated\nplain/*.gen -linguist-generated\n")
    o = read_table(spark, sf_dir, "orders").where("o_custkey % 3 < 2")
    file = F.concat(F.when(F.col("o_custkey") % 3 == 0, "plain/").otherwise("made/"), F.col("o_orderkey").cast("string"), F.lit(".gen"))
    found = ignore.decide(o.select("o_orderkey", file.alias("file")), own)
    return found.select(F.col("o_orderkey").alias("file"), F.col("ignored").alias("generated"))


@query("SELECT 'regions.zip' AS archive, 'r/'||r_name||'.txt' AS member, r_name||' é' AS text FROM region")
def archive_members(spark, sf_dir):
    root, data = _folder(spark), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for r in read_table(spark, sf_dir, "region").collect():
            z.writestr(f"r/{r.r_name}.txt", f"{r.r_name} é")
    with open(f"{root}/regions.zip", "wb") as f:
        f.write(data.getvalue())
    return sources.archives(spark, f"file://{root}/regions.zip").select(F.regexp_extract("file", "([^/]*)$", 1).alias("archive"), "member", "text")


@query(f"SELECT CASE WHEN file LIKE 'src1/%' THEN 'moved/'||substr(file, 6) ELSE file END AS file, size FROM {FILES}")
def renamed_files(spark, sf_dir):
    own = files(spark, sf_dir)
    moves = own.where("file LIKE 'src1/%'").select("file", F.concat(F.lit("moved/"), F.expr("substr(file, 6)")).alias("to"))
    return sources.renamed(own, moves).select("file", F.col("size").cast("int").alias("size"))


@query(f"SELECT file, CASE WHEN doc_id % 4 = 0 THEN 'unsaved' ELSE md5(text) END AS digest FROM {FILES}")
def overlaid_texts(spark, sf_dir):
    own = files(spark, sf_dir).select("file", F.md5("text").alias("text"), "doc_id")
    over = own.where("doc_id % 4 = 0").select("file", F.lit("unsaved").alias("text"))
    return sources.overlaid(own, over).withColumnRenamed("text", "digest")


def _the(spark, sf_dir) -> DataFrame:
    return sequence.grep(tape.lexed(turns(spark, sf_dir).select("file", "text"), tape.WORDS), [P.parse('(seq (capture a "of") (capture b (not "of")))')])


_OF = f"(SELECT file, start, \"end\", text, lead(text) OVER w AS b, lead(start) OVER w AS s2, lead(\"end\") OVER w AS e2 FROM {SPANS} WINDOW w AS (PARTITION BY file ORDER BY pos))"


@query(f"SELECT file, CAST(start AS BIGINT) AS start, CAST(e2 AS BIGINT) AS \"end\", b FROM {_OF} WHERE text = 'of' AND b <> 'of'")
def sink_json_lines(spark, sf_dir):
    out = f"{shared_dir(spark)}/matches"
    sinks.write_jsonl(_the(spark, sf_dir), out)
    back = spark.read.json(out)
    return back.select("file", "start", "end", F.get(back["sites.b"], F.lit(0))["text"].alias("b"))


@query(f"SELECT file, CAST(start AS INTEGER) AS start, text AS a, b FROM {_OF} WHERE text = 'of' AND b <> 'of'")
def sink_csv(spark, sf_dir):
    out = f"{shared_dir(spark)}/matches"
    sinks.write_csv(_the(spark, sf_dir), ["a", "b"], out)
    back = spark.read.option("header", True).schema("file string, start int, end int, text string, a string, b string").csv(out)
    return back.select("file", "start", "a", "b")


_HEAD = f"(SELECT x.file, x.p, x.s, coalesce(string_agg(y.p, '' ORDER BY y.i), '') AS head FROM {PIECES} x LEFT JOIN {PIECES} y ON y.file = x.file AND y.i < x.i WHERE x.p = 'and' GROUP BY x.file, x.i, x.p, x.s)"
_LINE = "(1 + length(head) - length(replace(head, chr(10), '')))"
_COL = "(1 + strlen(regexp_extract(head, '[^\\n]*$')))"


def _ands(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    own = turns(spark, sf_dir).select("file", "text")
    return rules.search(own, '"and"', regex=tape.WORDS), own


@query(f"SELECT file||':'||{_LINE}||':'||{_COL}||': and' AS value FROM {_HEAD}")
def sink_text_lines(spark, sf_dir):
    return sinks.as_text(*_ands(spark, sf_dir))


@query(f"SELECT 'warning[plain-and]: an and'||chr(10)||'  --> '||file||':'||{_LINE}||':'||{_COL}||chr(10)||'   | and' AS value FROM {_HEAD}")
def sink_compiler_lines(spark, sf_dir):
    found, own = _ands(spark, sf_dir)
    at = sinks.located(found.select("file", "start", "end", F.lit("plain-and").alias("rule_id"), F.lit("warning").alias("level"), F.lit("an and").alias("message")), own)
    return sinks.rustc_lines(at)


@query(f"SELECT file, CAST({_LINE} AS BIGINT) AS line, CAST({_COL} AS BIGINT) AS col, 'plain-and' AS rule_id FROM {_HEAD}")
def sink_sarif(spark, sf_dir):
    found, own = _ands(spark, sf_dir)
    at = sinks.located(found.select("file", "start", "end", F.lit("plain-and").alias("rule_id"), F.lit("warning").alias("level"), F.lit("an and").alias("message")), own)
    out = f"{shared_dir(spark)}/sarif"
    sinks.write_sarif(at, out)
    run = spark.read.json(out)
    result = run.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    place = F.col("r.locations")[0]["physicalLocation"]
    return result.select(place["artifactLocation"]["uri"].alias("file"), place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("col"), F.col("r.ruleId").alias("rule_id"))


@query(f"SELECT CASE text WHEN 'the' THEN 'article' ELSE 'join' END AS rule_id, count(*) AS n FROM {SPANS} WHERE text IN ('the', 'and') GROUP BY ALL")
def rule_pack_folder(spark, sf_dir):
    root = _folder(spark)
    os.makedirs(f"{root}/.rules", exist_ok=True)
    for name, source in (("b.rft", '(rule article note "an article" "the")'), (".rules/a.rft", '(rule join note "a join" "and") (rule article note "again" "the")')):
        with open(f"{root}/{name}", "w", encoding="utf-8") as f:
            f.write(source)
    found = rules.findings(turns(spark, sf_dir).select("file", "text"), load_folder(root), regex=tape.WORDS)
    return found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first FROM (SELECT conv_id||'/'||turn AS file, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]') AS t FROM conversations)) WHERE tok = 'the'")
def stream_pattern_matches(spark, sf_dir):
    """Turns as a stream of files; each micro-batch is searched on its own."""
    stream = streams.watch_table(spark, f"{sf_dir}/conversations.parquet")
    base = shared_dir(spark)
    own = stream.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("file"), "text")
    streams.each_batch(streams.grep_stream(own, '"the"').select("file", "first"), lambda b: b, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("file", "first")


# --- tapes -------------------------------------------------------------------


@query(f"SELECT file, s AS start, min(flag) FILTER (flag <> 'N') IS NOT NULL AS typed, arg_min(flag, [idx, ascii(flag)]) FILTER (flag <> 'N') AS type FROM {IV} GROUP BY file, s, e")
def tape_merged_cells(spark, sf_dir):
    """Cells of one span become one, with the first type that is not empty."""
    own = intervals(spark, sf_dir)
    cells = own.select("file", "start", "end", F.when(F.col("flag") == "N", "").otherwise(F.col("flag")).alias("type"), F.lit("").alias("target"), F.col("idx").alias("seq"))
    return tape.merged(cells).select("file", "start", F.col("type").isNotNull().alias("typed"), "type")


@query(f"SELECT file, idx, s AS start, CASE WHEN bool_or(flag = 'R') THEN 'path:x::'||idx ELSE '' END AS target FROM {IV} WHERE flag <> 'N' GROUP BY file, idx, s, e UNION ALL SELECT file, NULL, s, 'path:x::'||idx FROM (SELECT DISTINCT file, idx, s, e FROM {IV} n WHERE flag = 'N' AND NOT EXISTS (SELECT 1 FROM {IV} o WHERE o.flag <> 'N' AND o.file = n.file AND o.s = n.s AND o.e = n.e))")
def tape_attached_targets(spark, sf_dir):
    """Targets of spans that are cells, and of spans that become cells by them. All meet after one shuffle."""
    span, of = ["file", "start", "end"], lambda test, name: F.max(F.expr(test)).alias(name)
    own = dealt(intervals(spark, sf_dir), read_table(spark, sf_dir, "lineitem").count(), *span)
    each = own.groupBy(*span, "idx").agg(of("flag <> 'N'", "cell"), of("flag = 'R'", "marked"), of("flag = 'N'", "bare"))
    cells = each.where("cell").select("file", "idx", "start", "end")
    # spans of which a part is null are no cell's
    taken = F.coalesce(F.max("cell").over(Window.partitionBy(*span)), F.lit(False)) & F.col("file").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull()
    some = each.withColumn("taken", taken).where("marked or (bare and not taken)")
    targets = some.select(*span, F.concat(F.lit("path:x::"), F.col("idx").cast("string")).alias("target"))
    return tape.attached(cells, targets).select("file", "idx", "start", "target")


@query(f"SELECT file, idx, 'host' AS lang FROM {IV} a WHERE NOT EXISTS (SELECT 1 FROM {IV} b WHERE b.flag = 'R' AND b.file = a.file AND a.s < b.e AND b.s < a.e) UNION ALL SELECT file, idx, 'inner' FROM {IV} WHERE flag = 'R'")
def tape_spliced_regions(spark, sf_dir):
    own = intervals(spark, sf_dir)
    inner = own.where("flag = 'R'")
    spliced = tape.spliced(own.withColumn("lang", F.lit("host")), inner, inner.withColumn("lang", F.lit("inner")))
    return spliced.select("file", "idx", "lang")


@query(f"SELECT a.file, a.idx, coalesce(arg_min(b.flag, [b.e - b.s, ascii(b.flag)]), 'none') AS cls FROM {IV} a LEFT JOIN {IV} b ON b.flag <> 'N' AND b.file = a.file AND b.s <= a.s AND a.e <= b.e GROUP BY a.file, a.idx, a.s, a.e")
def tape_painted_cells(spark, sf_dir):
    own = intervals(spark, sf_dir)
    cells = own.select("file", "idx", "start", "end", F.lit("none").alias("cls")).distinct()
    return tape.painted(cells, own.where("flag <> 'N'").withColumnRenamed("flag", "cls")).select("file", "idx", "cls")


@query("SELECT 'c'||o_custkey AS file, CAST(o_orderkey AS INTEGER) AS start, CASE WHEN o_orderstatus = 'F' THEN 'alias' ELSE 'bind' END AS target FROM orders")
def tape_use_targets(spark, sf_dir):
    """An alias wins over a bind of the same span; its path token stands for its whole span."""
    o = read_table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderkey").cast("int").alias("start"), "o_orderstatus")
    binds = o.select("file", "start", (F.col("start") + 1).alias("end"), F.lit("bind").alias("target_ref"))
    own = o.where("o_orderstatus = 'F'")
    aliases = own.select(F.concat(F.lit("path:"), "file", F.lit("::x")).alias("ref"), F.lit(0).alias("start"), F.lit(9).alias("end"), F.lit("alias").alias("target"), F.col("start").alias("pstart"), (F.col("start") + 1).alias("pend"))
    return tape.use_targets(binds, aliases).select("file", "start", "target")


@query(f"SELECT file, CAST(pos AS INTEGER) AS pos, text, regexp_replace(regexp_replace(text, '^[\"''`]', ''), '[\"''`]$', '') AS bare, text IN ('.', ',') AS mark, regexp_matches(text, '^[A-Za-z_$][A-Za-z0-9_$]*$') AS name FROM {SPANS}")
def token_kinds(spark, sf_dir):
    t = F.col("text")
    return tape.spans(turns(spark, sf_dir)).select("file", F.col("pos").cast("int").alias("pos"), "text", texts.unquoted(t).alias("bare"), t.isin(".", ",").alias("mark"), t.rlike("^[A-Za-z_$][A-Za-z0-9_$]*$").alias("name"))


# --- patterns through the automaton ------------------------------------------


def _events(spark, sf_dir, *patterns: str) -> DataFrame:
    lexed = tape.lexed(event_files(spark, sf_dir), tape.WORDS)
    return sequence.grep(lexed, [P.parse(p) for p in patterns]).withColumn("file", F.col("file").cast("bigint"))


_AFTER = f"(SELECT *, min(CASE WHEN tok = 'purchase' THEN pos END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS p1, sum(CASE WHEN tok = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) AS clicks FROM {SEQ})"


@query(scanned(f"SELECT file, pos AS s, CASE WHEN b = 'purchase' THEN pos + 2 WHEN b = 'click' AND c = 'purchase' THEN pos + 3 END AS e FROM {SEQ} WHERE tok = 'signup'"))
def pattern_optional(spark, sf_dir):
    return _events(spark, sf_dir, '(seq "signup" (? "click") "purchase")').select("file", "first", "last")


@query(scanned(f"SELECT x.file, x.pos AS s, min(y.pos) + 1 AS e FROM {SEQ} x JOIN {SEQ} y ON y.file = x.file AND y.pos >= x.pos + 2 AND y.tok = 'purchase' WHERE x.tok = 'signup' AND x.b = 'click' GROUP BY x.file, x.pos"))
def pattern_plus(spark, sf_dir):
    return _events(spark, sf_dir, '(seq "signup" (+ "click") "purchase")').select("file", "first", "last")


@query(scanned(f"SELECT file, pos AS s, p1 + 1 AS e FROM {_AFTER} WHERE tok = 'signup'"))
def pattern_until(spark, sf_dir):
    return _events(spark, sf_dir, '(seq "signup" (until "purchase"))').select("file", "first", "last")


@query(scanned(f"SELECT x.file, x.pos AS s, min(y.pos) + 1 AS e FROM {_AFTER} x JOIN {_AFTER} y ON y.file = x.file AND y.pos > x.pos AND y.tok = 'purchase' AND y.clicks - x.clicks >= 2 WHERE x.tok = 'signup' GROUP BY x.file, x.pos"))
def pattern_bounded_gaps(spark, sf_dir):
    return _events(spark, sf_dir, '(seq "signup" (gaps 2 3 "click") "purchase")').select("file", "first", "last")


_LAST = f"(SELECT a.*, l.most, l.p0 FROM {_AFTER} a JOIN (SELECT file, max(clicks) AS most, min(pos) FILTER (clicks = m) AS p0 FROM (SELECT *, max(clicks) OVER (PARTITION BY file) AS m FROM {_AFTER} WHERE tok = 'purchase') GROUP BY file) l USING (file))"


@query(f"SELECT m.file, m.first, m.last, CAST(e.clicks - s.clicks AS INTEGER) AS n FROM ({scanned(f'''SELECT file, pos AS s, CASE WHEN p0 > pos THEN p0 + 1 ELSE p1 + 1 END AS e FROM {_LAST} WHERE tok = 'signup' AND p1 IS NOT NULL''')}) m JOIN {_AFTER} s ON s.file = m.file AND s.pos = m.first JOIN {_AFTER} e ON e.file = m.file AND e.pos = m.last - 1")
def pattern_most_sites(spark, sf_dir):
    """Of all ways to match from one start, the one with most sites wins, then the shortest."""
    found = _events(spark, sf_dir, '(seq "signup" (* (capture c "click")) "purchase")')
    return found.select("file", "first", "last", F.size("sites.c").alias("n"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, tok||' '||b AS g, b AS x FROM {SEQ} WHERE tok = 'view' AND b IN ('click', 'purchase')")
def pattern_group(spark, sf_dir):
    found = _events(spark, sf_dir, '(capture g (group (seq "view" (capture x (alt "click" "purchase")))))')
    return found.select("file", "first", F.get("sites.g", F.lit(0))["text"].alias("g"), F.get("sites.x", F.lit(0))["text"].alias("x"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first FROM {SEQ} WHERE tok = 'click' AND b = 'error'")
def pattern_token_and_equals(spark, sf_dir):
    return _events(spark, sf_dir, '(seq (token "click") (equals "error"))').select("file", "first")


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, regexp_extract(text, '^(th)(.+)$', 1) AS head, regexp_extract(text, '^(th)(.+)$', 2) AS tail, CAST(start + 2 AS INTEGER) AS at FROM {SPANS} WHERE regexp_matches(text, '^th.+$')")
def pattern_named_groups(spark, sf_dir):
    found = sequence.grep(tape.lexed(turns(spark, sf_dir).select("file", "text"), tape.WORDS), [P.parse('(regex "^(?P<head>th)(?P<tail>.+)$")')])
    one = lambda n: F.get(F.col("sites")[n], F.lit(0))
    return found.select("file", "first", one("head")["text"].alias("head"), one("tail")["text"].alias("tail"), one("tail")["start"].alias("at"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, b FROM (SELECT *, lead(text) OVER (PARTITION BY file ORDER BY pos) AS b FROM {SPANS}) WHERE text = 'the' AND start % 2 = 0 AND b <> 'the'")
def pattern_reference(spark, sf_dir):
    """Tokens by what they are bound to: every article that begins at an even byte."""
    lexed = tape.lexed(turns(spark, sf_dir).select("file", "text"), tape.WORDS)
    targets = tape.spans(turns(spark, sf_dir)).where("text = 'the' AND start % 2 = 0").select("file", "start", "end", F.lit("go:x/y::The").alias("target"))
    found = sequence.grep(lexed, [P.parse('(seq (ref "go:x/y::The") (capture b (not "the")))')], targets)
    return found.select("file", "first", F.get("sites.b", F.lit(0))["text"].alias("b"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, tok AS a FROM {SEQ} WHERE tok = b")
def pattern_macros(spark, sf_dir):
    """A pattern of its own words: def, let, get, fn, progn."""
    e = Expander('(def twice (p) "one, and again" (let q p (seq p (get q))))')
    pat = P.parse("(progn (def same (p) ((fn (x) (twice x)) p)) (same (unify a any)))", e)
    found = sequence.lowered(sequences(spark, sf_dir), pat, overlap=True)
    return found.select("file", "first", F.array_join(F.col("sites")["a"], ", ").alias("a"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first FROM {SEQ} WHERE tok = 'view' AND b = 'error'")
def pattern_as_json(spark, sf_dir):
    """The same pattern from its JSON form, printed and read again."""
    pat = P.parse(P.to_sexp(P.from_json('["seq", "view", {"text": "error"}]')))
    return sequence.lowered(sequences(spark, sf_dir), pat, overlap=True).select("file", "first")


@query(f"SELECT file, CAST(pos AS INTEGER) AS pos FROM (SELECT *, max(CASE WHEN tok = 'signup' THEN pos END) OVER w AS opened, max(CASE WHEN tok = 'error' THEN pos END) OVER w AS dead FROM {SEQ} WINDOW w AS (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE tok = 'purchase' AND NOT (opened IS NOT NULL AND (dead IS NULL OR opened > dead))")
def pattern_not_since(spark, sf_dir):
    """Purchases with no signup before them since the last error."""
    return sequence.not_since(sequences(spark, sf_dir), "signup", "error").where("token = 'purchase'").select("file", "pos")


# --- matchers through the engine ---------------------------------------------


def _search(spark, sf_dir, source: str) -> DataFrame:
    return rules.search(event_files(spark, sf_dir), source, regex=tape.WORDS).withColumn("file", F.col("file").cast("bigint"))


_REGIONS = scanned(f"SELECT file, pos AS s, p1 + 1 AS e FROM {_AFTER} WHERE tok = 'signup'")


@query(f"SELECT e.file, e.start, 'click' AS text FROM ({_REGIONS}) r JOIN {SEQB} e ON e.file = r.file AND e.pos >= r.first AND e.pos < r.last WHERE e.tok = 'click'")
def matcher_under(spark, sf_dir):
    return _search(spark, sf_dir, '(under (seq "signup" (* any) "purchase") "click")').select("file", "start", "text")


@query(f"SELECT e.file, e.start, 'click' AS text FROM ({_REGIONS}) r JOIN {SEQB} e ON e.file = r.file AND e.pos >= r.first AND e.pos < r.last WHERE e.tok = 'click'")
def matcher_as_language(spark, sf_dir):
    return _search(spark, sf_dir, '(as-language "clicks" (seq "signup" (* any) "purchase") "click")').select("file", "start", "text")


@query(f"SELECT file, start, 'view click' AS text FROM {SEQB} WHERE tok = 'view' AND b = 'click' UNION ALL SELECT file, start, 'view' FROM {SEQB} WHERE tok = 'view'")
def matcher_or(spark, sf_dir):
    return _search(spark, sf_dir, '(or (seq "view" "click") "view")').select("file", "start", "text")


@query(f"SELECT file, CAST(start + 5 AS INTEGER) AS start, CAST(start + 10 AS INTEGER) AS \"end\" FROM {SEQB} WHERE tok = 'view' AND b = 'click'")
def matcher_take(spark, sf_dir):
    return _search(spark, sf_dir, '(take b (seq (capture a "view") (capture b "click")))').select("file", "start", "end")


@query(f"SELECT file, n FROM (SELECT file, lang, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'), lambda t: t = 'the')) AS n FROM {FILES}) WHERE n > 0 AND file LIKE 'src1/%' AND file NOT LIKE '%.fr'")
def matcher_and_gate(spark, sf_dir):
    found = rules.search(files(spark, sf_dir), '(and (path "src1/*") (not (path "*.fr")) "the")', regex=tape.WORDS)
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file, n FROM (SELECT file, lang, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'), lambda t: t = 'the')) AS n FROM {FILES}) WHERE n > 0 AND lang = 'en'")
def matcher_lang(spark, sf_dir):
    return rules.search(files(spark, sf_dir), '(lang "en" "the")', regex=tape.WORDS).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file, text, n FROM (SELECT file, w AS text, len(list_filter(regexp_extract_all(d.text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]'), lambda t: t = w)) AS n FROM {FILES} d JOIN (VALUES ('src1/', 'the'), ('src2/', 'and')) v(p, w) ON starts_with(file, p)) WHERE n > 0")
def matcher_gated_arms(spark, sf_dir):
    found = rules.search(files(spark, sf_dir), '(or (path "src1/*" "the") (path "src2/*" "and"))', regex=tape.WORDS)
    return found.groupBy("file", "text").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 0, 's') AS title FROM pages WHERE regexp_matches(html, '<title>.*?</title>', 's')")
def matcher_node(spark, sf_dir):
    """Syntax nodes as matches: the title element of each page."""
    own = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file"), F.col("html").alias("text"))
    found = rules.search(own, '(node "title")', nodes=trees.nodes(own, "html"))
    return found.select(F.col("file").cast("bigint").alias("page_id"), F.col("text").alias("title"))


# --- columns -----------------------------------------------------------------


@query("SELECT page_id, CASE WHEN p = '' OR p = '.' THEN './' WHEN starts_with(p, './') OR starts_with(p, '../') OR starts_with(p, '/') THEN p ELSE './'||p END AS normal, regexp_extract(rtrim(p, '/'), '[^/]*$') AS last, CASE WHEN strpos(rtrim(p, '/'), '/') > 0 THEN regexp_replace(rtrim(p, '/'), '/[^/]*$', '') ELSE '' END AS parent, CASE WHEN strpos(p, '/') > 0 THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dir, regexp_replace(regexp_extract(p, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem, regexp_replace('a/'||p||'/b', '/+', '/', 'g') AS joined FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p FROM pages)")
def path_columns(spark, sf_dir):
    p = F.regexp_replace("url", "^[a-z]+://", "")
    own = read_table(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    c = F.col("p")
    return own.select("page_id", paths.normal_path(c).alias("normal"), paths.last_component(c).alias("last"), paths.parent_path(c).alias("parent"), paths.dir_of(c).alias("dir"), paths.stem(c).alias("stem"), paths.join_path(F.lit("a"), c, F.lit("b")).alias("joined"))


@query("SELECT page_id, 'path:'||p AS file_ref, 'path:'||p||'::Sub.'||k||'.x' AS atom_ref, 'x' AS leaf, '[k.y]' AS keyed, regexp_extract(p, '[^/]*$')||'.Sub.'||k||'.x' AS selector, 'path:'||p||'::Sub.'||k||'.x' AS printed FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS p, 'n'||page_id AS k FROM pages)")
def reference_columns(spark, sf_dir):
    own = read_table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("p"), F.concat(F.lit("n"), F.col("page_id").cast("string")).alias("k"))
    name = F.concat(F.lit("Sub."), "k", F.lit(".x"))
    ref = paths.atom_ref(F.col("p"), name)
    return own.select("page_id", paths.file_ref(F.col("p")).alias("file_ref"), ref.alias("atom_ref"), paths.leaf(name).alias("leaf"), paths.leaf(F.lit("Type.[k.y]")).alias("keyed"), paths.selector(ref).alias("selector"), paths.format_reference(paths.parse_reference(ref)).alias("printed"))


@query("SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_]|$)') AS uses_the, md5(regexp_replace(text, '[^\\n]', ' ', 'g')) AS masked, list_filter(['the', 'zzz', 'qqq'], lambda w: strpos(text, w) = 0) AS missing, coalesce(try_cast(left(text, 1) AS INTEGER), 0) AS number, regexp_matches(text, '^\\s*(//|#|--|;|/\\*|\\*)') AS comment, len(regexp_extract_all(text, '\"(?:[^\"\\\\]|\\\\.)*\"|''(?:[^''\\\\]|\\\\.)*''|`[^`]*`')) AS quoted FROM (SELECT doc_id, replace(text, '\\', '/') AS text FROM documents)")
def text_columns(spark, sf_dir):
    own = read_table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\\"), F.lit("/")).alias("t"))
    t = F.col("t")
    quoted = F.size(texts.string_literals(t))
    return own.select("doc_id", texts.uses_identifier(t, "the").alias("uses_the"), F.md5(texts.masked(t).cast("binary")).alias("masked"), texts.missing(t, F.array(F.lit("the"), F.lit("zzz"), F.lit("qqq"))).alias("missing"), texts.lenient_int(F.substring(t, 1, 1)).alias("number"), texts.is_comment_line(t).alias("comment"), quoted.cast("long").alias("quoted"))


@query(f"SELECT file, list(start ORDER BY start) AS starts FROM {SPANS} WHERE text = 'the' GROUP BY file UNION ALL SELECT file, [] FROM {TURN} WHERE file NOT IN (SELECT file FROM {SPANS} WHERE text = 'the')")
def occurrences_of_a_word(spark, sf_dir):
    """Byte starts of a word that stands alone."""
    own = turns(spark, sf_dir)
    return own.select("file", F.coalesce(texts.occurrences(F.col("text"), "the"), F.array().cast("array<int>")).alias("starts"))


@query(f"SELECT file, start, \"end\", text AS identifier FROM {SPANS} WHERE text = 'the'")
def identifier_at_byte(spark, sf_dir):
    """The identifier around a byte inside each article."""
    cells = tape.spans(turns(spark, sf_dir))
    points = cells.where("text = 'the'").select("file", (F.col("start") + 1).alias("at"))
    return tape.identifier_at(points, cells).select("file", "start", "end", "identifier")


@query("SELECT 1 AS k, 'f(a, b.c) + [1]' AS text UNION ALL SELECT 2, 'x = !y;' UNION ALL SELECT 3, 'g(&z)'")
def emitted_tokens(spark, sf_dir):
    rows = [(1, ["f", "(", "a", ",", "b", ".", "c", ")", "+", "[", "1", "]"]), (2, ["x", "=", "!", "y", ";"]), (3, ["g", "(", "&", "z", ")"])]
    return spark.createDataFrame(rows, "k int, t array<string>").select("k", texts.emitted(F.col("t")).alias("text"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN './'||doc_id ELSE '../src1/'||doc_id END AS import, CASE WHEN source = 'src1' THEN './x' ELSE '../'||source||'/x' END AS rebased FROM documents")
def relative_imports(spark, sf_dir):
    """How each file names one of the first source, and how its own import of ``./x`` reads from there."""
    d = read_table(spark, sf_dir, "documents")
    here = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    there = F.concat(F.lit("src1/"), F.col("doc_id").cast("string"))
    return d.select("doc_id", paths.relative_to(here, there).alias("import"), paths.rebased(F.lit("./x"), here, there).alias("rebased"))


@query("SELECT p_partkey, n AS atoms FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN ['a.b', 'c'] WHEN p_partkey % 3 = 1 THEN ['T.'||lower(replace(p_name, ' ', '_'))] ELSE ['a', 'b', 'c.d.e'] END AS n FROM part)")
def name_lists(spark, sf_dir):
    """Commas part atoms, anything else joins names to a path."""
    k = F.col("p_partkey") % 3
    leaf = F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))
    item = lambda t, m: F.struct(t.alias("text"), F.lit(m).alias("before"))
    s = F.lit
    parts = F.when(k == 0, F.array(item(s("a"), ""), item(s("b"), "."), item(s("c"), ", "))).when(k == 1, F.array(item(s("T"), ""), item(leaf, " { "))).otherwise(F.array(item(s("a"), ""), item(s("b"), ","), item(s("c"), ", "), item(s("d"), ") "), item(s("e"), ".")))
    return read_table(spark, sf_dir, "part").select("p_partkey", texts.name_list(parts).alias("atoms"))


@query(f"SELECT file AS unit, string_agg(CASE WHEN regexp_matches(text, '^[0-9]+$') THEN 'LIT('||text||')' WHEN h IS NOT NULL THEN '%r'||h WHEN text = '&' THEN '@path:x::and' ELSE text END, ' ' ORDER BY pos) AS terms FROM (SELECT s.*, CASE WHEN regexp_matches(text, '^[A-Za-z_]') THEN dense_rank() OVER (PARTITION BY file, regexp_matches(text, '^[A-Za-z_]') ORDER BY lo) END AS h FROM (SELECT *, min(pos) OVER (PARTITION BY file, text) AS lo FROM {SPANS}) s) GROUP BY file")
def abstract_projection(spark, sf_dir):
    """Each turn with its names as numbered holes, literals and references marked."""
    cells = tape.spans(turns(spark, sf_dir))
    cls = F.when(F.col("text").rlike("^[0-9]+$"), "number").otherwise("other")
    cells = cells.select(F.col("file").alias("unit"), "pos", "text", cls.alias("cls"), F.when(F.col("text") == "&", "path:x::and").otherwise("").alias("target"), F.when(F.col("text").rlike("^[A-Za-z_]"), F.col("text")).alias("key"))
    holes = similarity.hole_numbers(cells.where("key IS NOT NULL").select("unit", "key", "pos"))
    return similarity.abstract_terms(cells, holes).select("unit", F.array_join("terms", " ").alias("terms"))


@query(f"SELECT file, string_agg(CASE WHEN regexp_matches(text, '^[0-9]+$') THEN chr(27)||'[33m'||text||chr(27)||'[0m' ELSE text END, '' ORDER BY i) AS shown FROM (SELECT file, i, p AS text FROM {PIECES}) GROUP BY file")
def highlighted_texts(spark, sf_dir):
    return sinks.highlighted(turns(spark, sf_dir).select("file", "text"), {"number": "33"}, regex=tape.WORDS).withColumnRenamed("text", "shown")


