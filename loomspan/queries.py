"""The engine's queries on the supplied tables, each with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import model, queries_graph, queries_moves, queries_syntax, queries_text  # noqa: F401  all but the first add their queries
from .functions import paths, text as texts
from .operators import graph, relations, rules, sequence, similarity, spans, tape
from .plans import pattern as P
from .plans.rules import load
from .sources import files as sources
from .sources import ignore, sinks, trees
from .registry import FILES, IV, LEAD, ORACLE, PIECES, QUERIES, SEQ, SPANS, TAPE, TOK, TURN, docs, files, intervals, query, sequences, turns  # noqa: F401
from .storage import read_table, shared_dir, staged, unbounded  # noqa: F401
from .streaming import files as streams

# --- sources -----------------------------------------------------------------


@query(f"SELECT file, size, lang FROM {FILES}")
def scan_documents_as_files(spark, sf_dir):
    return files(spark, sf_dir).select("file", F.col("size").cast("int").alias("size"), "lang")


@query(f"SELECT file FROM {FILES} WHERE regexp_matches(file, '^src1/[^/]*$') OR (regexp_matches(file, '[.]fr$') AND NOT regexp_matches(file, '^src2/'))")
def path_gate_glob(spark, sf_dir):
    from .plans import matcher as M

    gate = M.parse('(or (path "src1/*") (and (path "*.fr") (not (path "src2/**"))))')
    return files(spark, sf_dir).where(rules.gate_column(gate)).select("file")


_IGNORE = "src1*\n!src12/\n*.de\n!src3/*.de\n# comment\nsrc5/**\n"


@query(f"""SELECT file, CASE WHEN regexp_matches(file, '^src5/.+') THEN true WHEN regexp_matches(file, '^src3/[^/]*[.]de$') THEN false
  WHEN regexp_matches(file, '[.]de$') THEN true WHEN regexp_matches(file, '^src12/') THEN false WHEN regexp_matches(file, '^src1') THEN true ELSE false END AS ignored FROM {FILES}""")
def ignore_last_match_wins(spark, sf_dir):
    return ignore.decide(files(spark, sf_dir), ignore.collect(gitignores={"": _IGNORE})).select("file", "ignored")


@query(f"SELECT file, size * 40 AS size FROM {FILES} WHERE size * 40 <= 262144")
def large_file_guard(spark, sf_dir):
    """Each text forty times over: long ones are beyond the bound."""
    big = files(spark, sf_dir).select("file", F.repeat("text", 40).alias("text"))
    return sources.guarded(big.withColumn("size", F.octet_length("text"))).select("file", F.col("size").cast("int").alias("size"))


@query(f"SELECT file, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' END AS lang FROM {FILES}")
def language_by_glob(spark, sf_dir):
    return graph.languages(files(spark, sf_dir).drop("lang"), None, [("*.en", "english"), ("*.de", "german")]).select("file", "lang")


@query(f"""WITH f AS (SELECT file, doc_id, split_part(file, '/', 1) AS source, lang FROM {FILES}) SELECT a.file, './'||(a.doc_id + 20)||'.'||a.lang AS spec, b.file AS base
  FROM f a JOIN f b ON b.source = a.source AND b.lang = a.lang AND b.doc_id = a.doc_id + 20""")
def import_resolution(spark, sf_dir):
    f = files(spark, sf_dir)
    imports = f.select("file", F.concat(F.lit("./"), (F.col("doc_id") + 20).cast("string"), F.lit("."), "lang").alias("spec"))
    return graph.resolved_specs(imports, f)


@query("""SELECT doc_id AS file, CASE WHEN doc_id % 5 = 0 THEN 'third' WHEN doc_id % 3 = 0 THEN 'second' ELSE md5(text) END AS digest FROM documents WHERE doc_id % 7 <> 0""")
def overlay_layers(spark, sf_dir):
    base = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.md5("text").alias("text"))
    second = base.where("file % 3 = 0").withColumn("text", F.lit("second"))
    third = base.where("file % 5 = 0").withColumn("text", F.lit("third"))
    gone = base.where("file % 7 = 0").withColumn("text", F.lit(None).cast("string"))
    return sources.layered([base, second, third, gone]).withColumnRenamed("text", "digest")


# --- tape --------------------------------------------------------------------


@query(f"SELECT file, CAST(pos AS INTEGER) AS pos, tok AS text FROM {TAPE}")
def tape_tokens(spark, sf_dir):
    return tape.tokens(docs(spark, sf_dir))


@query(f"SELECT * FROM {SPANS}")
def tape_spans(spark, sf_dir):
    return tape.spans(turns(spark, sf_dir)).select("file", F.col("pos").cast("int").alias("pos"), "text", "start", "end")


@query("SELECT tok AS token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '\\*\\*\\*|\\$\\$\\$|###|%%%|&&&|[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS tok FROM documents) GROUP BY tok")
def tape_atomic_tokens(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return tape.tokens(d.withColumnRenamed("doc_id", "file"), atomic=("***", "$$$", "###", "%%%", "&&&")).groupBy(F.col("text").alias("token")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file, CASE WHEN tok IN ('the', 'and', 'of') THEN 'keyword' WHEN regexp_matches(tok, '^[0-9]+$') THEN 'number' WHEN regexp_matches(tok, '^[A-Za-z0-9_]+$') THEN 'ident' WHEN regexp_matches(tok, '^[\"''`]') THEN 'string' ELSE 'punct' END AS cls, count(*) AS n FROM {TAPE} GROUP BY ALL")
def tape_class_counts(spark, sf_dir):
    return tape.class_counts(docs(spark, sf_dir), ("the", "and", "of"))


@query(f"SELECT file, idx FROM {IV} a WHERE NOT EXISTS (SELECT 1 FROM {IV} b WHERE b.file = a.file AND b.s >= a.s AND b.e <= a.e AND (b.s > a.s OR b.e < a.e))")
def span_prefer_innermost(spark, sf_dir):
    own = intervals(spark, sf_dir)
    return own.join(tape.innermost(own.select("file", "start", "end")), ["file", "start", "end"], "left_semi").select("file", "idx")


# --- patterns ----------------------------------------------------------------


def _grep(files: DataFrame, source: str, overlap: bool = True) -> DataFrame:
    return sequence.lowered(files, P.parse(source), overlap=overlap)


def _site(name: str) -> F.Column:
    return F.array_join(F.col("sites")[name], ", ").alias(name)


@query(f"SELECT file, CAST(pos AS INTEGER) AS first FROM {LEAD} WHERE tok = 'of' AND b = 'the'")
def pattern_literal_seq(spark, sf_dir):
    return _grep(docs(spark, sf_dir), '(seq "of" "the")').select("file", "first")


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, tok AS a, c AS b FROM {LEAD} WHERE b = ',' AND c IS NOT NULL")
def pattern_seq_capture(spark, sf_dir):
    return _grep(docs(spark, sf_dir), '(seq (capture a any) "," (capture b any))').select("file", "first", _site("a"), _site("b"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, CASE WHEN tok = 'the' THEN b ELSE '' END AS n FROM {LEAD} WHERE (tok = 'the' AND b IS NOT NULL) OR (tok = 'and' AND b = 'of')")
def pattern_alt(spark, sf_dir):
    return _grep(docs(spark, sf_dir), '(alt (seq "the" (capture n any)) (seq "and" "of"))').select("file", "first", _site("n"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, tok AS w FROM {TAPE} WHERE regexp_matches(tok, '^th.*on$')")
def pattern_regex_unit(spark, sf_dir):
    return _grep(docs(spark, sf_dir), '(capture w (regex "^th.*on$"))').select("file", "first", _site("w"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, regexp_extract(text, '^th(.+)on$', 1) AS mid FROM {SPANS} WHERE regexp_matches(text, '^th(.+)on$')")
def pattern_regex_group(spark, sf_dir):
    """A group of a regex as the site, through the automaton."""
    lexed = tape.lexed(turns(spark, sf_dir).select("file", "text"), tape.WORDS)
    found = sequence.grep(lexed, [P.parse('(capture mid (regex "^th(.+)on$" 1))')])
    return found.select("file", "first", F.get("sites.mid", F.lit(0))["text"].alias("mid"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, b AS w FROM {LEAD} WHERE tok = 'the' AND NOT regexp_matches(b, '^[a-n]')")
def pattern_not_unit(spark, sf_dir):
    return _grep(docs(spark, sf_dir), '(seq "the" (capture w (not (regex "^[a-n]"))))').select("file", "first", _site("w"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, tok AS a FROM {LEAD} WHERE tok = b")
def pattern_unify(spark, sf_dir):
    return _grep(docs(spark, sf_dir), "(seq (unify a any) (unify a any))").select("file", "first", _site("a"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first FROM {SEQ} WHERE tok = 'view' AND b = 'view' AND c = 'view'")
def pattern_rep_n(spark, sf_dir):
    return _grep(sequences(spark, sf_dir), '(rep 3 "view")').select("file", "first")


@query(f"SELECT file, CAST(pos AS INTEGER) AS first FROM {SEQ} WHERE tok = 'purchase' AND coalesce(z, '') <> 'error'")
def pattern_lookbehind(spark, sf_dir):
    return _grep(sequences(spark, sf_dir), '(seq (assert_not_behind "error") "purchase")').select("file", "first")


@query(f"""SELECT file, CAST(min(pos) AS INTEGER) AS first, CAST(nxt AS INTEGER) AS last FROM (SELECT file, pos, tok,
  min(CASE WHEN tok = 'purchase' THEN pos + 1 END) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM {SEQ})
  WHERE tok = 'signup' AND nxt IS NOT NULL GROUP BY file, nxt""")
def pattern_gap_star(spark, sf_dir):
    """The automaton on events: the scan of ``signup ... purchase`` takes the shortest match from the left."""
    seqs = sequences(spark, sf_dir)
    rows = seqs.select(F.col("file").cast("string").alias("file"), F.lit("").alias("text"), F.transform("tokens", lambda t: F.struct(t.alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end"))).alias("tokens"))
    found = sequence.grep(rows.withColumn("text", F.array_join(F.transform("tokens", lambda t: t["text"]), " ")), [P.parse('(seq "signup" (* any) "purchase")')])
    return found.select(F.col("file").cast("bigint").alias("file"), "first", "last")


@query(f"""SELECT file, CAST(unnest(list_reduce(list_prepend([-2], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN x[1] > a[-1] + 1 THEN list_concat(a, x) ELSE a END)[2:]) AS INTEGER) AS first
  FROM (SELECT file, list(CAST(pos AS INTEGER) ORDER BY pos) AS l FROM {SEQ} WHERE tok = 'click' AND b = 'click' GROUP BY file)""")
def pattern_nonoverlap_scan(spark, sf_dir):
    return _grep(sequences(spark, sf_dir), '(seq "click" "click")', overlap=False).select("file", "first")


@query(f"SELECT file, 0 AS pattern, CAST(pos AS INTEGER) AS first FROM {SEQ} WHERE tok = 'view' AND b = 'click' UNION ALL SELECT file, 1, CAST(pos AS INTEGER) FROM {SEQ} WHERE tok = 'error' AND b = 'signup'")
def pattern_multi_fused(spark, sf_dir):
    seqs = sequences(spark, sf_dir)
    toks = F.transform("tokens", lambda t: F.struct(t.alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    rows = seqs.select(F.col("file").cast("string").alias("file"), F.array_join("tokens", " ").alias("text"), toks.alias("tokens"))
    found = sequence.grep(rows, [P.parse('(seq "view" "click")'), P.parse('(seq "error" "signup")')])
    return found.select(F.col("file").cast("bigint").alias("file"), "pattern", "first")


@query(f"SELECT file, start, \"end\", text FROM (SELECT *, lead(text) OVER w AS b, lead(\"end\", 2) OVER w AS x FROM {SPANS} WINDOW w AS (PARTITION BY file ORDER BY pos)) WHERE text = 'of' AND b = 'the'")
def pattern_spans_in_bytes(spark, sf_dir):
    found = rules.search(turns(spark, sf_dir).select("file", "text"), '(take a (seq (capture a "of") "the"))', regex=tape.WORDS)
    return found.select("file", "start", "end", F.lit("of").alias("text"))


# --- matchers ----------------------------------------------------------------


@query(f"SELECT file, line, count(*) AS n FROM (SELECT file, CAST(1 + coalesce(sum(length(p) - length(replace(p, chr(10), ''))) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS line, p FROM {PIECES}) WHERE p = 'the' GROUP BY ALL")
def tokens_by_line(spark, sf_dir):
    """Tokens inside the spans of lines."""
    own_turns = turns(spark, sf_dir)
    cells = tape.spans(own_turns).where("text = 'the'")
    own = own_turns.select("file", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = own.select("file", "line", F.coalesce(F.sum(F.octet_length("t") + 1).over(before), F.lit(0)).cast("int").alias("start"), F.octet_length("t").alias("n"))
    lines = lines.select("file", (F.col("line") + 1).cast("int").alias("idx"), "start", (F.col("start") + F.col("n")).cast("int").alias("end"))
    both = spans.containing(cells.select("file", "start", "end"), lines)
    return both.groupBy("file", F.col("o_idx").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first, c AS last_site FROM {LEAD} WHERE b = ',' AND c IS NOT NULL")
def capture_last_site(spark, sf_dir):
    m = _grep(docs(spark, sf_dir), '(seq (capture x any) "," (capture x any))')
    return m.select("file", "first", F.element_at(F.col("sites")["x"], -1).alias("last_site"))


@query(f"SELECT file, CAST(pos AS INTEGER) AS first FROM {SEQ} WHERE tok = 'view' AND b = 'click' UNION ALL SELECT file, CAST(pos AS INTEGER) FROM {SEQ} WHERE tok = 'view'")
def union_of_matches(spark, sf_dir):
    own = sequences(spark, sf_dir)
    return _grep(own, '(seq "view" "click")').select("file", "first").unionAll(_grep(own, '"view"').select("file", "first"))


@query()
def html_nodes(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return trees.nodes(pages.withColumn("file", F.col("page_id").cast("string")), "html", text="html").groupBy("file", "type").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"))


# --- spans and edits ---------------------------------------------------------


@query(f"SELECT a.file, a.idx, a.s AS start, a.e AS \"end\", arg_min(b.idx, [b.e - b.s, b.idx]) AS cover FROM {IV} a LEFT JOIN {IV} b ON b.file = a.file AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e) GROUP BY a.file, a.idx, a.s, a.e")
def span_innermost_cover(spark, sf_dir):
    own = intervals(spark, sf_dir).select("file", "idx", "start", "end")
    return spans.innermost_cover(own, own, strict=True)


@query(f"SELECT a.file, a.idx, a.s AS start, a.e AS \"end\", coalesce(arg_min(b.idx, [b.e - b.s, b.idx]), -1) AS parent FROM {IV} a LEFT JOIN {IV} b ON b.file = a.file AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e) GROUP BY a.file, a.idx, a.s, a.e")
def span_parent_nesting(spark, sf_dir):
    return spans.parents(intervals(spark, sf_dir).select("file", "idx", "start", "end"))


@query(f"SELECT file, idx FROM {IV} a WHERE flag = 'N' AND NOT EXISTS (SELECT 1 FROM {IV} b WHERE b.file = a.file AND b.flag = 'R' AND a.s < b.e AND b.s < a.e)")
def span_overlap_antijoin(spark, sf_dir):
    own = intervals(spark, sf_dir)
    return spans.overlapping(own.where("flag = 'N'"), own.where("flag = 'R'"), "left_anti").select("file", "idx")


@query(f"""SELECT file, CAST(min(s) AS INTEGER) AS start, CAST(max(e) AS INTEGER) AS "end" FROM (SELECT *, sum(n) OVER (PARTITION BY file ORDER BY s, e, idx) AS run FROM (SELECT *,
  CASE WHEN s > coalesce(max(e) OVER (PARTITION BY file ORDER BY s, e, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS n FROM {IV})) GROUP BY file, run""")
def span_union_runs(spark, sf_dir):
    return spans.merged_runs(intervals(spark, sf_dir).select("file", "start", "end"))


@query("""SELECT p.user_id, p.event_id AS point, (SELECT arg_max(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts <= p.ts) AS found FROM events p WHERE p.event_type = 'purchase'""")
def asof_scope_at_offset(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    cuts = e.where("event_type = 'signup'").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id"))
    return spans.at_offset(cuts, e.where("event_type = 'purchase'").withColumn("point", F.col("event_id")), "user_id", "ts", "event_id")


@query(f"""WITH RECURSIVE o AS (SELECT file, idx, s, e, row_number() OVER (PARTITION BY file ORDER BY idx, s, e) AS k FROM {IV}),
  r AS (SELECT file, idx, k, [[s, e]] AS taken, true AS applied FROM o WHERE k = 1
  UNION ALL SELECT o.file, o.idx, o.k, CASE WHEN len(list_filter(r.taken, lambda t: t[1] < o.e AND o.s < t[2])) = 0 THEN list_append(r.taken, [o.s, o.e]) ELSE r.taken END, len(list_filter(r.taken, lambda t: t[1] < o.e AND o.s < t[2])) = 0 FROM r JOIN o ON o.file = r.file AND o.k = r.k + 1)
  SELECT file, idx AS seq, applied FROM r""")
def claim_greedy_edits(spark, sf_dir):
    e = intervals(spark, sf_dir).select("file", F.col("idx").alias("seq"), "start", "end", F.lit("x").alias("new_text"))
    return spans.claimed(e).select("file", "seq", "applied")


@query("SELECT doc_id AS file, md5(regexp_replace(text, '\\bthe\\b', 'THE', 'g')) AS digest FROM documents")
def rewrite_token(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), "text")
    new = rules.rewritten(d, '"the"', '"THE"', regex=tape.WORDS)
    return new.select(F.col("file").cast("bigint").alias("file"), F.md5("text").alias("digest"))


@query(f"SELECT file, count(*) AS n, min(start) AS first_start FROM {SPANS} WHERE text = 'the' GROUP BY file")
def rule_findings(spark, sf_dir):
    pack = load('(def article () (regex "^the$")) (rule plain-the warning "an article" (article))')
    found = rules.findings(turns(spark, sf_dir).select("file", "text"), pack, regex=tape.WORDS)
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"))


@query(f"SELECT file, line, CAST(1 + strlen(regexp_extract(head, '[^\\n]*$')) AS INTEGER) AS col FROM (SELECT file, CAST(1 + length(head) - length(replace(head, chr(10), '')) AS INTEGER) AS line, head FROM (SELECT x.file, coalesce(string_agg(y.p, '' ORDER BY y.i), '') AS head FROM {PIECES} x LEFT JOIN {PIECES} y ON y.file = x.file AND y.i < x.i WHERE x.p = 'and' GROUP BY x.file, x.i))")
def line_col_of_match(spark, sf_dir):
    own = turns(spark, sf_dir).select("file", "text")
    hits = tape.spans(own).where("text = 'and'").select("file", "start", "end")
    return sinks.located(hits, own).select("file", "line", "col")


@query(f"SELECT file, pos, text AS snippet FROM {SPANS}")
def byte_substring(spark, sf_dir):
    """Each token cut out of its text by its bytes; the text is encoded once."""
    lexed = tape.lexed(turns(spark, sf_dir).select("file", "text"), tape.WORDS)
    cut = F.transform(F.array(F.encode("text", "UTF-8")), lambda raw: F.transform("tokens", lambda t: texts.slice_of(raw, t["start"], t["end"])))
    return lexed.select("file", F.posexplode(F.get(cut, F.lit(0))).alias("pos", "snippet"))


@query(f"SELECT f.file, coalesce(sum(CASE WHEN f.flag = 'R' THEN 1 + d ELSE 1 END), 0)::BIGINT AS score FROM (SELECT a.*, (SELECT count(*) FROM {IV} b WHERE b.file = a.file AND b.flag IN ('R', 'A') AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e)) AS d FROM {IV} a WHERE a.flag IN ('R', 'A')) f GROUP BY f.file")
def flow_score(spark, sf_dir):
    own = intervals(spark, sf_dir).where("flag in ('R', 'A')")
    flows = own.select("file", "start", "end", F.when(F.col("flag") == "R", "structural").otherwise("hybrid").alias("class"))
    units = own.select("file").distinct().select("file", F.lit(0).alias("idx"), F.lit(0).alias("start"), F.lit(1000).alias("end"))
    return spans.flow_score(flows, units).select("file", "score")


@query(f"WITH v AS (SELECT DISTINCT file, idx, s, e FROM {IV}) SELECT a.file, a.idx, a.s AS start, (SELECT count(*) FROM v b WHERE b.file = a.file AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e))::INTEGER AS depth, CAST(row_number() OVER (PARTITION BY a.file ORDER BY a.s, a.e DESC, a.idx) AS INTEGER) AS ordinal FROM v a")
def outline_preorder(spark, sf_dir):
    own = intervals(spark, sf_dir).select("file", F.col("idx").cast("string").alias("name"), F.lit("line").alias("kind"), "start", "end")
    return graph.outline(own).select("file", F.col("name").cast("int").alias("idx"), "start", "depth", "ordinal")


# --- relations and graphs ----------------------------------------------------


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: read_table(spark, sf_dir, n)
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = t("nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    e = e.union(t("customer").select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return e.union(t("orders").select(name("c", "o_custkey"), name("o", "o_orderkey")))


_EDGES = "(SELECT 'r'||n_regionkey AS parent, 'n'||n_nationkey AS child FROM nation UNION ALL SELECT 'n'||c_nationkey, 'c'||c_custkey FROM customer UNION ALL SELECT 'c'||o_custkey, 'o'||o_orderkey FROM orders)"


@query("SELECT DISTINCT c_name AS customer, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def datalog_join(spark, sf_dir):
    a, c = relations.atom, relations.clause
    program = relations.Program(c(a("lives", "?who", "?where"), a("customer", "?k", "?who", "?n"), a("nation", "?n", "?nn", "?r"), a("region", "?r", "?where")))
    t = lambda n, *cols: read_table(spark, sf_dir, n).select(*cols)
    out = program.evaluate({"customer": t("customer", "c_custkey", "c_name", "c_nationkey"), "nation": t("nation", "n_nationkey", "n_name", "n_regionkey"), "region": t("region", "r_regionkey", "r_name")})["lives"]
    return out.toDF("customer", "region")


@query(f"WITH RECURSIVE p AS (SELECT parent AS ancestor, child AS descendant FROM {_EDGES} UNION SELECT p.ancestor, e.child FROM p JOIN {_EDGES} e ON e.parent = p.descendant) SELECT ancestor, count(*) AS n FROM p GROUP BY ancestor")
def datalog_closure(spark, sf_dir):
    a, c = relations.atom, relations.clause
    program = relations.Program(c(a("path", "?x", "?y"), a("edge", "?x", "?y")), c(a("path", "?x", "?z"), a("path", "?x", "?y"), a("edge", "?y", "?z")))
    path = program.evaluate({"edge": _edges(spark, sf_dir)})["path"].toDF("ancestor", "descendant")
    return path.groupBy("ancestor").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE p AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM {_EDGES} UNION ALL SELECT p.ancestor, e.child, depth + 1 FROM p JOIN {_EDGES} e ON e.parent = p.descendant) SELECT ancestor, CAST(max(depth) AS INTEGER) AS deepest FROM p GROUP BY ancestor")
def closure_depths(spark, sf_dir):
    return relations.closure(_edges(spark, sf_dir), "parent", "child").groupBy("ancestor").agg(F.max("depth").alias("deepest"))


@query("SELECT c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def datalog_negation(spark, sf_dir):
    """Customers none of whose orders is finished."""
    a, c = relations.atom, relations.clause
    program = relations.Program(c(a("idle", "?k"), a("customer", "?k"), a("orders", "?k", "F", negated=True)))
    t = read_table
    return program.evaluate({"customer": t(spark, sf_dir, "customer").select("c_custkey"), "orders": t(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")})["idle"].toDF("customer")


@query("SELECT DISTINCT page_id, 'path:'||url||'::'||part AS ref FROM (SELECT page_id, url, unnest(string_split(url, '/')) AS part FROM pages) WHERE part NOT IN ('', '*', '.', '_')")
def datalog_builtin_lateral(spark, sf_dir):
    a, c = relations.atom, relations.clause
    split = relations.Builtin(1, lambda u: F.transform(F.split(u, "/"), lambda p: F.struct(p.alias("o0"))))
    program = relations.Program(c(a("ref", "?p", "?r"), a("page", "?p", "?u"), a("$split", "?u", "?part"), a("$is_named", "?part"), a("$atom_ref", "?u", "?part", "?r")), builtins=relations.PLAIN | {"$split": split})
    return program.evaluate({"page": read_table(spark, sf_dir, "pages").select("page_id", "url")})["ref"].toDF("page_id", "ref")


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(p_size AS INTEGER) AS start, CAST(p_size + 10 AS INTEGER) AS \"end\", 'dead-imports' AS rule_id FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_linenumber = 1 AND NOT (l_quantity >= p_size AND l_quantity + 1 <= p_size + 10))")
def dead_import_analogue(spark, sf_dir):
    """Parts as imports of their own file, first lines that came back as uses; a use inside the import's span doesn't count."""
    key = lambda c: F.col(c).cast("string")
    i = read_table(spark, sf_dir, "part").select(key("p_partkey").alias("file"), F.concat(F.lit("p"), key("p_partkey")).alias("local"), F.lit("").alias("spec"), F.lit("").alias("member"), F.col("p_size").cast("int").alias("start"), (F.col("p_size") + 10).cast("int").alias("end"), F.lit(0).alias("pstart"), F.lit(0).alias("pend"), F.lit(False).alias("star"))
    u = read_table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_linenumber = 1").select(key("l_partkey").alias("file"), F.concat(F.lit("p"), key("l_partkey")).alias("name"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity") + 1).cast("int").alias("end"))
    found, _ = graph.dead_imports(i, u, u.limit(0))
    return found.select("file", "start", "end", "rule_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s.s_suppkey IS NOT NULL AND s_acctbal > 0 THEN s_name WHEN p_size > 25 THEN p_name END AS target_ref, CAST(CASE WHEN s.s_suppkey IS NOT NULL AND s_acctbal > 0 THEN 0 WHEN p_size > 25 THEN 1 END AS INTEGER) AS step FROM lineitem LEFT JOIN supplier s ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey")
def resolve_priority_ladder(spark, sf_dir):
    uses = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    first = read_table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("target"))
    second = read_table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("target"))
    return graph.binds(uses, [first, second], ["l_suppkey", "l_partkey"]).select("l_orderkey", "l_linenumber", "target_ref", "step")


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS last_event, arg_min(event_id, (ts, event_id)) AS first_event FROM events GROUP BY ALL")
def first_and_last_wins(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    last = graph.first_by(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", F.col("event_id").alias("last_event"))
    first = graph.first_by(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", F.col("event_id").alias("first_event"))
    return last.join(first, ["user_id", "event_type"])


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey HAVING count(*) = 1")
def sole_entity(spark, sf_dir):
    return graph.sole_entity(read_table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1")
def argmax_per_span(spark, sf_dir):
    return graph.first_by(read_table(spark, sf_dir, "documents"), ["source"], F.desc("n_chars"), "doc_id").select("source", "doc_id")


@query(f"""SELECT 'w' AS file, CAST(100 + n_nationkey AS INTEGER) AS scope_idx, leaf, ref FROM nation JOIN (SELECT DISTINCT c_nationkey, c_mktsegment AS leaf, 'n'||c_nationkey||c_mktsegment AS ref FROM customer) ON c_nationkey = n_nationkey
  UNION SELECT 'w', CAST(100 + n_nationkey AS INTEGER), r_name, 'r'||r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'w', CAST(r_regionkey AS INTEGER), r_name, 'r'||r_regionkey FROM region""")
def visible_closure(spark, sf_dir):
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    scopes = region.select(F.lit("w").alias("file"), F.col("r_regionkey").cast("int").alias("idx"), F.lit(-1).alias("parent")).union(nation.select(F.lit("w"), (F.col("n_nationkey") + 100).cast("int"), F.col("n_regionkey").cast("int")))
    c = read_table(spark, sf_dir, "customer").select(F.lit("w").alias("file"), (F.col("c_nationkey") + 100).cast("int").alias("scope_idx"), F.col("c_mktsegment").alias("leaf"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("ref")).distinct()
    r = region.select(F.lit("w").alias("file"), F.col("r_regionkey").cast("int").alias("scope_idx"), F.col("r_name").alias("leaf"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("ref"))
    return graph.visible(scopes, c.unionByName(r)).drop("depth")


@query(f"SELECT child AS ref, r.x AS target FROM {_EDGES} e JOIN (SELECT 'n'||n_nationkey AS k, 'r'||n_regionkey AS x FROM nation UNION ALL SELECT 'c'||c_custkey, 'r'||n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'o'||o_orderkey, 'r'||n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) r ON r.k = e.child")
def canonical_references(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graph.canonical(e.select(F.col("child").alias("ref")), e.select(F.col("child").alias("ref"), F.col("parent").alias("target")))


@query(f"WITH RECURSIVE p AS (SELECT 'r0' AS file, 0 AS round UNION ALL SELECT e.child, p.round + 1 FROM p JOIN {_EDGES} e ON e.parent = p.file) SELECT file, CAST(round AS INTEGER) AS round FROM p")
def seed_reachability(spark, sf_dir):
    seeds = spark.createDataFrame([("r0",)], "parent string")
    return graph.reached(seeds, _edges(spark, sf_dir), "parent", "child")


@query("SELECT 'n'||n_nationkey AS file, CAST(0 AS INTEGER) AS start, CAST(length(n_name) AS INTEGER) AS \"end\", 'renamed' AS new_text FROM nation WHERE n_regionkey = 1 UNION SELECT 's'||s_suppkey, CAST(5 AS INTEGER), CAST(5 + length(n_name) AS INTEGER), 'renamed' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 AND s_acctbal > 0")
def rename_symbol_edits(spark, sf_dir):
    n, s = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "supplier")
    file = F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    atoms = n.select(file.alias("file"), F.col("n_name").alias("name"), F.lit(0).alias("start"), F.length("n_name").cast("int").alias("end"))
    ref = F.concat(F.lit("path:"), file, F.lit("::"), "n_name")
    bound = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"), F.lit(5).alias("start"), (F.length("n_name") + 5).cast("int").alias("end"), ref.alias("target_ref"), (F.col("s_acctbal") <= 0).alias("via_alias"))
    goal = n.where("n_regionkey = 1").select(ref.alias("ref"), F.lit("renamed").alias("new_text"))
    return graph.rename_edits(goal, atoms, bound, model.relation(spark, "alias"))


@query(f"SELECT file, CASE WHEN file LIKE 'src1/%' THEN 'moved/here'||substr(file, 5) ELSE file END AS \"to\" FROM {FILES}")
def moved_folder(spark, sf_dir):
    return graph.moved_paths(files(spark, sf_dir), "src1", "moved/here")


@query("SELECT page_id, lower(split_part(url, ':', 1)) AS provider, substr(url, strpos(url, ':') + 1) AS path, '' AS name FROM pages")
def reference_parse(spark, sf_dir):
    r = paths.parse_reference(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", r["provider"].alias("provider"), r["path"].alias("path"), r["name"].alias("name"))


# --- similarity --------------------------------------------------------------


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select(F.col("file").alias("unit"), tape.token_array(F.col("text")).alias("terms"), "conv_id", "turn")


_UNITS = f"(SELECT file AS unit, unnest(t) AS a, generate_subscripts(t, 1) AS i FROM (SELECT file, {TOK} AS t FROM {TURN}))"
_GRAMS = f"(SELECT unit, a, lead(a) OVER w AS b, lead(a, 2) OVER w AS c FROM {_UNITS} WINDOW w AS (PARTITION BY unit ORDER BY i))"
_FEATS = f"(SELECT unit, feature, count(*) AS n FROM (SELECT unit, 'u:'||a AS feature FROM {_GRAMS} UNION ALL SELECT unit, 'b:'||a||chr(0)||b FROM {_GRAMS} WHERE b IS NOT NULL UNION ALL SELECT unit, 't:'||a||chr(0)||b||chr(0)||c FROM {_GRAMS} WHERE c IS NOT NULL) GROUP BY ALL)"
_PAIRS = f"(SELECT a.file AS a, b.file AS b FROM {TURN} a JOIN {TURN} b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"
_SCORED = f"""(SELECT p.a, p.b, coalesce(sum(least(x.n, y.n)), 0) AS low, count(y.n) AS inter, (SELECT count(*) FROM f WHERE unit = p.a) AS ka, (SELECT count(*) FROM f WHERE unit = p.b) AS kb, (SELECT sum(n) FROM f WHERE unit = p.a) AS wa, (SELECT sum(n) FROM f WHERE unit = p.b) AS wb
  FROM {_PAIRS} p LEFT JOIN f x ON x.unit = p.a LEFT JOIN f y ON y.unit = p.b AND y.feature = x.feature GROUP BY p.a, p.b)"""
_LOW = f"""(SELECT p.a, p.b, coalesce(s.low, 0) AS low, coalesce(s.inter, 0) AS inter, ka.k AS ka, kb.k AS kb, ka.w AS wa, kb.w AS wb FROM {_PAIRS} p
  LEFT JOIN (SELECT p.a, p.b, sum(least(x.n, y.n)) AS low, count(*) AS inter FROM {_PAIRS} p JOIN f x ON x.unit = p.a JOIN f y ON y.unit = p.b AND y.feature = x.feature GROUP BY p.a, p.b) s ON s.a = p.a AND s.b = p.b
  LEFT JOIN (SELECT unit, count(*) AS k, sum(n) AS w FROM f GROUP BY unit) ka ON ka.unit = p.a LEFT JOIN (SELECT unit, count(*) AS k, sum(n) AS w FROM f GROUP BY unit) kb ON kb.unit = p.b)"""
_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen(feature) + 1), lambda i: CAST('0x'||substr(hex(encode(feature)), 2 * i - 1, 2) AS UHUGEINT))), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)"
_SIM = "(SELECT unit, " + " + ".join(f"CASE WHEN sum(CASE WHEN (h >> {b}) & 1 = 1 THEN n ELSE -n END) > 0 THEN {1 << b}::HUGEINT ELSE 0::HUGEINT END" for b in range(64)) + f" AS bits FROM (SELECT unit, n, h FROM f JOIN (SELECT feature, CAST({_FNV} AS UBIGINT) AS h FROM (SELECT DISTINCT feature FROM f)) USING (feature)) GROUP BY unit)"


def _turn_pairs(units: DataFrame) -> DataFrame:
    b = units.select(F.col("unit").alias("b"), "conv_id", (F.col("turn") - 1).alias("turn"))
    return units.select(F.col("unit").alias("a"), "conv_id", "turn").join(unbounded(b), ["conv_id", "turn"]).select("a", "b")


@query(f"SELECT unit, substr(feature, 1, 1) AS kind, count(*) AS distinct_features, CAST(sum(n) AS BIGINT) AS total FROM {_FEATS} GROUP BY ALL")
def ngram_features(spark, sf_dir):
    f = similarity.features(_units(spark, sf_dir))
    return f.groupBy("unit", F.substring("feature", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("distinct_features"), F.sum("n").alias("total"))


@query(f"WITH f AS MATERIALIZED {_FEATS} SELECT a, b, round(inter / (ka + kb - inter), 9) AS jaccard, round(low / (wa + wb - low), 9) AS weighted FROM {_LOW}")
def jaccard_pairs(spark, sf_dir):
    u = _units(spark, sf_dir)
    s = similarity.jaccards(u, _turn_pairs(u))
    return s.select("a", "b", F.round("jaccard", 9).alias("jaccard"), F.round("weighted", 9).alias("weighted"))


@query(f"WITH f AS MATERIALIZED {_FEATS} SELECT unit, CAST(CASE WHEN bits >= 9223372036854775808 THEN bits - 18446744073709551616 ELSE bits END AS BIGINT) AS simhash FROM {_SIM}")
def simhash_fingerprints(spark, sf_dir):
    return similarity.simhash(similarity.features(_units(spark, sf_dir)))


@query(f"WITH f AS MATERIALIZED {_FEATS}, h AS MATERIALIZED {_SIM} SELECT s.a, s.b, round(CASE WHEN x.unit IS NULL OR y.unit IS NULL THEN 0 ELSE 0.85 * (low / (wa + wb - low)) END + CASE WHEN x.unit IS NULL OR y.unit IS NULL THEN 1 ELSE 0.15 END * (1 - bit_count(xor(coalesce(x.bits, 0), coalesce(y.bits, 0))) / 64.0), 9) AS score FROM {_LOW} s LEFT JOIN h x ON x.unit = s.a LEFT JOIN h y ON y.unit = s.b")
def blended_similarity(spark, sf_dir):
    u = _units(spark, sf_dir)
    return similarity.similarities(u, _turn_pairs(u)).select("a", "b", F.round("blended", 9).alias("score"))


@query(f"SELECT unit, a AS key, CAST(row_number() OVER (PARTITION BY unit ORDER BY min(i), a) AS INTEGER) AS hole FROM {_UNITS} WHERE regexp_matches(a, '^[A-Za-z]') GROUP BY unit, a")
def hole_numbering(spark, sf_dir):
    cells = tape.tokens(turns(spark, sf_dir)).where(F.col("text").rlike("^[A-Za-z]"))
    return similarity.hole_numbers(cells.select(F.col("file").alias("unit"), F.col("text").alias("key"), "pos"))


# --- streams -----------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_event_counts(spark, sf_dir):
    """A file stream of events, counted in each micro-batch and summed over batches."""
    events = streams.watch_table(spark, f"{sf_dir}/events.parquet")
    base = shared_dir(spark)
    q = streams.each_batch(events, lambda b: b.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), f"{base}/out", f"{base}/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.sum("n").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_seq_capture(spark, sf_dir)
