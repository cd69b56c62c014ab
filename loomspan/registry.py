"""The table of queries, and the tables and SQL fragments that they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import tape
from .sources import files as sources
from .storage import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.documents_as_files(read_table(spark, sf_dir, "documents"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("file"), "text", tape.token_array(F.col("text")).alias("tokens"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read_table(spark, sf_dir, "conversations")
    return t.select(F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")).alias("file"), "text", "conv_id", "turn")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: the types of their events in order."""
    e = read_table(spark, sf_dir, "events")
    item = F.struct("ts", "event_id", "event_type")
    return e.groupBy(F.col("user_id").alias("file")).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["event_type"]).alias("tokens"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as spans: they nest and overlap."""
    l = read_table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("int").alias("idx"), F.col("l_linenumber").cast("int").alias("start"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int").alias("end"), F.col("l_returnflag").alias("flag"))


FILES = "(SELECT source||'/'||doc_id||'.'||lang AS file, text, CAST(strlen(text) AS INTEGER) AS size, lang, doc_id FROM documents)"
TOK = "regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')"
TAPE = f"(SELECT file, unnest(t) AS tok, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id AS file, {TOK} AS t FROM documents))"
LEAD = f"(SELECT file, pos, tok, lead(tok) OVER w AS b, lead(tok, 2) OVER w AS c, lag(tok) OVER w AS z FROM {TAPE} WINDOW w AS (PARTITION BY file ORDER BY pos))"
SEQ = "(SELECT user_id AS file, event_type AS tok, row_number() OVER w - 1 AS pos, lead(event_type) OVER w AS b, lead(event_type, 2) OVER w AS c, lag(event_type) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"
TURN = "(SELECT conv_id||'/'||turn AS file, text, conv_id, turn FROM conversations)"
PIECES = f"""(SELECT file, i, p, CAST(coalesce(sum(strlen(p)) OVER (PARTITION BY file ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS s
  FROM (SELECT file, unnest(t) AS p, generate_subscripts(t, 1) AS i FROM (SELECT file, regexp_extract_all(text, '\\s+|[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]') AS t FROM {TURN})))"""
SPANS = f"(SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY i) - 1 AS INTEGER) AS pos, p AS text, s AS start, CAST(s + strlen(p) AS INTEGER) AS \"end\" FROM {PIECES} WHERE NOT regexp_matches(p, '^\\s'))"
IV = "(SELECT l_orderkey AS file, l_linenumber AS idx, CAST(l_linenumber AS INTEGER) AS s, CAST(l_linenumber + l_quantity AS INTEGER) AS e, l_returnflag AS flag FROM lineitem)"

SEQB = f"(SELECT *, CAST(coalesce(sum(length(tok) + 1) OVER (PARTITION BY file ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start FROM {SEQ})"


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text per user: the types of their events in order, with a blank between."""
    return sequences(spark, sf_dir).select(F.col("file").cast("string").alias("file"), F.array_join("tokens", " ").alias("text"))


def scanned(rows: str) -> str:
    """SQL for what a scan from left to right takes of the matches (file, s, e): each begins where the last taken one ends, or later."""
    greedy = "list_reduce(list_prepend([[-1, 0]], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN x[1][1] >= a[-1][2] THEN list_concat(a, x) ELSE a END)[2:]"
    return f"SELECT file, CAST(x[1] AS INTEGER) AS first, CAST(x[2] AS INTEGER) AS last FROM (SELECT file, unnest({greedy}) AS x FROM (SELECT file, list([s, e] ORDER BY s) AS l FROM ({rows}) WHERE e IS NOT NULL GROUP BY file))"
