"""Token tapes: one ordered row of tokens for each file."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import mapped
from . import spans as spans_of

#: Words and single other characters; no token holds white space.
WORDS = r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"
#: Comments and string literals are one token each.
SOURCE = r"//[^\n]*|/\*(?s:.*?)\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`|:=|[<>!=]=|&&|\|\||[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"


def token_array(text: Column, regex: str = WORDS, atomic: tuple[str, ...] = ()) -> Column:
    """Tokens of a text; ``atomic`` texts are one token each wherever they begin, the longest first."""
    first = [re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", a) for a in sorted(atomic, key=lambda a: (-len(a), a))]
    return F.regexp_extract_all(text, F.lit("(" + "|".join([*first, regex]) + ")"), F.lit(1))


def tokens(files: DataFrame, regex: str = WORDS, atomic: tuple[str, ...] = (), file: str = "file", text: str = "text") -> DataFrame:
    """file, pos, text: one row per token, without a shuffle."""
    return files.select(F.col(file).alias("file"), F.posexplode(token_array(F.col(text), regex, atomic)).alias("pos", "text"))


def spans(files: DataFrame, regex: str = WORDS, file: str = "file", text: str = "text") -> DataFrame:
    """file, pos, text, start, end in bytes: one row per token, without a shuffle."""
    own = lexed(files, regex, file, text).select("file", F.posexplode("tokens").alias("pos", "t"))
    return own.select("file", "pos", F.col("t.text").alias("text"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))


#: Leaf classes by text, checked in order.
CLASSES = (("comment", r"^(//|/\*)"), ("string", "^[\"'`]"), ("number", r"^[0-9]+$"), ("ident", r"^[A-Za-z0-9_]+$"))


def token_class(text: Column, keywords: tuple[str, ...] = ()) -> Column:
    out = F.when(text.isin(*keywords), F.lit("keyword")) if keywords else None
    for name, regex in CLASSES:
        out = (out if out is not None else F).when(text.rlike(regex), F.lit(name))
    return out.otherwise(F.lit("punct"))


def class_counts(files: DataFrame, keywords: tuple[str, ...] = (), tokens: str = "tokens") -> DataFrame:
    """file, cls, n: how many tokens of each class a file has, counted inside its array."""
    names = ["keyword"] * bool(keywords) + [name for name, _ in CLASSES] + ["punct"]
    classes = F.transform(tokens, lambda t: token_class(t, keywords))

    def of(own: Column, name: str) -> Column:
        return F.struct(F.lit(name).alias("cls"), F.size(F.filter(own, lambda x: x == name)).cast("long").alias("n"))

    bound = F.get(F.transform(F.array(classes), lambda c: F.array(*(of(c, n) for n in names))), F.lit(0))
    return files.select("file", F.explode(bound).alias("c")).where("c.n > 0").select("file", "c.cls", "c.n")


def compiled(regex: str) -> re.Pattern:
    """Blanks and words are those of ASCII, as they are where tokens are found without Python."""
    return re.compile(regex, re.ASCII)


TOKENS = "array<struct<text:string,start:int,end:int>>"


def lexed(files: DataFrame, regex: str = SOURCE, file: str = "file", text: str = "text") -> DataFrame:
    """file, text, tokens: a row per file with byte spans, lexed in Arrow batches. Null texts have no tokens."""
    pattern = compiled(regex)
    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def lex(x: str) -> list[dict]:
        wide = not x.isascii()
        out, at, done = [], 0, 0
        for m in pattern.finditer(x):
            a, b = m.span()
            if wide:
                at += len(x[done:a].encode())
                n = len(m[0].encode())
                out.append({"text": m[0], "start": at, "end": at + n})
                at, done = at + n, b
            else:
                out.append({"text": m[0], "start": a, "end": b})
        return out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [lex(x or "") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, kind)], ["file", "text", "tokens"])

    return mapped(files.select(F.col(file).alias("file"), F.col(text).alias("text")), work, f"file string, text string, tokens {TOKENS}")


def without_space(cells: DataFrame) -> DataFrame:
    return cells.where(F.trim("text") != "")


def merged(cells: DataFrame) -> DataFrame:
    """Cells of one span become one: the first type and target that are not empty, by ``seq``, then by name."""
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c) != "", F.struct("seq", c))).alias(c)
    return cells.groupBy("file", "start", "end").agg(first("type"), first("target"))


def attached(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Cells with the target of their span; targets without a cell become cells."""
    both = cells.join(targets.select("file", "start", "end", F.col("target").alias("_t")), ["file", "start", "end"], "full_outer")
    return both.withColumn("target", F.coalesce("_t", "target", F.lit("")) if "target" in cells.columns else F.coalesce("_t", F.lit(""))).drop("_t")


def innermost(cells: DataFrame) -> DataFrame:
    """Distinct spans that strictly contain no other: nothing that starts later or ends earlier lies in them."""
    own = cells.dropDuplicates(["file", "start", "end"])
    after = Window.partitionBy("file").orderBy("start", F.desc("end")).rowsBetween(1, Window.unboundedFollowing)
    return own.withColumn("_next", F.min("end").over(after)).where(F.col("_next").isNull() | (F.col("_next") > F.col("end"))).drop("_next")


def spliced(host: DataFrame, regions: DataFrame, embedded: DataFrame) -> DataFrame:
    """Host cells outside of the regions, and the embedded language's cells of the regions."""
    return spans_of.overlapping(host, regions, "left_anti").unionByName(embedded)


def painted(cells: DataFrame, paints: DataFrame) -> DataFrame:
    """Each cell's class: of its exact span, else of the smallest painted span around it, else its own ``cls``; of equal spans the first class by name."""
    around = spans_of.innermost_cover(cells, paints.select("file", "start", "end", "cls"), "cls")
    return around.withColumn("cls", F.coalesce("cover", "cls")).drop("cover")


def identifier_at(points: DataFrame, cells: DataFrame) -> DataFrame:
    """file, at, start, end, identifier: the identifier around each byte, else the one that ends there."""
    own = cells.where(F.col("text").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).select("file", "start", (F.col("end") + 1).alias("end"), F.col("text").alias("identifier"))
    met = spans_of.containing(points.select("file", "at", F.col("at").alias("start"), (F.col("at") + 1).alias("end")), own)
    best = met.groupBy("file", "at").agg(F.max(F.struct("o_start", "o_end", "o_identifier")).alias("o"))  # of two the one that begins at the byte
    return best.select("file", "at", F.col("o.o_start").alias("start"), (F.col("o.o_end") - 1).alias("end"), F.col("o.o_identifier").alias("identifier"))


def use_targets(binds: DataFrame, aliases: DataFrame) -> DataFrame:
    """file, start, end, target: an alias wins over a bind of the same span, its path token over its whole span."""
    a = aliases.withColumn("file", F.regexp_replace(F.regexp_replace("ref", "^path:", ""), "::.*$", ""))
    token = F.col("pend") > F.col("pstart")
    a = a.select("file", F.when(token, F.col("pstart")).otherwise(F.col("start")).alias("start"), F.when(token, F.col("pend")).otherwise(F.col("end")).alias("end"), "target", F.lit(0).alias("rank"))
    b = binds.select("file", "start", "end", F.col("target_ref").alias("target"), F.lit(1).alias("rank"))
    return a.unionByName(b).where("end > start").groupBy("file", "start", "end").agg(F.min_by("target", F.struct("rank", "target")).alias("target"))
