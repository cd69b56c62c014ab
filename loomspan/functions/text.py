"""Columns on source text; offsets are UTF-8 bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_substring(text: Column, start: Column, end: Column) -> Column:
    return F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")


def slice_of(raw: Column, start: Column, end: Column) -> Column:
    """The text of a byte range of an encoded text."""
    return F.decode(F.substring(raw, start + 1, end - start), "UTF-8")


def line_of(text: Column, at: Column) -> Column:
    """1-based line of a byte offset."""
    prefix = byte_substring(text, F.lit(0), at)
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit("\n"))) + 1).cast("int")


def column_of(text: Column, at: Column) -> Column:
    """1-based byte column of a byte offset."""
    prefix = byte_substring(text, F.lit(0), at)
    return (F.octet_length(F.substring_index(prefix, "\n", -1)) + 1).cast("int")


def uses_identifier(text: Column, name: str) -> Column:
    return text.rlike(f"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])")


def unquoted(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`]|[\"'`]$", "")


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[\p{L}_$][\p{L}\p{N}_$]*$")


def is_comment_line(text: Column) -> Column:
    return text.rlike(r"^\s*(//|#|--|;|/\*|\*)")


def string_literals(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'|`[^`]*`)'), F.lit(1))


def masked(text: Column) -> Column:
    """All but line ends as blanks."""
    return F.regexp_replace(text, r"[^\n]", " ")


def missing(text: Column, wanted: Column) -> Column:
    """The strings of an array that a text lacks."""
    return F.filter(wanted, lambda w: F.instr(text, w) == 0)


def lenient_int(text: Column) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(0))


def occurrences(text: Column, word: str, whole: bool = True) -> Column:
    """Byte starts of a word, in order; ``whole``: with no identifier character beside it."""
    around = f"(?<![A-Za-z0-9_]){re.escape(word)}(?![A-Za-z0-9_])" if whole else re.escape(word)
    parts = F.split(text, around)
    sizes = F.transform(parts, lambda p: F.octet_length(p))
    n = len(word.encode())
    nth = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(nth, lambda k: (F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda a, x: a + x) + (k - 1) * n).cast("int")) if word else F.array().cast("array<int>")


def term(text: Column, cls: Column, target: Column, hole: Column | None = None) -> Column:
    """The abstract term of a token: hole, reference, literal or the text itself; null for comments."""
    plain = (
        F.when(target != "", F.when(target.startswith("@"), target).otherwise(F.concat(F.lit("@"), target)))
        .when(cls == "comment", F.lit(None))
        .when(cls.isin("string", "number"), F.concat(F.lit("LIT("), text, F.lit(")")))
        .otherwise(text)
    )
    return plain if hole is None else F.when(hole.isNotNull(), F.concat(F.lit("%r"), hole.cast("string"))).otherwise(plain)


def name_list(parts: Column) -> Column:
    """Names of a list of names (array of struct<text, before>): after a comma a new one begins, after anything else the last one goes on."""

    def add(acc: Column, x: Column) -> Column:
        new = (F.size(acc) == 0) | x["before"].rlike(r"^\s*,\s*$")
        last = F.concat(F.get(acc, F.size(acc) - 1), F.lit("."), x["text"])
        return F.when(new, F.array_append(acc, x["text"])).otherwise(F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), last))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def qualified(text: Column, names: Column, qualifier: Column) -> Column:
    """A text with ``qualifier.`` before each identifier of ``names`` that has no dot before it."""
    word = lambda n: F.concat(F.lit(r"(?<![A-Za-z0-9_.])"), n, F.lit(r"(?![A-Za-z0-9_])"))
    return F.when(qualifier == "", text).otherwise(F.aggregate(names, text, lambda acc, n: F.regexp_replace(acc, word(n), F.concat(qualifier, F.lit("."), n))))


def dedented(text: Column) -> Column:
    """A text whose lines lose the blanks that the first line begins with."""
    blanks = F.length(F.regexp_extract(text, r"^([ \t]*)", 1))
    lines = F.transform(F.split(text, "\n"), lambda l: F.substring(l, 1 + F.least(blanks, F.length(F.regexp_extract(l, r"^([ \t]*)", 1))), F.length(l)))
    return F.array_join(lines, "\n")


#: Tokens that stand without a blank before or after them.
_TIGHT_BEFORE = (",", ".", ")", "]", ";", ":", "}")
_TIGHT_AFTER = (".", "(", "[", "{", "!", "&", "*")


def emitted(tokens: Column) -> Column:
    """Tokens as text with a blank between those that need one."""
    def add(acc: Column, t: Column) -> Column:
        tight = t["x"].isin(*_TIGHT_BEFORE) | acc.endswith("(") | F.substring(acc, -1, 1).isin(*_TIGHT_AFTER) | ((t["x"] == "(") & acc.rlike(r"[A-Za-z0-9_\])]$"))
        return F.when((acc == "") | tight, F.concat(acc, t["x"])).otherwise(F.concat(acc, F.lit(" "), t["x"]))

    return F.aggregate(F.transform(tokens, lambda t: F.struct(t.alias("x"))), F.lit(""), add)
