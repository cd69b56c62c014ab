"""String literals of several languages: what they hold, and from where in the source each character of it comes."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType


@dataclass(frozen=True)
class Strings:
    """How a language writes strings: prefixes, quotes (the longest first), which quotes or prefixes are raw, and its escapes."""

    prefixes: str  # letters that may stand before a quote
    quotes: tuple[str, ...]
    raw_quotes: tuple[str, ...] = ()
    raw_prefix: str = ""
    escapes: tuple[tuple[str, str], ...] = ()  # letter after the backslash, and what both stand for
    codes: str = ""  # x: \\xhh, o: octal, u: \\uhhhh, U: \\Uhhhhhhhh, N: \\N{name}, b: \\u{h...}, us: several u
    joins_lines: bool = False  # a backslash before a line's end stands for nothing
    keeps_unknown: bool = False  # an unknown escape stands for itself, else for its letter
    block: str = ""  # quotes whose first line and common blanks do not count


_COMMON = (("n", "\n"), ("t", "\t"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ("\\", "\\"), ("'", "'"), ('"', '"'))
#: The forms of each language.
LANGUAGES = {
    "python": Strings("rRbBuUfFtT", ('"""', "'''", '"', "'"), (), "rR", (*_COMMON, ("a", "\a"), ("v", "\v")), "xouUN", True, True),
    "go": Strings("", ('"', "'", "`"), ("`",), "", (*_COMMON, ("a", "\a"), ("v", "\v")), "xouU"),
    "java": Strings("", ('"""', '"', "'"), (), "", (*_COMMON, ("s", " ")), "ou", True, False, '"""'),
    "typescript": Strings("", ('"', "'", "`"), (), "", (*_COMMON, ("v", "\v"), ("0", "\0")), "xub", True),
}
_OCTAL = re.compile(r"[0-7]{1,3}")


def _code(text: str, at: int, s: Strings) -> tuple[str, int] | None:
    """What the escape whose letter is at ``at`` stands for, by a number or a name, and where it ends."""
    letter = text[at]
    if letter == "x" and "x" in s.codes and re.fullmatch("[0-9A-Fa-f]{2}", text[at + 1 : at + 3]):
        return chr(int(text[at + 1 : at + 3], 16)), at + 3
    if letter == "u" and "b" in s.codes and (m := re.compile(r"\{([0-9A-Fa-f]{1,6})\}").match(text, at + 1)):
        return chr(min(int(m[1], 16), 0x10FFFF)), m.end()
    if letter in "uU" and letter in s.codes:
        n = 4 if letter == "u" else 8
        digits = text[at + 1 : at + 1 + n]
        if re.fullmatch(f"[0-9A-Fa-f]{{{n}}}", digits) and int(digits, 16) <= 0x10FFFF:
            return chr(int(digits, 16)), at + 1 + n
    if letter == "N" and "N" in s.codes and (m := re.compile(r"\{([^}]+)\}").match(text, at + 1)):
        try:
            return unicodedata.lookup(m[1]), m.end()
        except KeyError:
            return None
    if "o" in s.codes and (m := _OCTAL.match(text, at)):
        return chr(int(m[0], 8)), m.end()
    return None


def parts_of(literal: str, language: str) -> tuple[str, str, bool] | None:
    """Prefix, quote, and whether the literal is closed; None for what is no literal of the language."""
    s = LANGUAGES[language]
    prefix = re.match(f"[{s.prefixes}]{{0,2}}" if s.prefixes else "", literal)[0]
    quote = next((q for q in s.quotes if literal.startswith(q, len(prefix))), None)
    if quote is None:
        return None
    return prefix, quote, len(literal) >= len(prefix) + 2 * len(quote) and literal.endswith(quote)


def content(literal: str, language: str) -> tuple[str, list[int]] | None:
    """What a literal holds, and the place in it that each character comes from; None for what is no literal.

    One that is not closed holds what is there. An escape that means nothing stands as the language has it. In halves
    of surrogate pairs, both together are one character.
    """
    found = parts_of(literal, language)
    if found is None:
        return None
    s, (prefix, quote, closed) = LANGUAGES[language], found
    at, end = len(prefix) + len(quote), len(literal) - (len(quote) if closed else 0)
    raw = quote in s.raw_quotes or any(c in s.raw_prefix for c in prefix)
    out: list[str] = []
    places: list[int] = []
    skip = _margins(literal, at, end) if quote == s.block else set()
    while at < end:
        c, start = literal[at], at
        if at in skip:
            at += 1
            continue
        if c != "\\" or raw or at + 1 >= end:
            at += 1
            if raw and c == "\r" and quote in s.raw_quotes:
                continue
        else:
            letter = literal[at + 1]
            known = dict(s.escapes).get(letter)
            if letter == "\n" and s.joins_lines:
                at += 2
                continue
            code = _code(literal, at + 1, s)
            if code and not (known is not None and letter == "0" and not literal[at + 2 : at + 3].isdigit()):
                c, at = code
            elif known is not None:
                c, at = known, at + 2
            else:
                c, at = ("\\" + letter if s.keeps_unknown else letter), at + 2
        for k, x in enumerate(c):
            if out and 0xDC00 <= ord(x) < 0xE000 and 0xD800 <= ord(out[-1]) < 0xDC00:
                out[-1] = chr(0x10000 + (ord(out[-1]) - 0xD800 << 10) + ord(x) - 0xDC00)
                continue
            out.append(x)
            places.append(start + (k if len(c) > 1 else 0))
    return "".join(out), places


def _margins(literal: str, at: int, end: int) -> set[int]:
    """Places in a text block that do not count: its first line, and the blanks that all lines begin with, or end with."""
    first = literal.find("\n", at, end)
    skip = set(range(at, first + 1 if first >= 0 else at))
    lines, start = [], first + 1 if first >= 0 else at
    while start <= end:
        stop = literal.find("\n", start, end)
        stop = end if stop < 0 else stop
        lines.append((start, stop))
        start = stop + 1
    indent = min((len(literal[a:b]) - len(literal[a:b].lstrip(" \t")) for a, b in lines if literal[a:b].strip() or b == end), default=0)
    for a, b in lines:
        skip |= set(range(a, min(a + indent, b))) | set(range(a + len(literal[a:b].rstrip(" \t")), b))
    return skip


def string_content(literal: Column, language: str) -> Column:
    """struct<text, places>: what a literal holds and the characters of it that each comes from; null for what is no literal, or null."""
    kind = StructType([StructField("text", StringType()), StructField("places", ArrayType(IntegerType()))])

    @F.pandas_udf(kind)
    def read(x: pd.Series) -> pd.DataFrame:
        rows = [content(v, language) if v is not None else None for v in x]
        # halves of pairs that stand alone are no text
        texts = [r[0].encode("utf-8", "replace").decode() if r else None for r in rows]
        return pd.DataFrame({"text": pd.Series(texts, dtype=object), "places": pd.Series([r[1] if r else None for r in rows], dtype=object)})

    found = read(literal)
    return F.when(found["text"].isNotNull(), found)


def is_string(literal: Column, language: str) -> Column:
    """Whether a text is a closed literal of a language."""

    @F.pandas_udf(BooleanType())
    def closed(x: pd.Series) -> pd.Series:
        return pd.Series([bool(v and (p := parts_of(v, language)) and p[2]) for v in x])

    return closed(literal)
