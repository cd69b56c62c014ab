"""Sequence patterns over tapes.

Patterns of bounded length without gaps are lowered to array functions on a file's
tokens: no shuffle, no Python. All others run as automata in Arrow batches, one pass for
any number of patterns, behind a filter on literals that a match must contain.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import mapped
from ..plans import pattern as P
from ..plans.automaton import Match, Program, Token
from ..storage import unbounded

MOST_ARMS = 64


@dataclass
class Arm:
    """One way through a pattern: a unit for each token, sites, and assertions before tokens."""

    units: list
    sites: list  # (name, unify, first, last, group)
    behind: list  # (position, list of arms)


def arms(pat) -> list[Arm] | None:
    """All ways through a pattern of bounded length; None where there are gaps or too many ways."""
    if isinstance(pat, P.Unit):
        return [Arm([pat], [], [])]
    if isinstance(pat, P.Group):
        return arms(pat.body)
    if isinstance(pat, P.Alt):
        own = [arms(x) for x in pat.items]
        return None if None in own or sum(map(len, own)) > MOST_ARMS else [a for o in own for a in o]
    if isinstance(pat, P.Seq):
        out = [Arm([], [], [])]
        for item in pat.items:
            own = arms(item)
            if own is None or len(out) * len(own) > MOST_ARMS:
                return None
            out = [_joined(a, b) for a in out for b in own]
        return out
    if isinstance(pat, P.NotBehind):
        own = arms(pat.body)
        return None if own is None or any(a.behind for a in own) else [Arm([], [], [(0, own)])]
    if isinstance(pat, P.Bind):
        own = arms(pat.body)
        if own is None or pat.name in P.UNNAMED:
            return own
        group = pat.body.group if isinstance(pat.body, P.Unit) and pat.body.kind == "regex" else 0
        return [Arm(a.units, [*a.sites, (pat.name, pat.unify, 0, max(len(a.units) - 1, 0), group)], a.behind) for a in own]
    return None


def _joined(a: Arm, b: Arm) -> Arm:
    n = len(a.units)
    return Arm(a.units + b.units, a.sites + [(m, u, f + n, t + n, g) for m, u, f, t, g in b.sites], a.behind + [(p + n, x) for p, x in b.behind])


def _unit(unit: P.Unit, text: Column) -> Column:
    if unit.kind == "any":
        return F.lit(True)
    if unit.kind == "regex":
        hit = _content(text).rlike(P.java_regex(unit.value))
    elif unit.kind == "content":
        hit = _content(text) == unit.value
    else:
        hit = text == unit.value
    return ~hit if unit.negated else hit


def _content(text: Column) -> Column:
    """A token without its quotes."""
    return F.when(text.rlike("^[\"'`].*[\"'`]$"), F.substring(text, 2, F.length(text) - 2)).otherwise(text)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def lowerable(pat) -> bool:
    """Whether the pattern can run as array functions: no gaps, no references, no named regex groups, no text of several tokens as a site to unify."""
    ways = arms(pat)
    if ways is None or P.uses_refs(pat) or any(not a.units for a in ways):
        return False
    plain = all(not (u.kind == "regex" and ("(?P<" in u.value or (u.group and not u.negated))) for a in ways for u in a.units)
    return plain and all(f == t for a in ways for _, _, f, t, _ in a.sites)


def lowered(files: DataFrame, pat, tokens: str = "tokens", overlap: bool = False) -> DataFrame:
    """file, first, last, sites: matches of a bounded pattern over ``tokens`` (array of strings).

    ``first`` is the 0-based token, ``last`` one past the end, ``sites`` maps names to texts.
    """
    if not lowerable(pat):
        raise P.PatternError("the pattern needs the automaton")
    ways = sorted(enumerate(arms(pat)), key=lambda x: (-len(x[1].sites), len(x[1].units), x[0]))
    names = P.names(pat)

    def hits(toks: Column) -> Column:
        at = lambda i, k: F.get(toks, i + k)

        def fits(a: Arm, i: Column) -> Column:
            here = [(i + len(a.units)) <= F.size(toks), _all([_unit(u, at(i, k)) for k, u in enumerate(a.units)])]
            first: dict[str, int] = {}
            for name, unify, k, _, _ in a.sites:
                if unify and first.setdefault(name, k) != k:
                    here.append(at(i, k) == at(i, first[name]))
            for p, own in a.behind:
                for b in own:
                    n = len(b.units)
                    here.append(~((i + p - n >= 0) & _all([F.coalesce(_unit(u, at(i, p - n + k)), F.lit(False)) for k, u in enumerate(b.units)])))
            return F.coalesce(_all(here), F.lit(False))

        def sites_of(a: Arm, i: Column) -> Column:
            entries = []
            for n in names:
                where = [k for m, _, k, _, _ in a.sites if m == n]
                if any(m == n and u for m, u, *_ in a.sites):
                    where = where[:1]
                entries += [F.lit(n), F.array(*(at(i, k) for k in where)) if where else F.array().cast("array<string>")]
            return F.create_map(*entries) if entries else F.create_map().cast("map<string,array<string>>")

        def hit(i: Column) -> Column:
            out = None
            for _, a in ways:
                row = F.struct(i.alias("first"), (i + len(a.units)).alias("last"), sites_of(a, i).alias("sites"))
                out = (out if out is not None else F).when(fits(a, i), row)
            return out

        starts = F.when(F.size(toks) > 0, F.sequence(F.lit(0), F.size(toks) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, hit), lambda h: h.isNotNull())

    def greedy(found: Column) -> Column:
        none = F.array().cast("array<struct<first:int,last:int,sites:map<string,array<string>>>>")
        step = lambda s, h: F.when(h["first"] >= s["e"], F.struct(h["last"].alias("e"), F.array_append(s["o"], h).alias("o"))).otherwise(s)
        return F.aggregate(found, F.struct(F.lit(0).alias("e"), none.alias("o")), step, lambda s: s["o"])

    # the token array is bound to a lambda's variable: written in place it would be worked out anew for every token
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    found = bound(F.col(tokens), hits if overlap else lambda t: greedy(hits(t)))
    return files.select("file", F.explode(found).alias("_h")).select("file", "_h.first", "_h.last", "_h.sites")


def not_since(files: DataFrame, first: str, dead: str, tokens: str = "tokens") -> DataFrame:
    """file, pos, token: tokens before which no ``first`` stands with nothing ``dead`` between.

    What ``(assert_not_behind (seq first (* (not dead))))`` asserts, by two running maxima instead of a run back from each token.
    """
    cells = files.select("file", F.posexplode(tokens).alias("pos", "token"))
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda t: F.max(F.when(F.col("token") == t, F.col("pos"))).over(before)
    out = cells.withColumn("_first", last(first)).withColumn("_dead", last(dead))
    return out.where(F.col("_first").isNull() | (F.coalesce("_dead", F.lit(-1)) > F.col("_first"))).drop("_first", "_dead")


SITES = "map<string,array<struct<start:int,end:int,text:string>>>"
MATCHES = f"pattern int, file string, first int, last int, start int, end int, text string, sites {SITES}"
_SITES = pa.map_(pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))


def tape_tokens(rows: list[dict], targets: dict[tuple[int, int], str] | None = None) -> list[Token]:
    """Tokens of the automaton from a lexed row."""
    out = []
    for r in rows:
        text, inner = r["text"], 0
        content = text
        if len(text) > 1 and text[0] in "\"'`" and text[-1] == text[0]:
            content, inner = text[1:-1], 1
        out.append(Token(text, r["start"], r["end"], content, (targets or {}).get((r["start"], r["end"]), ""), inner))
    return out


def lex_tokens(text: str, lexer: re.Pattern, targets: dict[tuple[int, int], str] | None = None) -> list[Token]:
    """Tokens of a text with byte spans."""
    out, at, done, wide = [], 0, 0, not text.isascii()
    for m in lexer.finditer(text):
        own, (a, b) = m[0], m.span()
        if wide:
            at += len(text[done:a].encode())
            a, done = at, b
            b = at = at + len(own.encode())
        quoted = len(own) > 1 and own[0] in "\"'`" and own[-1] == own[0]
        out.append(Token(own, a, b, own[1:-1] if quoted else own, targets.get((a, b), "") if targets else "", int(quoted)))
    return out


def prefiltered(files: DataFrame, pats: list) -> DataFrame:
    """Files that can match some pattern, by the literal texts that it requires."""
    each = []
    for pat in pats:
        need = sorted(P.required_texts(pat), key=lambda t: (-len(t), t))
        if not need:
            return files
        each.append(_all([F.instr("text", t) > 0 for t in need]))
    keep = each[0]
    for e in each[1:]:
        keep = keep | e
    return files.where(keep)


def grep(tape: DataFrame, pats: list, targets: DataFrame | None = None) -> DataFrame:
    """Matches of all patterns in one pass over lexed files (file, text, tokens); ``pattern`` numbers them.

    ``targets`` (file, start, end, target) resolves references; it is joined only where a pattern uses one.
    """
    programs = [Program(p) for p in pats]
    wanted = P.names
    all_names = [wanted(p) for p in pats]
    files = prefiltered(tape, pats).select("file", "text", "tokens")
    refs = targets is not None and any(map(P.uses_refs, pats))
    if refs:
        own = targets.groupBy("file").agg(F.collect_list(F.struct("start", "end", "target")).alias("targets"))
        files = files.join(unbounded(own), "file", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            cols = [c.to_pylist() for c in batch.columns] + ([] if refs else [[None] * batch.num_rows])
            for file, text, toks, found in zip(*cols, strict=True):
                raw = (text or "").encode()
                tokens = tape_tokens(toks or [], {(t["start"], t["end"]): t["target"] for t in found or ()})
                for k, program in enumerate(programs):
                    out += [(k, file, *row(m, all_names[k], raw)) for m in program.scan(tokens, raw)]
            yield batch_of(out)

    return mapped(files, work, MATCHES)


def row(m: Match, names: list[str], raw: bytes) -> tuple:
    sites = [(n, [{"start": s.start, "end": s.end, "text": s.text} for s in m.sites.get(n, [])]) for n in dict.fromkeys([*names, *m.sites])]
    return m.first, m.last, m.start, m.end, raw[m.start : m.end].decode("utf-8", "replace"), sites


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), _SITES]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["pattern", "file", "first", "last", "start", "end", "text", "sites"])


def shown(matches: DataFrame, names: list[str]) -> DataFrame:
    """One text column for each capture: its sites joined by ``, ``; empty where there is none."""
    each = [F.coalesce(F.array_join(F.transform(F.col("sites")[n], lambda s: s["text"]), ", "), F.lit("")).alias(n) for n in names]
    return matches.select("file", "start", "end", "text", *each)


def taken(matches: DataFrame, name: str) -> DataFrame:
    """Matches focused on the last site of a capture; those without one go."""
    last = F.element_at(F.col("sites")[name], -1)
    return matches.where(F.size(F.coalesce(F.col("sites")[name], F.array().cast("array<struct<start:int,end:int,text:string>>"))) > 0).withColumn("start", last["start"]).withColumn("end", last["end"]).withColumn("text", last["text"])
