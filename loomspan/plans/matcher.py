"""Matchers combine patterns with paths, regions, syntax nodes and languages."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from ..functions.paths import glob_regex
from . import pattern as P
from .automaton import Match, Program, Site, Token
from .sexp import Expander, PatternError, Sym, read_one, show


@dataclass
class Node:
    """A syntax node; ``fields`` names some of its parts."""

    type: str
    start: int
    end: int
    fields: dict[str, tuple[int, int]] = field(default_factory=dict)


@dataclass
class File:
    """What matching needs to know of one file."""

    path: str
    text: bytes
    tokens: list[Token]
    lang: str = ""
    nodes: list[Node] = field(default_factory=list)


@dataclass(frozen=True)
class Gate:
    """A condition on the path: a glob, or gates joined by and, or, not."""

    kind: str
    glob: str = ""
    gates: tuple = ()

    def opens(self, path: str) -> bool:
        if self.kind == "path":
            return re.search(glob_regex(self.glob), path.removeprefix("./")) is not None
        if self.kind == "not":
            return not self.gates[0].opens(path)
        return (all if self.kind == "and" else any)(g.opens(path) for g in self.gates)


@dataclass(frozen=True)
class Leaf:
    pat: object
    program: Program = field(compare=False)


@dataclass(frozen=True)
class Gated:
    gate: Gate
    body: object


@dataclass(frozen=True)
class Lang:
    lang: str
    body: object


@dataclass(frozen=True)
class Under:
    region: object
    body: object


@dataclass(frozen=True)
class Take:
    name: str
    body: object


@dataclass(frozen=True)
class Either:
    arms: tuple


@dataclass(frozen=True)
class OfType:
    type: str


@dataclass(frozen=True)
class AsLanguage:
    lang: str
    region: object
    body: object


def parse(source, expander: Expander | None = None):
    """A matcher, or a gate where the form is one."""
    form = (expander or Expander()).expand(read_one(source) if isinstance(source, str) else source)
    return decode(form)


def decode(form):
    head = str(form[0]) if isinstance(form, list) and form and isinstance(form[0], Sym) else ""
    args = form[1:] if head else []
    if head == "path":
        gate = Gate("path", str(args[0]))
        return gate if len(args) == 1 else Gated(gate, decode(args[1]))
    if head == "lang" and len(args) == 2:
        return _lang(str(args[0]), decode(args[1]))
    if head == "under" and len(args) == 2:
        region, body = args
        if isinstance(region, list) and region and region[0] == "lang" and len(region) == 2:
            return _lang(str(region[1]), decode(body))
        region = decode(region)
        return Gated(region, decode(body)) if isinstance(region, Gate) else Under(region, decode(body))
    if head == "take" and len(args) == 2:
        return Take(str(args[0]), decode(args[1]))
    if head == "node" and len(args) == 1:
        return OfType(str(args[0]))
    if head == "as-language" and len(args) == 3:
        return AsLanguage(str(args[0]), decode(args[1]), decode(args[2]))
    if head == "and":
        own = list(map(decode, args))
        gates, finders = [g for g in own if isinstance(g, Gate)], [f for f in own if not isinstance(f, Gate)]
        if len(finders) > 1 or not own:
            raise PatternError("and takes gates and one finder at most")
        gate = Gate("and", gates=tuple(gates))
        return gate if not finders else Gated(gate, finders[0]) if gates else finders[0]
    if head == "or":
        own = [x for a in map(decode, args) for x in (a.arms if isinstance(a, Either) else (a,))]
        if own and all(isinstance(x, Gate) for x in own):
            return Gate("or", gates=tuple(own))
        if not own or any(isinstance(x, Gate) for x in own):
            raise PatternError("or mixes gates and finders")
        return Either(tuple(own))
    if head == "not" and args:
        try:
            inner = decode(args[0])
        except PatternError:
            inner = None
        if isinstance(inner, Gate):
            return Gate("not", gates=(inner,))
    pat = P.decode(form)
    P.check(pat)
    return Leaf(pat, Program(pat))


def _lang(lang: str, body):
    for m in walk(body):
        if isinstance(m, Lang) and m.lang != lang:
            raise PatternError(f"both {lang} and {m.lang}")
    return Lang(lang, body)


def walk(m):
    yield m
    inner = m.arms if isinstance(m, Either) else [getattr(m, k) for k in ("region", "body") if hasattr(m, k)]
    for x in inner:
        yield from walk(x)


def leaves(m) -> list:
    return [x.pat for x in walk(m) if isinstance(x, Leaf)]


def names(m) -> list[str]:
    out: list[str] = []
    for pat in leaves(m):
        out += [n for n in P.names(pat) if n not in out]
    return out


def gate_of(m) -> Gate | None:
    """The condition on the path that all matches need; it is checked before a file is read."""
    if isinstance(m, Gate):
        return m
    if isinstance(m, Gated):
        inner = gate_of(m.body)
        return m.gate if inner is None else Gate("and", gates=(m.gate, inner))
    if isinstance(m, (Take, Lang)):
        return gate_of(m.body)
    if isinstance(m, Under):
        own = [g for g in (gate_of(m.region), gate_of(m.body)) if g]
        return Gate("and", gates=tuple(own)) if own else None
    if isinstance(m, Either):
        own = [gate_of(a) for a in m.arms]
        return None if None in own else Gate("or", gates=tuple(own))
    return None


#: Ways of a matcher that are told apart by what they need, at most.
MOST_WAYS = 64


def needs(m) -> list[frozenset[str]] | None:
    """Sets of texts, of which a file must hold one whole set to have a match; None where nothing is known."""
    if isinstance(m, Leaf):
        own = P.required_texts(m.pat)
        return [frozenset(own)] if own else None
    if isinstance(m, Either):
        own = [needs(a) for a in m.arms]
        return None if None in own or sum(map(len, own)) > MOST_WAYS else [x for o in own for x in o]
    if isinstance(m, (Under, AsLanguage)):
        region, body = needs(m.region), needs(m.body)
        if region is None or body is None:
            return region or body
        return [a | b for a in region for b in body] if len(region) * len(body) <= MOST_WAYS else region
    return needs(m.body) if isinstance(m, (Gated, Lang, Take)) else None


def within(tokens: list[Token], start: int, end: int) -> list[Token]:
    return [t for t in tokens if start <= t.start and t.end <= end]


def find(m, f: File, lexers: dict[str, Callable[[str], list[Token]]] | None = None) -> list[Match]:
    """Matches of a matcher in a file, arms of ``or`` one after the other."""
    if isinstance(m, Gate):
        return []
    if isinstance(m, Leaf):
        found = m.program.scan(f.tokens, f.text)
        return [_widened(x, f.nodes) for x in found] if f.nodes and P.looks_like_call(m.pat) else found
    if isinstance(m, Gated):
        return find(m.body, f, lexers) if m.gate.opens(f.path) else []
    if isinstance(m, Lang):
        return find(m.body, f, lexers) if f.lang == m.lang else []
    if isinstance(m, Either):
        return [x for a in m.arms for x in find(a, f, lexers)]
    if isinstance(m, OfType):
        out = []
        for n in f.nodes:
            if n.type == m.type:
                sites = {k: [Site(a, b, f.text[a:b].decode("utf-8", "replace"))] for k, (a, b) in n.fields.items()}
                out.append(Match(0, 0, n.start, n.end, sites))
        return out
    if isinstance(m, Take):
        out = []
        for x in find(m.body, f, lexers):
            if x.sites.get(m.name):
                s = x.sites[m.name][-1]
                out.append(replace(x, start=s.start, end=s.end))
        return out
    if isinstance(m, Under):
        out = []
        for region in find(m.region, f, lexers):
            inner = File(f.path, f.text, within(f.tokens, region.start, region.end), f.lang, [n for n in f.nodes if region.start <= n.start and n.end <= region.end])
            for x in find(m.body, inner, lexers):
                sites = {k: region.sites.get(k, []) + x.sites.get(k, []) for k in dict.fromkeys([*region.sites, *x.sites])}
                out.append(replace(x, sites=sites))
        return out
    assert isinstance(m, AsLanguage)
    lexer = (lexers or {}).get(m.lang)
    if lexer is None:
        raise PatternError(f"no lexer for {m.lang}")
    out = []
    for region in find(m.region, f, lexers):
        raw = f.text[region.start : region.end]
        inner = File(f.path, raw, lexer(raw.decode("utf-8", "replace")), m.lang)
        for x in find(m.body, inner, lexers):
            sites = {k: [Site(s.start + region.start, s.end + region.start, s.text) for s in v] for k, v in x.sites.items()}
            out.append(Match(x.first, x.last, x.start + region.start, x.end + region.start, sites))
    return out


def _widened(x: Match, nodes: list[Node]) -> Match:
    """A call's match takes the span of the smallest node around it."""
    around = [n for n in nodes if n.start <= x.start and x.end <= n.end]
    if not around:
        return x
    n = min(around, key=lambda n: n.end - n.start)
    return replace(x, start=n.start, end=n.end)


def describe(m) -> str:
    """A matcher as text, for messages."""
    if isinstance(m, Leaf):
        return P.to_sexp(m.pat)
    if isinstance(m, Gate):
        return show([Sym("path"), m.glob]) if m.kind == "path" else f"({m.kind} {' '.join(map(describe, m.gates))})"
    inner = m.arms if isinstance(m, Either) else [getattr(m, k) for k in ("gate", "region", "body") if hasattr(m, k)]
    return f"({type(m).__name__.lower()} {' '.join(map(describe, inner))})"
