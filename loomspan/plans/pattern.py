"""Sequence patterns over tokens: forms, checks, inferred captures."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

from .sexp import Expander, PatternError, Sym, read_one, show

UNNAMED = ("", "_", "ROOT")


@dataclass(frozen=True)
class Unit:
    """One token: ``kind`` is any, text, content, ref or regex."""

    kind: str
    value: str = ""
    group: int = 0
    negated: bool = False
    source: str = ""  # a capture that a rewrite stretches the match from


@dataclass(frozen=True)
class Seq:
    items: tuple


@dataclass(frozen=True)
class Alt:
    items: tuple


@dataclass(frozen=True)
class Filler:
    """Any tokens."""


@dataclass(frozen=True)
class Gaps:
    """``low`` to ``high`` (None: any number of) bodies; tokens other than the barrier may lie between and around."""

    body: object
    low: int = 0
    high: int | None = None


@dataclass(frozen=True)
class Bind:
    name: str
    body: object
    unify: bool = False


@dataclass(frozen=True)
class Group:
    body: object


@dataclass(frozen=True)
class NotBehind:
    body: object


#: Fixed value: the token that a gap never steps over.
BARRIER = "func"


def java_regex(source: str) -> str:
    """Named groups as Java and Python write them respectively differ: this is Java's."""
    return source.replace("(?P<", "(?<")


def decode(form) -> object:
    """The pattern of an expanded form."""
    if isinstance(form, Sym):
        if form == "any":
            return Unit("any")
        if form == "rest":
            return Filler()
        raise PatternError(f"an unknown word: {form}")
    if isinstance(form, str):
        return Unit("text", form)
    if not isinstance(form, list) or not form or not isinstance(form[0], Sym):
        raise PatternError(f"not a pattern: {show(form)}")
    head, args = str(form[0]), form[1:]

    def arity(*counts: int) -> None:
        if len(args) not in counts:
            raise PatternError(f"{head} has {len(args)} arguments: {show(form)}")

    if head in ("any", "rest"):
        arity(0)
        return decode(form[0])
    if head in ("token", "equals", "ref"):
        arity(1)
        return Unit({"token": "text", "equals": "content", "ref": "ref"}[head], str(args[0]))
    if head == "regex":
        arity(1, 2, 3)
        try:
            re.compile(args[0])
        except re.error as e:
            raise PatternError(f"regex {args[0]!r}: {e}") from e
        group = next((a for a in args[1:] if isinstance(a, int)), 0)
        return Unit("regex", args[0], group, source=next((str(a) for a in args[1:] if not isinstance(a, int)), ""))
    if head == "not":
        arity(1)
        inner = decode(args[0])
        if not isinstance(inner, Unit) or inner.kind in ("any", "ref", "content"):
            raise PatternError(f"not can't invert {show(args[0])}")
        return replace(inner, negated=not inner.negated, group=0)
    if head == "seq":
        return Seq(tuple(map(decode, args)))
    if head == "alt":
        if not args:
            raise PatternError("alt is empty")
        return Alt(tuple(map(decode, args)))
    if head == "*":
        arity(1)
        body = decode(args[0])
        return Filler() if body == Unit("any") else Gaps(body)
    if head == "gaps":
        arity(3)
        return Gaps(decode(args[2]), int(args[0]), int(args[1]))
    if head == "group":
        arity(1)
        return Group(decode(args[0]))
    if head == "assert_not_behind":
        arity(1)
        return NotBehind(decode(args[0]))
    if head in ("capture", "unify"):
        arity(2)
        return Bind(str(args[0]), decode(args[1]), head == "unify")
    raise PatternError(f"an unknown form: {head}")


def parse(source: str, expander: Expander | None = None) -> object:
    """Read, expand, decode and check a pattern."""
    pat = decode((expander or Expander()).expand(read_one(source)))
    check(pat)
    return pat


def from_json(data) -> object:
    """The same pattern written as JSON: lists with the head first, ``{"text": s}`` or strings for texts."""
    data = json.loads(data) if isinstance(data, str) else data

    def form(x, head: bool = False):
        if isinstance(x, list):
            return [form(x[0], True), *map(form, x[1:])] if x else []
        if isinstance(x, dict) and set(x) == {"text"}:
            return str(x["text"])
        if isinstance(x, dict) and set(x) == {"word"}:
            return Sym(x["word"])
        return Sym(x) if head or x in ("any", "rest") else x

    pat = decode(Expander().expand(form(data)))
    check(pat)
    return pat


def children(pat) -> tuple:
    if isinstance(pat, (Seq, Alt)):
        return pat.items
    return (pat.body,) if isinstance(pat, (Gaps, Bind, Group, NotBehind)) else ()


def walk(pat):
    yield pat
    for c in children(pat):
        yield from walk(c)


def check(pat) -> None:
    """One way of binding for each name; no binding around a repetition."""
    ways: dict[str, bool] = {}
    for p in walk(pat):
        if isinstance(p, Bind):
            if p.name not in UNNAMED and ways.setdefault(p.name, p.unify) != p.unify:
                raise PatternError(f"{p.name} is both captured and unified")
            if isinstance(p.body, (Gaps, Filler, NotBehind, Bind)):
                raise PatternError(f"{p.name} can't bind this form")
        if isinstance(p, NotBehind) and any(isinstance(x, NotBehind) for x in walk(p.body)):
            raise PatternError("an assertion lies inside an assertion")


def names(pat) -> list[str]:
    """Captures in the order in which they appear, named regex groups with them."""
    out: list[str] = []
    for p in walk(pat):
        own = []
        if isinstance(p, Bind) and p.name not in UNNAMED:
            own = [p.name]
        elif isinstance(p, Unit) and p.kind == "regex" and not p.negated:
            own = list(re.compile(p.value).groupindex)
        out += [n for n in own if n not in out]
    return out


def required_texts(pat) -> set[str]:
    """Token texts that every match holds."""
    if isinstance(pat, Unit):
        return {pat.value} if pat.kind == "text" and not pat.negated and pat.value else set()
    if isinstance(pat, Seq):
        return set().union(*map(required_texts, pat.items))
    if isinstance(pat, Alt):
        return set.intersection(*map(required_texts, pat.items))
    if isinstance(pat, (Group, Bind)):
        return required_texts(pat.body)
    return required_texts(pat.body) if isinstance(pat, Gaps) and pat.low else set()


def uses_refs(pat) -> bool:
    return any(isinstance(p, Unit) and p.kind == "ref" for p in walk(pat))


def looks_like_call(pat) -> bool:
    """Whether a match widens to the syntax node that covers it."""
    return any(p == Unit("text", "(") for p in walk(pat))


def to_sexp(pat) -> str:
    """A pattern as text that reads back to itself."""
    def form(p):
        if isinstance(p, Unit):
            inner = Sym("any") if p.kind == "any" else p.value if p.kind == "text" else [Sym({"content": "equals"}.get(p.kind, p.kind)), p.value, *([p.group] if p.group else []), *([p.source] if p.source else [])]
            return [Sym("not"), inner] if p.negated else inner
        if isinstance(p, Filler):
            return [Sym("*"), Sym("any")]
        if isinstance(p, Gaps):
            return [Sym("*"), form(p.body)] if p.high is None and not p.low else [Sym("gaps"), p.low, p.high, form(p.body)]
        if isinstance(p, Bind):
            return [Sym("unify" if p.unify else "capture"), p.name, form(p.body)]
        head = {Seq: "seq", Alt: "alt", Group: "group", NotBehind: "assert_not_behind"}[type(p)]
        return [Sym(head), *map(form, children(p))]

    return show(form(pat))
