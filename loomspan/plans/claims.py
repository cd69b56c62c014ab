"""Packs that say what a language is: its claims (family, layout, atomic texts, docstrings), and verbs that turn matches into facts.

``(under PLACE form ...)`` puts verbs below a path condition or inside the matches of a matcher.
A verb such as ``(as-atom public M)`` makes a fact of each match of ``M`` in its place, ``(as-scope (this))`` of
the place itself. What a match's captures ``name``, ``path``, ``alias``, ``member`` and ``pkg`` hold is what the fact says.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from . import matcher as M
from .automaton import Match, Site
from .sexp import Expander, PatternError, Sym, read, show

#: Verbs that make facts, and verbs that paint.
VERBS = ("as-package", "as-atom", "as-use", "as-import", "as-reexport", "as-default", "as-scope", "as-decl", "as-flow")
PAINTS = ("as-keyword", "as-string", "as-number", "as-comment", "as-type", "as-const", "as-ident", "as-op", "as-punct")
CLAIMS = ("as-language", "as-family", "as-layout", "as-atomic", "as-docstring", "as-directory-representant")


@dataclass
class Act:
    """A verb in its places; without ``body`` it takes the innermost place itself."""

    verb: str
    gate: M.Gate | None
    places: tuple
    body: object | None
    option: str = ""


@dataclass
class Claim:
    """What a pack states of the files that a path condition lets through."""

    kind: str
    gate: M.Gate | None
    values: tuple[str, ...]


@dataclass
class Claims:
    acts: list[Act] = field(default_factory=list)
    claims: list[Claim] = field(default_factory=list)

    def of(self, kind: str, path: str) -> list[tuple[str, ...]]:
        """The values that claims of a kind state for a file."""
        return [c.values for c in self.claims if c.kind == kind and (c.gate is None or c.gate.opens(path))]

    def families(self) -> list[tuple[str, str, str]]:
        """(lang, family, flag) of all families; a language is named by the claim beside it."""
        out = []
        for c in self.claims:
            if c.kind == "as-family":
                langs = [x.values[0] for x in self.claims if x.kind == "as-language" and x.gate == c.gate] or [c.values[0]]
                out += [(lang, c.values[0], flag) for lang in langs for flag in c.values[1:] or ("",)]
        return out


def load(source: str, *preludes: str) -> Claims:
    """The claims and verbs of a pack."""
    expander, out = Expander(*preludes), Claims()

    def take(form, gate: M.Gate | None, places: tuple) -> None:
        if not isinstance(form, list) or not form or not isinstance(form[0], Sym):
            raise PatternError(f"not a form of a pack: {show(form)}")
        head, args = str(form[0]), form[1:]
        if head == "under":
            place = M.decode(args[0])
            if isinstance(place, M.Gate):
                gate = place if gate is None else M.Gate("and", gates=(gate, place))
            else:
                places = (*places, place)
            for inner in args[1:]:
                take(inner, gate, places)
        elif head in CLAIMS:
            out.claims.append(Claim(head, gate, tuple(map(str, args))))
        elif head in VERBS or head in PAINTS:
            option = str(args[0]) if args and isinstance(args[0], Sym) and args[0] in ("public", "private", "structural", "hybrid") else ""
            rest = [a for a in (args[1:] if option else args) if not (isinstance(a, list) and a and a[0] in ("scope", "this"))]
            if len(rest) > 1:
                raise PatternError(f"{head} takes one matcher: {show(form)}")
            out.acts.append(Act(head, gate, places, M.decode(rest[0]) if rest else None, option))
        else:
            raise PatternError(f"an unknown form: {head}")

    for form in read(source):
        if not expander.define(form):
            take(expander.expand(form), None, ())
    return out


def _found(act: Act, f: M.File, lexers: dict | None) -> Iterator[Match]:
    """The matches that a verb takes in a file."""
    regions: list[tuple[M.File, Match | None]] = [(f, None)]
    for place in act.places:
        inner = []
        for own, _ in regions:
            for x in M.find(place, own, lexers):
                inside = M.File(f.path, f.text, M.within(own.tokens, x.start, x.end), f.lang, [n for n in own.nodes if x.start <= n.start and n.end <= x.end])
                inner.append((inside, x))
        regions = inner
    for own, x in regions:
        if act.body is not None:
            yield from M.find(act.body, own, lexers)
        elif x is not None:
            yield x


def _parts(x: Match, f: M.File) -> list[Site]:
    """The sites of ``name`` in the order of the text; the match itself where there is none."""
    own = sorted({(s.start, s.end, s.text) for s in x.sites.get("name", [])})
    return [Site(*s) for s in own] or [Site(x.start, x.end, f.text[x.start : x.end].decode("utf-8", "replace"))]


def atom_names(parts: list[Site], text: bytes) -> list[tuple[str, int, int]]:
    """Names from the parts of a declaration: after a comma a new one begins, after anything else the last one goes on; the span is the last part's."""
    groups: list[list[Site]] = []
    for s in parts:
        between = text[groups[-1][-1].end : s.start] if groups else b""
        if not groups or re.fullmatch(rb"\s*,\s*", between):
            groups.append([s])
        else:
            groups[-1].append(s)
    return [(".".join(s.text for s in g), g[-1].start, g[-1].end) for g in groups]


def use_name(parts: list[Site], text: bytes) -> tuple[Site, list[Site]]:
    """The name used and what qualifies it: parts before it that only dots or colons join."""
    last, prefix, at = parts[-1], [], parts[-1].start
    for s in reversed(parts[:-1]):
        if s.end > at or not re.fullmatch(rb"\s*(\.|::|:)?\s*", text[s.end : at]) or s.text in ("this", "super"):
            break
        prefix.insert(0, s)
        at = s.start
    return last, prefix


def facts(claims: Claims, f: M.File, lexers: dict | None = None):
    """What the verbs make of a file, as ``extract.Facts``, and what they paint: (start, end, class)."""
    from ..operators.extract import Facts

    out, paints, uses = Facts(), [], {}
    for act in claims.acts:
        if act.gate is not None and not act.gate.opens(f.path):
            continue
        for x in _found(act, f, lexers):
            text = lambda name: next((s for s in x.sites.get(name, [])), None)  # noqa: B023, E731
            if act.verb in PAINTS:
                paints.append((x.start, x.end, act.verb.removeprefix("as-")))
            elif act.verb in ("as-scope", "as-decl"):
                if (x.start, x.end, act.verb == "as-decl") not in out.scopes and x.end > x.start:
                    out.scopes.append((x.start, x.end, act.verb == "as-decl"))
            elif act.verb == "as-atom":
                out.atoms += [(*a, act.option != "private") for a in atom_names(_parts(x, f), f.text)]
            elif act.verb == "as-use":
                last, prefix = use_name(_parts(x, f), f.text)
                best = uses.get((last.start, last.end))
                if best is None or (prefix and not best[3]):  # a use with a prefix beats one without
                    uses[last.start, last.end] = (last.text, last.start, last.end, [(s.text, s.start, s.end) for s in prefix])
            elif act.verb == "as-flow":
                out.flows.append((x.start, x.end, act.option or "structural"))
            elif act.verb == "as-package":
                p = text("pkg") or Site(x.start, x.end, f.text[x.start : x.end].decode("utf-8", "replace"))
                out.package = (p.text, p.end)
            elif act.verb == "as-import":
                p, alias, member = text("path"), text("alias"), text("member")
                p = p or Site(x.start, x.end, f.text[x.start : x.end].decode("utf-8", "replace"))
                quoted = len(p.text) > 1 and p.text[0] in "\"'`" and p.text[-1] == p.text[0]
                spec = p.text[1:-1] if quoted else p.text
                local = alias.text if alias else member.text if member else ""
                ms, me = (member.start, member.end) if member else (0, 0)
                out.imports.append((local, spec, member.text if member else "", x.start, x.end, ms, me, alias is not None, p.start + quoted, p.end - quoted, spec == "*" or bool(member and member.text == "*")))
    out.uses = [uses[k] for k in sorted(uses)]
    return out, paints
