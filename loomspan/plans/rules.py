"""Rule packs: definitions, rules, rewrites; planned so that shared work is done once."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from . import matcher as M
from .sexp import Expander, PatternError, Sym, read, show


@dataclass
class Rule:
    """A finding for each match; with ``emit``, a fix too."""

    id: str
    level: str
    message: str
    matcher: object
    emit: object = None
    builtin: str = ""


@dataclass
class Pack:
    rules: list[Rule] = field(default_factory=list)

    def merged(self, other: Pack) -> Pack:
        """Both packs' rules in order; of one id the first stays."""
        have = {r.id for r in self.rules}
        return Pack(self.rules + [r for r in other.rules if not r.id or r.id not in have])


LEVELS = ("error", "warning", "note", "none")


def load(source: str, *preludes: str) -> Pack:
    """Top-level forms ``def``, ``rule``, ``rewrite`` and ``builtin``."""
    expander, pack = Expander(*preludes), Pack()
    for form in read(source):
        if expander.define(form):
            continue
        if not isinstance(form, list) or not form or not isinstance(form[0], Sym):
            raise PatternError(f"not a top-level form: {show(form)}")
        head = str(form[0])
        if head == "rule" and len(form) == 5:
            _, ident, level, message, body = form
            if str(level) not in LEVELS:
                raise PatternError(f"{level} is no level")
            pack.rules.append(_rule(str(ident), str(level), str(message), expander.expand(body)))
        elif head == "rewrite" and len(form) == 3:
            pack.rules.append(_rule("", "none", "", expander.expand(form)))
        elif head == "builtin" and len(form) == 2:
            pack.rules.append(Rule(str(form[1]), "warning", "", None, builtin=str(form[1])))
        else:
            raise PatternError(f"not a top-level form: {show(form)}")
    return pack


def _rule(ident: str, level: str, message: str, body) -> Rule:
    if isinstance(body, list) and body and body[0] == "rewrite":
        return Rule(ident, level, message, M.decode(body[1]), body[2])
    return Rule(ident, level, message, M.decode(body))


def load_folder(folder: str, suffix: str = ".rft", hidden: str = ".rules") -> Pack:
    """All packs of a folder and of its folder ``hidden``, by name; a folder without any is an error."""
    paths = []
    for d in (folder, os.path.join(folder, hidden)):
        if os.path.isdir(d):
            paths += sorted(os.path.join(d, n) for n in os.listdir(d) if n.endswith(suffix))
    if not paths:
        raise PatternError(f"{folder} holds no rules")
    pack = Pack()
    for p in paths:
        with open(p, encoding="utf-8") as f:
            pack = pack.merged(load(f.read()))
    return pack


@dataclass
class Plan:
    """Rule numbers by how they run: bare patterns fused in one scan, regions evaluated once for all rules below them, the rest."""

    fused: list[int] = field(default_factory=list)
    under: dict[str, list[int]] = field(default_factory=dict)
    rest: list[int] = field(default_factory=list)
    builtins: list[int] = field(default_factory=list)


def plan(pack: Pack) -> Plan:
    out = Plan()
    for k, r in enumerate(pack.rules):
        if r.builtin:
            out.builtins.append(k)
        elif isinstance(r.matcher, M.Leaf):
            out.fused.append(k)
        elif isinstance(r.matcher, M.Under):
            out.under.setdefault(M.describe(r.matcher.region), []).append(k)
        else:
            out.rest.append(k)
    return out


def costly(pack: Pack) -> list[str]:
    """Warnings on patterns that try every token: they begin with a gap, or with any token."""
    out = []
    for r in pack.rules:
        for leaf in (x for x in M.walk(r.matcher) if isinstance(x, M.Leaf)) if r.matcher else ():
            if leaf.program.first_units() is None:
                out.append(f"{r.id or 'rewrite'}: {M.describe(leaf)} can begin at any token")
    return out


def emitted(emit, sites: dict[str, list]) -> str:
    """The text of a template: literals, ``(slot name)``, ``(ref r)``, ``(seq ...)``."""
    if isinstance(emit, (Sym, int)):
        return str(emit)
    if isinstance(emit, str):
        return emit
    head, args = str(emit[0]), emit[1:]
    if head == "slot":
        found = sites.get(str(args[0]), [])
        return found[0].text if found else ""
    if head == "ref":
        path, _, name = str(args[0]).partition("::")
        base = path.partition(":")[2].rsplit("/", 1)[-1]
        return f"{base}.{name}" if name else base
    if head == "seq":
        return "".join(emitted(a, sites) for a in args)
    raise PatternError(f"not a template: {show(emit)}")
