"""Declarations, uses, imports, scopes and flow of source files, as relations.

Python files are read with Python's own parser; files of languages with braces are walked
token by token, with a table of each language's words. A file is one row, so
extraction is one pass in Arrow batches without a shuffle. Offsets are UTF-8 bytes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.paths import atom_ref, leaf
from ..storage import unbounded
from .tape import SOURCE, compiled


@dataclass
class Facts:
    """What a file states; scopes are numbered in the order in which they are found."""

    package: tuple[str, int] | None = None
    scopes: list[tuple[int, int, bool]] = field(default_factory=list)  # start, end, whether a declaration's body is a hole
    atoms: list[tuple[str, int, int, bool]] = field(default_factory=list)  # name, start, end, exported
    imports: list[tuple] = field(default_factory=list)  # local, spec, member, start, end, member's start and end, has_alias, spec's start and end, star
    uses: list[tuple[str, int, int, list]] = field(default_factory=list)  # name, start, end, prefix of (name, start, end)
    flows: list[tuple[int, int, str]] = field(default_factory=list)  # start, end, structural or hybrid
    docs: list[tuple[str, str, str]] = field(default_factory=list)  # name, signature, doc

    def inner(self, start: int, end: int, strict: bool = False) -> int:
        """The smallest scope around a span; -1 where there is none."""
        best, size = -1, None
        for k, (a, b, _) in enumerate(self.scopes):
            if a <= start and end <= b and (not strict or a < start or end < b) and (size is None or b - a < size):
                best, size = k, b - a
        return best


# --- Python ------------------------------------------------------------------


class _Python(ast.NodeVisitor):
    def __init__(self, raw: bytes, tree: ast.Module):
        self.raw, self.out = raw, Facts()
        self.lines = [0]
        for line in raw.split(b"\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.path: list[str] = []
        self.in_function = 0
        self.visit(tree)

    def _span(self, n) -> tuple[int, int]:
        return self.lines[n.lineno - 1] + n.col_offset, self.lines[n.end_lineno - 1] + n.end_col_offset

    def _named(self, n) -> tuple[int, int]:
        """The span of the name of a definition."""
        start, _ = self._span(n)
        m = re.compile(rb"(?:async\s+)?(?:def|class)\s+").match(self.raw, start)
        return m.end(), m.end() + len(n.name.encode())

    def _atom(self, name: str, start: int, end: int) -> None:
        full = ".".join([*self.path, name])
        self.out.atoms.append((full, start, end, not name.startswith("_")))

    def _define(self, n, is_class: bool) -> None:
        for d in n.decorator_list:
            self.visit(d)
        start, end = self._span(n)
        at = self._named(n)
        if not self.in_function:
            self._atom(n.name, *at)
        self.out.scopes.append((start, end, False))
        body = self._span(n.body[0])[0]
        head = self.raw[start:body].decode("utf-8", "replace").strip().removesuffix(":").strip()
        if not self.in_function:
            self.out.docs.append((".".join([*self.path, n.name]), head, ast.get_docstring(n) or ""))
        for x in [*getattr(n, "bases", []), *getattr(n, "keywords", [])]:
            self.visit(x)
        if not is_class:
            self.visit(n.args)
            if n.returns:
                self.visit(n.returns)
        self.path.append(n.name)
        self.in_function += not is_class
        for x in n.body:
            self.visit(x)
        self.in_function -= not is_class
        self.path.pop()

    def visit_ClassDef(self, n):
        self._define(n, True)

    def visit_FunctionDef(self, n):
        self._define(n, False)

    visit_AsyncFunctionDef = visit_FunctionDef

    def _targets(self, targets) -> None:
        for t in targets:
            if isinstance(t, ast.Name):
                if not self.in_function:
                    self._atom(t.id, *self._span(t))
            elif isinstance(t, (ast.Tuple, ast.List)):
                self._targets(t.elts)
            else:
                self.visit(t)

    def visit_Assign(self, n):
        self._targets(n.targets)
        self.visit(n.value)

    def visit_AnnAssign(self, n):
        self._targets([n.target])
        self.visit(n.annotation)
        if n.value:
            self.visit(n.value)

    def visit_TypeAlias(self, n):
        self._targets([n.name])
        self.visit(n.value)

    def visit_Name(self, n):
        if isinstance(n.ctx, ast.Load):
            self.out.uses.append((n.id, *self._span(n), []))

    def visit_Attribute(self, n):
        parts, at = [], n
        while isinstance(at, ast.Attribute):
            _, end = self._span(at)
            parts.append((at.attr, end - len(at.attr.encode()), end))
            at = at.value
        if isinstance(at, ast.Name) and at.id != "self":
            last, *rest = parts
            self.out.uses.append((*last, [(at.id, *self._span(at)), *reversed(rest)]))
        else:
            self.visit(at)

    def _import(self, n, spec: str, member: str, alias: ast.alias, local: str) -> None:
        start, end = self._span(n)
        a, b = self._span(alias)
        first = self.raw.find(spec.lstrip(".").encode(), start) if spec.strip(".") else start
        whole = (a, a + len(alias.name.encode())) if member else (0, 0)
        self.out.imports.append((local, spec, member, a if len(n.names) > 1 else start, b if len(n.names) > 1 else end, *whole, alias.asname is not None, first, first + len(spec.lstrip(".").encode()), member == "*"))

    def visit_Import(self, n):
        for alias in n.names:
            self._import(n, alias.name, "", alias, alias.asname or alias.name.split(".")[0])

    def visit_ImportFrom(self, n):
        spec = "." * n.level + (n.module or "")
        for alias in n.names:
            self._import(n, spec, alias.name, alias, alias.asname or alias.name)

    def _flow(self, n, kind: str = "structural") -> None:
        self.out.flows.append((*self._span(n), kind))
        self.generic_visit(n)

    def visit_If(self, n, other: bool = False):
        """An ``elif`` is the only statement of the branch it stands in: it counts once, as a branch of the first."""
        self.out.flows.append((*self._span(n), "hybrid" if other else "structural"))
        self.visit(n.test)
        for x in n.body:
            self.visit(x)
        chained = len(n.orelse) == 1 and isinstance(n.orelse[0], ast.If) and self.raw[self._span(n.orelse[0])[0] :].startswith(b"elif")
        for x in n.orelse:
            self.visit_If(x, True) if chained else self.visit(x)

    def visit_For(self, n):
        self._targets([n.target] if self.in_function else [])
        self._flow(n)

    visit_While = visit_Try = visit_With = visit_Match = visit_AsyncFor = visit_AsyncWith = _flow

    def visit_BoolOp(self, n):
        self._flow(n, "hybrid")

    visit_IfExp = visit_BoolOp


def python_facts(raw: bytes) -> Facts:
    """Facts of a Python file; none of one that does not parse."""
    try:
        return _Python(raw, ast.parse(raw)).out
    except (SyntaxError, ValueError, RecursionError):
        return Facts()


# --- languages with braces ---------------------------------------------------


@dataclass(frozen=True)
class Words:
    """What a language's words declare."""

    types: frozenset[str]
    functions: frozenset[str]
    values: frozenset[str]
    members: str = ""  # "call": name(...) in a type; "typed": also fields after a type; "named": name: T; "line": the first word of a line
    exported: frozenset[str] = frozenset()  # words that export what follows them


_f = frozenset
#: The words of each language that begin declarations.
LANGUAGES = {
    "go": Words(_f(), _f({"func"}), _f({"const", "var"}), "line"),
    "java": Words(_f({"class", "interface", "enum", "record"}), _f(), _f(), "typed", _f({"public"})),
    "kotlin": Words(_f({"class", "interface", "object"}), _f({"fun"}), _f({"val", "var"}), ""),
    "typescript": Words(_f({"class", "interface", "enum"}), _f({"function"}), _f({"const", "let", "var", "type"}), "named", _f({"export"})),
    "rust": Words(_f({"struct", "enum", "trait", "union", "mod"}), _f({"fn"}), _f({"const", "static", "type"}), "named", _f({"pub"})),
}
FLOW = _f({"if", "for", "while", "switch", "match", "select", "try", "loop", "do", "catch"})
_COMMON = FLOW | _f("else return import in as case break continue true false static".split())
#: Further words of each language that are never names.
RESERVED = {
    "go": "package defer go chan map range struct interface func type fallthrough goto nil default",
    "java": "package extends implements throws final abstract synchronized native transient volatile strictfp private protected instanceof assert new this super void null throw finally default",
    "kotlin": "package override abstract final data sealed companion private protected internal suspend inline is when init by this super null throw finally",
    "typescript": "extends implements from of async await abstract readonly private protected public typeof instanceof declare namespace undefined new this super void null throw finally default yield",
    "rust": "impl use where mut ref unsafe crate dyn move async await extern self Self super",
}


def _reserved(lang: str) -> frozenset[str]:
    w = LANGUAGES[lang]
    return _COMMON | w.types | w.functions | w.values | w.exported | _f(RESERVED[lang].split())


_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*$")
_OPEN, _CLOSE = {"{": "}", "(": ")", "[": "]"}, _f("})]")


class _Braces:
    def __init__(self, text: str, lang: str):
        self.words, self.lang, self.out = LANGUAGES[lang], lang, Facts()
        self.reserved = _reserved(lang)
        self.raw = text.encode()
        self.tok: list[tuple[str, int, int, bool]] = []  # text, start, end, whether it begins a line
        at = done = 0
        for m in compiled(SOURCE).finditer(text):
            at += len(text[done : m.start()].encode())
            n = len(m[0].encode())
            if not m[0].startswith(("//", "/*")):
                self.tok.append((m[0], at, at + n, "\n" in text[done : m.start()] or not self.tok))
            at, done = at + n, m.end()
        self.declared: set[int] = set()
        self.skipped: set[int] = set()  # tokens of imports and package clauses
        self.close = self._pairs()
        self._head()
        self._walk(0, len(self.tok), [], False)
        self._uses()

    def t(self, k: int) -> str:
        return self.tok[k][0] if 0 <= k < len(self.tok) else ""

    def name(self, k: int) -> bool:
        return bool(_NAME.match(self.t(k))) and self.t(k) not in self.reserved

    def _pairs(self) -> dict[int, int]:
        stack, out = [], {}
        for k, (x, *_) in enumerate(self.tok):
            if x in _OPEN:
                stack.append(k)
            elif x in _CLOSE and stack:
                out[stack.pop()] = k
        return out | {k: len(self.tok) for k in stack}

    def _atom(self, k: int, path: list[str], exported: bool) -> str:
        text, start, end, _ = self.tok[k]
        full = ".".join([*path, text])
        public = text[:1].isupper() if self.lang == "go" else exported or (self.lang == "kotlin" and not text.startswith("_"))
        self.out.atoms.append((full, start, end, public))
        self.declared.add(k)
        return full

    def _scope(self, start: int, close: int, hole: bool = False) -> None:
        end = self.tok[close][2] if close < len(self.tok) else len(self.raw)
        self.out.scopes.append((self.tok[start][1], end, hole))

    def _body(self, k: int, stop: int) -> int | None:
        """The brace that opens a declaration's body, looked for from ``k``; None where it ends before one."""
        while k < stop:
            x = self.t(k)
            if x == "{":
                return k
            if x in (";", "}") or (x == "=" and self.lang not in ("go", "typescript")):
                return None
            if self.lang == "go" and k and self.tok[k][3] and self.t(k - 1) not in (",", "("):
                return None
            k = self.close.get(k, k) + 1
        return None

    def _walk(self, k: int, stop: int, path: list[str], in_type: bool) -> None:
        """Declarations among the tokens from ``k`` to ``stop``."""
        w, first = self.words, k
        exported = False
        while k < stop:
            x = self.t(k)
            if k in self.skipped:
                k += 1
                continue
            if self.tok[k][3] or self.t(k - 1) in (";", "}", "{"):
                exported = False
            exported |= x in w.exported
            if x in w.types and self.name(k + 1):
                k = self._type(k, stop, path, exported)
            elif x == "impl" and self.lang == "rust":
                k = self._impl(k, stop)
            elif x == "type" and self.lang == "go":
                k = self._go_types(k, stop)
            elif x in w.functions:
                k = self._function(k, stop, path, exported)
            elif x in w.values and (self.name(k + 1) or self.t(k + 1) == "("):
                k = self._values(k, stop, path, exported)
            elif in_type and self._member(k, first, path, exported):
                k = self._after_member(k, stop)
            elif x in _OPEN:
                if x == "{":
                    self._block(k)
                self._walk(k + 1, self.close[k], path, False) if not in_type else None
                k = self.close[k] + 1
            else:
                k += 1

    def _block(self, k: int) -> None:
        """Flow of the statement whose block opens at ``k``."""
        at = k - 1
        while at >= 0 and self.t(at) not in (";", "{", "}") and not self.tok[at][3]:
            at -= 1
        at = max(at, 0)
        words = [j for j in range(at, k) if self.t(j) in FLOW]
        if words:
            kind = "hybrid" if words[0] and self.t(words[0] - 1) == "else" else "structural"
            self.out.flows.append((self.tok[words[0]][1], self.tok[self.close[k]][2] if self.close[k] < len(self.tok) else len(self.raw), kind))

    def _type(self, k: int, stop: int, path: list[str], exported: bool) -> int:
        kind, own = self.t(k), [*path, self.t(k + 1)]
        self._atom(k + 1, path, exported)
        if kind == "record" and self.t(k + 2) == "(":  # components: a type, then a name
            for j in range(k + 3, self.close[k + 2]):
                if self.name(j) and self.t(j + 1) in (",", ")"):
                    self._atom(j, own, exported)
        at = self._body(k + 2, stop)
        if at is None:
            return k + 2
        close = self.close[at]
        self._scope(k, close, True)
        if kind == "enum":
            at = self._constants(at + 1, close, own, exported)
        self._walk(at + 1 if kind != "enum" else at, close, own, True)
        return close + 1

    def _constants(self, k: int, close: int, own: list[str], exported: bool) -> int:
        """Names of an enumeration, up to a semicolon; returns where its members begin."""
        expect = True
        while k < close and self.t(k) != ";":
            if expect and self.name(k):
                self._atom(k, own, exported)
                expect = False
            elif self.t(k) == ",":
                expect = True
            k = self.close.get(k, k) + 1
        return k

    def _impl(self, k: int, stop: int) -> int:
        at = self._body(k + 1, stop)
        if at is None:
            return k + 1
        depth, names = 0, []
        for j in range(k + 1, at):
            x = self.t(j)
            depth += (x == "<") - (x == ">")
            if x == "for" and not depth:
                names = []
            elif self.name(j) and not depth and self.t(j - 1) != "where":
                names.append(x)
        self._scope(k, self.close[at], True)
        self._walk(at + 1, self.close[at], names[-1:] if names else [], True)
        return self.close[at] + 1

    def _go_types(self, k: int, stop: int) -> int:
        if self.t(k + 1) == "(":
            end = self.close[k + 1]
            j = k + 2
            while j < end:
                j = self._go_type(j, end) if self.name(j) and self.tok[j][3] else j + 1
            return end + 1
        return self._go_type(k + 1, stop) if self.name(k + 1) else k + 1

    def _go_type(self, k: int, stop: int) -> int:
        own = [self.t(k)]
        self._atom(k, [], False)
        at = k + 1
        if self.t(at) == "[" and self.t(at + 1) != "]":
            at = self.close[at] + 1
        at += self.t(at) == "="
        if self.t(at) not in ("struct", "interface") or self.t(at + 1) != "{":
            return at
        close = self.close[at + 1]
        self._scope(k, close, True)
        call = self.t(at) == "interface"
        j = at + 2
        while j < close:
            if self.name(j) and (self.tok[j][3] or self.t(j - 1) in (";", "{")):
                if call == (self.t(j + 1) == "("):
                    self._atom(j, own, False)
                    while not call and self.t(j + 1) == "," and self.name(j + 2):
                        j += 2
                        self._atom(j, own, False)
            j = self.close.get(j, j) + 1
        return close + 1

    def _function(self, k: int, stop: int, path: list[str], exported: bool) -> int:
        at, own = k + 1, path
        if self.lang == "go" and self.t(at) == "(":  # a receiver: its type's name
            end = self.close[at]
            names = [j for j in range(at + 1, end) if self.name(j) and self.t(j - 1) != "[" and self.t(j - 1) != ","]
            own = [self.t(names[-1])] if names else []
            at = end + 1
        if self.lang == "kotlin" and self.name(at) and self.t(at + 1) == "." and self.name(at + 2):  # an extension of a type
            own, at = [self.t(at)], at + 2
        if not self.name(at):
            return k + 1
        self._atom(at, own, exported)
        body = self._body(at + 1, stop)
        if body is None:
            return at + 1
        self._scope(k, self.close[body])
        self._walk(body + 1, self.close[body], own, False) if self.lang != "go" else self._blocks(body + 1, self.close[body])
        return self.close[body] + 1

    def _blocks(self, k: int, stop: int) -> None:
        for j in range(k, stop):
            if self.t(j) == "{":
                self._block(j)

    def _values(self, k: int, stop: int, path: list[str], exported: bool) -> int:
        inside = self.t(k + 1) == "("
        top = not path and self._depth(k) == 0
        if not (top or (path and self.lang in ("kotlin", "rust") and self._depth(k) == len(path))):
            return k + 1
        if inside:  # a group: the first word of each line
            end = self.close[k + 1]
            for j in range(k + 2, end):
                if self.name(j) and self.tok[j][3] and self._depth(j) == 0:
                    self._atom(j, path, exported)
            return end + 1
        at = k + 1
        self._atom(at, path, exported)
        while self.t(at + 1) == "," and self.name(at + 2):
            at += 2
            self._atom(at, path, exported)
        return at + 1

    def _depth(self, k: int) -> int:
        return sum(1 for a, b in self.close.items() if self.t(a) == "{" and a < k < b)

    def _member(self, k: int, first: int, path: list[str], exported: bool) -> bool:
        """Whether a member of the type around is declared at ``k``; it is taken in."""
        if not self.name(k) or not path:
            return False
        before, after, style = self.t(k - 1), self.t(k + 1), self.words.members
        begins = k == first or self.tok[k][3] or before in (";", "}", "{", ",") or before in self.reserved
        if style == "named":
            ok = begins and (after in ("(", ":", "?", "<") if self.lang == "typescript" else after == ":")
            if not ok and self.lang == "typescript":
                ok = begins and after in ("=", ";")
        elif style == "typed":
            typed = self.name(k - 1) or before in (">", "]", "void", "int", "long", "boolean", "double", "float", "char", "byte", "short")
            ok = (typed and after in ("=", ";", ",")) or (after == "(" and (typed or self.t(k) == path[-1]))
        else:
            ok = False
        if ok:
            self._atom(k, path, exported)
        return ok

    def _after_member(self, k: int, stop: int) -> int:
        """Behind a member: its parameters, type, value and body."""
        if self.t(k + 1) == ",":
            return k + 2
        at = k + 1
        while at < stop and self.t(at) not in (";", "}"):
            if self.t(at) == "{":
                self._scope(k, self.close[at])
                self._blocks(at + 1, self.close[at])
                return self.close[at] + 1
            if at > k + 1 and (self.t(at) == "," or (self.tok[at][3] and self.lang in ("typescript", "kotlin"))):
                return at
            at = self.close.get(at, at) + 1
        return at + 1

    def _string(self, k: int) -> str | None:
        x = self.t(k)
        return x[1:-1] if len(x) > 1 and x[0] in "\"'`" and x[-1] == x[0] else None

    def _head(self) -> None:
        """Package clause and imports."""
        k = 0
        while k < len(self.tok):
            x = self.t(k)
            begins = self.tok[k][3] or self.t(k - 1) == ";"
            if x == "package" and begins and self.lang in ("go", "java", "kotlin"):
                j = k + 1
                while self.t(j + 1) == ".":
                    j += 2
                name = "".join(self.t(i) for i in range(k + 1, j + 1))
                self.out.package = (name, self.tok[min(j, len(self.tok) - 1)][2])
                self.skipped.update(range(k, j + 1))
                k = j
            elif begins and ((x == "import" and self.lang != "rust") or (x in ("use", "pub") and self.lang == "rust" and "use" in (x, self.t(k + 1)))):
                k = self._import(k + (x == "pub"))
            k += 1

    def _add(self, local: str, spec: str, member: str, start: int, end: int, at: int, alias: bool, star: bool = False) -> None:
        a, b = self.tok[at][1], self.tok[at][2]
        quoted = self._string(at) is not None
        self.out.imports.append((local, spec, member, start, end, 0, 0, alias, a + quoted, b - quoted, star))

    def _import(self, k: int) -> int:
        start = self.tok[k][1]
        if self.lang == "go":
            group = self.t(k + 1) == "("
            stop = self.close[k + 1] if group else None
            j = k + 2 if group else k + 1
            while j < (stop if group else min(k + 3, len(self.tok))):
                spec = self._string(j)
                if spec is not None:
                    named = j > k + group and (self.name(j - 1) or self.t(j - 1) in (".", "_")) and j - 1 > k
                    local = self.t(j - 1) if named else ""
                    self._add(local, spec, "", self.tok[j - 1][1] if named else self.tok[j][1] if group else start, self.tok[j][2], j, named, local == ".")
                    if not group:
                        break
                j += 1
            end = stop if group else j
            self.skipped.update(range(k, end + 1))
            return end
        j = k
        while j + 1 < len(self.tok) and self.t(j) != ";" and not (self.tok[j + 1][3] and self.t(j) not in ("{", ",") and not any(a < j + 1 < b for a, b in self.close.items() if k < a)):
            j += 1
        end = self.tok[j][2] if self.t(j) == ";" else self.tok[j][2]
        self.skipped.update(range(k, j + 1))
        toks = [i for i in range(k + 1, j + 1) if self.t(i) != ";"]
        if self.lang == "typescript":
            at = next((i for i in toks if self._string(i) is not None), None)
            if at is None:
                return j
            spec = self._string(at)
            names, i = [], 0
            inside = False
            while i < len(toks) and toks[i] != at:
                x = self.t(toks[i])
                if x in "{}":
                    inside = x == "{"
                elif x == "*" and self.t(toks[i + 1]) == "as":
                    names.append((self.t(toks[i + 2]), "", True))
                    i += 2
                elif _NAME.match(x) and x not in ("from", "as", "type"):
                    alias = self.t(toks[i + 1]) == "as"
                    names.append((self.t(toks[i + 2]) if alias else x, x if inside else "default", alias))
                    i += 2 * alias
                i += 1
            for local, member, alias in names or [("", "", False)]:
                self._add(local, spec, member, start, end, at, alias)
            return j
        if self.lang == "rust":
            self._rust_use(toks, [], start, end)
            return j
        names = [self.t(i) for i in toks if self.t(i) not in (".", "static")]
        if names:
            alias = len(names) > 2 and names[-2] == "as"
            path = names[:-2] if alias else names
            star = path[-1] == "*"
            self._add("*" if star else names[-1], ".".join(path[:-1] if star else path), "*" if star else "", start, end, toks[0], alias, star)
        return j

    def _rust_use(self, toks: list[int], before: list[str], start: int, end: int) -> None:
        path, k = list(before), 0
        while k < len(toks):
            x = self.t(toks[k])
            if x == "{":
                close = next((i for i, n in enumerate(toks) if n == self.close[toks[k]]), len(toks))
                part: list[int] = []
                depth = 0
                for n in [*toks[k + 1 : close], None]:
                    y = "," if n is None else self.t(n)
                    depth += (y == "{") - (y == "}")
                    if y == "," and not depth:
                        if part:
                            self._rust_use(part, path, start, end)
                        part = []
                    else:
                        part.append(n)
                return
            if x == "as":
                self._add(self.t(toks[k + 1]), "::".join(path), "", start, end, toks[0], True)
                return
            if x != ":":
                path.append(x)
            k += 1
        if path:
            star = path[-1] == "*"
            self._add("*" if star else path[-1], "::".join(path[:-1] if star else path), "*" if star else "", start, end, toks[0], False, star)

    def _uses(self) -> None:
        k = 0
        while k < len(self.tok):
            if not self.name(k) or k in self.declared or k in self.skipped:
                k += 1
                continue
            chain, j = [k], k
            while True:  # names joined by . or ::
                step = 2 if self.t(j + 1) == "." else 3 if self.t(j + 1) == ":" and self.t(j + 2) == ":" else 0
                if not step or not self.name(j + step) or j + step in self.declared:
                    break
                j += step
                chain.append(j)
            own = [self.tok[i][:3] for i in chain]
            joined = k > 0 and self.t(k - 1) == "."  # part of what is no name, as a call's result
            if not joined:
                self.out.uses.append((*own[-1], own[:-1]))
            k = j + 1


def brace_facts(raw: bytes, lang: str) -> Facts:
    return _Braces(raw.decode("utf-8", "replace"), lang).out


#: Languages by the ends of file names.
ENDINGS = {"py": "python", "go": "go", "java": "java", "kt": "kotlin", "ts": "typescript", "tsx": "typescript", "js": "typescript", "rs": "rust"}


def facts_of(path: str, text: str) -> tuple[str, Facts]:
    lang = ENDINGS.get(path.rsplit(".", 1)[-1], "")
    raw = text.encode()
    return lang, python_facts(raw) if lang == "python" else brace_facts(raw, lang) if lang else Facts()


_COLUMNS = [("relation", pa.string()), ("file", pa.string()), ("name", pa.string()), ("a", pa.string()), ("b", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("k", pa.int32()), ("l", pa.int32()), ("flag", pa.bool_()), ("star", pa.bool_())]


def _rows(path: str, text: str) -> Iterator[tuple]:
    lang, f = facts_of(path, text)
    yield from _rows_of(path, text, lang, f)


def _rows_of(path: str, text: str, lang: str, f: Facts) -> Iterator[tuple]:
    blank = (None,) * 6
    yield ("file", path, lang, f.package[0] if f.package else "", "", 0, len(text.encode()), f.package[1] if f.package else 0, *blank[:3], None, None)
    around = [f.inner(a, b, strict=True) for a, b, _ in f.scopes]
    for k, (a, b, hole) in enumerate(f.scopes):
        yield ("scope", path, "", "", "", a, b, k, around[k], None, None, hole, None)
    for name, a, b, exported in f.atoms:
        yield ("atom", path, name, "", "", a, b, f.inner(a, b), None, None, None, exported, None)
    for local, spec, member, a, b, ts, te, alias, ps, pe, star in f.imports:
        yield ("import", path, local, spec, member, a, b, ts, te, ps, pe, alias, star)
    firsts = {k: min(((a, name) for name, a, b, _ in f.atoms if f.inner(a, b) == k), default=(-1, "")) for k in range(len(f.scopes))}
    names = {k: name for k, (_, name) in firsts.items()}
    for name, a, b, _ in f.atoms:  # what names a scope is declared around it, and a hole passes its names on
        scope = f.inner(a, b)
        while scope >= 0 and (firsts[scope][0] == a or f.scopes[scope][2]):
            scope = around[scope]
        yield ("declares", path, name, "", "", a, b, scope, *blank[:3], None, None)
    for n, (name, a, b, prefix) in enumerate(f.uses):
        scope = f.inner(a, b)
        own = scope
        while own >= 0 and not names[own]:
            own = around[own]
        yield ("use", path, name, names[own] if own >= 0 else "", "", a, b, scope, len(prefix), n, None, None, None)
        for k, (part, s, e) in enumerate(prefix):
            yield ("use_seg", path, part, "", "", s, e, n, k, None, None, None, None)
    for a, b, kind in f.flows:
        yield ("flow", path, kind, "", "", a, b, None, None, None, None, None, None)
    for name, head, doc in f.docs:
        yield ("doc", path, name, head, doc, 0, 0, None, None, None, None, None, None)


def extracted(files: DataFrame) -> DataFrame:
    """All facts of files (file, text) in one table, one row for each; ``relation`` says of which kind. See ``relations``."""
    return _table(files, lambda: _rows)


def packed(files: DataFrame, pack: str, regex: str = SOURCE) -> DataFrame:
    """As ``extracted``, by the verbs of a pack; what they paint are rows ``paint`` with the class as name."""

    def maker() -> Callable[[str, str], Iterator[tuple]]:
        from ..plans import claims, matcher
        from .sequence import lex_tokens

        own, lexer = claims.load(pack), compiled(regex)

        def rows(path: str, text: str) -> Iterator[tuple]:
            lang = next((v[0] for v in own.of("as-language", path)), "")
            f, paints = claims.facts(own, matcher.File(path, text.encode(), lex_tokens(text, lexer), lang))
            yield from _rows_of(path, text, lang, f)
            for a, b, cls in paints:
                yield ("paint", path, cls, "", "", a, b, None, None, None, None, None, None)

        return rows

    return _table(files, maker)


def _table(files: DataFrame, maker: Callable[[], Callable[[str, str], Iterator[tuple]]]) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows_of = maker()
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                rows = [r for f, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for r in rows_of(f, t or "")]
                columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)], [n for n, _ in _COLUMNS])

    kinds = ", ".join(f"{n} {'string' if t == pa.string() else 'int' if t == pa.int32() else 'boolean'}" for n, t in _COLUMNS)
    return mapped(files.select("file", "text"), work, kinds)


def relations(found: DataFrame) -> dict[str, DataFrame]:
    """The relations of ``extracted`` (stage it first: each is a filter on it), with the columns of ``model.RELATIONS``, and ``doc``."""
    of = lambda name: unbounded(found.where(F.col("relation") == name))
    c = F.col
    atom = of("atom").select("file", "name", "start", "end", c("flag").alias("exported"), c("i").alias("scope_idx"))
    return {
        "file": of("file").select("file", c("name").alias("lang"), c("a").alias("package")),
        "package": of("file").where("a <> ''").select("file", c("a").alias("name"), c("i").alias("end")),
        "scope": of("scope").select("file", c("i").alias("idx"), c("j").alias("parent"), "start", "end", c("flag").alias("hole")),
        "atom": atom,
        "atom_in_file": atom.select("file", "name", atom_ref(c("file"), c("name")).alias("ref"), c("start").alias("seq")),
        "import": of("import").select("file", c("name").alias("local"), c("a").alias("spec"), c("b").alias("member"), "start", "end", c("i").alias("tstart"), c("j").alias("tend"), c("flag").alias("has_alias"), c("k").alias("pstart"), c("l").alias("pend"), "star"),
        "use": of("use").select("file", "name", "start", "end", c("a").alias("scope"), c("i").alias("scope_idx"), c("j").alias("n_prefix"), c("k").alias("use_id")),
        "use_seg": of("use_seg").select("file", c("i").alias("use_id"), c("j").alias("idx"), "name", "start", "end"),
        "flow": of("flow").select("file", "start", "end", c("name").alias("class")),
        "paint": of("paint").select("file", "start", "end", c("name").alias("cls")),
        "doc": of("doc").select("file", "name", c("a").alias("signature"), c("b").alias("doc")),
        "declares": of("declares").select("file", c("i").alias("scope_idx"), leaf(c("name")).alias("leaf"), atom_ref(c("file"), c("name")).alias("ref"), c("start").alias("seq")),
    }
