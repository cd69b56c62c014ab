"""Queries by shape over trees: ordered children, quantifiers, anchors, negated fields, alternatives, predicates.

``(call function: (identifier) @f (arguments . (string) @first !spread)) (#eq? @f "open")``. Children match
siblings in order, not necessarily next to each other. ``.`` asks for the first, the last, or the next named
sibling. ``+`` and ``*`` take a longest run of neighbouring named siblings, ``?`` one; ``*`` and ``?`` take none only where
nothing fits. ``!field`` says that no child has a field, ``[...]`` holds alternatives, ``_`` is any named node, and a text in
quotes is a mark or word.

Nodes come once, in order: a node's interval ends where the next one is no deeper. The nodes that are open stand
on a stack; one that ends is matched against all steps by what its children matched, so every
file takes one pass, however deep the query is.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from dataclasses import field as made

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import mapped
from ..sources import trees
from ..sources.syntax import is_named

_TOKEN = re.compile(r"\"(?:[^\"\\]|\\.)*\"|;[^\n]*|#[\w?!-]+|@[\w.-]+|![A-Za-z_]\w*|[A-Za-z_]\w*:|[A-Za-z_][\w.]*|[()\[\].*+?]")
Bound = dict[str, tuple]


@dataclass
class Step:
    type: str  # "_": any named node; "[": alternatives
    anonymous: bool = False
    field: str = ""
    children: list[Step] = made(default_factory=list)
    captures: list[str] = made(default_factory=list)
    quantifier: str = ""
    after: bool = False  # next to the step before it, or the first
    last: bool = False  # its last step is the last child
    absent: list[str] = made(default_factory=list)

    def every(self) -> Iterator[Step]:
        for c in self.children:
            yield from c.every()
        yield self


@dataclass
class Query:
    steps: list[Step]
    predicates: list[tuple[str, list[str]]]

    @property
    def names(self) -> list[str]:
        return sorted({n for s in self.steps for x in s.every() for n in x.captures})


def _text(word: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), word[1:-1])


def parse(source: str) -> Query:
    words = [w for w in _TOKEN.findall(source) if not w.startswith(";")]
    at = 0
    predicates: list[tuple[str, list[str]]] = []

    def fail(why: str):
        raise ValueError(f"{why} in tree query: {source}")

    def need(word: str) -> None:
        nonlocal at
        if at >= len(words) or words[at] != word:
            fail(f"no {word}")
        at += 1

    def suffixed(step: Step) -> Step:
        nonlocal at
        while at < len(words) and (words[at] in ("*", "+", "?") or words[at][0] == "@"):
            if words[at][0] == "@":
                step.captures.append(words[at][1:])
            else:
                step.quantifier = words[at]
            at += 1
        return step

    def inside(step: Step, closer: str) -> None:
        nonlocal at
        own, anchor = "", False
        while at < len(words) and words[at] != closer:
            word = words[at]
            if word == ".":
                anchor, at = True, at + 1
            elif word[0] == "!":
                step.absent.append(word[1:])
                at += 1
            elif word[-1] == ":":
                own, at = word[:-1], at + 1
            elif word == "(" and words[at + 1 : at + 2] and words[at + 1][0] == "#":
                predicate()
            else:
                child = node()
                child.field, child.after = own, anchor
                step.children.append(child)
                own, anchor = "", False
        step.last = anchor
        need(closer)

    def node() -> Step:
        nonlocal at
        word = words[at]
        at += 1
        if word == "(":
            if at >= len(words) or not (words[at][0].isalpha() or words[at][0] == "_"):
                fail("no type")
            step = Step(words[at])
            at += 1
            inside(step, ")")
        elif word == "[":
            step = Step("[")
            inside(step, "]")
        elif word[0] == '"':
            step = Step(_text(word), anonymous=True)
        elif word == "_":
            step = Step("_")
        else:
            return fail(f"unexpected {word}")
        return suffixed(step)

    def predicate() -> None:
        nonlocal at
        need("(")
        op, args = words[at], []
        at += 1
        while at < len(words) and words[at] != ")":
            args.append(words[at])
            at += 1
        need(")")
        if op.removeprefix("#").removeprefix("not-").removeprefix("any-") not in ("eq?", "match?", "of?"):
            fail(f"unknown {op}")
        predicates.append((op, args))

    steps = []
    while at < len(words):
        if words[at] == "(" and words[at + 1 : at + 2] and words[at + 1][0] == "#":
            predicate()
        else:
            steps.append(node())
    if not steps:
        fail("nothing to find")
    return Query(steps, predicates)


@dataclass
class _Open:
    type: str
    start: int
    end: int
    field: str
    named: bool
    depth: int
    children: list[_Open] = made(default_factory=list)
    found: dict[int, list[Bound]] = made(default_factory=dict)


class Twig:
    """Matches of a query over the nodes of one file, which come in order."""

    def __init__(self, query: Query):
        self.query = query
        self.steps = [x for s in query.steps for x in s.every()]  # inner steps before the ones around them
        self.roots = {id(s): k for k, s in enumerate(query.steps)}
        self.stack: list[_Open] = []
        self.out: list[tuple[int, int, int, Bound]] = []

    def push(self, type_: str, start: int, end: int, depth: int, field_: str) -> None:
        self.close(depth)
        own = _Open(type_, start, end, field_, is_named(type_), depth)
        if self.stack:
            self.stack[-1].children.append(own)
        self.stack.append(own)

    def close(self, depth: int = 0) -> None:
        while self.stack and self.stack[-1].depth >= depth:
            self._match(self.stack.pop())

    def _match(self, n: _Open) -> None:
        for step in self.steps:
            if step.type == "[":
                ways = [w for c in step.children if not c.field or c.field == n.field for w in n.found.get(id(c), [])]
            elif step.anonymous:
                ways = [{}] if step.type == n.type and not n.named else []
            elif step.type not in ("_", n.type) or not n.named or any(c.field in step.absent for c in n.children):
                ways = []
            else:
                ways = self._ordered(step, n.children, 0, 0) if step.children or step.last else [{}]
            if ways:
                if step.captures:
                    own = {name: ((n.start, n.end),) for name in step.captures}
                    ways = [_joined(own, w) for w in ways]
                n.found[id(step)] = ways
                if id(step) in self.roots:
                    self.out += [(n.start, n.end, self.roots[id(step)], w) for w in ways]
        n.children = []

    def _ordered(self, step: Step, children: list[_Open], k: int, at: int) -> list[Bound]:
        """Ways in which steps from ``k`` match children from ``at`` on."""
        if k == len(step.children):
            return [{}] if not (step.last and any(c.named for c in children[at:])) else []
        want = step.children[k]
        fits = lambda c: (not want.field or c.field == want.field) and id(want) in c.found
        out = []
        for j in range(at, len(children)):
            if fits(children[j]) and not (want.quantifier in ("+", "*") and self._before(children, at, j, fits)):
                run = [j]
                if want.quantifier in ("+", "*"):
                    run = self._run(children, j, fits)
                own = [_all(ways) for ways in itertools.product(*(children[i].found[id(want)] for i in run))]
                rest = self._ordered(step, children, k + 1, run[-1] + 1)
                out += [_joined(x, y) for x in own for y in rest]
            if want.after and children[j].named:
                break
        if not out and want.quantifier in ("*", "?") and not any(fits(c) for c in children[at:]):
            return self._ordered(step, children, k + 1, at)
        return out

    def _run(self, children: list[_Open], j: int, fits) -> list[int]:
        run = [j]
        for i in range(j + 1, len(children)):
            if fits(children[i]):
                run.append(i)
            elif children[i].named or not children[j].named:
                break
        return run

    def _before(self, children: list[_Open], at: int, j: int, fits) -> bool:
        """Whether the sibling before ``j`` belongs to the same run."""
        for i in range(j - 1, at - 1, -1):
            if children[i].named or not children[j].named:
                return fits(children[i])
        return False


def _joined(a: Bound, b: Bound) -> Bound:
    return a | {k: a.get(k, ()) + v for k, v in b.items()}


def _all(ways: tuple[Bound, ...]) -> Bound:
    out: Bound = {}
    for w in ways:
        out = _joined(out, w)
    return out


def holds(predicates: list[tuple[str, list[str]]], bound: Bound, raw: bytes) -> bool:
    """Whether the texts of captures satisfy all predicates; a name without a capture satisfies any."""
    texts = {k: [raw[a:b].decode("utf-8", "replace") for a, b in v] for k, v in bound.items()}
    value = lambda w: texts.get(w[1:], []) if w[0] == "@" else [_text(w)]
    for op, (name, *args) in predicates:
        own, kind = texts.get(name[1:], []), op.removeprefix("#").removeprefix("not-")
        others = [x for a in args for x in value(a)]
        if kind == "match?":
            good = [bool(re.search(others[0], x)) for x in own]
        else:
            good = [x in others for x in own]
        if any(g == op.startswith("#not-") for g in good):
            return False
    return True


FOUND = "file string, start int, end int, pattern int, captures map<string,array<struct<start:int,end:int>>>"


def _batch(rows: list[tuple[str, int, int, int, Bound]]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
    maps = [[(k, [{"start": a, "end": b} for a, b in v]) for k, v in sorted(r[4].items())] for r in rows]
    columns = [*([r[k] for r in rows] for k in range(4)), maps]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "end", "pattern", "captures"])


def search(files: DataFrame, language: str, source: str, file: str = "file", text: str = "text") -> DataFrame:
    """file, start, end, pattern (its number in the query), captures (spans by name): one row for each way to match.

    Files are parsed and matched in one pass, without a shuffle; null texts have no nodes.
    """
    query, parser = parse(source), trees.PARSERS[language]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t is None:
                    continue
                twig, raw = Twig(query), t.encode()
                for _, _, type_, a, b, depth, name in parser(t):
                    twig.push(type_, a, b, depth, name)
                twig.close()
                rows += [(f, *m) for m in sorted(twig.out, key=lambda m: m[:3]) if holds(query.predicates, m[3], raw)]
            yield _batch(rows)

    return mapped(files.select(F.col(file).cast("string").alias("file"), F.col(text).alias("text")), work, FOUND)


def join(nodes: DataFrame, source: str) -> DataFrame:
    """As ``search``, over a table of nodes: each file's nodes are sorted once and go by. Predicates need texts, so they are an error here."""
    query = parse(source)
    if query.predicates:
        raise ValueError("predicates need the texts: use search")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, twig = None, Twig(query)
        for batch in batches:
            rows: list = []
            for f, type_, a, b, depth, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if f != file:
                    twig.close()
                    rows += [(file, *m) for m in sorted(twig.out, key=lambda m: m[:3])]
                    file, twig = f, Twig(query)
                twig.push(type_, a, b, depth, name)
            if rows:
                yield _batch(rows)
        twig.close()
        if twig.out:
            yield _batch([(file, *m) for m in sorted(twig.out, key=lambda m: m[:3])])

    own = nodes.select("file", "node_id", "type", "start", "end", "depth", "field").repartition("file").sortWithinPartitions("file", "node_id")
    return mapped(own.select("file", "type", "start", "end", "depth", "field"), work, FOUND)


def captured(found: DataFrame, name: str) -> DataFrame:
    """file, start, end of the match, at, c_start, c_end: one row for each span of a capture, in order."""
    each = found.select("file", "start", "end", F.posexplode(F.col("captures")[name]).alias("at", "x"))
    return each.select("file", "start", "end", "at", F.col("x.start").alias("c_start"), F.col("x.end").alias("c_end"))
