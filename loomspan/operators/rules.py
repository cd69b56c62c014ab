"""Running rule packs over files: findings, fixes, and the loop that applies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.paths import matches_glob
from ..plans import matcher as M
from ..plans.rules import Pack, emitted, plan
from ..storage import unbounded
from . import spans
from .sequence import lex_tokens
from .tape import SOURCE, compiled

FINDINGS = "file string, seq int, rule_id string, level string, message string, start int, end int, new_text string"


def gate_column(gate: M.Gate):
    """A gate as a condition on the column ``file``: it is checked where files are read."""
    if gate.kind == "path":
        return matches_glob(F.col("file"), gate.glob)
    inner = [gate_column(g) for g in gate.gates]
    if gate.kind == "not":
        return ~inner[0]
    out = inner[0] if inner else F.lit(gate.kind == "and")
    for x in inner[1:]:
        out = (out & x) if gate.kind == "and" else (out | x)
    return out


def can_match(matchers: list) -> Column | None:
    """Whether a file (file, text) can have a match of some matcher, by path conditions and the texts that a match requires; None where any may.

    The condition is checked where files are read.
    """
    each = []
    for m in matchers:
        gate, ways = M.gate_of(m), M.needs(m)
        if gate is None and ways is None:
            return None
        own = F.lit(True) if gate is None else gate_column(gate)
        if ways is not None:
            held = [reduce(lambda x, y: x & y, [F.instr("text", t) > 0 for t in sorted(need, key=lambda t: (-len(t), t))]) for need in ways]
            own &= reduce(lambda x, y: x | y, held)
        each.append(own)
    return F.coalesce(reduce(lambda x, y: x | y, each), F.lit(False)) if each else None


def gated(files: DataFrame, matchers: list) -> DataFrame:
    """Files that can have a match of some matcher."""
    keep = can_match(matchers)
    return files if keep is None else files.where(keep)


def _files(batch: pa.RecordBatch, regex: str, with_nodes: bool, with_targets: bool) -> Iterator[M.File]:
    lexer = compiled(regex)
    for r in batch.to_pylist():
        targets = {(t["start"], t["end"]): t["target"] for t in r["targets"] or ()} if with_targets else {}
        nodes = _nodes(r["nodes"] or ()) if with_nodes else []
        text = r["text"] or ""
        yield M.File(r["file"], text.encode(), lex_tokens(text, lexer, targets), r["lang"] or "", nodes)


def _nodes(rows: list[dict]) -> list[M.Node]:
    """Nodes with the spans of what fills their fields."""
    out = [M.Node(n["type"], n["start"], n["end"]) for n in rows]
    number = {n["node_id"]: k for k, n in enumerate(rows) if n["node_id"] is not None}
    for n in rows:
        if n["field"] and n["parent_id"] in number:
            out[number[n["parent_id"]]].fields.setdefault(n["field"], (n["start"], n["end"]))
    return out


def _prepared(files: DataFrame, nodes: DataFrame | None, targets: DataFrame | None) -> DataFrame:
    out = files.select("file", "text", (F.col("lang") if "lang" in files.columns else F.lit("")).alias("lang"))
    if nodes is not None:
        more = [F.col(c) if c in nodes.columns else F.lit(None).cast(k).alias(c) for c, k in (("node_id", "int"), ("parent_id", "int"), ("field", "string"))]
        own = nodes.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "end", "type", *more))).alias("nodes"))
        out = out.join(unbounded(own), "file", "left")
    if targets is not None:
        own = targets.groupBy("file").agg(F.collect_list(F.struct("start", "end", "target")).alias("targets"))
        out = out.join(unbounded(own), "file", "left")
    return out


def search(files: DataFrame, source: str, regex: str = SOURCE, nodes: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Matches of one matcher: file, start, end, text, sites."""
    m = M.parse(source)
    ready = _prepared(gated(files, [m]), nodes, targets)
    with_nodes, with_targets = nodes is not None, targets is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .sequence import batch_of, row

        lexers = {name: lambda t: lex_tokens(t, compiled(regex)) for name in _languages(m)}
        for batch in batches:
            out = []
            for f in _files(batch, regex, with_nodes, with_targets):
                out += [(0, f.path, *row(x, M.names(m), f.text)) for x in M.find(m, f, lexers)]
            yield batch_of(out)

    from .sequence import MATCHES

    return mapped(ready, work, MATCHES).drop("pattern", "first", "last")


def captured(files: DataFrame, source: str, names: list[str], regex: str = SOURCE, **more) -> DataFrame:
    """file, start, end and the text of each capture's first site: matches as rows that clauses can read."""
    found = search(files, source, regex, **more)
    each = [F.coalesce(F.get(F.col("sites")[n], F.lit(0))["text"], F.lit("")).alias(n) for n in names]
    return found.select("file", "start", "end", *each)


def _languages(m) -> set[str]:
    return {x.lang for x in M.walk(m) if isinstance(x, M.AsLanguage)}


class _Run:
    """A pack's rules on one file after the other; made where the files are."""

    def __init__(self, pack: Pack, regex: str):
        self.own = [r for r in pack.rules if not r.builtin]
        self.steps = plan(Pack(self.own))
        self.lexers = {lang: lambda t: lex_tokens(t, compiled(regex)) for r in self.own for lang in _languages(r.matcher)}

    def matches(self, f: M.File) -> dict[int, list]:
        out = {k: M.find(self.own[k].matcher, f, self.lexers) for k in [*self.steps.fused, *self.steps.rest]}
        for group in self.steps.under.values():
            regions = M.find(self.own[group[0]].matcher.region, f, self.lexers)  # once for all rules below it
            for k in group:
                out[k] = []
                for region in regions:
                    inner = M.File(f.path, f.text, M.within(f.tokens, region.start, region.end), f.lang, [n for n in f.nodes if region.start <= n.start and n.end <= region.end])
                    out[k] += M.find(self.own[k].matcher.body, inner, self.lexers)
        return out

    def rows(self, f: M.File) -> Iterator[tuple]:
        """The file's findings as FINDINGS, in the order of rules."""
        seq = 0
        for k, found in sorted(self.matches(f).items()):
            r = self.own[k]
            for x in found:
                yield f.path, seq, r.id, r.level, r.message, x.start, x.end, None if r.emit is None else emitted(r.emit, x.sites)
                seq += 1


def findings(files: DataFrame, pack: Pack, regex: str = SOURCE, nodes: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """All rules' matches in one pass over the files, in the order of rules: FINDINGS; new_text is null without a fix."""
    own = [r.matcher for r in pack.rules if not r.builtin]
    ready = _prepared(gated(files, own), nodes, targets)
    with_nodes, with_targets = nodes is not None, targets is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "seq", "rule_id", "level", "message", "start", "end", "new_text"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
        run = _Run(pack, regex)
        for batch in batches:
            rows = [row for f in _files(batch, regex, with_nodes, with_targets) for row in run.rows(f)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return mapped(ready, work, FINDINGS)


def mended(files: DataFrame, pack: Pack, regex: str = SOURCE, nodes: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """file, text: files with all fixes that overlap no earlier one applied; matching, claims and edits in one pass, without a shuffle."""
    own = [r.matcher for r in pack.rules if not r.builtin]
    keep = can_match(own)
    ready = _prepared(files if keep is None else files.where(keep), nodes, targets)
    with_nodes, with_targets = nodes is not None, targets is not None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Run(pack, regex)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = part.column(1).to_pylist()
                for at, f in enumerate(_files(part, regex, with_nodes, with_targets)):
                    claims = spans.Claims()
                    edits = [(start, end, new) for *_, start, end, new in run.rows(f) if new is not None and claims.take(start, end)]
                    if edits:
                        texts[at] = spans.apply_edits(texts[at], edits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["file", "text"])

    done = mapped(ready, work, "file string, text string")
    return done if keep is None else done.unionByName(files.where(~keep).select("file", "text"))


def fixed(files: DataFrame, pack: Pack, regex: str = SOURCE, **more) -> tuple[DataFrame, DataFrame]:
    """Files with all fixes that overlap no earlier one applied, and the findings that a second run leaves."""
    new = mended(files, pack, regex, **more)
    return new, findings(new, pack, regex)


def rewritten(files: DataFrame, pattern: str, emit: str, regex: str = SOURCE, **more) -> DataFrame:
    """file, text: every match replaced by the template."""
    from ..plans.rules import load

    return mended(files, load(f"(rewrite {pattern} {emit})"), regex, **more)
