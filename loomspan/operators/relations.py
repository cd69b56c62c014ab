"""Horn clauses over relations: bodies become joins, negation an anti join, recursion a semi-naive loop.

Clauses fall into three fixed strata: positive ones, those with a negated literal,
and those whose head is ``finding`` or ``edit``. Body order is the order of reading,
not of execution, which is left to the optimizer.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import staged


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    relation: str
    args: tuple
    negated: bool = False


@dataclass(frozen=True)
class Clause:
    head: Atom
    body: tuple[Atom, ...]

    @property
    def stratum(self) -> int:
        if self.head.relation in ("finding", "edit"):
            return 2
        return int(any(a.negated for a in self.body))


def atom(relation: str, *args, negated: bool = False) -> Atom:
    """``"?x"`` is a variable, everything else a constant."""
    return Atom(relation, tuple(Var(a[1:]) if isinstance(a, str) and a.startswith("?") else a for a in args), negated)


def clause(head: Atom, *body: Atom) -> Clause:
    return Clause(head, body)


@dataclass(frozen=True)
class Builtin:
    """A relation worked out by the host: ``inputs`` leading arguments, then outputs.

    ``rows`` takes the input columns: with outputs it gives an array of structs, one for
    each result; without, a boolean.
    """

    inputs: int
    rows: Callable[..., Column]


def _scan(df: DataFrame, a: Atom) -> DataFrame | None:
    """The rows of a relation that fit an atom, with its variables as columns."""
    if len(df.columns) != len(a.args):
        return None
    cols = [F.col(f"`{c}`") for c in df.columns]
    seen: dict[str, Column] = {}
    keep = F.lit(True)
    for c, arg in zip(cols, a.args, strict=True):
        if not isinstance(arg, Var):
            keep &= c.cast("string") == str(arg) if isinstance(arg, str) else c == arg
        elif arg.name in seen:
            keep &= c == seen[arg.name]
        else:
            seen[arg.name] = c
    return df.where(keep).select(*(c.alias(v) for v, c in seen.items())) if seen else df.where(keep).limit(1).select(F.lit(1).alias("_unit"))


def _without(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows that are not among the known ones; a null is equal to a null."""
    names = [f"_k{k}" for k in range(len(rows.columns))]
    own, other = rows.toDF(*names).alias("n"), known.toDF(*names).alias("o")
    same = reduce(lambda x, y: x & y, [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in names])
    return own.join(other, same, "left_anti").toDF(*rows.columns)


def _shared(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in b.columns if c in a.columns]


ROUNDS_HELD = 8  # rounds after which a relation that grows is written


class Program:
    def __init__(self, *clauses: Clause, builtins: dict[str, Builtin] | None = None):
        self.clauses, self.builtins = clauses, builtins or {}

    def _body(self, c: Clause, tables: dict[str, DataFrame], instead: int | None = None, delta: DataFrame | None = None) -> DataFrame | None:
        """Bindings of a body; ``delta`` stands in for the relation of the atom ``instead``."""
        out: DataFrame | None = None
        for k, a in enumerate(c.body):
            if a.relation.startswith("$") and a.relation not in tables:
                out = self._builtin(out, a)
            else:
                df = delta if k == instead else tables.get(a.relation)
                rows = None if df is None else _scan(df, a)
                if a.negated:
                    if rows is None or out is None:
                        continue
                    on = _shared(out, rows)
                    out = out.join(rows.select(*on).distinct(), on, "left_anti") if on else (out.limit(0) if not rows.isEmpty() else out)
                    continue
                if rows is None:
                    return None
                if out is None:
                    out = rows
                    continue
                on = _shared(out, rows)
                if on:
                    out = out.join(rows, on)
                elif "_unit" in rows.columns:
                    out = out if not rows.isEmpty() else out.limit(0)
                else:
                    raise ValueError(f"{a.relation} shares no variable with what stands before it")
            if out is None:
                return None
        return out

    def _builtin(self, out: DataFrame | None, a: Atom) -> DataFrame | None:
        b = self.builtins.get(a.relation)
        if b is None:
            return out if a.negated else None
        value = lambda x: F.col(x.name) if isinstance(x, Var) else F.lit(x)
        ins, outs = a.args[: b.inputs], a.args[b.inputs :]
        if out is None:
            return None
        found = b.rows(*map(value, ins))
        if not outs:
            return out.where(~found if a.negated else found)
        free = [x for x in outs if isinstance(x, Var) and x.name not in out.columns]
        if a.negated:
            if free:
                return out
            hit = lambda r: reduce(lambda x, y: x & y, [r[f"o{k}"] == value(x) for k, x in enumerate(outs)])
            return out.where(~F.exists(found, hit))
        rows = out.withColumn("_row", F.explode(found))
        keep = F.lit(True)
        for k, x in enumerate(outs):
            if x not in free:
                keep &= F.col(f"_row.o{k}") == value(x)
        rows = rows.where(keep)
        new = {x.name: F.col(f"_row.o{k}") for k, x in enumerate(outs) if x in free}
        return rows.withColumns(new).drop("_row")

    def _head(self, c: Clause, rows: DataFrame, columns: list[str], kinds: list | None) -> DataFrame | None:
        if any(isinstance(x, Var) and x.name not in rows.columns for x in c.head.args):
            return None
        cols = [F.col(x.name) if isinstance(x, Var) else F.lit(x) for x in c.head.args]
        if kinds:
            cols = [x.cast(k) for x, k in zip(cols, kinds, strict=True)]
        return rows.select(*(x.alias(n) for x, n in zip(cols, columns, strict=True)))

    def evaluate(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """All relations after the three strata; each stratum runs to its fixed point, however many rounds that takes.

        A round works on the rows that the one before found for the first time. Rows are
        equal where all values are, nulls included, so a rule that finds them again ends.
        """
        tables, grown = dict(tables), {}
        for stratum in range(3):
            own = [c for c in self.clauses if c.stratum == stratum]
            heads = {c.head.relation for c in own}
            recursive = any(a.relation in heads for c in own for a in c.body)
            delta = self._round(own, tables, None)
            while delta:
                fresh: dict[str, DataFrame] = {}
                for name, rows in delta.items():
                    old = tables.get(name)
                    rows = rows.dropDuplicates()
                    if old is not None:
                        rows = _without(rows, old)
                    if recursive:
                        rows = staged(rows)
                        if rows.isEmpty():
                            continue
                    fresh[name] = rows
                    tables[name] = rows if old is None else old.union(rows)
                    grown[name] = grown.get(name, 0) + recursive
                    if grown[name] >= ROUNDS_HELD:  # a plan does not grow with the depth
                        tables[name], grown[name] = staged(tables[name]), 0
                delta = self._round(own, tables, fresh) if recursive and fresh else {}
        return tables

    def _round(self, own: list[Clause], tables: dict[str, DataFrame], delta: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
        """New rows of all clauses; with ``delta``, only those that use a row of the last round."""
        out: dict[str, list[DataFrame]] = {}
        for c in own:
            if delta is None:
                bodies = [self._body(c, tables)]
            else:
                bodies = [self._body(c, tables, k, delta[a.relation]) for k, a in enumerate(c.body) if not a.negated and a.relation in delta]
            for rows in bodies:
                if rows is None:
                    continue
                have = tables.get(c.head.relation) or (out.get(c.head.relation) or [None])[0]
                columns = have.columns if have is not None and len(have.columns) == len(c.head.args) else [f"c{k}" for k in range(len(c.head.args))]
                head = self._head(c, rows, columns, [have.schema[n].dataType for n in columns] if have is not None and columns == have.columns else None)
                if head is not None:
                    out.setdefault(c.head.relation, []).append(head)
        return {n: reduce(DataFrame.union, dfs) for n, dfs in out.items()}


def closure(edges: DataFrame, parent: str, child: str) -> DataFrame:
    """All (ancestor, descendant, depth) pairs of a graph, each at its smallest depth; doubles the depth in each round.

    In a circle each node is its own descendant. Edges with a null end lead nowhere.
    """
    ends = edges.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"), F.lit(1).alias("depth")).dropna().distinct()
    paths = staged(ends)
    reach = 1
    while True:
        right = paths.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("to"), F.col("depth").alias("more"))
        longer = paths.where(F.col("depth") == reach).join(right, "descendant").select("ancestor", F.col("to").alias("descendant"), (F.col("depth") + F.col("more")).alias("depth"))
        paths = staged(paths.union(longer).groupBy("ancestor", "descendant").agg(F.min("depth").alias("depth")))
        reach *= 2
        if paths.where(F.col("depth") >= reach).isEmpty():
            return paths


#: Host relations that need no data beside their arguments.
PLAIN = {
    "$file_ref": Builtin(1, lambda f: F.array(F.struct(F.concat(F.lit("path:"), f).alias("o0")))),
    "$file_ref_of": Builtin(1, lambda f: F.array(F.struct(F.concat(F.lit("path:"), f).alias("o0")))),
    "$atom_ref": Builtin(2, lambda f, n: F.array(F.struct(F.concat(F.lit("path:"), f, F.lit("::"), n).alias("o0")))),
    "$concat": Builtin(3, lambda a, b, c: F.array(F.struct(F.concat(a, b, c).alias("o0")))),
    "$leaf_eq": Builtin(2, lambda a, b: F.substring_index(a, ".", -1) == F.substring_index(b, ".", -1)),
    "$neq": Builtin(2, lambda a, b: a != b),
    "$ge0": Builtin(1, lambda n: n >= 0),
    "$gt0": Builtin(1, lambda n: n > 0),
    "$pred": Builtin(1, lambda n: F.filter(F.array(F.struct((n - 1).alias("o0"))), lambda r: r["o0"] >= 0)),
    "$last": Builtin(1, lambda n: F.filter(F.array(F.struct((n - 1).alias("o0"))), lambda r: r["o0"] >= 0)),
    "$not_private": Builtin(1, lambda n: ~n.startswith("_")),
    "$is_named": Builtin(1, lambda n: ~n.isin("", "*", ".", "_")),
    "$import_name": Builtin(2, lambda local, spec: F.array(F.struct(F.when(local != "", local).otherwise(F.substring_index(F.regexp_replace(spec, "^[\"'`]|[\"'`]$", ""), "/", -1)).alias("o0")))),
    "$import_span": Builtin(4, lambda s, e, ps, pe: F.filter(F.array(F.struct(F.when(e > s, s).otherwise(ps).alias("o0"), F.when(e > s, e).otherwise(pe).alias("o1"))), lambda r: r["o1"] > r["o0"])),
    "$pick_span": Builtin(4, lambda s, e, ts, te: F.array(F.struct(F.when((ts == 0) & (te == 0), s).otherwise(ts).alias("o0"), F.when((ts == 0) & (te == 0), e).otherwise(te).alias("o1")))),
    "$reexport_names": Builtin(2, lambda e, s: F.array(F.struct(F.when(e != "", e).otherwise(s).alias("o0"), F.when(s != "", s).otherwise(e).alias("o1")))),
    "$reexport_target": Builtin(2, lambda b, n: F.array(F.struct(F.when(n == "", F.concat(F.lit("path:"), b)).otherwise(F.concat(F.lit("path:"), b, F.lit("::"), n)).alias("o0")))),
    "$path_file": Builtin(1, lambda r: F.filter(F.array(F.struct(F.regexp_extract(r, "^path:([^:]+)$", 1).alias("o0"))), lambda x: x["o0"] != "")),
    "$ref_file": Builtin(1, lambda r: F.filter(F.array(F.struct(F.regexp_extract(r, "^path:([^:]+)", 1).alias("o0"))), lambda x: x["o0"] != "")),
    "$span_ok": Builtin(2, lambda s, e: e > s),
}


def host_tables(specs: DataFrame | None = None, visible: DataFrame | None = None, members: DataFrame | None = None, renames: DataFrame | None = None, holes: DataFrame | None = None, places: DataFrame | None = None, moved: DataFrame | None = None, rewrites: DataFrame | None = None, sites: DataFrame | None = None, peers: DataFrame | None = None, sources: DataFrame | None = None, imported: DataFrame | None = None) -> dict[str, DataFrame]:
    """The host relations that are tables, by name; a clause reads them like any other relation.

    ``$mod_resolve`` spec, file, base; ``$visible_at`` file, scope, name, ref; ``$hop`` ref, name, target;
    ``$rename_leaf`` ref, new_text; ``$move_hole`` and ``$move_place``; ``$move_file`` (the moved
    files, for ``$not_move_file`` use it negated); ``$rewrite_spec`` file, spec, new_spec (where they differ);
    ``$rule`` number, file, start, end; ``$pkg_peer`` file, peer; ``$use_from`` file, scope, ref;
    ``$import_member`` base, member, ref.
    """
    changed = None if rewrites is None else rewrites.where(~F.col("spec").eqNullSafe(F.col("new_spec"))).select("file", "spec", "new_spec")
    given = {
        "$mod_resolve": (specs, ["spec", "file", "base"]), "$visible_at": (visible, ["file", "scope_idx", "leaf", "ref"]), "$hop": (members, ["ref", "name", "target"]),
        "$rename_leaf": (renames, ["ref", "new_text"]), "$move_hole": (holes, ["file", "start", "end"]), "$move_place": (places, ["file", "start", "end", "text"]),
        "$move_file": (moved, ["file"]), "$rewrite_spec": (changed, ["file", "spec", "new_spec"]), "$rule": (sites, ["rule", "file", "start", "end"]),
        "$pkg_peer": (peers, ["file", "peer"]), "$use_from": (sources, ["file", "scope", "ref"]), "$import_member": (imported, ["base", "member", "ref"]),
    }
    return {name: df.select(*columns).distinct() for name, (df, columns) in given.items() if df is not None}
