"""Declarations moved to other files with the imports that they and their users then need.

Names are told by tables: what a moved declaration uses, who declares or imports that, where it will be, and who
uses what moved. Each file's new imports follow from these; moves that would clash, or make two files import each other, are
turned back, and what depends on them is worked out again until no more are.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.paths import dir_of
from ..storage import staged
from . import refactor, reimport, spans

Tables = dict[str, DataFrame]


def module_of(path: Column) -> Column:
    """The dotted name of a Python file."""
    return F.replace(F.regexp_replace(path, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))


def rooted_uses(t: Tables) -> DataFrame:
    """file, root, start, end, name, name_start, n_prefix: uses by the first name that they begin with, and its span."""
    first = t["use_seg"].where("idx = 0").select("file", "use_id", F.col("name").alias("r"), F.col("start").alias("rs"), F.col("end").alias("re"))
    own = t["use"].join(first, ["file", "use_id"], "left")
    return own.select("file", F.coalesce("r", "name").alias("root"), F.coalesce("rs", "start").alias("start"), F.coalesce("re", "end").alias("end"), "name", F.col("start").alias("name_start"), "n_prefix")


def _inside(uses: DataFrame, holes: DataFrame) -> DataFrame:
    """Uses inside of moved declarations, with these as ``o_name`` and ``o_to``."""
    return spans.containing(uses, holes.select("file", "start", "end", "name", "to")).drop("o_file", "o_start", "o_end")


def _line(target: str, member: str, local: str, alias: str) -> Column:
    whole = F.concat(F.lit("import "), F.col(target))
    part = F.concat(F.lit("from "), F.col(target), F.lit(" import "), F.col(member))
    return F.concat(F.when(F.col(member) == "", whole).otherwise(part), F.when(F.col(alias), F.concat(F.lit(" as "), F.col(local))).otherwise(F.lit("")))


class PythonMoves:
    """Plans of moves (file, name, to) of top-level declarations between Python files (file, text), from relations ``t``."""

    def __init__(self, moves: DataFrame, files: DataFrame, t: Tables):
        self.files = files
        declared = refactor.declarations(t["atom"].join(moves.select("file", "name").distinct(), ["file", "name"], "left_semi"), t["scope"], files)
        self.declared = staged(declared)
        order = Window.partitionBy("to", "name").orderBy("file")
        self.moves = staged(moves.where("file <> to").distinct().join(self.declared.select("file", "name", "start", "end"), ["file", "name"]).withColumn("nth", F.row_number().over(order)))
        self.uses = staged(rooted_uses(t))
        self.atoms = staged(t["atom"].where("NOT contains(name, '.')").select("file", "name").distinct())
        named = reimport.resolved(reimport.marked(t["import"], files), files).select("file", F.col("start").alias("pstart"), "path")
        spec_dots = F.length(F.regexp_extract("spec", r"^\.*", 0))
        self.imports = staged(t["import"].where("NOT star").withColumn("ps", F.col("pstart") - spec_dots).join(named.withColumnRenamed("pstart", "ps"), ["file", "ps"], "left"))

    def rejects(self) -> DataFrame:
        """file, name, to, reason: moves that must not be made; runs until no more follow."""
        m = self.moves
        taken = m.join(self.atoms.select(F.col("file").alias("to"), "name").join(m.select(F.col("file").alias("to"), "name"), ["to", "name"], "left_anti"), ["to", "name"])
        both = m.where("nth > 1")
        imported = m.join(self.imports.select(F.col("file").alias("to"), F.col("local").alias("name"), "path").where("name <> ''"), ["to", "name"]).where("path IS NULL OR path <> file")
        bad = [d.select("file", "name", "to", F.concat("to", F.lit(" has "), "name", F.lit(" already")).alias("reason")) for d in (taken, both, imported)]
        found = staged(bad[0].unionByName(bad[1]).unionByName(bad[2]).distinct())
        while True:
            good = m.join(found.select("file", "name"), ["file", "name"], "left_anti")
            needs, circles = self.needed(good), self.circles(good)
            clash = needs.join(self.imports.select(F.col("file").alias("to"), "local", "path", F.col("spec").alias("have"), F.col("member").alias("their")), ["to", "local"])
            clash = clash.where("NOT (their <=> member AND ((home IS NOT NULL AND path <=> home) OR (home IS NULL AND have = target)))")
            own = needs.join(self.atoms.select(F.col("file").alias("to"), F.col("name").alias("local")), ["to", "local"])
            more = clash.select("file", "name", "to", "local").unionByName(own.select("file", "name", "to", "local"))
            more = more.select("file", "name", "to", F.concat("to", F.lit(" has "), "local", F.lit(" already")).alias("reason")).unionByName(circles)
            more = staged(more.groupBy("file", "name", "to").agg(F.min("reason").alias("reason")))
            if more.isEmpty():
                return found
            found = staged(found.unionByName(more))

    def _stays(self, good: DataFrame) -> DataFrame:
        """file, name, to, root, home: what moved declarations use of their old file, and the file where that will be."""
        inner = _inside(self.uses, good).select("file", F.col("o_name").alias("name"), F.col("o_to").alias("to"), "root").distinct()
        own = inner.join(self.atoms.withColumnRenamed("name", "root"), ["file", "root"]).where("root <> name")
        to = good.select("file", F.col("name").alias("root"), F.col("to").alias("moved"))
        return own.join(to, ["file", "root"], "left").select("file", "name", "to", "root", F.coalesce("moved", "file").alias("home")).where("home <> to")

    def needed(self, good: DataFrame) -> DataFrame:
        """file, name, to, local, target, member, alias, home: imports that moved declarations need in their new file."""
        inner = _inside(self.uses, good).select("file", F.col("o_name").alias("name"), F.col("o_to").alias("to"), "root").distinct()
        gone = good.select(F.col("file").alias("path"), F.col("name").alias("member"), F.col("to").alias("moved"))
        own = self.imports.select("file", F.col("local").alias("root"), "spec", "member", "has_alias", "path").join(gone, ["path", "member"], "left")
        own = own.withColumn("home", F.coalesce("moved", "path"))
        brought = inner.join(own, ["file", "root"]).where("NOT (home <=> to)")
        target = F.when(F.col("home").isNull(), F.col("spec")).otherwise(module_of(F.col("home")))
        brought = brought.select("file", "name", "to", F.col("root").alias("local"), target.alias("target"), "member", F.col("has_alias").alias("alias"), "home")
        left = self._stays(good).select("file", "name", "to", F.col("root").alias("local"), module_of(F.col("home")).alias("target"), F.col("root").alias("member"), F.lit(False).alias("alias"), "home")
        return brought.unionByName(left).distinct()

    def _left_behind(self, good: DataFrame) -> DataFrame:
        """file, name, to: moved names that their old file still uses outside of what moves."""
        outer = self.uses.join(_inside(self.uses, good).select("file", "start", "end"), ["file", "start", "end"], "left_anti").select("file", F.col("root").alias("name")).distinct()
        return outer.join(good.select("file", "name", "to"), ["file", "name"])

    def circles(self, good: DataFrame) -> DataFrame:
        """Moves whose old file still uses them while they use what stays there."""
        back = self._stays(good).where("home = file").groupBy("file", "name", "to").agg(F.min("root").alias("root"))
        return back.join(self._left_behind(good), ["file", "name", "to"]).select("file", "name", "to", F.concat(F.lit("a circle of imports through "), "root").alias("reason"))

    def applied(self) -> DataFrame:
        """file, text: all files after the moves that are not rejected."""
        good = staged(self.moves.join(self.rejects().select("file", "name"), ["file", "name"], "left_anti"))
        lines = self.needed(good).select(F.col("to").alias("file"), _line("target", "member", "local", "alias").alias("line"))
        behind = self._left_behind(good).select("file", module_of(F.col("to")).alias("target"), F.col("name").alias("member"), F.col("name").alias("local"), F.lit(False).alias("alias"))
        lines = lines.unionByName(behind.select("file", _line("target", "member", "local", "alias").alias("line")))
        gone = good.select(F.col("file").alias("path"), F.col("name").alias("member"), "to")
        asked = staged(self.imports.join(gone, ["path", "member"], "left"))
        moved = asked.where("to IS NOT NULL AND to <> file").select("file", module_of(F.col("to")).alias("target"), "member", "local", F.col("has_alias").alias("alias"))
        lines = lines.unionByName(moved.select("file", _line("target", "member", "local", "alias").alias("line")))
        none = self.files.sparkSession.createDataFrame([], "file string, name string, left string, qualifier string")
        placed = refactor.moved_declarations(good, self.declared.drop("to"), self.files, none.select("file", "name", "left"), none.select("file", "qualifier"))
        edits = placed.unionByName(self._without(asked))
        return with_imports(spans.edited(self.files, edits), lines.distinct())

    def _without(self, asked: DataFrame) -> DataFrame:
        """Edits that take moved names (``to``) out of the statements that import them; a statement without names goes with its line."""
        of = Window.partitionBy("file", "pstart")
        kept = F.col("to").isNull()
        own = asked.where("member <> ''").withColumn("_next", F.lead("start").over(of.orderBy("start")))
        own = own.withColumn("_kept", F.max(F.when(kept, F.col("start"))).over(of)).withColumn("_until", F.max(F.when(kept, F.col("end"))).over(of)).withColumn("_end", F.max("end").over(of)).withColumn("_last", F.max("start").over(of))
        own = own.where(~kept)
        amid = own.where("start < _kept").select("file", "start", F.col("_next").alias("end"), F.lit("").alias("new_text"))
        tail = own.where("start > _kept AND start = _last").select("file", F.col("_until").alias("start"), F.col("_end").alias("end"), F.lit("").alias("new_text"))
        whole = own.where("_kept IS NULL").groupBy("file", "pstart").agg(F.max("_end").alias("e")).join(self.files.select("file", "text"), "file")
        raw = F.encode("text", "UTF-8")
        head, rest = F.decode(F.substring(raw, 1, F.col("pstart")), "UTF-8"), F.decode(F.substring(raw, F.col("e") + 1, F.octet_length(raw)), "UTF-8")
        start, end = F.col("pstart") - F.octet_length(F.substring_index(head, "\n", -1)), F.col("e") + F.octet_length(F.regexp_extract(rest, r"^((\s*,?\s*\))?[^\n]*\n?)", 1))
        return amid.unionByName(tail).unionByName(whole.select("file", start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit("").alias("new_text")))


def import_place(text: str) -> int:
    """The line before which a Python file's imports can begin: behind its docstring and what must come first."""
    try:
        body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError):
        return 0
    at = 0
    for k, x in enumerate(body):
        doc = k == 0 and isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)
        if not doc and not (isinstance(x, ast.ImportFrom) and x.module == "__future__"):
            break
        at = x.end_lineno
    return at


def with_imports(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file, text: Python files with import lines (file, line) that they lack, in order, where their imports can begin."""
    own = lines.groupBy("file").agg(F.sort_array(F.collect_set("line")).alias("lines"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, want in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                have = (text or "").split("\n")
                new = [x for x in want or [] if x not in have]
                at = import_place(text or "") if new else 0
                texts.append("\n".join([*have[:at], *new, *have[at:]]) if new else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["file", "text"])

    return mapped(files.select("file", "text").join(own, "file", "left"), work, "file string, text string")


def go_moves(moves: DataFrame, files: DataFrame, t: Tables, root: str) -> DataFrame:
    """file, text: Go files after exported declarations (file, name) moved to files ``to`` of other packages; ``root`` is the module's path.

    What a declaration uses of its old package is written with that package's name, as is, in all other files, what moved with that
    of its new one; names that stand in their own package again lose it. Imports follow. A package is named as its clause says, else
    as its folder. Moves within a folder need nothing but the move. Unexported names can't be seen from elsewhere: see ``refactor.move_rejects``.
    """
    package = t["package"].select(dir_of(F.col("file")).alias("dir"), "name").groupBy("dir").agg(F.min("name").alias("pkg"))
    declared = staged(refactor.declarations(t["atom"], t["scope"], files).join(moves.select("file", "name"), ["file", "name"], "left_semi"))
    m = moves.join(declared.select("file", "name", "start", "end"), ["file", "name"]).withColumn("from_dir", dir_of(F.col("file"))).withColumn("to_dir", dir_of(F.col("to")))
    named = lambda d: F.coalesce("pkg", F.substring_index(d, "/", -1))
    m = m.join(package.withColumnRenamed("dir", "to_dir"), "to_dir", "left").withColumn("to_pkg", named("to_dir")).drop("pkg")
    m = staged(m.join(package.withColumnRenamed("dir", "from_dir"), "from_dir", "left").withColumn("from_pkg", named("from_dir")).drop("pkg"))
    far = m.where("from_dir <> to_dir")
    uses = staged(rooted_uses(t).withColumn("dir", dir_of(F.col("file"))))
    inner = staged(spans.containing(uses, far.select("file", "start", "end", "name", "to", "to_dir", "from_dir", "from_pkg")).drop("o_file", "o_start", "o_end"))
    outer = uses.join(inner.select("file", "start", "end"), ["file", "start", "end"], "left_anti")
    moved = far.select("from_dir", F.col("name").alias("root"), "to_dir", "to_pkg", "to")
    spec = lambda d: F.concat(F.lit(f'{root}/'), F.col(d))
    local = F.when(F.col("local") != "", F.col("local")).otherwise(F.substring_index("spec", "/", -1))
    imports = t["import"].select("file", local.alias("root"), "spec", "has_alias").distinct()

    # in the old package, and in others that name it
    near = outer.where("n_prefix = 0").join(moved.withColumnRenamed("from_dir", "dir"), ["dir", "root"]).where("dir <> to_dir")
    apart = outer.where("n_prefix = 1").join(imports, ["file", "root"])
    apart = apart.join(moved.select(spec("from_dir").alias("spec"), F.col("root").alias("name"), "to_dir", "to_pkg"), ["spec", "name"])
    home = F.col("dir") == F.col("to_dir")
    edits = near.select("file", "start", F.col("start").alias("end"), F.concat("to_pkg", F.lit(".")).alias("new_text"))
    edits = edits.unionByName(apart.select("file", "start", F.when(home, F.col("name_start")).otherwise(F.col("end")).cast("int").alias("end"), F.when(home, "").otherwise(F.col("to_pkg")).alias("new_text")))
    want = near.select("file", spec("to_dir").alias("spec"), F.lit("").alias("alias")).unionByName(apart.where(~home).select("file", spec("to_dir").alias("spec"), F.lit("").alias("alias")))

    # inside of what moves
    atoms = t["atom"].where("NOT contains(name, '.')").select(dir_of(F.col("file")).alias("o_from_dir"), F.col("name").alias("root")).distinct()
    with_it = far.select(F.col("from_dir").alias("o_from_dir"), F.col("name").alias("root"), F.col("to_dir").alias("o_to_dir"))
    left = inner.where("n_prefix = 0").join(atoms, ["o_from_dir", "root"]).where("root <> o_name").join(with_it, ["o_from_dir", "root", "o_to_dir"], "left_anti")
    names = left.select("file", F.col("o_name").alias("name"), F.col("root").alias("left")).distinct()
    brought = inner.where("n_prefix > 0").join(imports, ["file", "root"])
    want = want.unionByName(left.select(F.col("o_to").alias("file"), spec("o_from_dir").alias("spec"), F.lit("").alias("alias")))
    want = want.unionByName(brought.select(F.col("o_to").alias("file"), "spec", F.when(F.col("has_alias"), F.col("root")).otherwise("").alias("alias")))
    qualifier = far.select("file", F.col("from_pkg").alias("qualifier")).distinct()
    edits = edits.unionByName(refactor.moved_declarations(m, declared, files, names, qualifier))
    # imports that only what moved used go with it
    used = brought.select("file", "spec").distinct()
    sites = refactor.import_sites(t["import"]).join(used.withColumnRenamed("spec", "key"), ["file", "key"], "left_semi")
    edits = edits.unionByName(refactor.pruned_imports(files.join(used.select("file").distinct(), "file", "left_semi"), sites, far.select("file", "start", "end"), lines=True))
    return refactor.merged_imports(spans.edited(files, edits), want.distinct())
