"""What build and lock files say of imports: module roots and requirements of Go, locked crates of Rust.

Build files are read once into tables; imports meet them by the folders above their file and by the prefixes of their paths, the
longest first.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.paths import dir_of, join_path
from ..operators.graph import first_by

_KINDS = "dir string, relation string, name string, value string, more string"


def _table(files: DataFrame, ending: str, read: Callable[[str], Iterator[tuple[str, str, str | None, str | None]]]) -> DataFrame:
    """dir, relation, name, value, more of the build files of one name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in read(t or "")]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["dir", "relation", "name", "value", "more"])

    own = files.where((F.col("file") == ending) | F.col("file").endswith(f"/{ending}"))
    folder = F.when(F.instr("file", "/") > 0, dir_of(F.col("file"))).otherwise(F.lit(""))
    return mapped(own.select(folder.alias("dir"), "text"), work, _KINDS)


def go_mod(text: str) -> Iterator[tuple[str, str, str | None, str | None]]:
    """Rows of a go.mod: (module, path), (require, path, version), (replace, path, new path, new version)."""
    block = ""
    for line in text.split("\n"):
        words = re.sub(r"//.*", "", line).replace("(", " ( ").split()
        words = [w.strip("\"`") for w in words]
        if not words:
            continue
        if words == [")"]:
            block = ""
            continue
        if len(words) == 2 and words[1] == "(":
            block = words[0]
            continue
        verb, args = (block, words) if block else (words[0], words[1:])
        if verb == "module" and args:
            yield "module", args[0], None, None
        elif verb == "require" and len(args) > 1:
            yield "require", args[0], args[1], None
        elif verb == "replace" and "=>" in args:
            at = args.index("=>")
            if at and args[at + 1 :]:
                yield "replace", args[0], args[at + 1], (args[at + 2 :] or [None])[0]


def cargo_lock(text: str) -> Iterator[tuple[str, str, str | None, str | None]]:
    """Rows of a Cargo.lock: (package, name, version, source), and (pins, name, version) for what packages of the tree itself depend on."""
    try:
        packages = tomllib.loads(text).get("package", [])
    except tomllib.TOMLDecodeError:
        return
    fold = lambda n: n.replace("-", "_")
    for p in packages:
        yield "package", fold(str(p.get("name", ""))), p.get("version"), p.get("source")
        for d in p.get("dependencies", []) if not p.get("source") else []:
            name, *version = str(d).split(" ")
            if version:
                yield "pins", fold(name), version[0], None


def _above(folder: Column) -> Column:
    """A folder and all folders above it, up to the root, as an array."""
    parts = F.split(folder, "/")
    n = F.when(folder == "", 0).otherwise(F.size(parts))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(k, F.lit(1))), "/")))


def _nearest(imports: DataFrame, dirs: DataFrame) -> DataFrame:
    """Imports (file, spec) with ``dir``: the nearest folder above the file that is among ``dirs``."""
    own = imports.select("file", "spec").distinct()
    folder = F.when(F.instr("file", "/") > 0, dir_of(F.col("file"))).otherwise(F.lit(""))
    met = own.select("file", "spec", F.explode(_above(folder)).alias("dir")).join(dirs.select("dir").distinct(), "dir")
    return first_by(met, ["file", "spec"], F.desc(F.length("dir"))).select("file", "spec", "dir")


def go_packages(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, spec, kind, module, version, path: what Go imports (file, spec) mean by the go.mod nearest above.

    ``tree``: a folder ``path`` of the tree, of its own module or of one that is replaced by a folder; ``module``: a required (or replaced)
    module with its version; ``std``: a path whose first part has no dot; else ``unknown``. Of several modules the longest path counts,
    the own one and replacements before requirements.
    """
    t = _table(files, "go.mod", go_mod)
    own = _nearest(imports, t.where("relation = 'module'"))
    parts = F.split("spec", "/")
    steps = own.select("file", "spec", "dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("name"))
    local = F.col("value").startswith("./") | F.col("value").startswith("../")
    rank = F.when(F.col("relation") == "module", 0).when(F.col("relation") == "replace", 1).otherwise(2)
    best = first_by(steps.join(t, ["dir", "name"]), ["file", "spec"], F.desc(F.length("name")), rank, F.desc_nulls_last("value"))
    rest = F.expr("substring(spec, length(name) + 2)")
    base = F.when(F.col("relation") == "module", F.col("dir")).when((F.col("relation") == "replace") & local, _joined(F.col("dir"), F.col("value")))
    best = best.select("file", "spec", "name", "relation", "value", "more", base.alias("base"), rest.alias("rest"))
    out = own.select("file", "spec").join(best, ["file", "spec"], "left")
    kind = F.when(F.col("base").isNotNull(), "tree").when(F.col("name").isNotNull(), "module").when(~F.element_at(parts, 1).contains("."), "std").otherwise("unknown")
    replaced = (F.col("relation") == "replace") & F.col("base").isNull()
    module = F.when(replaced, F.col("value")).otherwise(F.col("name"))
    version = F.when(F.col("relation") == "require", F.col("value")).when(replaced, F.col("more"))
    return out.select("file", "spec", kind.alias("kind"), module.alias("module"), version.alias("version"), F.when(F.col("base").isNotNull(), F.regexp_replace(join_path(F.col("base"), F.col("rest")), "^/|/$", "")).alias("path"))


def _joined(folder: Column, relative: Column) -> Column:
    """A folder and a path relative to it, without ``.`` and ``..``."""
    parts = F.split(F.concat_ws("/", F.when(folder != "", folder), relative), "/")
    step = lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def locked_crates(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, spec, crate, version, kind: what the Cargo.lock nearest above says of Rust paths (file, spec), by their first part; hyphens count as underscores.

    ``locked``: the only version, or the one that the tree's own packages depend on; ``ambiguous``: several and no such one; ``own``:
    a package of the tree; ``unlocked``: none of that name. ``crate``, ``self`` and ``super`` are left out.
    """
    t = _table(files, "Cargo.lock", cargo_lock)
    crate = F.replace(F.element_at(F.split("spec", "::"), 1), F.lit("-"), F.lit("_"))
    own = _nearest(imports.where(~F.element_at(F.split("spec", "::"), 1).isin("crate", "self", "super")), t).withColumn("crate", crate)
    packages = t.where("relation = 'package'").groupBy("dir", F.col("name").alias("crate")).agg(F.count_distinct("value").alias("n"), F.max("value").alias("only"), F.bool_and(F.col("more").isNull()).alias("inside"))
    pins = t.where("relation = 'pins'").groupBy("dir", F.col("name").alias("crate")).agg(F.count_distinct("value").alias("pinned"), F.max("value").alias("pin"))
    out = own.join(packages, ["dir", "crate"], "left").join(pins, ["dir", "crate"], "left")
    kind = F.when(F.col("n").isNull(), "unlocked").when(F.col("inside"), "own").when((F.col("n") == 1) | (F.col("pinned") == 1), "locked").otherwise("ambiguous")
    version = F.when(F.col("n") == 1, F.col("only")).when(F.col("pinned") == 1, F.col("pin"))
    return out.select("file", "spec", "crate", version.alias("version"), kind.alias("kind"))
