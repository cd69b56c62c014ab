"""Import paths rewritten after many files and folders move at once.

Every way in which a path can name a file or folder of the tree is a candidate, and candidates meet the tree's own names by
an equi-join. Paths meet the table of moves by their prefixes, the longest one wins. A path that still names its target is left
alone; others are written anew in the style that they had: relative, dotted, from a root, with or without an ending.
"""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions.paths import dir_of, relative_import
from .graph import first_by

#: Files that stand for their folder.
REPRESENTATIVES = ("__init__.py", "index.ts", "index.tsx", "index.js", "mod.rs", "default.nix")
_STEM = r"\.[A-Za-z0-9]+$"


def _folders(path):
    """All folders above a path, the nearest last."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1
    return F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def moved_paths(paths: DataFrame, moves: DataFrame) -> DataFrame:
    """path, to: where each path is after ``moves`` (old, new) of files and folders; the longest old path that holds it decides, else it stays.

    Of two moves of one old path the first new one counts.
    """
    own = paths.select("path").distinct()
    prefix = own.select("path", F.explode(F.array_append(_folders(F.col("path")), F.col("path"))).alias("old"))
    moves = moves.groupBy("old").agg(F.min("new").alias("new"))
    best = first_by(prefix.join(moves, "old"), ["path"], F.desc(F.length("old")))
    to = F.concat("new", F.expr("substring(path, length(old) + 1)"))
    return own.join(best.select("path", to.alias("to")), "path", "left").select("path", F.coalesce("to", "path").alias("to"))


def names_of(files: DataFrame) -> DataFrame:
    """key, path: what files and folders of a tree can be called: with their ending, without it, a folder for the file that stands for it; a file before a folder."""
    path, name = F.col("file"), F.substring_index("file", "/", -1)
    stem = F.regexp_replace(path, _STEM, "")
    keys = F.array(F.struct(path.alias("key"), F.lit(0).alias("o")), F.struct(stem.alias("key"), F.lit(1).alias("o")), F.struct(F.when(name.isin(*REPRESENTATIVES), dir_of(path)).alias("key"), F.lit(2).alias("o")))
    own = files.select(path.alias("path"), F.explode(keys).alias("k")).select("k.*", "path")
    folders = files.select(F.explode(_folders(path)).alias("path")).distinct().select(F.col("path").alias("key"), F.lit(3).alias("o"), "path")
    return first_by(own.unionByName(folders).where("key <> ''"), ["key"], "o", "path").select("key", "path")


@F.pandas_udf(ArrayType(StructType([StructField("style", StringType()), StructField("key", StringType())])))
def _ways(file: pd.Series, spec: pd.Series, root: pd.Series) -> pd.Series:
    def one(file: str, spec: str, root: str) -> list[dict]:
        folder = posixpath.dirname(file)
        found: list[tuple[str, str]] = []
        if spec.startswith(("./", "../")) or spec in (".", ".."):
            found.append(("path", posixpath.join(folder, spec)))
        if spec.startswith(".") and "/" not in spec:
            level = len(spec) - len(spec.lstrip("."))
            found.append(("dots", posixpath.join(folder, "../" * (level - 1), spec.lstrip(".").replace(".", "/"))))
        if not spec.startswith("."):
            if "::" in spec:
                found.append(("colons", spec.removeprefix("crate::").replace("::", "/")))
            if root and (spec == root or spec.startswith(f"{root}/")):
                found.append(("root", spec[len(root) + 1 :]))
            beside = [("slash", spec), ("bare", posixpath.join(folder, spec))]
            found += beside[::-1] if posixpath.splitext(spec)[1] else beside  # with its ending, a file beside comes first
            found.append(("dotted", spec.replace(".", "/")))
        return [{"style": s, "key": k} for s, x in found if (k := posixpath.normpath(x)) and not k.startswith("..")]

    return pd.Series([one(*x) if None not in x else [] for x in zip(file, spec, root, strict=True)], dtype=object)


def resolved(imports: DataFrame, files: DataFrame, root: str = "") -> DataFrame:
    """Imports (file, spec, start, end) with the path that each names and its style; those that name nothing of the tree are left out.

    ``root`` is what paths from the tree's root begin with, as a module's name. The first way that names something counts.
    """
    ways = imports.select("file", "spec", "start", "end", F.posexplode(_ways("file", "spec", F.lit(root))).alias("o", "w")).select("file", "spec", "start", "end", "o", "w.*")
    met = ways.join(names_of(files), "key")
    return first_by(met, ["file", "start", "end"], "o").select("file", "spec", "start", "end", "style", "path")


def respelled(style: str, spec: str, importer: str, old: str, new: str, root: str) -> str:
    """How the file ``importer`` names ``new``, in the style in which ``spec`` named ``old``."""
    stem = lambda p: posixpath.splitext(p)[0]
    stands = lambda p: posixpath.basename(p) in REPRESENTATIVES
    ending = posixpath.splitext(old)[1]
    with_ending = bool(ending) and spec.endswith(ending)
    by_folder = stands(old) and not with_ending and posixpath.basename(stem(old)) != posixpath.basename(spec.replace(".", "/").replace("::", "/"))
    if by_folder and stands(new):
        key = posixpath.dirname(new)
    else:
        key = new if with_ending or not ending else stem(new)
    relative = relative_import(importer, key or ".")
    if style == "path":
        return relative
    if style == "bare":
        return relative.removeprefix("./")
    if style == "dots":
        parts = relative.split("/")
        ups = sum(p == ".." for p in parts)
        return "." * (ups + 1) + ".".join(p for p in parts if p not in ("..", "."))
    if style == "colons":
        return ("crate::" if spec.startswith("crate::") else "") + key.replace("/", "::")
    if style == "root":
        return f"{root}/{key}" if key else root
    return key.replace("/", ".") if style == "dotted" else key


@F.pandas_udf(StringType())
def _respelled(style: pd.Series, spec: pd.Series, importer: pd.Series, old: pd.Series, new: pd.Series, root: pd.Series) -> pd.Series:
    return pd.Series([respelled(*x) for x in zip(style, spec, importer, old, new, root, strict=True)], dtype=object)


def import_edits(imports: DataFrame, files: DataFrame, moves: DataFrame, root: str = "") -> DataFrame:
    """file (as it was), start, end, new_text: import paths that no longer name what they named, once ``moves`` (old, new) are made.

    ``imports`` has file, spec, start, end: the path's own bytes. Both the file that imports and what it imports may move, by a
    move of their own or with a folder. A path changes only where one of both moved.
    """
    found = resolved(imports, files, root)
    to = moved_paths(found.select("path").unionByName(found.select(F.col("file").alias("path"))), moves)
    found = found.join(to.withColumnRenamed("to", "new_path"), "path")
    found = found.join(to.select(F.col("path").alias("file"), F.col("to").alias("new_file")), "file")
    found = found.where("path <> new_path OR file <> new_file")
    text = _respelled("style", "spec", "new_file", "path", "new_path", F.lit(root))
    return found.withColumn("new_text", text).where("new_text <> spec").select("file", "start", "end", "new_text")


def marked(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Imports as ``import_edits`` takes them, from the relation of imports: each path once, with the dots that stand before it and without quotes."""
    own = imports.where("pend > pstart OR spec RLIKE '^[.]+$'").select("file", "pstart", "pend", "spec").distinct().join(files.select("file", "text"), "file")
    raw = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("pstart") + 1, F.col("pend") - F.col("pstart")), "UTF-8")
    own = own.withColumn("raw", raw)
    quoted = F.col("raw").rlike("^[\"'`]")
    dots = F.when(F.col("spec").rlike(r"^\.+[^./]") & ~quoted & ~F.col("raw").startswith("."), F.length(F.regexp_extract("spec", r"^\.+", 0))).otherwise(0)
    start, end = F.col("pstart") - dots + F.when(quoted, 1).otherwise(0), F.col("pend") - F.when(quoted, 1).otherwise(0)
    return own.select("file", F.regexp_replace("spec", "^[\"'`]|[\"'`]$", "").alias("spec"), start.cast("int").alias("start"), end.cast("int").alias("end")).where("end > start").distinct()
