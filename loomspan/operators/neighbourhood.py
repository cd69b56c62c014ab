"""Loads the files that seeds lead to, by imports and as peers of a package, and no others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dir_of
from ..storage import staged
from . import extract, reimport


def imports_of(files: DataFrame, index: DataFrame, root: str = "") -> DataFrame:
    """path: the files and folders of the tree (``index``: file) that files (file, text) import."""
    imports = extract.relations(staged(extract.extracted(files)))["import"]
    return reimport.resolved(reimport.marked(imports, files), index, root).select("path").distinct()


def loaded(index: DataFrame, seeds: DataFrame, read: Callable[[DataFrame], DataFrame], targets: Callable[[DataFrame, DataFrame], DataFrame] = imports_of, scoped: tuple[str, ...] = ("go",)) -> DataFrame:
    """file, text, round of all files that ``seeds`` (file) lead to; ``index`` (file) lists what there is.

    In each round ``read`` gets the files (file) that are new and gives their texts; ``targets`` tells what these import. A folder
    that is imported brings all its files, and a file with an ending among ``scoped`` its folder's files of the same kind: folders
    meet the index once each, never files in pairs. Every file is read once, however many ways lead to it; the loop ends with no new file.
    """
    ending = F.regexp_extract("file", r"\.([A-Za-z0-9]+)$", 1)
    index = staged(index.select("file").distinct().withColumn("dir", dir_of(F.col("file"))).withColumn("ending", ending))
    todo = staged(index.join(seeds.select("file").distinct(), "file", "left_semi"))
    seen, peers = todo.select("file"), None
    out: DataFrame | None = None
    k = 0
    while not todo.isEmpty():
        texts = staged(read(todo.select("file")).select("file", "text"))
        out = texts.withColumn("round", F.lit(k)) if out is None else out.unionByName(texts.withColumn("round", F.lit(k)))
        met = staged(targets(texts, index.select("file")).select("path").distinct())
        dirs = todo.where(F.col("ending").isin(*scoped)).select("dir", "ending").distinct()
        dirs = staged(dirs if peers is None else dirs.join(peers, ["dir", "ending"], "left_anti"))
        peers = dirs if peers is None else peers.unionByName(dirs)
        by_name = index.join(met.withColumnRenamed("path", "file"), "file", "left_semi")
        inside = index.join(met.withColumnRenamed("path", "dir"), "dir", "left_semi").select(*index.columns)
        beside = index.join(dirs, ["dir", "ending"], "left_semi").select(*index.columns)
        more = by_name.select(*index.columns).unionByName(inside).unionByName(beside).distinct()
        todo = staged(more.join(seen, "file", "left_anti").select(*index.columns))
        seen = staged(seen.unionByName(todo.select("file")))
        k += 1
    none = index.select("file", F.lit("").alias("text"), F.lit(0).alias("round")).limit(0)
    return none if out is None else out
