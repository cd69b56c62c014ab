"""A search that ends once enough files have matched, without reading the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import staged


def first_matches(table: DataFrame, find: Callable[[DataFrame], DataFrame], limit: int, key: str = "file", first: int = 1, growth: int = 4) -> DataFrame:
    """Matches in the first ``limit`` values of ``key`` that match: what ``find`` gives for ``table``, which is read from stored files.

    Stored files are searched in order of their paths, ``first`` of them, then ``growth`` times as many each time, until enough
    have matched or none is left; later ones are never opened. In each such group, values of ``key`` come in order; a value that
    two groups have counts once, in the first. A table that is not made of files is searched whole. At most ``growth`` times as many files are
    read as the answer needs.
    """
    if limit < 1:
        return find(table).limit(0)
    paths = sorted(table.inputFiles())
    found: DataFrame | None = None
    at, size, have = 0, max(1, first), 0
    while at < max(1, len(paths)):
        own = paths[at : at + size]  # a local path begins with one slash below, with three in the list
        part = table.where(F.col("_metadata.file_path").isin([*own, *(x.replace("file:///", "file:/", 1) for x in own)])) if len(paths) > 1 else table
        new = find(part)
        if found is not None:
            new = new.join(found.select(key).distinct(), key, "left_anti")
        new = staged(new.select(*(found.drop("_group").columns if found is not None else new.columns)))
        keys = new.select(key).distinct().orderBy(key).limit(limit - have)  # a few values
        keys = staged(keys)
        taken = new.join(F.broadcast(keys), key).withColumn("_group", F.lit(at))  # ``limit`` values at most
        found = taken if found is None else found.unionByName(taken)
        have += keys.count()
        at, size = at + size, size * growth
        if have >= limit:
            break
    return found.drop("_group")
