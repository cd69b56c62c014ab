"""Source trees as DataFrames: folders, path lists, archives; overlays of unsaved text."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ignore import IgnoreRule, explored

LARGE = 256 << 10


@dataclass(frozen=True)
class Source:
    """What to scan: a folder, or the very paths named."""

    root: str
    paths: tuple[str, ...] = ()
    recursive: bool = True
    glob: str = "*"


def scan(spark: SparkSession, source: Source, rules: list[IgnoreRule] | None = None) -> DataFrame:
    """file (below the root), text, size. Named paths are read whatever the rules or their size."""
    if source.paths:
        df = spark.read.format("binaryFile").load([f"{source.root}/{p}" for p in source.paths])
    else:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", str(source.recursive).lower()).option("pathGlobFilter", source.glob).load(source.root)
    root = source.root.removeprefix("file://").rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{root}/", "")
    out = df.select(rel.alias("file"), F.col("content"), F.col("length").alias("size"))
    if not source.paths:
        out = guarded(explored(out, rules or []))
    return out.select("file", F.decode("content", "UTF-8").alias("text"), "size")


def guarded(files: DataFrame, named: tuple[str, ...] = (), size: str = "size") -> DataFrame:
    """Files of at most 256 KiB, and those named."""
    return files.where((F.col(size) <= LARGE) | F.col("file").isin(*named)) if named else files.where(F.col(size) <= LARGE)


def archives(spark: SparkSession, path: str) -> DataFrame:
    """file, member, text of all members of zip archives."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([m.filename]), pa.array([z.read(m).decode("utf-8", "replace")])], ["file", "member", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, "file string, member string, text string")


def documents_as_files(docs: DataFrame) -> DataFrame:
    """A table of documents as files ``source/doc_id.lang``."""
    path = F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.coalesce("lang", F.lit("txt")))
    return docs.select(path.alias("file"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "lang", "doc_id")


def layered(layers: list[DataFrame]) -> DataFrame:
    """file, text of copy-on-write layers (file, text; a null text deletes): the last layer that has a file wins."""
    all_ = None
    for k, layer in enumerate(layers):
        own = layer.select("file", "text").withColumn("layer", F.lit(k))
        all_ = own if all_ is None else all_.unionByName(own)
    top = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("layer")))
    return all_.withColumn("_rn", top).where("_rn = 1 and text is not null").select("file", "text")


def overlaid(files: DataFrame, overlay: DataFrame) -> DataFrame:
    """Files with the overlay's texts in place of their own."""
    return files.select("file", "text").join(overlay.select("file"), "file", "left_anti").unionByName(overlay.select("file", "text"))


def renamed(files: DataFrame, moves: DataFrame) -> DataFrame:
    """Files at their new paths (file, to)."""
    return files.join(moves, "file", "left").withColumn("file", F.coalesce("to", "file")).drop("to")


def repo_root(path: str) -> str | None:
    """The nearest folder at or above a path that holds ``.git``."""
    here = os.path.abspath(path)
    while True:
        if os.path.exists(os.path.join(here, ".git")):
            return here
        up = os.path.dirname(here)
        if up == here:
            return None
        here = up
