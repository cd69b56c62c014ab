"""Schemas of the relations; spans are half-open ranges of UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int>"

#: Columns of each relation in order.
RELATIONS = {
    "file": "file string, lang string, package string",
    "package": "file string, name string, end int",
    "default_export": "file string, name string",
    "scope": "file string, idx int, parent int, start int, end int, hole boolean",
    "flow": "file string, start int, end int, class string",
    "atom": "file string, name string, start int, end int, exported boolean, scope_idx int",
    "import": "file string, local string, spec string, member string, start int, end int, tstart int, tend int, has_alias boolean, pstart int, pend int, star boolean",
    "reexport": "file string, export string, source_name string, spec string, star boolean, sstart int, send int",
    "use": "file string, name string, start int, end int, scope string, scope_idx int, n_prefix int, use_id int",
    "use_seg": "file string, use_id int, idx int, name string, start int, end int",
    "lang": "lang string, flag string",
    "declares": "file string, scope_idx int, leaf string, ref string",
    "atom_in_file": "file string, name string, ref string",
    "visible": "file string, scope_idx int, leaf string, ref string",
    "resolved_spec": "file string, spec string, base string",
    "star_base": "file string, base string",
    "import_target": "file string, local string, target string, member string, alias boolean",
    "alias": "ref string, start int, end int, target string, spec string, pstart int, pend int",
    "binds": "file string, start int, end int, from_ref string, target_ref string, via_alias boolean",
    "used_name": "file string, name string",
    "finding": "file string, start int, end int, rule_id string, level string, message string",
    "edit": "file string, start int, end int, new_text string",
    "bound": "file string, name string",
}


def relation(spark: SparkSession, name: str, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or [], RELATIONS[name])


def canonical_path(path: Column) -> Column:
    """Paths are equal but for a leading ``./``."""
    return F.regexp_replace(path, r"^(\./)+", "")


class Store:
    """Named relations; ``insert`` keeps sets, ``append`` keeps bags."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tables = spark, {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else relation(self.spark, name)

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def put(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = rows

    def append(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = self[name].unionByName(rows)

    def insert(self, name: str, rows: DataFrame) -> None:
        self.tables[name] = self[name].unionByName(rows).dropDuplicates()

    def drop_file(self, file: str) -> None:
        for name, df in self.tables.items():
            if "file" in df.columns:
                self.tables[name] = df.where(F.col("file") != file)

    def view(self, prefix: str = "") -> None:
        for name, df in self.tables.items():
            df.createOrReplaceTempView(f"{prefix}{name}")
