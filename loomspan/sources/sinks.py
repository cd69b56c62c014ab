"""Results as text, CSV, JSON lines, findings reports, and edits written back."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import column_of, line_of
from ..operators import sequence
from ..operators.tape import WORDS, token_array, token_class


def located(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Spans with line, column, end_line, end_col (1-based; columns in bytes) and the text of the span."""
    both = rows.join(files.select("file", F.col("text").alias("_text")), "file")
    raw = F.encode("_text", "UTF-8")
    return both.select(*rows.columns, line_of(F.col("_text"), F.col("start")).alias("line"), column_of(F.col("_text"), F.col("start")).alias("col"), line_of(F.col("_text"), F.col("end")).alias("end_line"), column_of(F.col("_text"), F.col("end")).alias("end_col"), F.decode(F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8").alias("snippet"))


def as_text(matches: DataFrame, files: DataFrame) -> DataFrame:
    """One line for each match: ``file:line:col: text``."""
    at = located(matches.select("file", "start", "end"), files)
    return at.select(F.concat_ws(":", "file", F.col("line").cast("string"), F.col("col").cast("string"), F.concat(F.lit(" "), F.regexp_replace("snippet", r"\s+", " "))).alias("value"))


def write_csv(matches: DataFrame, names: list[str], path: str) -> None:
    """A header and fixed columns: where, the text, and one column for each capture."""
    sequence.shown(matches, names).write.option("header", True).mode("overwrite").csv(path)


def write_jsonl(matches: DataFrame, path: str) -> None:
    matches.write.mode("overwrite").json(path)


def rustc_lines(findings: DataFrame) -> DataFrame:
    """Findings with places as compilers print them."""
    head = F.concat("level", F.lit("["), "rule_id", F.lit("]: "), "message")
    where = F.concat(F.lit("  --> "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("col").cast("string"))
    return findings.select(F.concat(head, F.lit("\n"), where, F.lit("\n   | "), F.regexp_replace("snippet", "\n", "\n   | ")).alias("value"))


def _sarif(rows: list[dict], tool: str) -> str:
    results = []
    for r in rows:
        region = {"startLine": r["line"], "startColumn": r["col"], "endLine": r["end_line"], "endColumn": r["end_col"]}
        results.append({"ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]}, "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["file"]}, "region": region}}]})
    rules = [{"id": k} for k in dict.fromkeys(r["ruleId"] for r in results)]
    return json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]})


def sarif(findings: DataFrame, tool: str = "loomspan") -> str:
    """One SARIF document; its findings come to the driver one after the other. ``write_sarif`` has no such limit."""
    return _sarif([r.asDict() for r in findings.orderBy("file", "start", "rule_id").toLocalIterator()], tool)


def write_sarif(findings: DataFrame, path: str, tool: str = "loomspan") -> None:
    """SARIF documents, one on each line, written where the findings are."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_sarif(batch.to_pylist(), tool)])], ["value"])

    findings.mapInArrow(work, "value string").write.mode("overwrite").text(path)


def highlighted(files: DataFrame, styles: dict[str, str], regex: str = WORDS, keywords: tuple[str, ...] = ()) -> DataFrame:
    """file, text: tokens of the classes of ``styles`` between terminal codes."""
    def shown(t: Column) -> Column:
        cls, out = token_class(t, keywords), None
        for name, code in styles.items():
            out = (F if out is None else out).when(cls == name, F.concat(F.lit(f"\x1b[{code}m"), t, F.lit("\x1b[0m")))
        return t if out is None else out.otherwise(t)

    return files.select("file", F.array_join(F.transform(token_array(F.col("text"), rf"\s+|{regex}"), shown), "").alias("text"))


class Formatter(Protocol):
    """What writes rows of findings or matches somewhere."""

    def write(self, rows: DataFrame, path: str) -> None: ...


#: Formatters by name; others can be added.
FORMATTERS: dict[str, Callable[[DataFrame, str], None]] = {
    "jsonl": write_jsonl,
    "sarif": write_sarif,
    "lines": lambda rows, path: rustc_lines(rows).write.mode("overwrite").text(path),
    "table": lambda rows, path: rows.write.mode("overwrite").parquet(path),
}


def write_as(name: str, rows: DataFrame, path: str) -> None:
    """Rows through the formatter of that name."""
    if name not in FORMATTERS:
        raise ValueError(f"no formatter {name}; there are {', '.join(sorted(FORMATTERS))}")
    FORMATTERS[name](rows, path)


def commit(old: DataFrame, new: DataFrame, root: str, backup: str = "", dry_run: bool = False) -> DataFrame:
    """Write changed texts below ``root``; returns file, changed, written. Each file is replaced whole, from a file beside it."""
    both = new.select("file", F.col("text").alias("new")).join(old.select("file", F.col("text").alias("old")), "file", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed, written = [], []
            for file, text, was in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                changed.append(text != was)
                written.append(text != was and not dry_run)
                if not written[-1]:
                    continue
                path = os.path.join(root, file)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                if backup and was is not None:
                    with open(path + backup, "w", encoding="utf-8") as f:
                        f.write(was)
                with open(path + ".new", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(path + ".new", path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(changed, pa.bool_()), pa.array(written, pa.bool_())], ["file", "changed", "written"])

    return both.select("file", "new", "old").mapInArrow(work, "file string, changed boolean, written boolean")
