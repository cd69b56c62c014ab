"""Ignore rules: git's order of precedence, the last rule that matches wins."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Folders that hold no sources.
SKIPPED = ("node_modules", ".git", "vendor", "dist", "build", "out", "coverage", ".svelte-kit", ".astro", ".output", ".next", ".nuxt", ".venv", "venv", "__pycache__", "target", ".turbo", ".cache", ".parcel-cache")


@dataclass(frozen=True)
class IgnoreRule:
    pattern: str
    base: str = ""  # folder of the file that states the rule
    negated: bool = False
    dir_only: bool = False
    kind: str = "gitignore"

    @property
    def regex(self) -> str:
        """The rule on a path below the root; a folder's rule covers what lies in it."""
        body = self.pattern
        anchored = "/" in body
        body = body.removeprefix("/")
        out, at = "", 0
        while at < len(body):
            if body.startswith("**/", at):
                out, at = out + "(?:[^/]*/)*", at + 3
            elif body[at:] == "/**":
                out, at = out + "/.+", len(body)
            elif body.startswith("**", at):
                out, at = out + ".*", at + 2
            elif body[at] == "*":
                out, at = out + "[^/]*", at + 1
            elif body[at] == "?":
                out, at = out + "[^/]", at + 1
            else:
                out, at = out + re.escape(body[at]), at + 1
        start = re.escape(f"{self.base}/") if self.base else ""
        end = "/.*$" if self.dir_only else "(?:/.*)?$"
        return f"^{start}" + ("" if anchored else "(?:.*/)?") + out + end


def parse_gitignore(text: str, base: str = "") -> list[IgnoreRule]:
    out = []
    for line in text.removeprefix("﻿").split("\n"):
        line = line.rstrip("\r")
        line = re.sub(r"(?<!\\) +$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = re.sub(r"\\([ #!])", r"\1", line[1:] if negated else line)
        dir_only = line.endswith("/")
        line = line.rstrip("/")
        if line:
            out.append(IgnoreRule(line, base, negated, dir_only))
    return out


def parse_gitattributes(text: str, base: str = "", marks: tuple[str, ...] = ("linguist-generated",)) -> list[IgnoreRule]:
    """Rules of the attributes ``marks``; of several on a line the last counts."""
    out = []
    for line in text.split("\n"):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        mark = None
        for a in parts[1:]:
            name, _, value = a.lstrip("-!").partition("=")
            if name in marks:
                mark = not (a[0] in "-!" or value == "false")
        if mark is not None:
            out.append(IgnoreRule(parts[0].rstrip("/"), base, not mark, False, "attributes"))
    return out


def builtins() -> list[IgnoreRule]:
    return [IgnoreRule(n, dir_only=True, kind="builtin") for n in SKIPPED]


def collect(exclude: str = "", gitignores: dict[str, str] | None = None, attributes: dict[str, str] | None = None, marks: tuple[str, ...] = ("linguist-generated",)) -> list[IgnoreRule]:
    """All rules in the order of precedence: built-in ones, exclude, ignore files from the root down, attributes."""
    shallow = lambda d: sorted((d or {}).items(), key=lambda x: (x[0].count("/") + bool(x[0]), x[0]))
    out = builtins() + parse_gitignore(exclude)
    for base, text in shallow(gitignores):
        out += parse_gitignore(text, base)
    for base, text in shallow(attributes):
        out += parse_gitattributes(text, base, marks)
    return out


def decide(files: DataFrame, rules: list[IgnoreRule], file: str = "file") -> DataFrame:
    """Files with ``ignored`` and ``rule`` (number of the winning one, null where none matches)."""
    path = F.regexp_replace(F.col(file), r"^(\./)+", "")
    winner = F.array_max(F.array(F.lit(None).cast("int"), *(F.when(path.rlike(r.regex), F.lit(k)) for k, r in enumerate(rules))))
    negated = F.array(*(F.lit(r.negated) for r in rules)) if rules else F.array().cast("array<boolean>")
    return files.withColumn("rule", winner).withColumn("ignored", F.coalesce(~F.get(negated, F.col("rule")), F.lit(False)))


def explored(files: DataFrame, rules: list[IgnoreRule], file: str = "file") -> DataFrame:
    return decide(files, rules, file).where("not ignored").drop("ignored", "rule")


def skip_dir(path: str, rules: list[IgnoreRule]) -> bool:
    """Whether a walk need not enter a folder: it is ignored, and no negation could hold below it."""
    last = None
    for r in rules:
        if re.search(r.regex, path) or re.search(r.regex, f"{path}/"):
            last = r
    if last is None or last.negated:
        return False
    return not any(r.negated and ("/" not in r.pattern or f"{r.base}/{r.pattern}".lstrip("/").startswith(f"{path}/") or r.pattern.startswith("**")) for r in rules)


def skipped(folders: DataFrame, rules: list[IgnoreRule], folder: str = "folder") -> DataFrame:
    """Folders with ``skipped``: whether a walk need not enter them."""

    @F.pandas_udf(BooleanType())
    def skip(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: p is not None and skip_dir(p, rules)).astype(bool)

    return folders.withColumn("skipped", skip(folder))
