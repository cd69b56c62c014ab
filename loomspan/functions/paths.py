"""Columns on paths, globs and references."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def glob_regex(glob: str) -> str:
    """A glob as an anchored regular expression that Java, RE2 and Python read alike.

    ``*`` and ``?`` stay inside a segment, ``**/`` spans any segments, a glob without a
    slash is held against the last segment.
    """
    glob = glob.strip().removeprefix("./")
    if "/" not in glob and not glob.startswith("**"):
        glob = f"**/{glob}"
    out, at = "", 0
    while at < len(glob):
        if glob.startswith("**/", at):
            out, at = out + "([^/]*/)*", at + 3
        elif glob[at:] == "**":
            out, at = out + ".*", at + 2
        elif glob[at] == "*":
            at += 1 + (glob[at : at + 2] == "**")
            out += "[^/]*"
        elif glob[at] == "?":
            out, at = out + "[^/]", at + 1
        else:
            out, at = out + re.sub(r"([.^$*+?()\[\]{}|\\])", r"\\\1", glob[at]), at + 1
    return f"^{out}$"


def matches_glob(path: Column, glob: str) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "").rlike(glob_regex(glob))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    """The folder of a path, ``.`` where there is none."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(base_name(path), r"(.)\.[^.]*$", "$1")


def parse_reference(ref: Column) -> Column:
    """``provider:path::name`` and its short forms as struct<provider, path, name>."""
    cut = F.instr(ref, "::")
    name = F.when(cut > 0, F.substring(ref, cut + 2, F.length(ref))).otherwise(F.lit(""))
    base = F.when(cut > 0, F.substring(ref, 1, cut - 1)).otherwise(ref)
    colon = F.instr(base, ":")
    short = (name != "") | base.contains("/") | base.startswith(".")
    anchored = base.startswith("./") | base.startswith("../") | base.startswith("/")
    return F.struct(
        F.when(colon > 0, F.lower(F.substring(base, 1, colon - 1))).when(short, F.lit("path")).otherwise(F.lit("")).alias("provider"),
        F.when(colon > 0, F.substring(base, colon + 1, F.length(base))).when(short & ~anchored, F.concat(F.lit("./"), base)).otherwise(base).alias("path"),
        name.alias("name"),
    )


def format_reference(ref: Column) -> Column:
    base = F.when(ref["provider"] != "", F.concat(F.lower(ref["provider"]), F.lit(":"), ref["path"])).otherwise(ref["path"])
    return F.when(ref["name"] != "", F.concat(base, F.lit("::"), ref["name"])).otherwise(base)


def normal_path(path: Column) -> Column:
    """Relative paths begin with ``./``; the empty one is ``./``."""
    anchored = path.startswith("./") | path.startswith("../") | path.startswith("/")
    return F.when((path == "") | (path == "."), F.lit("./")).when(anchored, path).otherwise(F.concat(F.lit("./"), path))


def file_ref(path: Column) -> Column:
    return F.concat(F.lit("path:"), path)


def atom_ref(path: Column, name: Column) -> Column:
    return F.concat(F.lit("path:"), path, F.lit("::"), name)


def last_component(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def parent_path(path: Column) -> Column:
    trimmed = F.rtrim(path, F.lit("/"))
    return F.when(F.instr(trimmed, "/") > 0, F.regexp_replace(trimmed, r"/[^/]*$", "")).otherwise(F.lit(""))


def join_path(*parts: Column) -> Column:
    return F.regexp_replace(F.concat_ws("/", *(F.when(p != "", p) for p in parts)), "/+", "/")


def leaf(name: Column) -> Column:
    """What follows the last dot outside brackets and quotes."""
    return F.when(name.rlike(r"[\]\"'`]$"), F.regexp_extract(name, r"((?:\[[^\]]*\]|\"[^\"]*\"|'[^']*'|`[^`]*`))$", 1)).otherwise(F.substring_index(name, ".", -1))


def selector(ref: Column) -> Column:
    """How source names a reference: ``go:net/http::X`` becomes ``http.X``."""
    r = parse_reference(ref)
    return F.when(r["name"] == "", F.substring_index(r["path"], "/", -1)).otherwise(F.concat(F.substring_index(r["path"], "/", -1), F.lit("."), r["name"]))


def import_candidates(spec: Column, file: Column, extensions: tuple[str, ...] = ("py", "go", "js", "ts")) -> Column:
    """Paths that an import may name: relative to the file, with dots as slashes, its first segment; with extensions."""
    clean = F.regexp_replace(spec, "^[\"'`]|[\"'`]$", "")
    relative = join_path(dir_of(file), F.regexp_replace(clean, r"^(\./)+", ""))
    dotted = F.translate(clean, ".", "/")
    first = F.substring_index(dotted, "/", 1)
    base = F.array(relative, clean, dotted, first)
    more = F.flatten(F.transform(base, lambda b: F.array(b, *(F.concat(b, F.lit(f".{e}")) for e in extensions))))
    return F.array_distinct(F.transform(more, lambda p: F.regexp_replace(p, r"^(\./)+", "")))


def relative_import(source: str, target: str) -> str:
    """The path by which a file names another one."""
    rel = posixpath.relpath(target, posixpath.dirname(source) or ".")
    return rel if rel.startswith(".") else f"./{rel}"


def rebased_import(spec: str, old: str, new: str) -> str:
    """A relative import after its file moved; others stay."""
    if not spec.startswith("."):
        return spec
    return relative_import(new, posixpath.normpath(posixpath.join(posixpath.dirname(old), spec)))


@F.pandas_udf(StringType())
def relative_to(source: pd.Series, target: pd.Series) -> pd.Series:
    """``relative_import`` of columns."""
    return pd.Series([None if a is None or b is None else relative_import(a, b) for a, b in zip(source, target, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def rebased(spec: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    """``rebased_import`` of columns."""
    return pd.Series([None if None in x else rebased_import(*x) for x in zip(spec, old, new, strict=True)], dtype=object)


def common_prefix(a: Column, b: Column) -> Column:
    """The folders that two paths share, from the root down."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y)) - 1
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    same = F.filter(steps, lambda k: F.slice(x, 1, k) == F.slice(y, 1, k))
    return F.array_join(F.slice(x, 1, F.size(same)), "/")


def atom_name(name: Column) -> Column:
    """The last part of an atom's name, without quotes or brackets around it: ``T.'x.md'`` gives ``x.md``."""
    return F.regexp_replace(F.regexp_replace(leaf(name), r"^\[(.*)\]$", "$1"), "^([\"'`])(.*)\\1$", "$2")
