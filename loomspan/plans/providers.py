"""Where imports lead: a resolver for each language, by name; others can be added."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import dir_of, import_candidates, join_path
from ..operators.graph import first_by


class Provider(Protocol):
    """Names the paths that an import may mean, the likeliest first."""

    def candidates(self, spec: Column, member: Column, file: Column) -> Column: ...


@dataclass(frozen=True)
class PythonModules:
    """``a.b`` is ``a/b.py`` or a package's ``__init__.py``, below one of the roots; dots before go up; a member can be a module."""

    roots: tuple[str, ...] = ("",)

    def candidates(self, spec: Column, member: Column, file: Column) -> Column:
        dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
        rest = F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/")
        up = F.aggregate(F.sequence(F.lit(1), F.greatest(dots, F.lit(1))), F.concat(F.lit("./"), file), lambda acc, _: F.regexp_replace(acc, r"/[^/]*$", ""))
        here = F.regexp_replace(up, r"^\./?", "")
        bases = F.when(dots > 0, F.array(join_path(here, rest))).otherwise(F.array(*(join_path(F.lit(r), rest) for r in self.roots), join_path(F.regexp_replace(dir_of(file), r"^\.$", ""), rest)))
        inner = F.when((member != "") & (member != "*"), member)
        ends = lambda b: F.array_compact(F.array(F.concat(b, F.lit("/"), inner, F.lit(".py")), F.concat(b, F.lit(".py")), F.concat(b, F.lit("/__init__.py"))))
        return F.array_distinct(F.transform(F.flatten(F.transform(bases, ends)), lambda p: F.regexp_replace(p, "^/", "")))


@dataclass(frozen=True)
class JavaPackages:
    """``a.b.C`` is ``a/b/C.java`` (or ``.kt``, ``.scala``) below one of the roots; the part before the last can be the type."""

    roots: tuple[str, ...] = ("", "src", "src/main/java", "src/test/java")
    extensions: tuple[str, ...] = ("java", "kt", "scala")

    def candidates(self, spec: Column, member: Column, file: Column) -> Column:
        whole = F.replace(spec, F.lit("."), F.lit("/"))
        owner = F.regexp_replace(whole, "/[^/]*$", "")
        return F.array_distinct(F.array(*(join_path(F.lit(r), F.concat(p, F.lit(f".{e}"))) for p in (whole, owner) for r in self.roots for e in self.extensions)))


@dataclass(frozen=True)
class Relative:
    """Paths relative to the file, with the language's endings or an index file."""

    extensions: tuple[str, ...] = ("ts", "tsx", "js")

    def candidates(self, spec: Column, member: Column, file: Column) -> Column:
        plain = import_candidates(spec, file, self.extensions)
        index = F.transform(F.filter(plain, lambda p: ~F.substring_index(p, "/", -1).contains(".")), lambda p: F.concat(p, F.lit(f"/index.{self.extensions[0]}")))
        return F.concat(plain, index)


#: Providers by language.
PROVIDERS: dict[str, Provider] = {"python": PythonModules(), "java": JavaPackages(), "kotlin": JavaPackages(), "typescript": Relative()}


def resolved(imports: DataFrame, files: DataFrame, go_module: str = "") -> DataFrame:
    """file, spec, member, base: the file that each import means, where it is one of ``files`` (file, lang).

    Go imports below ``go_module`` mean a folder: its first file, so that the package's peers are found through it.
    """
    own = imports.select("file", "spec", "member").distinct().join(files.select("file", "lang"), "file")
    known = files.select(F.col("file").alias("base")).distinct()
    tried = F.array().cast("array<string>")
    for lang, p in PROVIDERS.items():
        tried = F.when(F.col("lang") == lang, p.candidates(F.col("spec"), F.col("member"), F.col("file"))).otherwise(tried)
    each = own.select("file", "spec", "member", F.posexplode(tried).alias("rank", "base"))
    out = first_by(each.join(known, "base"), ["file", "spec", "member"], "rank").select("file", "spec", "member", "base")
    folder = F.regexp_replace(F.expr("substring(spec, length('" + go_module.replace("'", "''") + "') + 1, 10000)"), "^/", "")
    go = own.where(F.col("lang") == "go").where(F.col("spec").startswith(go_module) if go_module else F.lit(False)).select("file", "spec", "member", folder.alias("dir"))
    firsts = files.where("lang = 'go'").groupBy(dir_of(F.col("file")).alias("dir")).agg(F.min("file").alias("base"))
    return out.unionByName(go.join(firsts, "dir").select("file", "spec", "member", "base"))
