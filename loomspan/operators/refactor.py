"""Plans that change source: imports kept clean, declarations moved, manifests and layouts rewritten, edits put together."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..batches import mapped
from ..functions.paths import atom_ref, dir_of, leaf, parse_reference, relative_to
from ..functions.text import dedented, qualified
from ..model import canonical_path
from ..storage import unbounded
from . import spans

EDIT = "file string, start int, end int, new_text string"
_EDIT = [("file", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("new_text", pa.string())]
#: Names that stand for no name.
NAMELESS = ("", "*", ".", "_")


def _edits(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_EDIT)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _EDIT, strict=True)], [n for n, _ in _EDIT])


def unoccupied(edits: DataFrame, occupied: DataFrame, order: str = "seq") -> DataFrame:
    """Edits, in order, that overlap neither an occupied span nor an edit taken before. Occupied spans may overlap each other."""
    taken = spans.merged_runs(occupied.select("file", "start", "end")).select("file", F.lit(-1).cast("long").alias(order), "start", "end", F.lit("").alias("new_text"), F.lit(True).alias("_there"))
    own = edits.select("file", F.col(order).cast("long").alias(order), "start", "end", "new_text", F.lit(False).alias("_there"))
    both = spans.claimed(taken.drop("_there").unionByName(own.drop("_there")), order)
    return both.where(F.col(order) >= 0).where("applied").drop("applied")


# --- imports -----------------------------------------------------------------


def masked_text(text: str, masks: list[tuple[int, int]]) -> str:
    """The text with blanks for all but line ends in the byte ranges."""
    raw = bytearray(text.encode())
    for a, b in masks:
        raw[a:b] = re.sub(rb"[^\n]", b" ", bytes(raw[a:b]))
    return raw.decode("utf-8", "replace")


def whole_line(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span of the line that a span is alone on, but for the word that imports it, with its end; else the span."""
    first = raw.rfind(b"\n", 0, start) + 1
    stop = raw.find(b"\n", end)
    stop = len(raw) if stop < 0 else stop
    if raw[first:start].strip() not in (b"", b"import") or raw[end:stop].strip():
        return start, end
    return first, min(stop + 1, len(raw))


def used_in(text: str, name: str) -> bool:
    return re.search(rf"(?<![A-Za-z0-9_]){re.escape(name)}(?![A-Za-z0-9_])", text) is not None


def pruned_imports(files: DataFrame, sites: DataFrame, masks: DataFrame | None = None, only: tuple[str, ...] = (), lines: bool = False) -> DataFrame:
    """Edits that delete import sites (file, key, start, end, locals, keep) none of whose names the rest of the file uses.

    All sites and ``masks`` count as blank. Sites with ``keep``, without a name, or with a key that is not
    among ``only`` (where given) stay. With ``lines``, a site that is alone on its line goes with the line.
    """
    own = sites.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("start", "end", "key", "locals", "keep"))).alias("sites"))
    rows = files.select("file", "text").join(own, "file")
    if masks is not None:
        rows = rows.join(masks.groupBy("file").agg(F.collect_list(F.struct("start", "end")).alias("masks")), "file", "left")
    else:
        rows = rows.withColumn("masks", F.lit(None).cast("array<struct<start:int,end:int>>"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, text, own, hidden in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = masked_text(text or "", [(x["start"], x["end"]) for x in [*own, *(hidden or [])]])
                for x in own:
                    names = [n for n in x["locals"] or [] if n not in NAMELESS]
                    if x["keep"] or not x["locals"] or (only and x["key"] not in only) or any(used_in(rest, n) for n in names):
                        continue
                    out.append((file, *(whole_line((text or "").encode(), x["start"], x["end"]) if lines else (x["start"], x["end"])), ""))
            yield _edits(out)

    return mapped(rows.select("file", "text", "sites", "masks"), work, EDIT)


def import_sites(imports: DataFrame) -> DataFrame:
    """Sites as ``pruned_imports`` takes them, from the relation of imports: star imports stay."""
    plain = F.regexp_replace("spec", "^[\"'`]|[\"'`]$", "")
    local = F.when(F.col("local") != "", F.col("local")).otherwise(F.substring_index(plain, "/", -1))
    own = imports.where("end > start")
    return own.groupBy("file", "start", "end").agg(F.min("spec").alias("key"), F.sort_array(F.collect_set(local)).alias("locals"), F.max("star").alias("keep"))


def needed_imports(declarations: DataFrame, imports: DataFrame) -> DataFrame:
    """file, name, key: imports whose names a declaration (file, name, text) uses; star imports are always needed."""
    own = imports.select("file", F.col("spec").alias("key"), "local", "star")
    both = declarations.join(own, "file")
    word = F.concat(F.lit("(?<![A-Za-z0-9_])"), F.col("local"), F.lit("(?![A-Za-z0-9_])"))
    used = ~F.col("local").isin(*NAMELESS) & F.regexp_like("text", F.when(F.col("local").rlike("^[A-Za-z0-9_]+$"), word).otherwise(F.lit("$^")))
    return both.where(F.col("star") | used).select("file", "name", "key").distinct()


def with_hygiene(files: DataFrame, edits: DataFrame, imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edits of a rewrite with those that its imports need: what it wants (file, spec, line) is added, what only its sites used is deleted."""
    from .graph import ensured_import

    touched = edits.select("file").distinct()
    own = files.join(touched, "file", "left_semi")
    added = ensured_import(own, imports, wanted.join(touched, "file", "left_semi"))
    gone = pruned_imports(own, import_sites(imports), edits.where("end > start").select("file", "start", "end"), lines=True)
    return edits.select("file", "start", "end", "new_text").unionByName(added).unionByName(gone)


_HEAD = re.compile(r'(?P<blank>\s+|//[^\n]*|/\*(?s:.*?)\*/|;)|(?P<package>package\s+\w+)|(?P<group>import\s*\((?P<specs>[^)"`]*(?:(?:"[^"\n]*"|`[^`]*`)[^)"`]*)*)\))|(?P<one>import\s+(?:[\w.]+\s+)?(?:"[^"\n]*"|`[^`]*`))')
_SPEC = re.compile(r'(?P<name>[\w.]+)?[ \t]*["`](?P<path>[^"`\n]*)["`]')


def merged_import(text: str, spec: str, alias: str = "") -> str:
    """A Go text with one more import: in its first group, as a group with a single import, or behind the package clause.

    Only the head is read, up to the first declaration, so strings and comments that look like imports stay. In a group, the
    import stands before the first path that is larger; comments keep their lines.
    """
    line = f'{alias + " " if alias else ""}"{spec}"'
    at, clause, group, one, have = 0, 0, None, None, set()
    while m := _HEAD.match(text, at):
        at = m.end()
        if m["package"]:
            clause = at
        elif m["group"] or m["one"]:
            code = re.sub(r"//[^\n]*", "", m["specs"] if m["group"] else m["one"].removeprefix("import"))
            have |= {(x["name"] or "", x["path"]) for x in _SPEC.finditer(code)}
            group, one = (group or m if m["group"] else group), (one or m if m["one"] else one)
    if (alias, spec) in have:
        return text
    if group:
        start, own = group.start("specs"), group["specs"]
        for x in re.finditer(r"(?m)^[ \t]*(?!//)[^\n]*?[\"`]([^\"`\n]*)[\"`]", own):
            if x[1] > spec:
                return f"{text[: start + x.start()]}\t{line}\n{text[start + x.start() :]}"
        lead = "" if own.endswith("\n") else "\n"
        return f"{text[: group.end('specs')]}{lead}\t{line}\n{text[group.end('specs') :]}"
    if one:
        end = text.find("\n", one.end())
        end = len(text) if end < 0 else end
        old = (one["one"].removeprefix("import").strip() + text[one.end() : end]).rstrip()
        both = sorted([old, line], key=lambda x: _SPEC.search(x)["path"])
        return text[: one.start()] + "import (\n" + "".join(f"\t{x}\n" for x in both) + ")" + text[end:]
    if not clause:
        return f"import {line}\n{text}"
    rest = text[clause:].removeprefix("\n")
    return f"{text[:clause]}\n\nimport {line}\n{'' if not rest or rest.startswith(chr(10)) else chr(10)}{rest}"


def merged_imports(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """file, text: Go files (file, text) with the imports that they want (file, spec, alias) merged into their heads; others stay as they are."""
    own = wanted.groupBy("file").agg(F.sort_array(F.collect_set(F.struct("spec", F.coalesce("alias", F.lit("")).alias("alias")))).alias("wanted"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, want in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for w in want or [] if text is not None else []:
                    text = merged_import(text, w["spec"], w["alias"])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["file", "text"])

    return mapped(files.select("file", "text").join(own, "file", "left"), work, "file string, text string")


# --- renames and moves -------------------------------------------------------


def receiver(name):
    """The type that a member's name begins with, without pointer and parameters; null for other names."""
    owner = F.regexp_replace(F.regexp_replace(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1), r"^\*", ""), r"\[.*$", "")
    return F.when(F.instr(name, ".") > 0, owner)


def partitioned_rename(atoms: DataFrame, sources: DataFrame, old: str) -> DataFrame:
    """receiver, side: types whose member ``old`` is renamed (``our``), and others that have such a member (``foreign``).

    ``atoms`` has ref and name, ``sources`` ref.
    """
    own = atoms.join(sources.select("ref").distinct(), "ref", "left_semi").select(receiver(F.col("name")).alias("receiver")).where("receiver IS NOT NULL").distinct()
    other = atoms.join(sources.select("ref").distinct(), "ref", "left_anti").where(leaf(F.col("name")) == old)
    other = other.select(receiver(F.col("name")).alias("receiver")).where("receiver IS NOT NULL").distinct().join(own, "receiver", "left_anti")
    return own.withColumn("side", F.lit("our")).unionByName(other.withColumn("side", F.lit("foreign")))


def rename_clashes(goals: DataFrame, atoms: DataFrame) -> DataFrame:
    """Goals (ref, new_text) whose new name its file declares already, with the reason."""
    r = parse_reference(F.col("ref"))
    new = F.concat(F.regexp_replace(F.col("r.name"), r"[^.]*$", ""), "new_text")
    want = goals.withColumn("r", r).select("ref", "new_text", canonical_path(F.col("r.path")).alias("file"), new.alias("name"))
    have = atoms.select(canonical_path(F.col("file")).alias("file"), "name").distinct()
    return want.join(have, ["file", "name"]).select("ref", "new_text", F.concat("file", F.lit(" has "), "name", F.lit(" already")).alias("reason"))


def move_rejects(moves: DataFrame, atoms: DataFrame, binds: DataFrame, files: DataFrame, aliases: DataFrame) -> DataFrame:
    """Moves (file, name, start, end, to: the hole of a declaration and its new file) that must not be made, with the first reason.

    Within one folder all moves are fine. Between folders of a language that sees a package's files
    (``files`` as ``binding.facts`` gives them): an unexported name, a test out of tests, a type whose methods stay, a hole
    that uses what its folder keeps. Between any files: a member of a type, and a circle of
    imports, where the old file still uses what moves and the hole uses what stays, or the new file imports the old one.
    """
    m = moves.withColumn("leaf", leaf(F.col("name"))).withColumn("from_dir", dir_of(F.col("file"))).withColumn("to_dir", dir_of(F.col("to")))
    m = m.where("file <> to").join(files.select("file", F.col("package_scoped").alias("scoped")), "file", "left").withColumn("ref", atom_ref(F.col("file"), F.col("name")))
    key = ["file", "name"]
    own = atoms.select("file", F.col("name").alias("other"), F.col("start").alias("a"), F.col("end").alias("b"))
    stays = own.join(m.select(*key, "start", "end"), "file").where("NOT (a >= start AND b <= end)").select(*key, F.col("other"), atom_ref(F.col("file"), F.col("other")).alias("target_ref"))
    inner = binds.select("file", F.col("start").alias("a"), F.col("end").alias("b"), "target_ref").join(m.select(*key, "start", "end"), "file")
    holds = inner.where("a >= start AND b <= end").join(stays, [*key, "target_ref"]).select(*key, "other")
    deps = holds.groupBy(*key).agg(F.min("other").alias("dep"))
    left = inner.where("NOT (b > start AND a < end)").where(F.col("target_ref") == atom_ref(F.col("file"), F.col("name"))).select(*key).distinct().withColumn("residual", F.lit(True))
    back = aliases.select(canonical_path(F.regexp_extract("ref", "^path:([^:]+)", 1)).alias("to"), canonical_path(F.regexp_extract("target", "^path:([^:]+)", 1)).alias("file")).distinct().withColumn("imports_back", F.lit(True))
    methods = atoms.select(dir_of(F.col("file")).alias("from_dir"), receiver(F.col("name")).alias("name"), F.col("name").alias("method")).where("name IS NOT NULL").groupBy("from_dir", "name").agg(F.min("method").alias("method"))
    full = m.join(deps, key, "left").join(left, key, "left").join(back, ["to", "file"], "left").join(methods, ["from_dir", "name"], "left")
    apart = (F.col("from_dir") != F.col("to_dir")) & F.coalesce("scoped", F.lit(False))
    test = lambda c: F.regexp_replace(c, r"\.[^./]*$", "").endswith("_test")
    why = (
        F.when(F.instr("name", ".") > 0, F.lit("a member of a type can't move alone"))
        .when(apart & (F.col("leaf") != "init") & ~F.col("leaf").rlike(r"^\p{Lu}"), F.concat(F.lit("unexported: "), "leaf"))
        .when(apart & test("file") & ~test("to") & F.col("leaf").startswith("Test"), F.concat(F.lit("a test outside of tests: "), "leaf"))
        .when(apart & F.col("method").isNotNull(), F.concat(F.lit("methods stay: "), "method"))
        .when(apart & F.col("dep").isNotNull(), F.concat(F.lit("still depends on "), "dep"))
        .when(F.col("residual") & F.col("dep").isNotNull(), F.concat(F.lit("a circle of imports through "), "dep"))
        .when(F.col("residual") & F.col("imports_back"), F.lit("a circle of imports: the new file imports the old one"))
    )
    return full.select(*key, "to", why.alias("reason")).where("reason IS NOT NULL")


def declarations(atoms: DataFrame, scopes: DataFrame, files: DataFrame) -> DataFrame:
    """file, name, start, end, text: the whole lines of each atom's declaration, without the blanks before it, for a move.

    A declaration reaches as far as the smallest scope that begins on the atom's line, else to its line's end.
    """
    rows = atoms.select("file", "name", F.col("start").alias("at"), F.col("end").alias("until")).join(files.select("file", "text"), "file")
    raw = F.encode("text", "UTF-8")
    before = F.decode(F.substring(raw, 1, F.col("at")), "UTF-8")
    begin = F.col("at") - F.octet_length(F.substring_index(before, "\n", -1))
    rows = rows.withColumn("start", begin.cast("int"))
    # a scope begins in one stretch of a file, an atom's line reaches over few: they meet by stretches
    stretch = lambda c: F.floor(F.col(c) / spans.BIN).cast("int")
    own = scopes.select("file", F.col("start").alias("_s"), F.col("end").alias("_e"), stretch("start").alias("_bin"))
    lines = rows.select("file", "at", "until", "start", F.explode(F.sequence(stretch("start"), stretch("at"))).alias("_bin"))
    met = lines.join(own, ["file", "_bin"]).where("_s >= start AND _s <= at AND _e >= until")
    rows = rows.join(met.groupBy("file", "at", "until").agg(F.min("_e").alias("_e")), ["file", "at", "until"], "left")
    stop = F.coalesce("_e", "until")
    after = F.decode(F.substring(raw, stop + 1, F.octet_length(raw)), "UTF-8")
    end = stop + F.octet_length(F.substring_index(after, "\n", 1)) + F.when(F.instr(after, "\n") > 0, 1).otherwise(0)
    rows = rows.withColumn("end", end.cast("int"))
    own_text = F.decode(F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    return rows.select("file", "name", "start", "end", dedented(own_text).alias("text"))


def moved_declarations(moves: DataFrame, declared: DataFrame, files: DataFrame, names: DataFrame, qualifier: DataFrame) -> DataFrame:
    """Edits that cut declarations (file, name) and add them at the end of their new file ``to``.

    What a declaration leaves behind (``names``: file, name, left: the names that stay) is written with the
    old file's ``qualifier`` (file, qualifier) before it.
    """
    own = moves.select("file", "name", "to").join(declared, ["file", "name"])
    left = names.groupBy("file", "name").agg(F.sort_array(F.collect_set("left")).alias("left"))
    own = own.join(left, ["file", "name"], "left").join(qualifier, "file", "left")
    text = F.when(F.col("left").isNull() | F.col("qualifier").isNull(), F.col("text")).otherwise(qualified(F.col("text"), F.col("left"), F.col("qualifier")))
    cut = own.select("file", "start", "end", F.lit("").alias("new_text"))
    size = files.select(F.col("file").alias("to"), F.octet_length("text").alias("at"), F.col("text").endswith("\n").alias("ended"))
    put = own.select("to", "start", text.alias("t")).join(size, "to", "left")
    put = put.select(F.col("to").alias("file"), F.coalesce("at", F.lit(0)).cast("int").alias("start"), F.coalesce("at", F.lit(0)).cast("int").alias("end"), F.concat(F.when(F.col("ended") | (F.coalesce("at", F.lit(0)) == 0), "").otherwise("\n"), "t").alias("new_text"))
    return cut.unionByName(put)


def manifest_edits(manifests: DataFrame, moves: DataFrame) -> DataFrame:
    """Edits of the string literals of JSON manifests (file, text) that name what moves (old, new), relative to the manifest's folder.

    All moves are made at once: literals meet the table of moves by the prefixes of the paths that they name.
    """
    from .reimport import moved_paths

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                for m in re.finditer(rb'"((?:[^"\\]|\\.)*)"', raw):
                    spec = m[1].decode("utf-8", "replace")
                    if spec.startswith(".") or "/" in spec:
                        out.append((file, m.start(1), m.end(1), spec, posixpath.normpath(posixpath.join(posixpath.dirname(file), spec))))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()], strict=True)], ["file", "start", "end", "spec", "path"])

    found = mapped(manifests.select("file", "text"), work, "file string, start int, end int, spec string, path string")
    met = found.join(moved_paths(found.select("path"), moves), "path").where(F.col("to") != F.col("path"))
    to = relative_to(F.col("file"), F.col("to"))
    return met.select("file", "start", "end", F.when(F.col("spec").startswith("."), to).otherwise(F.regexp_replace(to, r"^\./", "")).alias("new_text"))


def layout_edits(files: DataFrame, packages: DataFrame, imports: DataFrame, units: DataFrame, layout: tuple[str, ...] = ("package", "import", "body")) -> DataFrame:
    """Edits that add units (file, section, unit) to sections of files: behind the section's last line, else where the section would begin.

    The package section ends with its clause's line, the import section with the last import's, the body with the file.
    """
    size = F.octet_length("text")
    own = files.select("file", "text", size.alias("size"))
    own = own.join(packages.groupBy("file").agg(F.max("end").alias("p")), "file", "left").join(imports.groupBy("file").agg(F.max("end").alias("i")), "file", "left")
    raw = F.encode("text", "UTF-8")

    def line_end(at):
        rest = F.decode(F.substring(raw, at + 1, F.col("size")), "UTF-8")
        return at + F.octet_length(F.substring_index(rest, "\n", 1)) + F.when(F.instr(rest, "\n") > 0, 1).otherwise(0)

    ends = {"package": F.when(F.col("p") > 0, line_end(F.col("p"))), "import": F.when(F.col("i").isNotNull(), line_end(F.col("i"))), "body": F.when(F.col("size") > 0, F.col("size"))}
    rows = units.join(own, "file")
    at = F.lit(0)
    for k, name in enumerate(layout):
        before = [ends[n] for n in reversed(layout[:k])]
        at = F.when(F.col("section") == name, F.coalesce(ends[name], *before, F.lit(0))).otherwise(at)
    rows = rows.where(F.col("section").isin(*layout)).withColumn("at", at.cast("int"))
    return rows.select("file", F.col("at").alias("start"), F.col("at").alias("end"), F.col("unit").alias("new_text"))


def applied_plan(files: DataFrame, edits: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """file, text after a plan: edits on the files as they are, then folders and files renamed (file, to); files that become empty by an edit go."""
    done = spans.edited(files, edits)
    emptied = unbounded(edits.select("file").distinct())
    kept = done.join(emptied.withColumn("_e", F.lit(True)), "file", "left").where(F.col("_e").isNull() | (F.trim("text") != "")).drop("_e")
    if moves is None:
        return kept
    return kept.join(moves.select("file", "to"), "file", "left").select(F.coalesce("to", "file").alias("file"), "text")


# --- documentation and flow --------------------------------------------------


def comments_before(files: DataFrame, points: DataFrame) -> DataFrame:
    """file, at, doc: the comment lines right above the line of each byte, without their marks."""
    own = points.groupBy("file").agg(F.collect_list("at").alias("points")).join(files.select("file", "text"), "file")

    def doc(text: bytes, at: int) -> str:
        lines = text[:at].decode("utf-8", "replace").split("\n")[:-1]
        while lines and not lines[-1].strip():
            lines.pop()
        out: list[str] = []
        while lines and re.match(r"\s*(//|#|/\*|\*)", lines[-1]):
            x = lines.pop().strip()
            out.append(x.removeprefix("//").removeprefix("#").removeprefix("/*").removesuffix("*/").removeprefix("*").strip())
        return "\n".join(reversed(out))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(f, at, doc((t or "").encode(), at)) for f, t, points in zip(*(c.to_pylist() for c in batch.columns), strict=True) for at in points]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["file", "at", "doc"])

    return mapped(own.select("file", "text", "points"), work, "file string, at int, doc string")


def scope_children(paths: DataFrame) -> DataFrame:
    """parent, path, kind, ordinal: folders before files, then by path, in each folder (``paths`` has a path for each file)."""
    parts = F.split("path", "/")
    steps = paths.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), F.when(k == F.size(parts), "file").otherwise("folder").alias("kind")))).alias("s")).select("s.*").distinct()
    own = steps.withColumn("parent", dir_of(F.col("path")))
    order = Window.partitionBy("parent").orderBy(F.col("kind") != "folder", "path")
    return own.withColumn("ordinal", F.row_number().over(order))


def sorted_result(rows: DataFrame, *order: str) -> DataFrame:
    """Rows in an order over all of them: a range sort, no single task."""
    return rows.orderBy(*order)
