"""Symbol graphs: scopes, visibility, binding, imports, navigation, renames and moves."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import file_ref, import_candidates, matches_glob
from ..storage import kept
from . import spans


def first_by(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row per key: the first in the order given."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def languages(files: DataFrame, claims: DataFrame, globs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Files with their language; a file with two claims is an error."""
    rows = globs or [(r.glob, r.lang) for r in claims.collect()]  # a table of globs, not of files
    hits = F.array_distinct(F.array_compact(F.array(*(F.when(matches_glob(F.col("file"), g), F.lit(lang)) for g, lang in rows))))
    one = F.when(F.size("_l") > 1, F.raise_error(F.concat(F.lit("two languages claim "), F.col("file"))).cast("string")).otherwise(F.get("_l", F.lit(0)))
    return files.withColumn("_l", hits).withColumn("lang", one).drop("_l")


def visible(scopes: DataFrame, declares: DataFrame) -> DataFrame:
    """file, scope_idx, leaf, ref, depth: declarations of a scope and of all scopes around it; depth 0 is the scope's own.

    Scopes that lie around each other in a circle are an error.
    """
    own = declares.select("file", "scope_idx", "leaf", "ref", F.lit(0).alias("depth"))
    out, last = own, kept(own)
    up = scopes.where("parent >= 0").select("file", F.col("idx").alias("child"), F.col("parent").alias("scope_idx"))
    deepest = up.groupBy("file").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] + 1
    for depth in range(1, deepest + 1):
        last = kept(last.join(up, ["file", "scope_idx"]).select("file", F.col("child").alias("scope_idx"), "leaf", "ref", F.lit(depth).alias("depth")))
        if last.isEmpty():
            return out.groupBy("file", "scope_idx", "leaf", "ref").agg(F.min("depth").alias("depth"))
        out = out.unionByName(last)
    if not last.isEmpty() and deepest > 1:
        raise RuntimeError("scopes lie in a circle")
    return out.groupBy("file", "scope_idx", "leaf", "ref").agg(F.min("depth").alias("depth"))


def declared_in(scopes: DataFrame, atoms: DataFrame, levels: int = 32) -> DataFrame:
    """file, scope_idx, leaf, ref: each atom in its scope, or in the nearest one around that is no hole; -1 is the file."""
    own = atoms.select("file", "name", F.col("scope_idx").alias("at"))
    s = scopes.select("file", F.col("idx").alias("at"), "parent", "hole")
    for _ in range(levels):
        own = own.join(s, ["file", "at"], "left").select("file", "name", F.when(F.col("hole"), F.col("parent")).otherwise(F.col("at")).alias("at"))
        own = kept(own)
        if own.join(s.where("hole"), ["file", "at"], "left_semi").isEmpty():
            break
    return own.select("file", F.col("at").alias("scope_idx"), F.substring_index("name", ".", -1).alias("leaf"), F.concat(F.lit("path:"), "file", F.lit("::"), "name").alias("ref"))


def shadowed(scopes: DataFrame, declares: DataFrame, points: DataFrame) -> DataFrame:
    """Points (file, start, end, leaf) with the innermost declaration that is visible there."""
    seen = visible(scopes, declares)
    at = spans.innermost_cover(points, scopes.select("file", "start", "end", "idx")).withColumn("scope_idx", F.coalesce("cover", F.lit(-1))).drop("cover")
    hit = at.join(seen, ["file", "scope_idx", "leaf"], "left")
    return hit.groupBy(*points.columns).agg(F.min_by("ref", F.struct("depth", "ref")).alias("ref"))


def resolved_specs(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, spec, base: the first path that an import may name and that exists."""
    tried = imports.select("file", "spec").distinct().select("file", "spec", F.posexplode(import_candidates(F.col("spec"), F.col("file"))).alias("rank", "base"))
    known = files.select(F.col("file").alias("base")).distinct()
    return first_by(tried.join(known, "base"), ["file", "spec"], "rank").select("file", "spec", "base")


def import_targets(imports: DataFrame, specs: DataFrame, atoms: DataFrame) -> DataFrame:
    """file, local, target, member, alias, seq: what a name imported from a file stands for."""
    named = imports.where("not star").join(specs, ["file", "spec"])
    exact = atoms.select(F.col("file").alias("base"), F.col("name").alias("member"), F.lit(True).alias("_exact")).distinct()
    by_leaf = atoms.select(F.col("file").alias("base"), F.substring_index("name", ".", -1).alias("member"), "name").groupBy("base", "member").agg(F.min("name").alias("_leafed"))
    out = named.join(exact, ["base", "member"], "left").join(by_leaf, ["base", "member"], "left")
    name = F.when(F.col("_exact"), F.col("member")).otherwise(F.coalesce("_leafed", "member"))
    target = F.when(F.col("member") == "", file_ref(F.col("base"))).otherwise(F.concat(F.lit("path:"), "base", F.lit("::"), name))
    return out.select("file", "local", target.alias("target"), "member", F.col("has_alias").alias("alias"), "start")


def aliases(imports: DataFrame, targets: DataFrame) -> DataFrame:
    """The alias relation of plain imports: the file's reference, the chosen span, the target, the path token."""
    rows = imports.where("not star").join(targets.select("file", "local", "member", "target").distinct(), ["file", "local", "member"])
    whole = (F.col("tstart") == 0) & (F.col("tend") == 0)
    return rows.select(file_ref(F.col("file")).alias("ref"), F.when(whole, F.col("start")).otherwise(F.col("tstart")).alias("start"), F.when(whole, F.col("end")).otherwise(F.col("tend")).alias("end"), "target", "spec", "pstart", "pend")


def binds(uses: DataFrame, steps: list[DataFrame], keys: list[str]) -> DataFrame:
    """Uses with ``target_ref`` of the first step that knows one, and that step's number.

    Each step has the ``keys`` of a use and ``target``; a step's rows are unique by key.
    """
    out = uses
    for k, step in enumerate(steps):
        on = [c for c in keys if c in step.columns]
        out = out.join(step.select(*on, F.col("target").alias(f"_t{k}")), on, "left")
    found = [F.col(f"_t{k}") for k in range(len(steps))]
    which = F.coalesce(*(F.when(t.isNotNull(), F.lit(k)) for k, t in enumerate(found))) if found else F.lit(None)
    return out.withColumn("target_ref", F.coalesce(*found)).withColumn("step", which).drop(*(f"_t{k}" for k in range(len(steps))))


def star_targets(stars: DataFrame, atoms: DataFrame) -> DataFrame:
    """file, name, target: names from star imports, the last import first; names with ``_`` stay private."""
    rows = stars.join(atoms.select(F.col("file").alias("base"), "name"), "base").where(~F.col("name").startswith("_"))
    best = first_by(rows, ["file", "name"], F.desc("seq"))
    return best.select("file", "name", F.concat(F.lit("path:"), "base", F.lit("::"), "name").alias("target"))


def chained(uses: DataFrame, segments: DataFrame, members: DataFrame) -> DataFrame:
    """use_id, idx, ref: a dotted use followed segment by segment; it ends at the first that is unknown.

    ``uses`` has the reference of the first segment; ``members`` maps (ref, name) to ref.
    """
    out = now = uses.select("file", "use_id", F.lit(0).alias("idx"), "ref")
    step = members.select(F.col("ref"), F.col("name"), F.col("target"))
    for k in itertools.count(1):  # until no use has a segment that is known
        seg = segments.where(F.col("idx") == k).select("file", "use_id", "name")
        now = kept(now.join(seg, ["file", "use_id"]).join(step, ["ref", "name"]).select("file", "use_id", F.lit(k).alias("idx"), F.col("target").alias("ref")))
        if now.isEmpty():
            return out
        out = out.unionByName(now)


def canonical(refs: DataFrame, links: DataFrame, hops: int = 16) -> DataFrame:
    """ref, target: each reference followed through aliases, at most ``hops`` times; circles end where they began to turn."""
    step = first_by(links.where("ref <> target"), ["ref"], "target").select(F.col("ref").alias("_from"), F.col("target").alias("_to"))
    own = refs.select("ref", F.col("ref").alias("target"), F.array("ref").alias("seen")).distinct()
    for _ in range(hops):
        moved = own.join(step, F.col("target") == F.col("_from"), "left")
        go = F.col("_to").isNotNull() & ~F.array_contains("seen", F.coalesce("_to", F.lit("")))
        own = kept(moved.select("ref", F.when(go, F.col("_to")).otherwise(F.col("target")).alias("target"), F.when(go, F.array_append("seen", F.col("_to"))).otherwise(F.col("seen")).alias("seen"), go.alias("moved")))
        if own.where("moved").isEmpty():
            break
        own = own.drop("moved")
    return own.select("ref", "target")


def sole_entity(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with exactly one value."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")


def reached(seeds: DataFrame, links: DataFrame, source: str, target: str) -> DataFrame:
    """All files reachable from the seeds, with the round in which each was found."""
    known = kept(seeds.select(F.col(source).alias("file"), F.lit(0).alias("round")).distinct())
    front = known
    for k in itertools.count(1):  # each round finds new files or is the last
        new = front.join(links.select(F.col(source).alias("file"), F.col(target).alias("_to")), "file").select(F.col("_to").alias("file")).distinct()
        front = kept(new.join(known, "file", "left_anti").withColumn("round", F.lit(k)))
        if front.isEmpty():
            return known
        known = kept(known.unionByName(front))


def one_hop(loaded: DataFrame, specs: DataFrame, files: DataFrame) -> DataFrame:
    """Loaded files and the targets of their imports."""
    more = specs.join(loaded.select("file"), "file", "left_semi").select(F.col("base").alias("file")).distinct()
    return loaded.unionByName(files.join(more, "file", "left_semi").join(loaded.select("file"), "file", "left_anti").select(*loaded.columns))


def outside(uses: DataFrame, imports: DataFrame) -> DataFrame:
    """Uses that lie in no import's span of their file."""
    around = imports.where("end > start").select("file", "start", "end")
    hit = spans.containing(uses.select("file", "start", "end").distinct(), around).select("file", "start", "end").distinct()
    return uses.join(hit, ["file", "start", "end"], "left_anti")


#: Fixed values of the built-in rule.
DEAD_IMPORT = ("dead-imports", "warning", "unused import")


def dead_imports(imports: DataFrame, uses: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and deleting edits of named imports that nothing outside of imports uses."""
    used = outside(uses, imports).select("file", "name").union(outside(segments, imports).select("file", "name")).distinct()
    local = F.when(F.col("local") != "", F.col("local")).otherwise(F.substring_index(F.regexp_replace("spec", "^[\"'`]|[\"'`]$", ""), "/", -1))
    named = imports.where("not star").withColumn("name", local).where(~F.col("name").isin("", "*", ".", "_"))
    dead = named.join(used, ["file", "name"], "left_anti")
    whole = F.col("end") > F.col("start")
    dead = dead.select("file", F.when(whole, F.col("start")).otherwise(F.col("pstart")).alias("start"), F.when(whole, F.col("end")).otherwise(F.col("pend")).alias("end")).where("end > start").distinct()
    rule, level, message = DEAD_IMPORT
    found = dead.select("*", F.lit(rule).alias("rule_id"), F.lit(level).alias("level"), F.lit(message).alias("message"))
    return found, dead.select("*", F.lit("").alias("new_text"))


def rename_edits(goal: DataFrame, atoms: DataFrame, bound: DataFrame, alias: DataFrame) -> DataFrame:
    """Edits for goals (ref, new_text): at declarations, at uses not through an alias, at alias tokens."""
    refs = atoms.withColumn("ref", F.concat(F.lit("path:"), "file", F.lit("::"), "name"))
    at_atoms = refs.join(goal, "ref").select("file", "start", "end", "new_text")
    at_uses = bound.where("not via_alias").join(goal.withColumnRenamed("ref", "target_ref"), "target_ref").select("file", "start", "end", "new_text")
    at_alias = alias.join(goal.select(F.col("ref").alias("target"), "new_text"), "target").select(F.regexp_extract("ref", "^path:([^:]+)", 1).alias("file"), "start", "end", "new_text")
    return at_atoms.unionByName(at_uses).unionByName(at_alias).where("end > start").distinct()


def move_edits(holes: DataFrame, places: DataFrame, alias: DataFrame, specs: DataFrame, moved: DataFrame) -> DataFrame:
    """Edits of a move: holes are cut, places get text, importing files but the moved one get the new path."""
    cut = holes.select("file", "start", "end", F.lit("").alias("new_text"))
    put = places.select("file", "start", "end", F.col("text").alias("new_text"))
    from_file = alias.withColumn("file", F.regexp_extract("ref", "^path:([^:]+)", 1)).where("pend > pstart")
    new = from_file.join(specs, ["file", "spec"]).where("new_spec <> spec").join(moved, "file", "left_anti")
    return cut.unionByName(put).unionByName(new.select("file", F.col("pstart").alias("start"), F.col("pend").alias("end"), F.col("new_spec").alias("new_text"))).distinct()


def moved_paths(files: DataFrame, old: str, new: str) -> DataFrame:
    """file, to: the paths of a folder or file after a move; others stay."""
    inside = (F.col("file") == old) | F.col("file").startswith(f"{old}/")
    return files.select("file", F.when(inside, F.concat(F.lit(new), F.substring(F.col("file"), len(old) + 1, 1 << 20))).otherwise(F.col("file")).alias("to"))


def ensured_import(files: DataFrame, imports: DataFrame, wanted: DataFrame) -> DataFrame:
    """Edits that add imports (file, spec, line) that a file lacks: after its last import, else at its start.

    Where ``files`` has texts, a line is added behind the whole line that the last import ends in.
    """
    missing = wanted.join(imports.select("file", "spec").distinct(), ["file", "spec"], "left_anti")
    last = imports.groupBy("file").agg(F.max("end").alias("at"))
    if "text" not in files.columns:
        put = missing.join(files.select("file"), "file", "left_semi").join(last, "file", "left")
        text = F.when(F.col("at").isNull(), F.concat("line", F.lit("\n"))).otherwise(F.concat(F.lit("\n"), "line"))
        return put.select("file", F.coalesce("at", F.lit(0)).alias("start"), F.coalesce("at", F.lit(0)).alias("end"), text.alias("new_text"))
    raw = F.encode("text", "UTF-8")
    rest = F.decode(F.substring(raw, F.col("at") + 1, F.octet_length(raw)), "UTF-8")
    ended = F.instr(rest, "\n") > 0
    to = F.when(F.col("at").isNull(), 0).otherwise(F.col("at") + F.octet_length(F.substring_index(rest, "\n", 1)) + F.when(ended, 1).otherwise(0)).cast("int")
    own = files.select("file", "text").join(last, "file", "left").select("file", to.alias("start"), (F.col("at").isNull() | ended).alias("_ended"))
    return missing.join(own, "file").select("file", "start", F.col("start").alias("end"), F.when(F.col("_ended"), F.concat("line", F.lit("\n"))).otherwise(F.concat(F.lit("\n"), "line")).alias("new_text"))


def tightest(hits: DataFrame, points: DataFrame, idx: str = "idx") -> DataFrame:
    """Points (file, at) with the smallest span around them, of equals the first."""
    p = points.select("file", F.col("at").alias("start"), (F.col("at") + 1).alias("end"))
    return spans.innermost_cover(p, hits, idx).select("file", F.col("start").alias("at"), "cover")


def outline(rows: DataFrame) -> DataFrame:
    """Named spans (file, name, kind, start, end) with ``depth``, in the order of reading: outer ones before inner ones."""
    own = rows.dropDuplicates().withColumn("idx", F.xxhash64("file", "name", "kind", "start", "end"))
    around = spans.containing(own, own.select("file", "start", "end", "idx"), "left", strict=True)
    out = around.groupBy("file", "name", "kind", "start", "end").agg(F.count("o_idx").cast("int").alias("depth"))
    order = Window.partitionBy("file").orderBy("start", F.desc("end"), "name")
    return out.withColumn("ordinal", F.row_number().over(order))


def listed(atoms: DataFrame, prefix: str, recursive: bool = False, hidden: bool = False) -> DataFrame:
    """Atoms below a file or folder; without ``recursive`` only its own, without ``hidden`` only exported ones."""
    inside = (F.col("file") == prefix) | F.col("file").startswith(f"{prefix.rstrip('/')}/") if prefix not in ("", ".", "./") else F.lit(True)
    direct = F.lit(True) if recursive else ~F.substring(F.col("file"), len(prefix.rstrip("/")) + 2, 1 << 20).contains("/")
    return atoms.where(inside & direct & (F.lit(True) if hidden else F.col("exported"))).orderBy("file", "start")


def best_atom(atoms: DataFrame) -> DataFrame:
    """One atom per span: the name with most dots, then the longest."""
    dots = F.length("name") - F.length(F.replace("name", F.lit(".")))
    return first_by(atoms, ["file", "start", "end"], F.desc(dots), F.desc(F.length("name")), "name")


def merged_results(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: what ``a`` says of it, else what ``b`` says; of several rows of one side the one of the smallest hash.

    Columns that one side lacks are null there.
    """
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    plain = [f.name for f in both.schema.fields if f.dataType.typeName() != "map"]
    return first_by(both, keys, "_side", F.xxhash64(*plain)).drop("_side")


def flow_diagram(points: DataFrame, kind: str = "mermaid") -> DataFrame:
    """idx, diagram: the increments of each unit as a chain, for Mermaid or DOT."""
    arrow, head, tail = (" --> ", "flowchart TD\n  ", "") if kind == "mermaid" else (" -> ", "digraph flow { ", " }")
    node = F.concat(F.lit("n"), F.col("start").cast("string"), F.lit("_"), F.col("class"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("start", node.alias("n")))), lambda x: x["n"])
    return points.groupBy("file", "idx").agg(F.concat(F.lit(head), F.array_join(steps, arrow), F.lit(tail)).alias("diagram"))
