"""Binding uses to what they name.

A bare name is looked for in a fixed order: the file's imports, a declaration at the
very span, the scopes around, other files of the package, included files, the type around,
star imports. Each way is an equi join with a table that has one row for each key, so a
use stays one row; the first way that knows the name wins. Dotted names are followed segment
by segment.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import atom_ref, dir_of, file_ref, leaf, parse_reference
from ..model import canonical_path
from ..storage import kept, unbounded
from .graph import first_by

#: What a language can state of how its files see each other.
FLAGS = ("nested", "include_export", "package_scoped", "empty_dir")


def family_flags(claims: DataFrame) -> DataFrame:
    """lang, family, flags: a language has the flags that any claim of its family states (lang, family, flag)."""
    own = claims.groupBy("family").agg(F.sort_array(F.collect_set("flag")).alias("flags"))  # a handful of flags
    return claims.groupBy("lang").agg(F.min("family").alias("family")).join(own, "family").select("lang", "family", "flags")


def same_family(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Pairs of languages a, b with ``same``: equal, or of one family."""
    of = claims.groupBy("lang").agg(F.min("family").alias("family"))
    side = lambda s: of.select(F.col("lang").alias(s), F.col("family").alias(f"_{s}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    same = (F.col("a") == F.col("b")) | (F.col("_a") == F.col("_b"))
    return both.withColumn("same", F.coalesce(same, F.lit(False)) & (F.col("a") != "") & (F.col("b") != "")).drop("_a", "_b")


def facts(files: DataFrame, flags: DataFrame) -> DataFrame:
    """file, lang, package and one boolean for each of FLAGS, from files and (lang, flag)."""
    has = flags.groupBy("lang").agg(*(F.max(F.col("flag") == f).alias(f) for f in FLAGS))
    own = files.select("file", "lang", F.coalesce("package", F.lit("")).alias("package"))
    return own.join(F.broadcast(has), "lang", "left").select("file", "lang", "package", *(F.coalesce(f, F.lit(False)).alias(f) for f in FLAGS))


def used_from(uses: DataFrame, atoms: DataFrame) -> DataFrame:
    """Uses with ``from_ref``: the file, or the declaration that the use's scope names, if it is the only one of that name or leaf."""
    key = F.explode(F.array_distinct(F.array("name", leaf(F.col("name")))))
    found = atoms.select("file", "name", key.alias("scope")).groupBy("file", "scope").agg(F.count(F.lit(1)).alias("_n"), F.min("name").alias("_name"))
    both = uses.join(found, ["file", "scope"], "left")
    name = F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.col("scope"))
    return both.withColumn("from_ref", F.when(F.col("scope") == "", file_ref(F.col("file"))).otherwise(atom_ref(F.col("file"), name))).drop("_n", "_name")


def _known(df: DataFrame, keys: list[str], value: str, name: str, last: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the first (or last) one's value by ``seq``."""
    pick = F.max_by if last else F.min_by
    order = F.struct("seq", value)
    return df.groupBy(*keys).agg(pick(value, order).alias(name), *(pick(c, order).alias(f"{name}_{c}") for c in more))


def peer_targets(files: DataFrame, declares: DataFrame) -> DataFrame:
    """lang, package, dir, leaf, first, second: which files of a package declare a name at their top, the two that come first.

    Two are enough to tell every file of the package a peer other than itself, and no pair of files is made.
    """
    groups = packages(files)
    own = declares.where("scope_idx = -1").groupBy("file", "leaf").agg(F.min("ref").alias("ref")).join(groups, "file")
    keys = ["lang", "package", "dir", "leaf"]
    one = own.groupBy(*keys).agg(F.min(F.struct("file", "ref")).alias("first"))
    two = own.join(unbounded(one), keys).where(F.col("file") != F.col("first.file")).groupBy(*keys).agg(F.min(F.struct("file", "ref")).alias("second"))
    return one.join(unbounded(two), keys, "left")


def packages(files: DataFrame) -> DataFrame:
    """file, lang, package, dir: the package of each file whose language sees a package's files; ``dir`` parts unnamed packages where flagged."""
    own = F.when(F.col("empty_dir") & (F.col("package") == ""), dir_of(F.col("file"))).otherwise(F.lit(""))
    return files.where("package_scoped").select("file", "lang", "package", own.alias("dir"))


def _exposed(wanted: DataFrame, places: DataFrame, named: DataFrame, value: str, last: bool = False) -> DataFrame:
    """file, name and what the first (or last) place of the file that knows the name knows."""
    met = wanted.select("file", "name").distinct().join(unbounded(places), "file").join(named.select(F.col("file").alias("path"), "name", "ref"), ["path", "name"])
    return unbounded(_known(met, ["file", "name"], "ref", value, last))


def _paths_of(refs: DataFrame, column: str) -> DataFrame:
    """file, path, seq of references to whole files."""
    r = parse_reference(F.col(column))
    own = refs.select("file", "seq", r.alias("r")).where("r.name = '' AND r.provider IN ('path', '')")
    return own.select("file", canonical_path(F.col("r.path")).alias("path"), "seq")


class Ladder:
    """The tables in which names are looked for.

    ``imports`` file, local, target, member, alias, seq; ``atoms`` file, name, start, end;
    ``visible`` file, scope_idx, leaf, ref, seq; ``declares`` file, scope_idx, leaf, ref; ``named``
    file, name, ref, seq (the atoms of files); ``stars`` file, base, seq; ``files`` as ``facts`` gives them.
    """

    WAYS = ("import", "span", "scope", "root", "peer", "include", "type", "head", "include_head", "star")

    def __init__(self, files: DataFrame, imports: DataFrame, atoms: DataFrame, visible: DataFrame, declares: DataFrame, named: DataFrame, stars: DataFrame):
        self.files, self.atoms = unbounded(files), atoms
        self.imports = _known(imports, ["file", "local"], "target", "_import", last=True, more=("member", "alias"))
        self.visible = _known(visible, ["file", "scope_idx", "leaf"], "ref", "_scope")
        self.peers = peer_targets(self.files, declares)
        self.named = _known(named.withColumn("file", canonical_path(F.col("file"))), ["file", "name"], "ref", "ref")
        self.includes = _paths_of(imports.withColumnRenamed("target", "base").join(files.where("include_export").select("file"), "file", "left_semi"), "base")
        self.stars = _paths_of(stars, "base")

    def _near(self, rows: DataFrame) -> DataFrame:
        """Rows (file, name, scope_idx) with what imports, scopes and peers know: ``_import``, ``_scope``, ``_root``, ``_peer``."""
        root = self.visible.where("scope_idx = -1").select("file", F.col("leaf").alias("name"), F.col("_scope").alias("_root"))
        out = rows.join(self.imports.withColumnRenamed("local", "name"), ["file", "name"], "left")
        out = out.join(self.visible.withColumnRenamed("leaf", "name"), ["file", "scope_idx", "name"], "left").join(root, ["file", "name"], "left")
        out = out.join(packages(self.files), "file", "left").join(self.peers.withColumnRenamed("leaf", "name"), ["lang", "package", "dir", "name"], "left")
        peer = F.when(F.col("first.file") != F.col("file"), F.col("first.ref")).otherwise(F.col("second.ref"))
        return out.withColumn("_peer", peer).drop("lang", "package", "dir", "first", "second")

    def _member(self, rows: DataFrame, name: Column, value: str) -> DataFrame:
        """Rows with what their own file knows of another name."""
        own = self.named.select(F.col("file").alias("_f"), F.col("name").alias("_n"), F.col("ref").alias(value))
        return rows.join(own, (canonical_path(F.col("file")) == F.col("_f")) & (name == F.col("_n")), "left").drop("_f", "_n")

    def bare(self, uses: DataFrame) -> DataFrame:
        """file, start, end, from_ref, target_ref, via_alias, way of the uses without prefix that are known."""
        rows = used_from(uses.where("n_prefix = 0").select("file", "name", "start", "end", "scope", "scope_idx"), self.atoms)
        span = self.atoms.groupBy("file", "start", "end").agg(F.max("name").alias("_at"))
        rows = self._near(rows).join(span, ["file", "start", "end"], "left")
        at = F.when((F.col("_at") == F.col("name")) | (leaf(F.col("_at")) == F.col("name")), atom_ref(F.col("file"), F.col("_at")))
        rows = rows.withColumn("_span", at)
        nested = self.files.select("file", "nested")
        head = F.when((F.col("scope") != "") & F.col("nested"), F.concat(F.substring_index("scope", ".", 1), F.lit("."), "name"))
        rows = rows.join(nested, "file", "left").withColumn("_headed", head)
        rows = rows.join(_exposed(rows, self.includes, self.named, "_include"), ["file", "name"], "left")
        rows = self._member(rows, F.when(F.col("scope") != "", F.concat("scope", F.lit("."), "name")), "_type")
        rows = self._member(rows, F.col("_headed"), "_head")
        headed = _exposed(rows.where("_headed IS NOT NULL").select("file", F.col("_headed").alias("name")), self.includes, self.named, "_include_head")
        rows = rows.join(headed.withColumnRenamed("name", "_headed"), ["file", "_headed"], "left")
        public = rows.where(~F.col("name").startswith("_"))
        rows = rows.join(_exposed(public, self.stars, self.named, "_star", last=True), ["file", "name"], "left")
        ways = [F.when(F.col(f"_{w}") != "", F.col(f"_{w}")) for w in self.WAYS]
        which = F.coalesce(*(F.when(t.isNotNull(), F.lit(w)) for w, t in zip(self.WAYS, ways, strict=True)))
        out = rows.select("file", "start", "end", "from_ref", F.coalesce(*ways).alias("target_ref"), which.alias("way"), "_import_alias")
        return out.where("target_ref IS NOT NULL").select("file", "start", "end", "from_ref", "target_ref", (F.col("way") == "import") & F.coalesce("_import_alias", F.lit(False)), "way").toDF("file", "start", "end", "from_ref", "target_ref", "via_alias", "way")

    def dotted(self, uses: DataFrame, segments: DataFrame) -> DataFrame:
        """As ``bare`` for the segments and the last name of uses with prefix; a use whose first segment is unknown has no row."""
        own = used_from(uses.where("n_prefix > 0").select("file", "use_id", "name", "start", "end", "scope", "scope_idx"), self.atoms)
        first = segments.where("idx = 0").select("file", "use_id", F.col("name").alias("_leaf"), F.col("start").alias("_s"), F.col("end").alias("_e"))
        rows = own.withColumnRenamed("name", "_last").join(first, ["file", "use_id"]).withColumnRenamed("_leaf", "name")
        rows = self._near(rows)
        target = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in ("_import", "_scope", "_root", "_peer")))
        member = F.when(F.col("_import") != "", F.coalesce("_import_member", F.lit(""))).otherwise(F.lit(""))
        rows = rows.withColumn("_target", target).where("_target IS NOT NULL").withColumn("_member", member)
        cut = F.col("_target").endswith(F.concat(F.lit("::"), F.col("_member"))) & (F.col("_member") != "")
        base = F.when(cut, F.expr("substring(_target, 1, length(_target) - length(_member) - 2)")).otherwise(F.col("_target"))
        now = kept(rows.select("file", "use_id", "from_ref", "_s", "_e", "_target", base.alias("base"), F.col("_member").alias("member")))
        out = now.select("file", F.col("_s").alias("start"), F.col("_e").alias("end"), "from_ref", F.col("_target").alias("target_ref"))
        done = now.select("file", "use_id", "base", "member")
        for k in itertools.count(1):
            seg = segments.where(F.col("idx") == k).select("file", "use_id", F.col("name").alias("wanted"), "start", "end")
            step = kept(self._hop(now.select("file", "use_id", "from_ref", "base", "member").join(seg, ["file", "use_id"])))
            if step.isEmpty():
                break
            out = out.unionByName(step.select("file", "start", "end", "from_ref", "target_ref"))
            now = step.select("file", "use_id", "from_ref", F.col("target_ref").alias("base"), F.lit("").alias("member"))
            done = kept(done.join(step.select("file", "use_id"), ["file", "use_id"], "left_anti").unionByName(now.select("file", "use_id", "base", "member")))
        last = self._hop(own.select("file", "use_id", F.col("name").alias("wanted"), "start", "end", "from_ref").join(done, ["file", "use_id"]))
        out = out.unionByName(last.select("file", "start", "end", "from_ref", "target_ref"))
        return out.select("*", F.lit(False).alias("via_alias"), F.lit("dotted").alias("way"))

    def _hop(self, rows: DataFrame) -> DataFrame:
        """Rows (base, member, wanted) with ``target_ref``: the member of the base that is wanted, whether it is known or not."""
        r = parse_reference(F.col("base"))
        rows = rows.withColumn("_r", r).withColumn("_path", canonical_path(F.col("_r.path")))
        local = F.col("_r.provider").isin("path", "")
        inside = F.when((F.col("_r.name") != "") & local, F.col("_r.name")).when((F.col("_r.name") == "") & (F.col("member") != ""), F.col("member"))
        rows = rows.withColumn("_inner", F.concat(inside, F.lit("."), "wanted")).withColumn("_outer", F.when((F.col("_r.name") == "") & (F.col("member") != ""), F.col("wanted")))
        for c in ("_inner", "_outer"):
            own = self.named.select(F.col("file").alias("_path"), F.col("name").alias(c), F.col("ref").alias(f"{c}_ref"))
            rows = rows.join(own, ["_path", c], "left")
        plain = F.concat("base", F.lit("::"), "wanted")
        return rows.withColumn("target_ref", F.coalesce("_inner_ref", "_outer_ref", plain)).drop("_r", "_path", "_inner", "_outer", "_inner_ref", "_outer_ref")

    def binds(self, uses: DataFrame, segments: DataFrame) -> DataFrame:
        """All binds: of bare names and of dotted ones."""
        return self.bare(uses).unionByName(self.dotted(uses, segments))


def best_use(uses: DataFrame) -> DataFrame:
    """One use for each span: one with a prefix before one in a scope before any other; of equals the first."""
    return first_by(uses, ["file", "start", "end"], F.desc(F.col("n_prefix") > 0), F.desc(F.col("scope") != ""), "use_id")


def first_atoms(atoms: DataFrame) -> DataFrame:
    """The atom that begins each scope."""
    return first_by(atoms.where("scope_idx >= 0"), ["file", "scope_idx"], "start", "name")


def atoms_named(refs: DataFrame, atoms: DataFrame) -> DataFrame:
    """ref, found: the atom (ref, start) of that very reference, else of that name in that file, else of that name anywhere; null where there is none."""
    r = parse_reference(F.col("ref"))
    want = refs.select("ref").distinct().withColumn("r", r).select("ref", canonical_path(F.col("r.path")).alias("path"), F.col("r.name").alias("name"))
    a = atoms.select(F.col("ref").alias("found"), "start").withColumn("r", parse_reference(F.col("found"))).select("found", "start", canonical_path(F.col("r.path")).alias("path"), F.col("r.name").alias("name"))
    exact = a.select(F.col("found").alias("ref"), F.col("found").alias("_exact")).distinct()
    near = a.groupBy("path", "name").agg(F.min_by("found", F.struct("found", "start")).alias("_near"))
    far = a.groupBy("name").agg(F.min_by("found", F.struct("found", "start")).alias("_far"))
    both = want.join(exact, "ref", "left").join(near, ["path", "name"], "left").join(far, "name", "left")
    return both.select("ref", F.coalesce("_exact", F.when(F.col("name") != "", F.coalesce("_near", "_far"))).alias("found"))


def navigated(refs: DataFrame, atoms: DataFrame, links: DataFrame, hops: int = 12) -> DataFrame:
    """ref, target, exact: references followed through links (ref, target) until an atom has the reference, at most ``hops`` times; circles end."""
    known = atoms.select(F.col("ref").alias("target"), F.lit(True).alias("_atom")).distinct()
    step = first_by(links.where("ref <> target"), ["ref"], "target").select(F.col("ref").alias("target"), F.col("target").alias("_to"))
    now = refs.select("ref", F.col("ref").alias("target")).distinct().withColumn("seen", F.array("ref"))
    for _ in range(hops):
        met = now.join(known, "target", "left").join(step, "target", "left")
        go = F.col("_atom").isNull() & F.col("_to").isNotNull() & ~F.array_contains("seen", F.coalesce("_to", F.lit("")))
        now = kept(met.select("ref", F.when(go, F.col("_to")).otherwise(F.col("target")).alias("target"), F.when(go, F.array_append("seen", F.col("_to"))).otherwise(F.col("seen")).alias("seen"), go.alias("moved")))
        if now.where("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.join(known, "target", "left").select("ref", "target", F.coalesce("_atom", F.lit(False)).alias("exact"))


def local_deps(binds: DataFrame, atoms: DataFrame, holes: DataFrame, top_only: bool = False) -> DataFrame:
    """file, ref, name: what a hole (file, start, end, ref of what moves) uses of its own file, but itself."""
    own = atoms.select("file", F.col("name"), atom_ref(F.col("file"), F.col("name")).alias("target_ref")).where(F.instr("name", ".") == 0 if top_only else F.lit(True)).distinct()
    h = holes.select("file", F.col("start").alias("_s"), F.col("end").alias("_e"), "ref")
    inside = binds.join(h, "file").where((F.col("start") >= F.col("_s")) & (F.col("end") <= F.col("_e")) & (F.col("target_ref") != F.col("ref")))
    return inside.join(own, ["file", "target_ref"]).select("file", "ref", "name").distinct()


def expected(rows: DataFrame, n: int, what: str = "matches") -> DataFrame:
    """The number of rows as a table ``n``; an error where it differs from what is expected."""
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    wrong = F.raise_error(F.concat(F.lit(f"expected {n} {what}, found "), F.col("n").cast("string"))).cast("long")
    return total.select(F.when(F.col("n") == n, F.col("n")).otherwise(wrong).alias("n"))
