"""One handle on a source tree: it reads the files once, keeps their relations as tables, and answers from those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import atom_ref, file_ref, leaf
from ..model import Store
from ..operators import binding, extract, graph, refactor, spans
from ..storage import kept, unbounded
from . import providers

#: How files of a language see each other.
LANGUAGE_FLAGS = [("go", "package_scoped"), ("java", "package_scoped"), ("java", "empty_dir"), ("java", "nested"), ("kotlin", "package_scoped"), ("kotlin", "nested")]


class Walker:
    """Loads files (file, text); every answer is a DataFrame."""

    def __init__(self, files: DataFrame, go_module: str = ""):
        self.spark: SparkSession = files.sparkSession
        self.files = files.select("file", "text")
        self.store = Store(self.spark)
        tables = extract.relations(kept(extract.extracted(self.files)))
        self.doc, self.paint = tables.pop("doc"), tables.pop("paint")
        for name, rows in tables.items():
            self.store.put(name, rows)
        self._close(go_module)

    def _close(self, go_module: str) -> None:
        s = self.store
        imports = s["import"].withColumn("local", F.when(F.col("local") != "", F.col("local")).otherwise(F.substring_index("spec", "/", -1)))
        s.put("resolved_spec", kept(providers.resolved(imports, s["file"], go_module)))
        specs = s["resolved_spec"]
        named = imports.where("NOT star").join(specs, ["file", "spec", "member"])
        # a member that is a module of its own is that file
        module = F.col("base").rlike(r"\.py$") & (F.col("member") != "") & F.col("base").endswith(F.concat(F.lit("/"), F.col("member"), F.lit(".py")))
        have = s["atom"].select(F.col("file").alias("base"), F.col("name").alias("member"), F.lit(True).alias("_exact")).distinct()
        rows = named.join(have, ["base", "member"], "left")
        whole = (F.col("member") == "") | module
        leafed = s["atom"].select(F.col("file").alias("base"), leaf(F.col("name")).alias("_leaf"), "name").groupBy("base", "_leaf").agg(F.min("name").alias("_named"))
        rows = rows.join(leafed, (rows["base"] == leafed["base"]) & (rows["local"] == leafed["_leaf"]), "left").drop(leafed["base"])
        java = F.col("base").rlike(r"\.(java|kt|scala)$")
        target = F.when(java & F.col("_named").isNotNull(), atom_ref(F.col("base"), F.col("_named"))).when(whole, file_ref(F.col("base"))).otherwise(atom_ref(F.col("base"), F.col("member")))
        s.put("import_target", kept(rows.select("file", "local", target.alias("target"), F.when(whole, "").otherwise(F.col("member")).alias("member"), F.col("has_alias").alias("alias"), F.col("start").alias("seq"))))
        s.put("star_base", unbounded(imports.where("star").join(specs, ["file", "spec", "member"]).select("file", file_ref(F.col("base")).alias("base"), F.col("start").alias("seq"))))
        s.put("visible", kept(graph.visible(s["scope"], s["declares"].drop("seq")).withColumnRenamed("depth", "seq")))
        flags = self.spark.createDataFrame(LANGUAGE_FLAGS, "lang string, flag string")
        self.facts = binding.facts(s["file"], flags)
        ladder = binding.Ladder(self.facts, s["import_target"], s["atom"], s["visible"], s["declares"], s["atom_in_file"], s["star_base"])
        s.put("binds", kept(ladder.binds(binding.best_use(s["use"]), s["use_seg"])))

    def atoms(self, below: str = "", recursive: bool = True, hidden: bool = True) -> DataFrame:
        return graph.listed(self.store["atom"], below, recursive, hidden)

    def outline(self) -> DataFrame:
        """Named scopes and atoms of each file in the order of reading."""
        own = self.store["atom"].join(self.store["scope"].select("file", F.col("idx").alias("scope_idx"), F.col("start").alias("_s"), F.col("end").alias("_e")), ["file", "scope_idx"], "left")
        first = binding.first_atoms(self.store["atom"]).select("file", "scope_idx", F.col("name").alias("_first"))
        own = own.join(first, ["file", "scope_idx"], "left")
        whole = F.col("name") == F.col("_first")
        return graph.outline(own.select("file", "name", F.lit("atom").alias("kind"), F.when(whole, F.col("_s")).otherwise(F.col("start")).alias("start"), F.when(whole, F.col("_e")).otherwise(F.col("end")).alias("end")))

    def definition_at(self, points: DataFrame) -> DataFrame:
        """file, at, ref, target: the smallest use or declaration around each byte and where it is declared."""
        uses = self.store["binds"].select("file", "start", "end", F.col("target_ref").alias("ref"))
        own = self.store["atom"].select("file", "start", "end", atom_ref(F.col("file"), F.col("name")).alias("ref"))
        hits = uses.unionByName(own).groupBy("file", "start", "end").agg(F.min("ref").alias("idx"))
        found = spans.innermost_cover(points.select("file", F.col("at").alias("start"), (F.col("at") + 1).alias("end")), hits).select("file", F.col("start").alias("at"), F.col("cover").alias("ref")).where("ref IS NOT NULL")
        refs = binding.navigated(found.select("ref"), self.store["atom_in_file"], self.links())
        return found.join(unbounded(refs.select("ref", "target")), "ref").select("file", "at", "ref", "target")

    def links(self) -> DataFrame:
        """ref, target: names that stand for others, as imports of them do."""
        t = self.store["import_target"]
        return t.select(atom_ref(F.col("file"), F.col("local")).alias("ref"), "target").where("ref <> target").distinct()

    def dead_imports(self) -> tuple[DataFrame, DataFrame]:
        return graph.dead_imports(self.store["import"], self.store["use"].where("n_prefix = 0"), self.store["use_seg"])

    def rename(self, goals: DataFrame) -> DataFrame:
        """Edits for goals (ref, new_text)."""
        alias = self.store["import"].where("NOT star AND tend > tstart").join(self.store["import_target"].select("file", "local", "target").distinct(), ["file", "local"])
        alias = alias.select(file_ref(F.col("file")).alias("ref"), F.col("tstart").alias("start"), F.col("tend").alias("end"), "target", "spec", "pstart", "pend")
        return graph.rename_edits(goals, self.store["atom"], self.store["binds"], unbounded(alias))

    def applied(self, edits: DataFrame, moves: DataFrame | None = None) -> DataFrame:
        return refactor.applied_plan(self.files, edits, moves)

    def dropped(self, file: str) -> Walker:
        """Forget a file."""
        self.store.drop_file(file)
        return self
