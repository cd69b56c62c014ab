"""What passes the driver and what a task holds must not grow with the tables."""

from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan import batches, queries, queries_graph, storage
from loomspan.plans.walker import Walker
from loomspan.sources import trees

WALKED = (("resolve_python_modules", 154), ("dead_imports_of_modules", 22), ("deps_in_a_hole", 22), ("definition_at_byte", 22), ("outline_of_modules", 66), ("rename_across_modules", 23), ("rename_applied", 23))


def initial_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def broadcasts(plan):
    """Broadcast joins of a plan, but those with the flags of languages."""
    return [x for x in plan.split("\n") if "BroadcastHashJoin" in x and "BroadcastHashJoin [lang#" not in x]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sizes"))
    spark.range(22).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{at}/supplier.parquet")
    spark.range(44).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(f"{at}/part.parquet")
    return at


def test_facts_and_nodes_are_not_broadcast_by_the_size_of_their_files(spark, folder, monkeypatch):
    """Compressed files and a few sources looked small, so their rows all passed the driver."""
    threshold, plans, write, walked = "spark.sql.autoBroadcastJoinThreshold", {}, storage.staged, []

    def walker(files):
        if not walked:  # one for all queries
            walked.append(Walker(files))
        return walked[0]

    monkeypatch.setattr(storage, "staged", lambda df, *more: plans.setdefault(f"table {len(plans)}", initial_plan(df)) and write(df, *more))
    monkeypatch.setattr(queries_graph, "Walker", walker)
    spark.conf.set(threshold, "64k")  # as small beside the sizes guessed for joins as 10 MB is on large tables
    try:
        for name, n in (*WALKED, ("syntax_faults", 12), ("matches_widened_to_calls", 17)):
            out = queries.QUERIES[name](spark, folder)
            plans[name] = initial_plan(out)
            assert out.count() == n, name
    finally:
        spark.conf.unset(threshold)
    assert len(plans) > 12 and not {k: x for k, p in plans.items() if (x := broadcasts(p))}


def test_batches_are_cut_by_rows_and_bytes():
    one = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["k"])
    assert [b.num_rows for b in batches.slices([one])] == [256, 256, 256, 232]
    wide = pa.RecordBatch.from_arrays([pa.array(["x" * 100_000] * 50)], ["text"])
    cut = list(batches.slices([wide, wide.slice(0, 0)]))
    assert max(b.num_rows for b in cut) == 10 and sum(b.num_rows for b in cut) == 50


def test_a_task_holds_few_rows_at_a_time(spark):
    """Patterns, matchers and nodes made Python objects of ten thousand files at once."""
    def sizes(parts):
        for b in parts:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    seen = [r.n for r in batches.mapped(spark.range(0, 1500, 1, 1), sizes, "n long").collect()]
    assert sum(seen) == 1500 and max(seen) <= batches.ROWS
    engine = [p for d in ("operators", "plans", "streaming") for p in Path(batches.__file__).parent.glob(f"{d}/*.py")]
    assert not [p.name for p in [*engine, Path(trees.__file__)] if ".mapInArrow(" in p.read_text()]


def test_leaves_are_told_by_one_pass_over_the_nodes(spark):
    """tape_of_leaves: files were parsed twice, once for the nodes that are parents."""
    own = spark.createDataFrame([("a", "class A { int f() { return g(1"), ("b", ""), ("c", ") int x = 1;")], "file string, text string")
    found = trees.leaves(trees.nodes(own, "java"), own)
    assert initial_plan(found).count("MapInArrow") == 1
    assert [(r.file, r.text) for r in found.orderBy("file", "pos").collect()] == [("a", x) for x in "class A { int f ( ) { return g ( 1".split()] + [("c", x) for x in ") int x = 1 ;".split()]


def test_pairs_are_scored_without_moving_their_features(spark, tmp_path):
    """jaccard_pairs: each feature of each unit was written, and shuffled four times, a row each."""
    turns = [("c", 0, "one two two"), ("c", 1, "one two"), ("c", 2, ""), ("c", 3, None), ("d", 0, "x y x y"), ("d", 1, "y x y x"), ("d", 3, "x")]
    spark.createDataFrame(turns, "conv_id string, turn int, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.jaccard_pairs(spark, str(tmp_path))
    assert "feature" not in initial_plan(out) and not broadcasts(initial_plan(out))
    got = {r.a: (r.b, r.jaccard, r.weighted) for r in out.collect()}
    assert got == {"c/0": ("c/1", 0.6, 0.5), "c/1": ("c/2", 0.0, 0.0), "c/2": ("c/3", 1.0, 1.0), "d/0": ("d/1", 1.0, 0.8)}


LINES = [(1, 1, 5.0, "A"), (1, 1, 5.0, "R"), (1, 2, 3.0, "N"), (1, 2, 3.0, "N"), (2, 1, 4.0, "A"), (2, 1, 4.0, "N"), (2, 3, None, "N"), (2, 3, None, "A"), (3, 1, 1.0, None), (None, 1, 2.0, "R"), (None, 1, 2.0, "N"), (4, 1, 9.0, "R"), (4, 1, 8.0, "N")]
ATTACHED = {(1, 1, 1, "path:x::1"), (1, None, 2, "path:x::2"), (2, 1, 1, ""), (2, 3, 3, ""), (2, None, 3, "path:x::3"), (None, 1, 1, ""), (None, None, 1, "path:x::1"), (4, 1, 1, "path:x::1"), (4, None, 1, "path:x::1")}


@pytest.mark.parametrize("most", [1 << 18, 2])
def test_targets_meet_their_cells_after_one_shuffle(spark, tmp_path, monkeypatch, most):
    """tape_attached_targets: six joins and groupings on parts that Spark sized by their compressed bytes, cells broadcast where files are small."""
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(storage, "PART_ROWS", most, raising=False)
    out = queries.QUERIES["tape_attached_targets"](spark, str(tmp_path))
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == ATTACHED
    plan = initial_plan(out)
    shuffles = [x for x in plan.split("== Initial Plan ==")[-1].split("\n") if " Exchange " in x]
    assert len(shuffles) == 2 and all("REPARTITION_BY_NUM" in x for x in shuffles) and not broadcasts(plan)  # two of one kind are made once


def test_parts_hold_few_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "PART_ROWS", 100)
    parts = storage.dealt(spark.range(5000), 5000, "id").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 51 and max(r["count"] for r in parts) < 200
