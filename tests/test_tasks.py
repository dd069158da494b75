"""Shared steps deal their rows to as many tasks as the rows ask for, so that a task's memory doesn't grow with the tables."""

from pyspark.sql import functions as F

from quilt.functions import signature, storage
from quilt.operators.traversal import Graph
from quilt.plans import registry
from quilt.sources import relational

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_line_items(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert relational.tasks(spark, SF) == 8 and relational.tasks(spark, SF, 100) == -(-rows // 100)


def dealt(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_distinct_edges_neighbours_and_merges_are_dealt_by_number(spark):
    e = relational.edges(spark, SF)
    assert dealt(e).count("REPARTITION_BY_NUM") == 2
    v = relational.vertices(spark, SF).withColumn("part", F.lit(0))
    near = Graph(v, relational.edges(spark, SF, distinct=False), 9).neighbours("Part", v.where("label = 'Supplier'").select("id"))
    assert "hashpartitioning(u" in dealt(near) and ", 9), REPARTITION_BY_NUM" in dealt(near)
    want = relational.edges(spark, SF, ("Part", "Supplier")).select(F.col("dst").alias("v"), F.col("src").alias("u"))
    got = near.select("v", "u")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    rows = spark.createDataFrame([(1, [2, 3]), (1, [2, 3]), (1, [3]), (2, []), (3, None)], "g int, s array<int>")
    merged = signature.merge_all(rows, ["g"], "s", 7)
    assert ", 7), REPARTITION_BY_NUM" in dealt(merged)
    assert {r.g: [tuple(x) for x in r.counts] for r in merged.collect()} == {1: [(2, 2), (3, 3)], 2: [], 3: []}


def test_adjacency_lists_are_shuffled_as_numbers(spark):
    """Edges go once to either end, with no exchange that makes them distinct before, and without strings."""
    plan = registry._adjacency_text(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and "collect_set" in plan


def test_adjacency_lists_are_stored_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry.stored_graph, "shared_folder", lambda spark, name: str(tmp_path / name))
    registry.QUERIES["json_neighbourhoods_whole"](spark, SF)
    files = [p for p in (tmp_path / "json").iterdir() if p.name.startswith("part-")]
    assert files and all(p.suffix == ".gz" for p in files)


def test_levels_compare_vertices_not_edges(spark, monkeypatch):
    """What a level reaches is written before it is compared with the vertices and earlier levels, which else are joined with every edge."""
    plans, real = [], storage.materialise
    monkeypatch.setattr(storage, "materialise", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    v = relational.vertices(spark, SF)
    relational.bfs_order(v, relational.edges(spark, SF, distinct=False), v.where("label = 'Region'").select("id"))
    assert any("Join Inner" in p for p in plans) and any("LeftAnti" in p for p in plans)
    assert not any("Join Inner" in p and ("LeftAnti" in p or "LeftSemi" in p) for p in plans)
