"""Sources, traversals, trie and workloads."""

import json

import pytest
from pyspark.sql import functions as F

from quilt.operators import trie
from quilt.operators.partitioners import round_robin
from quilt.operators.traversal import Graph, run
from quilt.plans import workload as W
from quilt.sources import adjacency, relational


@pytest.fixture(scope="module")
def demo(spark):
    v, e = relational.literal_graph(spark, [(1, "Entity", 1), (2, "Entity", 2), (3, "Activity", 2), (4, "Agent", 1), (5, "Activity", 2)], [(1, 2), (1, 3), (3, 2), (3, 4), (2, 5)])
    return Graph(v, e)


def write(tmp_path, value):
    path = tmp_path / "g.json"
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


GOOD = [
    {"id": 1, "label": "ENTITY", "in": [{"rel": "USED", "id": 2}, {"rel": "USED", "id": 2}], "out": []},
    {"id": 2, "label": "ACTIVITY", "in": [], "out": [{"rel": "USED", "id": 1}]},
    {"id": 3, "label": "AGENT", "out": [{"rel": "WASASSOCIATEDWITH", "id": 2}, None, {"rel": "USED", "id": 1}]},
]


def test_json(spark, tmp_path):
    n = adjacency.read_neighbourhoods(spark, write(tmp_path, GOOD), "provenance")
    got = {r.id: r for r in n.collect()}
    assert got[1].label == "Entity" and [tuple(x) for x in got[1]["in"]] == [(2, "Activity")] and got[1].out == []
    assert [tuple(x) for x in got[3].out] == [(2, "Agent")]  # a null ends the list
    assert {(r.src, r.dst) for r in adjacency.to_edges(n).collect()} == {(2, 1), (3, 2)}
    assert {(r.id, r.label) for r in adjacency.to_vertices(n).collect()} == {(1, "Entity"), (2, "Activity"), (3, "Agent")}


def test_json_lines_of_many_files(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for i, part in enumerate((GOOD[:1], GOOD[1:])):
        (folder / f"part-{i}.txt").write_text("".join(json.dumps(x) + "\n" for x in part))
    want = adjacency.read_neighbourhoods(spark, write(tmp_path, GOOD), "provenance")
    assert sorted(map(repr, adjacency.read_neighbourhoods(spark, str(folder), "provenance", lines=True).collect())) == sorted(map(repr, want.collect()))


@pytest.mark.parametrize(
    "bad",
    [
        [{"id": "x", "label": "ENTITY"}],
        [{"label": "ENTITY"}],
        [{"id": 1}],
        [{"id": 1, "label": "NOBODY"}],
        [{"id": 1, "label": "ENTITY", "in": [{"rel": "NOTHING", "id": 2}]}],
        [{"id": 1, "label": "ENTITY", "in": [{"id": 2}]}],
        [{"id": 2**40, "label": "ENTITY"}],
        '[{"id": 1, "label": "ENTITY"',
    ],
)
def test_json_errors(spark, tmp_path, bad):
    with pytest.raises(Exception):  # noqa: B017
        adjacency.read_neighbourhoods(spark, write(tmp_path, bad), "provenance").collect()


def test_music_labels(spark, tmp_path):
    n = adjacency.read_neighbourhoods(spark, write(tmp_path, [{"id": 1, "label": "", "in": [{"rel": "", "id": 2}], "out": [{"rel": "Track", "id": 3}]}]), "music")
    r = n.first()
    assert (r.label, r["in"][0].label, r.out[0].label) == ("Other", "Other", "Track")
    assert len(adjacency.vertex_labels("music")) == 19


def test_demo_queries(demo):
    t, hops = run(demo.get_all("Entity"), lambda t: t.neighbours("Entity"))
    assert sorted(tuple(r) for r in t.paths().collect()) == [(1, 2), (2, 1)]
    assert [tuple(r) for r in hops.orderBy("hop").collect()] == [(0, 2, 0), (1, 2, 2)]
    start, steps = W.QUERIES["demo"]["q2"]
    assert sorted(tuple(r) for r in run(start(demo), *steps)[0].paths().collect()) == [(3, 1), (3, 2)]


def test_options_count_before_the_lookup(demo):
    t = demo.get(1).optional(F.lit(5))
    assert [(r.v0, r.v1, r.ipt_1) for r in t.rows.collect()] == [(1, None, 1)]
    assert [r.v1 for r in demo.get(2).optional(F.lit(1), "in").rows.collect()] == [1]
    assert [r.v1 for r in demo.get(2).optional(F.lit(1), "out").rows.collect()] == [None]


def test_missing_partitions_differ(spark):
    v, e = relational.literal_graph(spark, [(1, "a", None), (2, "b", 0), (3, "b", None)], [(1, 2), (1, 3)])
    got = Graph(v, e).get_all("a").neighbours("b").rows.select("v1", "ipt_1")
    assert {tuple(r) for r in got.collect()} == {(2, 1), (3, 0)}


def test_orders(demo):
    levels = relational.bfs_order(demo.vertices, demo.edges, demo.point(4).select("id"))
    assert {(r.id, r.level) for r in levels.collect()} == {(4, 0), (3, 1), (1, 2), (2, 2), (5, 3)}
    assert relational.dfs_order([(1, 2), (1, 3), (3, 4)], [1]) == [1, 2, 3, 4]


CODES = {"Agent": 5, "Activity": 9, "Entity": 12}


@pytest.fixture(scope="module")
def small_trie(spark):
    subsets, growth = trie.subgraphs(W.patterns(spark, W.PATTERNS["provenance"], CODES), 13)
    return subsets, growth


def adds(spark, **n):
    return spark.createDataFrame(list(n.items()), "query string, n long")


def test_support(spark, small_trie):
    subsets, growth = small_trie
    a = adds(spark, q3=5)
    nodes = trie.nodes(subsets, a)
    assert [r.support for r in nodes.collect()] == [5]
    mix = adds(spark, q1=16, q2=2, q3=22)
    nodes, edges = trie.nodes(subsets, mix), trie.edges(growth, mix)
    support = {(r.depth, tuple(r.sig)): r.support for r in nodes.collect()}
    for r in edges.where("depth > 0").collect():  # support never grows with depth
        assert support[(r.depth + 1, tuple(r.child_sig))] <= support[(r.depth, tuple(r.parent_sig))]
    assert trie.total(mix).first().total == 40
    frequent = trie.motifs(nodes, edges, 40, 0.6).collect()
    assert [(r.depth, r.support) for r in frequent] == [(1, 24)]  # Agent-Activity, on the inclusive bound
    first = edges.where("depth = 0").first()
    assert trie.with_factors(nodes, edges, [list(first.factor)]).count() == 1
    assert trie.with_factors(nodes, edges, [[13, 13, 13]]).count() == 0
    assert trie.leaves(nodes, edges).agg(F.max("depth")).first()[0] == 5
    assert trie.lookup(nodes, list(first.child_sig)).count() == 1
    assert trie.graph_of(nodes.where("depth = 2")).count() == 2 * nodes.where("depth = 2").count()
    assert trie.motifs(nodes, edges, 0, 0.6).count() == 0


def test_streams():
    s = W.fixed_stream(W.MIX, set(W.MIX))
    drawn = [next(s) for _ in range(40)]
    assert [drawn.count(q) for q in ("q1", "q2", "q3")] == [16, 2, 22]
    with pytest.raises(ValueError):
        next(W.fixed_stream({"q9": 1.0}, {"q1"}))
    with pytest.raises(ValueError):
        next(W.fixed_stream({"q1": 0.5}, {"q1"}))
    p = W.periodic_stream(["q1", "q2", "q3"])
    assert {next(p) for _ in range(60)} == {"q1", "q2", "q3"}


def test_experiment(demo):
    got = {r["query"]: r for r in W.experiment(demo, "demo", iter(["q1", "q2", "q1"]), 3).collect()}
    assert got["q1"].draws == 2 and got["q1"].ipt == 4
    total = W.result_sum(W.experiment(demo, "demo", iter(["q1"]), 1)).first()
    assert total.ipt == 2
    assert "partition sizes" in W.report(demo, "demo")


def test_experiments_over_orders_and_partitioners(demo):
    orders = {"id": lambda v, e: relational.sequence(v, "id"), "random": lambda v, e: relational.random_order(v, 3, "id")}
    partitioners = {"robin": lambda v, e: round_robin(v, 2), "none": lambda v, e: v.where("false").selectExpr("id", "0 AS part")}
    got = W.experiments(demo.vertices, demo.edges, "demo", orders, partitioners, lambda: iter(["q1", "q2", "q1"]), 3).collect()
    assert len(got) == 8 and {(r.arrival, r.partitioner) for r in got} == {(a, p) for a in orders for p in partitioners}
    assert all(r.ipt == 0 for r in got if r.partitioner == "none")  # vertices without partition equal one another
    assert {r.draws for r in got if r["query"] == "q1"} == {2}


def test_bfs_of_a_deep_graph(spark):
    v, e = relational.literal_graph(spark, [(i, "A", 0) for i in range(72)], [(i, i + 1) for i in range(70)] + [(3, 3)])
    levels = {r.id: r.level for r in relational.bfs_order(v, e, v.where("id = 0").select("id")).collect()}
    assert levels == {i: i for i in range(71)} | {71: 2**31 - 1}


def test_run_agrees_with_single_steps(demo):
    for q in W.QUERIES["demo"].values():
        start, steps = q
        last, hops = run(start(demo), *steps)
        plain = start(demo)
        for s in steps:
            plain = s(plain)
        assert sorted(last.paths().collect()) == sorted(plain.paths().collect())
        assert hops.count() == plain.step + 1


def test_labelled_edges_lead_to_the_same_neighbours(demo):
    names = demo.vertices.select("id", "label")
    e = demo.edges.select("src", "dst").join(names.toDF("src", "src_label"), "src").join(names.toDF("dst", "dst_label"), "dst")
    for label in ("Entity", "Agent", "Activity"):
        assert sorted(Graph(demo.vertices, e).neighbours(label).collect()) == sorted(demo.neighbours(label).collect())


def test_partitioned_sink(demo, tmp_path, spark):
    adjacency.write_partitions(demo.vertices, f"{tmp_path}/v")
    assert spark.read.parquet(f"{tmp_path}/v").where("part = 2").count() == 3
