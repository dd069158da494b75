"""Motifs of a workload in a table, sessions, and depth-first order, against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quilt.functions import scalars
from quilt.operators import trie
from quilt.sources import relational

PATTERN = "query long, e long, src long, src_code int, dst long, dst_code int"


def random_patterns(seed, n):
    """Trees, paths and cycles with few codes, so that different subsets share signatures."""
    r, rows = random.Random(seed), []
    for q in range(n):
        size = r.randint(2, 5)
        codes = [r.choice([1, 2, 3, 5]) for _ in range(size)]
        pairs = {(r.randrange(i), i) for i in range(1, size)}
        if r.random() < 0.4 and size > 2:
            pairs.add((0, size - 1))
        rows += [(q, i, a, codes[a], b, codes[b]) for i, (a, b) in enumerate(sorted(pairs))]
    return rows


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.15), (2, 0.4)])
def test_frequent_equals_the_whole_trie(spark, seed, threshold):
    patterns = spark.createDataFrame(random_patterns(seed, 14), PATTERN)
    adds = spark.createDataFrame([(q, (q * 7 + seed) % 4) for q in range(14)], "query long, n int")
    n = adds.agg(F.sum("n")).first()[0]
    ints = patterns.select("query", F.col("e").cast("int"), F.col("src").cast("int"), "src_code", F.col("dst").cast("int"), "dst_code")
    subsets, growth = trie.subgraphs(ints, 13)
    nodes, edges = trie.nodes(subsets, adds.where("n > 0")), trie.edges(growth, adds)
    want = trie.motifs(nodes, edges, n, threshold).select("depth", "sig", "support", F.col("repr.query").alias("query"))
    got, grown = trie.frequent(patterns, adds, 13, n, threshold)
    want = sorted(map(repr, want.collect()))
    # nothing is in two fifths of the second workload
    assert bool(want) == (seed == 1)
    assert sorted(map(repr, got.select("depth", "sig", "support", F.col("repr.query").alias("query")).collect())) == want
    kept = {(r.depth, tuple(r.sig)) for r in got.collect()} | {(0, ())}
    links = {(r.depth, tuple(r.parent_sig), tuple(r.child_sig)) for r in edges.collect()}
    links = {x for x in links if (x[0], x[1]) in kept and (x[0] + 1, x[2]) in kept}
    assert {(r.depth, tuple(r.parent_sig), tuple(r.child_sig)) for r in grown.collect()} == links


def test_frequent_of_nothing(spark):
    none = spark.createDataFrame([], PATTERN)
    adds = spark.createDataFrame([], "query long, n int")
    for n in (0, 3):
        nodes, edges = trie.frequent(none, adds, 13, n, 0.5)
        assert nodes.count() == edges.count() == 0


def test_sessions_cross_stretches_and_skip_nulls(spark):
    r = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=r.choice([0, 30, 50, 61, 200]) * r.randint(0, 40)), r.choice([1, 2, 2, 2]), r.choice(list(relational.EVENT_CODES))) for i in range(150)]
    extra = [(1000, None, 1, "view"), (1001, start, None, "view"), (1002, start, 1, "other"), (1003, start, 1, None)]
    events = spark.createDataFrame(rows + extra, "event_id long, ts timestamp, user_id long, event_type string")
    want = set()
    for user in (1, 2):
        mine, query = sorted((ts, i) for i, ts, u, _ in rows if u == user), None
        for k, (ts, i) in enumerate(mine):
            if k and (ts - mine[k - 1][0]).total_seconds() <= 60:
                want.add((query, mine[k - 1][1], i))
            else:
                query = i
    got = relational.sessions(events, 60).collect()
    assert len(got) == len(want)
    assert {(x.query, x.src, x.dst) for x in got} == want
    assert all(x.e == x.dst and x.src_code == relational.EVENT_CODES[rows[x.src][3]] for x in got)


def test_alike_sessions_are_one_pattern(spark):
    """Supports are those of all sessions; long ones and those that share an id are kept as they are."""
    r = random.Random(4)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=100 * (i // 4) + i % 4), i // 4 % 5, r.choice(["view", "click"])) for i in range(160)]
    rows += [(500 + i, start + dt.timedelta(seconds=i), 9, "view") for i in range(7)]
    # two sessions with the ids of one, so that their steps are no path
    rows += [(600 + i, start + dt.timedelta(days=day, seconds=i), 10 + day, "click") for day in (1, 2) for i in range(3)]
    steps = relational.sessions(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string"), 60)
    paths, adds = relational.alike(steps, 5)
    n = {x.query: x.n for x in adds.collect()}
    assert sum(n.values()) == 42 and len(n) <= 16 + 2 and n[500] == n[600] == 1
    assert paths.where("query = 500").count() == 6 and paths.where("query = 600").count() == 4 and paths.count() < steps.count()
    all_adds = steps.select("query").distinct().withColumn("n", F.lit(1))
    want, got = trie.frequent(steps, all_adds, 13, 42, 0.1), trie.frequent(paths, adds, 13, 42, 0.1)
    for one, other, columns in zip(want, got, (["depth", "sig", "support"], ["depth", "parent_sig", "factor", "child_sig"]), strict=True):
        rows_of = lambda df: sorted(map(repr, df.select(*columns).distinct().collect()))  # noqa: B023, E731
        assert rows_of(one) == rows_of(other) != []


def forest(seed, n):
    r = random.Random(seed)
    names = r.sample(range(1, 500), n)
    edges = [(names[r.randrange(max(0, i - 6), i)], names[i]) for i in range(1, n) if r.random() < 0.9]
    return names, [x if r.random() < 0.5 else x[::-1] for x in edges]


def test_depth_first_equals_the_stack(spark):
    names, edges = forest(5, 24)
    hub = [(900, x) for x in range(895, 908) if x != 900]
    chain = [(x, x + 1) for x in range(600, 612)]
    edges = edges + hub + chain
    roots = [names[0], names[3], names[9], 700, 905, 604, 609, 604]
    e = spark.createDataFrame(edges + edges[:3] + [(names[0], names[0])], "src int, dst int")
    got = relational.depth_first(e, spark.createDataFrame([(x,) for x in roots], "id int")).orderBy("seq").collect()
    assert [r.id for r in got] == relational.dfs_order(edges, roots)
    assert [r.seq for r in got] == list(range(len(got)))


def test_leaves_go_before_the_tour(spark):
    """A tree of few levels is raked whole; what a leaf took with it counts, and siblings' sizes are summed by id."""
    edges = [(1, x) for x in range(10, 14)] + [(10, x) for x in range(20, 29)] + [(12, 5), (30, 31)]
    pair = spark.createDataFrame([tuple(sorted(x)) for x in edges], "a int, b int")
    left, layers, sums = relational.rake(pair, spark.createDataFrame([(1,)], "id int"))
    assert left.isEmpty() and [x.count() for x in layers] == [14, 2]
    assert {x.id: x["size"] for x in layers[1].collect()} == {10: 10, 12: 2}
    assert {x.id: x["size"] for x in sums.collect()}[1] == 14
    children = layers[0].withColumn("layer", F.lit(1)).union(layers[1].withColumn("layer", F.lit(2)))
    before = {(x.parent, x.id): x.before for x in relational.lesser_siblings(children).collect()}
    assert [before[1, x] for x in range(10, 14)] == [0, 10, 11, 13] and before[10, 28] == 8 and len(before) == 16


def test_spanning_forest_is_the_least(spark):
    r = random.Random(8)
    edges = sorted({tuple(sorted(r.sample(range(14), 2))) for _ in range(24)})
    boss, want = {v: v for v in range(14)}, []

    def top(v):
        while boss[v] != v:
            v = boss[v]
        return v

    for a, b in edges:
        if top(a) != top(b):
            boss[top(a)] = top(b)
            want.append((a, b))
    got = relational.spanning_forest(spark.createDataFrame([x[::-1] for x in edges], "src int, dst int"))[0].collect()
    assert sorted((x.a, x.b) for x in got) == want


def test_depth_first_of_a_graph_is_that_of_its_tree(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 2)]
    e = spark.createDataFrame(edges, "src int, dst int")
    tree = [(x.a, x.b) for x in relational.spanning_forest(e)[0].collect()]
    got = relational.depth_first(e, spark.createDataFrame([(4,)], "id int")).orderBy("seq").collect()
    assert [r.id for r in got] == relational.dfs_order(tree, [4])
    assert relational.spanning_forest(e.where("false"))[0].count() == 0


def test_time_now(spark):
    import time

    before = time.time_ns() // 1_000_000
    got = spark.range(2).select(scalars.time_now().alias("t")).collect()
    assert before - 1 <= got[0].t == got[1].t <= time.time_ns() // 1_000_000
