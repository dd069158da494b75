"""A property graph over the relational tables, literal graphs, arrival orders, and dense sequence numbers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Id offset of each label's keys, and label codes modulo 13.
OFFSETS = {"Region": 0, "Nation": 100, "Supplier": 1_000, "Part": 100_000, "Customer": 1_000_000, "Order": 10_000_000}
CODES = {"Region": 5, "Nation": 9, "Supplier": 12, "Part": 3, "Customer": 7, "Order": 1}
PRIME = 13
#: Links between labels: source and its key, target and its key, table, and whether the table repeats pairs.
LINKS = [
    ("Nation", "n_nationkey", "Region", "n_regionkey", "nation", False),
    ("Supplier", "s_suppkey", "Nation", "s_nationkey", "supplier", False),
    ("Customer", "c_custkey", "Nation", "c_nationkey", "customer", False),
    ("Order", "o_orderkey", "Customer", "o_custkey", "orders", False),
    ("Order", "l_orderkey", "Part", "l_partkey", "lineitem", True),
    ("Part", "l_partkey", "Supplier", "l_suppkey", "lineitem", True),
]


def _id(label: str, column: str) -> Column:
    return (F.col(column) + OFFSETS[label]).cast("int")


def vertices(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(OFFSETS)) -> DataFrame:
    """(id, label) of every key of the chosen labels. A key outside INT is an error.

    Large tables outgrow the offsets, and ids of one label run into those of the next (parts from key 900,000 on into customers). Vertices are
    then told apart by id and label, and an edge reaches every vertex with the id of its end.
    """
    keys = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Customer": ("customer", "c_custkey"), "Order": ("orders", "o_orderkey")}
    parts = [spark.read.parquet(f"{sf_dir}/{t}.parquet").select(_id(label, c).alias("id"), F.lit(label).alias("label")) for label, (t, c) in keys.items() if label in labels]
    return reduce(DataFrame.union, parts)


def edges(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(OFFSETS), distinct: bool = True) -> DataFrame:
    """(src, dst, src_label, dst_label) between the chosen labels, each edge once unless ``distinct`` is false."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    n = tasks(spark, sf_dir) if distinct and "Part" in labels else 0
    parts = []
    for a, ka, b, kb, name, repeat in LINKS:
        if a in labels and b in labels:
            part = t(name).select(_id(a, ka).alias("src"), _id(b, kb).alias("dst"))
            # a foreign key of a primary key is distinct as it is; only line items repeat pairs
            part = part.repartition(n, "src", "dst").distinct() if repeat and distinct else part
            parts.append(part.select("src", "dst", F.lit(a).alias("src_label"), F.lit(b).alias("dst_label")))
    return reduce(DataFrame.union, parts)


def link() -> Column:
    """The place in LINKS of edges with labels."""
    return F.coalesce(*[F.when((F.col("src_label") == a) & (F.col("dst_label") == b), i) for i, (a, _, b, *_) in enumerate(LINKS)])


def pairs(spark: SparkSession, sf_dir: str, labels: tuple[str, ...] = tuple(OFFSETS), directed: bool = True) -> DataFrame:
    """(src, dst, n): each pair of ids once, however many labels' edges join it, with their number; undirected, src <= dst."""
    e, swap = edges(spark, sf_dir, labels, distinct=False), F.col("src") > F.col("dst")
    bit = F.coalesce(*[F.when((F.col("src_label") == a) & (F.col("dst_label") == b), 1 << i) for i, (a, _, b, *_) in enumerate(LINKS)])
    if not directed:
        bit = F.when(swap, bit * (1 << len(LINKS))).otherwise(bit)
        e = e.select(F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("dst"), bit.alias("bit"))
    return e.groupBy("src", "dst").agg(F.bit_count(F.bit_or(F.col("bit") if not directed else bit)).alias("n"))


def tasks(spark: SparkSession, sf_dir: str, rows: int = 250_000) -> int:
    """How many tasks share the line items, the largest table, at so many rows each; its files' footers have the count.

    Adaptive execution joins small partitions by their compressed size, of which a hash table or a sort takes some twenty times as much.
    """
    return max(8, -(-spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // rows))


def event_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the events table: event -> user, and event -> the same user's next event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    event, user = (F.col("event_id") + 100_000_000).cast("int"), _id("Customer", "user_id")
    v = e.select(event.alias("id"), F.col("event_type").alias("label")).union(e.select(user.alias("id"), F.lit("User").alias("label")).distinct())
    following = F.lead(event).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    to_next = e.select(event.alias("src"), following.alias("dst")).where("dst is not null")
    return v, e.select(event.alias("src"), user.alias("dst")).union(to_next)


#: Label codes of event types modulo 13.
EVENT_CODES = {"click": 2, "error": 4, "view": 6, "purchase": 8, "signup": 11}


def sessions(events: DataFrame, gap_seconds: int, codes: dict[str, int] = EVENT_CODES) -> DataFrame:
    """(query, e, src, src_code, dst, dst_code, t): a workload of query patterns, one path of event types for each session of a user.

    A session is a run of a user's events with at most ``gap_seconds`` from each to the next, by (ts, event_id); ``query`` is its first
    event, an edge is named by the event it leads to, and a session of one event has none. Events without a user, a time or a known
    type belong to no session.

    Events are windowed by user and stretch of time as long as the gap, with the last event of the stretch before as a guest, so that a
    user with very many events is many tasks' work; only stretches, bounded by the calendar, are windowed by user.
    """
    gap = gap_seconds * 1_000_000
    code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    # local times are counted from their fields, so that the session's time zone can't stretch them
    local = F.unix_date(F.to_date("ts")) * F.lit(86_400_000_000) + (F.hour("ts") * 3600 + F.minute("ts") * 60) * F.lit(1_000_000).cast("long") + (F.expr("extract(SECOND FROM ts)") * 1_000_000).cast("long")
    t = F.unix_micros("ts") if dict(events.dtypes)["ts"] == "timestamp" else local
    rows = events.select(F.col("user_id").alias("user"), t.alias("t"), F.col("event_id").alias("event"), code[F.col("event_type")].alias("code"))
    rows = rows.where("user is not null and t is not null and event is not null and code is not null").withColumn("stretch", F.expr(f"t div {gap}"))
    last = rows.groupBy("user", "stretch").agg(F.max(F.struct("t", "event", "code")).alias("l"))
    guests = last.select("user", "l.t", "l.event", "l.code", (F.col("stretch") + 1).alias("stretch"), F.lit(True).alias("guest"))
    by_time = Window.partitionBy("user", "stretch").orderBy("t", "event")
    near = rows.withColumn("guest", F.lit(False)).union(guests).withColumn("prev", F.lag(F.struct("t", "event", "code")).over(by_time)).where("not guest")
    starts = F.col("prev").isNull() | (F.col("t") - F.col("prev.t") > gap)
    # null in the run that goes on from the stretch before
    own = F.last(F.when(starts, F.col("event")), ignorenulls=True).over(by_time)
    near = near.withColumn("starts", starts).withColumn("own", own)
    tails = near.groupBy("user", "stretch").agg(F.max_by("own", F.struct("t", "event")).alias("tail"))
    earlier = Window.partitionBy("user").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("user", "stretch", F.last("tail", ignorenulls=True).over(earlier).alias("carried"))
    steps = near.where("not starts").join(carried, ["user", "stretch"], "left")
    return steps.select(F.coalesce("own", "carried").alias("query"), F.col("event").alias("e"), F.col("prev.event").alias("src"), F.col("prev.code").alias("src_code"), F.col("event").alias("dst"), F.col("code").alias("dst_code"), "t")


def alike(steps: DataFrame, longest: int = 64) -> tuple[DataFrame, DataFrame]:
    """(patterns, adds(query, n)) of sessions: one path stands for all with the same codes in the same order, with their number.

    Its steps are numbered, since no sub-pattern's signature depends on which events they are. Sessions of more steps stay as they are, once
    each, so that a session of any length is never one row; so do queries whose steps are no path, as where events share an id.
    """
    from quilt.functions.storage import materialise

    short = steps.join(steps.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") <= longest), "query", "left_semi")
    path = short.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("t", "e", "src", "dst", "src_code", "dst_code"))).alias("x"))
    first, events = F.col("x")[0], F.transform("x", lambda s: s["dst"])
    follows = F.col("events") == F.concat(F.transform(F.slice("x", 2, longest), lambda s: s["src"]), F.slice("events", -1, 1))
    once = F.size(F.array_distinct(F.concat(F.array(first["src"]), "events"))) == F.size("x") + 1
    codes = F.concat(F.array(first["src_code"]), F.transform("x", lambda s: s["dst_code"]))
    path = materialise(path.withColumn("events", events).where(follows & once).select("query", codes.alias("codes")))
    groups = path.groupBy("codes").agg(F.min("query").alias("query"), F.count("*").alias("n"))
    kinds, code = dict(steps.dtypes), lambda i: F.element_at("codes", i)
    numbered = groups.select("query", "codes", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("i"))
    edge = {"e": F.col("i"), "src": F.col("i") - 1, "src_code": code(F.col("i")), "dst": F.col("i"), "dst_code": code(F.col("i") + 1)}
    numbered = numbered.select("query", *[c.cast(kinds[name]).alias(name) for name, c in edge.items()])
    rest = steps.join(path.select("query"), "query", "left_anti").select("query", *edge)
    return numbered.union(rest), groups.select("query", "n").union(rest.select("query").distinct().withColumn("n", F.lit(1).cast("long")))


#: Id offset of brands, the media of the music view.
BRANDS = 90_000


def provenance_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) with provenance labels: orders are activities of customers, the agents, and use parts, the entities.

    A part is derived from the part of the same brand with the next key.
    """
    label = F.create_map(*[F.lit(x) for kv in {"Customer": "Agent", "Order": "Activity", "Part": "Entity"}.items() for x in kv])
    some = ("Customer", "Order", "Part")
    v = vertices(spark, sf_dir, some).select("id", label[F.col("label")].alias("label"))
    known = edges(spark, sf_dir, some).select("src", "dst", label[F.col("src_label")].alias("src_label"), label[F.col("dst_label")].alias("dst_label"))
    following = F.lead("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    derived = spark.read.parquet(f"{sf_dir}/part.parquet").select(_id("Part", "p_partkey").alias("src"), (following + OFFSETS["Part"]).cast("int").alias("dst")).where("dst is not null")
    return v, known.union(derived.select("src", "dst", F.lit("Entity"), F.lit("Entity")))


def music_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) with music labels: nations are areas, customers artists, suppliers labels, orders credits, parts tracks, brands media.

    An artist is with the labels that have supplied the artist's orders.
    """
    names = {"Nation": "Area", "Customer": "Artist", "Supplier": "Label", "Order": "ArtistCredit", "Part": "Track"}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    brand = (F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int") + BRANDS).alias("dst")
    v = vertices(spark, sf_dir, tuple(names)).select("id", label[F.col("label")].alias("label")).union(part.select(brand, F.lit("Medium")).distinct())
    known = edges(spark, sf_dir, tuple(names)).where("dst_label <> 'Supplier'").select("src", "dst", label[F.col("src_label")].alias("src_label"), label[F.col("dst_label")].alias("dst_label"))
    bought = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    supplied = bought.select(_id("Customer", "o_custkey").alias("src"), _id("Supplier", "l_suppkey").alias("dst")).distinct()
    return v, known.union(supplied.select("src", "dst", F.lit("Artist"), F.lit("Label"))).union(part.select(_id("Part", "p_partkey").alias("src"), brand, F.lit("Track"), F.lit("Medium")))


def literal_graph(spark: SparkSession, vertex_rows: list[tuple], edge_rows: list[tuple]) -> tuple[DataFrame, DataFrame]:
    """(vertices(id, label, part), edges(src, dst)) from Python rows."""
    return spark.createDataFrame(vertex_rows, "id int, label string, part int"), spark.createDataFrame(edge_rows, "src int, dst int")


def sequence(df: DataFrame, *order: str, name: str = "seq") -> DataFrame:
    """Dense numbers from 0 in the given order, without sending all rows to one task.

    Rows are range-partitioned and sorted; the counts of the partitions, as many numbers as there are partitions, give each its first one.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = _at_rest(placed)
    counts = {r.p: r.n for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    first = [0]
    for p in range(max(counts, default=0)):
        first.append(first[-1] + counts.get(p, 0))
    start = F.get(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), F.shiftright("_at", 33).cast("int"))
    return placed.withColumn(name, start + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at")


def numbered(v: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Vertices numbered by id; of several that share an id the one whose label stands first in ``labels`` comes first."""
    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return sequence(v.withColumn("_rank", rank), "id", "_rank").drop("_rank")


def random_order(df: DataFrame, seed: int, *key: str) -> DataFrame:
    return sequence(df.withColumn("_h", F.xxhash64(F.lit(seed), *key)), "_h", *key).drop("_h")


def bfs_order(v: DataFrame, e: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level): breadth-first level of every id of ``v`` from ``roots``(id); ids out of reach come last, at level 2^31 - 1.

    Vertices that share an id are one place of the graph. Ends of edges that are no vertices are not walked through.
    """
    return bfs_levels(v, e.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(e.select("dst", "src")), roots)


def bfs_levels(v: DataFrame, both: DataFrame, roots: DataFrame) -> DataFrame:
    """The same over both(a, b), an adjacency with both directions of every edge."""
    from quilt.functions.storage import materialise

    ids = v.select("id").distinct()
    front = materialise(roots.select("id", F.lit(0).alias("level")).distinct())
    seen = last = front
    for level in count(1):
        # a neighbour of a level lies in that level, the one before or the next
        # written before it is compared: the optimiser would compare every edge instead, and shuffle all of them for each comparison
        near = materialise(front.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()).join(ids, "id", "left_semi")
        last, front = front, materialise(near.join(last.union(front), "id", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        seen = seen.union(front)
        if level % 32 == 0:  # keeps the plan short on deep graphs
            seen = materialise(seen)
    return ids.join(seen, "id", "left").select("id", F.coalesce("level", F.lit(2**31 - 1)).alias("level"))


def _at_rest(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: its size is that of its files.

    A checkpoint keeps its plan's estimate, and a join's is the product of its sides', whose digits double with each round of a loop
    until planning is all that a round does.
    """
    from quilt.sources.stored import shared_folder

    path = shared_folder(df.sparkSession, "rounds")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spanning_forest(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(a, b), components(id, comp)): the least spanning forest of the undirected graph, a < b, edges compared by (a, b).

    Each component chooses its least edge to another, components hook along them and chains are halved until all know their root:
    at least half of the components go in a round. Of a forest these are all its edges. Loops are left out, and vertices without other edges.
    """
    pair = e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    # ca and cb are the components of the ends
    left, chosen = _at_rest(pair.withColumns({"ca": F.col("a"), "cb": F.col("b")})), []
    comp = _at_rest(left.select(F.col("a").alias("id")).union(left.select("b")).distinct().select("id", F.col("id").alias("comp")))
    while not left.isEmpty():
        # in the edges' order, so that no cycle can arise but of two that choose the same edge
        side = left.select(F.col("ca").alias("c"), F.struct("a", "b", F.col("cb").alias("to")).alias("x")).union(left.select("cb", F.struct("a", "b", F.col("ca").alias("to"))))
        hook = _at_rest(side.groupBy("c").agg(F.min("x").alias("x")).select("c", "x.a", "x.b", "x.to"))
        chosen.append(hook.select("a", "b").distinct())
        back = hook.select(F.col("c").alias("to"), F.col("to").alias("beyond"))
        up = hook.join(back, "to").select("c", F.when((F.col("beyond") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        while True:
            over = up.select(F.col("c").alias("to"), F.col("to").alias("beyond"))
            further = _at_rest(up.join(over, "to").select("c", F.col("beyond").alias("to"), (F.col("beyond") != F.col("to")).alias("moved")))
            up = further.select("c", "to")
            if further.where("moved").isEmpty():
                break
        root = lambda c: up.select(F.col("c").alias(c), F.col("to").alias(f"{c}_root"))
        left = left.join(root("ca"), "ca").join(root("cb"), "cb").where("ca_root <> cb_root")
        left = _at_rest(left.select("a", "b", F.col("ca_root").alias("ca"), F.col("cb_root").alias("cb")))
        comp = _at_rest(comp.join(root("comp"), "comp", "left").select("id", F.coalesce("comp_root", "comp").alias("comp")))
    return (reduce(DataFrame.union, chosen).distinct() if chosen else left.select("a", "b")), comp


def list_sums(links: DataFrame) -> DataFrame:
    """(k, total): the sum of ``step`` from each element of disjoint lists or trees links(k, next, step) to where next is null.

    Pointers double: logarithmic rounds in the longest way. Elements at their end wait outside of the join.
    """
    at = _at_rest(links.select("k", "next", F.col("step").cast("long").alias("total")))
    while True:
        open_ = at.where("next is not null")
        if open_.isEmpty():
            return at.select("k", "total")
        far = at.select(F.col("k").alias("next"), F.col("next").alias("beyond"), F.col("total").alias("more"))
        moved = open_.join(far, "next").select("k", F.col("beyond").alias("next"), (F.col("total") + F.col("more")).alias("total"))
        at = _at_rest(moved.union(at.where("next is null")))


def rake(pair: DataFrame, roots: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """(edges left, layers(id, parent, size), sums(id, size)) of a graph of pairs(a, b): vertices with one neighbour, its children, go layer by
    layer while these are an eighth of those left, so that the rounds are logarithmic. Roots stay.

    size is that of the subtree that went with a vertex; sums are those of the children that went, by parent. Two that only have each other go
    both: there is no root in their component.
    """
    left, layers, sums = pair, [], None
    while True:
        ends = left.select(F.col("a").alias("id"), F.col("b").alias("to")).union(left.select("b", "a"))
        degree = ends.groupBy("id").agg(F.count("*").alias("n"), F.max("to").alias("parent"))
        degree = _at_rest(degree.join(roots.withColumn("stays", F.lit(True)), "id", "left").withColumn("goes", (F.col("n") == 1) & F.col("stays").isNull()))
        counts = degree.agg(F.count("*").alias("n"), F.count_if("goes").alias("goes")).first()
        if not counts.goes or counts.goes * 8 < counts.n:
            return left, layers, sums
        layer = degree.where("goes").select("id", "parent")
        size = F.lit(1).cast("long") if sums is None else 1 + F.coalesce("size", F.lit(0))
        layer = _at_rest((layer if sums is None else layer.join(sums, "id", "left")).select("id", "parent", size.alias("size")))
        layers.append(layer)
        more = layer.select(F.col("parent").alias("id"), "size")
        sums = _at_rest((more if sums is None else more.union(sums)).groupBy("id").agg(F.sum("size").alias("size")))
        stay = degree.where("not goes").select("id")
        left = _at_rest(left.join(stay.withColumnRenamed("id", "a"), "a", "left_semi").join(stay.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))


def lesser_siblings(children: DataFrame) -> DataFrame:
    """children(parent, id, size, layer) with ``before``, the sizes of the siblings with lesser ids.

    Sizes are summed along one global sort, by partition and then over the partitions' totals, so a vertex of any degree is spread over tasks.
    """
    spark = children.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, p = 0, TaskContext.get().partitionId()
        for b in batches:
            sums = np.cumsum(b.column("size").to_numpy(zero_copy_only=False)) + total
            starts = np.concatenate([[total], sums[:-1]])[: b.num_rows]
            total = int(sums[-1]) if b.num_rows else total
            columns = [*[b.column(c) for c in ("parent", "id", "size", "layer")], pa.array(starts, pa.int64()), pa.array([p] * b.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["parent", "id", "size", "layer", "sum", "p"])

    schema = ", ".join(f"{c} {dict(children.dtypes)[c]}" for c in ("parent", "id", "size", "layer")) + ", sum long, p int"
    placed = _at_rest(children.select("parent", "id", "size", "layer").repartitionByRange(n, "parent", "id").sortWithinPartitions("parent", "id").mapInArrow(run, schema))
    totals = {r.p: r.n for r in placed.groupBy("p").agg(F.max(F.col("sum") + F.col("size")).alias("n")).collect()}
    first = [0]
    for p in range(max(totals, default=0)):
        first.append(first[-1] + totals.get(p, 0))
    summed = placed.withColumn("sum", F.get(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), F.col("p")) + F.col("sum"))
    least = summed.groupBy("parent").agg(F.min("sum").alias("least"))
    return _at_rest(summed.join(least, "parent").select("parent", "id", "layer", (F.col("sum") - F.col("least")).alias("before")))


def depth_first(e: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, seq): depth-first order from ``roots``(id), roots and neighbours by id, over the least spanning forest of the graph.

    Of a forest this is the order that a stack gives; elsewhere it is a depth-first order of the tree of ``spanning_forest``. A component
    starts at its least root; vertices without a root in their component have no row; a root without edges is a row of its own.

    Vertices with one neighbour hang from it in every spanning forest; they go first, layer by layer, and come back last. What is left of a
    tree is toured: every edge is two arcs, each followed by the next arc around the vertex it leads to, by id and cyclically; ranking this tour
    from the root tells down from up, and the sizes of the subtrees. A vertex comes after its parent by one and the sizes of its lesser
    siblings; these steps are summed up to the root. All rounds are logarithmic. Arcs around a vertex and siblings are numbered by
    global sorts, so a vertex of any degree is spread over tasks.
    """
    roots = _at_rest(roots.select("id").where("id is not null").distinct())
    pair = e.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    core, layers, sums = rake(_at_rest(pair), roots)
    tree, comp = spanning_forest(core.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    chosen = roots.join(comp, "id").groupBy("comp").agg(F.min("id").alias("root"))
    rooted = _at_rest(comp.join(chosen, "comp").select("id", "root"))
    both = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).union(tree.select("b", "a"))
    arcs = _at_rest(sequence(both.join(rooted.withColumnRenamed("id", "u"), "u"), "u", "v", name="k"))
    ends = arcs.groupBy("u").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).select(F.col("u").alias("v"), "lo", "hi")
    twin = arcs.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("k").alias("t"))
    following = F.when(F.col("t") == F.col("hi"), F.col("lo")).otherwise(F.col("t") + 1)
    # a tour ends where it would begin again: at the first arc of its root
    over = (F.col("v") == F.col("root")) & (F.col("t") == F.col("hi"))
    tour = _at_rest(arcs.join(twin, ["u", "v"]).join(ends, "v").select("k", "u", "v", "t", F.when(~over, following).alias("next"), F.lit(1).alias("step")))
    ranked = tour.select("k", "u", "v", "t").join(list_sums(tour), "k")
    # more of the tour is left at the arc down than at the arc up
    other = ranked.select(F.col("k").alias("t"), F.col("total").alias("other"))
    down = ranked.join(other, "t").where("total > other").select("k", "t", F.col("u").alias("parent"), F.col("v").alias("id"))
    if sums is not None:
        down = down.join(sums, "id", "left")
    down = _at_rest(down.select("k", "t", "parent", "id", (1 + F.coalesce("size", F.lit(0)) if sums is not None else F.lit(1)).cast("long").alias("step")))
    # a subtree is what the arcs down from its own one to its arc up lead to
    weights = list_sums(tour.drop("step").join(down.select("k", "step"), "k", "left").select("k", "next", F.coalesce("step", F.lit(0)).alias("step")))
    up = weights.select(F.col("k").alias("t"), F.col("total").alias("rest"))
    sized = down.join(weights, "k").join(up, "t").select("parent", "id", (F.col("total") - F.col("rest")).alias("size"), F.lit(0).alias("layer"))
    children = reduce(DataFrame.union, [sized, *[x.select("parent", "id", "size", F.lit(i + 1).alias("layer")) for i, x in enumerate(layers)]])
    before = lesser_siblings(children)
    steps = before.where("layer = 0").select(F.col("id").alias("k"), F.col("parent").alias("next"), (F.col("before") + 1).alias("step"))
    starts = chosen.select(F.col("root").alias("k"), F.lit(None).alias("next"), F.lit(0).cast("long").alias("step"))
    placed = list_sums(steps.union(starts)).join(rooted.withColumnRenamed("id", "k"), "k").select(F.col("k").alias("id"), "root", "total")
    placed = _at_rest(placed.union(roots.join(comp, "id", "left_anti").select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("total"))))
    for i in reversed(range(len(layers))):
        parents = placed.withColumnRenamed("id", "parent")
        back = before.where(F.col("layer") == i + 1).join(parents, "parent").select("id", "root", (F.col("total") + F.col("before") + 1).alias("total"))
        placed = placed.union(_at_rest(back))
    return sequence(placed, "root", "total").select("id", "seq")


def dfs_order(edge_rows: list[tuple[int, int]], roots: list[int]) -> list[int]:
    """Depth-first order of a graph small enough for the driver; neighbours by id."""
    near: dict[int, set[int]] = {}
    for a, b in edge_rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out, seen, stack = [], set(), sorted([*roots], reverse=True)
    while stack:
        v = stack.pop()
        if v not in seen:
            seen.add(v)
            out.append(v)
            stack += sorted(near.get(v, set()) - seen, reverse=True)
    return out
