"""Workloads: pattern graphs, seeded query streams, traversal queries, and the experiment that sums time and IPT."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import log, sqrt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.functions.scalars import timed
from quilt.operators.frontier import Field, Walk, count_hops, count_one
from quilt.operators.traversal import Graph, Traversal, run

#: The paths of labels that make up each data set's query patterns.
PATTERNS = {
    "tables": {"q1": ["Region", "Nation", "Customer", "Order"], "q2": ["Customer", "Order", "Part", "Order", "Customer"], "q3": ["Nation", "Supplier", "Part"]},
    "provenance": {"q1": ["Entity", "Entity", "Entity"], "q2": ["Agent", "Activity", "Entity", "Entity", "Activity", "Agent"], "q3": ["Agent", "Activity"]},
    "music": {"q1": ["Area", "Artist", "Label", "Area"], "q2": ["Artist", "ArtistCredit", "Recording", "ArtistCredit", "Artist"], "q3": ["Artist", "ArtistCredit", "Track", "Medium"]},
}
#: Query mix, seed and number of draws of an experiment.
MIX = {"q1": 0.4, "q2": 0.1, "q3": 0.5}
SEED = 12738419
DRAWS = 40


def pattern_rows(paths: dict[str, list[str]], codes: dict[str, int]) -> list[tuple]:
    """(query, e, src, src_code, dst, dst_code) of paths, vertices numbered along each path from 1."""
    return [(q, i + 1, i + 1, codes[a], i + 2, codes[b]) for q, path in paths.items() for i, (a, b) in enumerate(zip(path, path[1:], strict=False))]


def patterns(spark: SparkSession, paths: dict[str, list[str]], codes: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(pattern_rows(paths, codes), "query string, e int, src int, src_code int, dst int, dst_code int")


class JavaRandom:
    """The 48-bit linear congruential generator of java.util.Random, whose draws the recorded mix relies on."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)
        self.spare: float | None = None

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def next_double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)

    def next_gaussian(self) -> float:
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            a, b = 2 * self.next_double() - 1, 2 * self.next_double() - 1
            s = a * a + b * b
            if 0 < s < 1:
                m = sqrt(-2 * log(s) / s)
                self.spare = b * m
                return a * m


def fixed_stream(frequencies: dict[str, float], known: set[str], seed: int = SEED) -> Iterator[str]:
    """Endless queries by frequency; draws above the last cumulative bound are dropped."""
    if not set(frequencies) <= known:
        raise ValueError(f"frequencies name unknown queries: {sorted(set(frequencies) - known)}")
    if sum(frequencies.values()) <= 0.99:
        raise ValueError("frequencies must sum to one")
    r = JavaRandom(seed)
    while True:
        x, bound = r.next_double(), 0.0
        for q, f in frequencies.items():
            bound += f
            if x <= bound:
                yield q
                break


def periodic_stream(queries: list[str], seed: int = SEED, exact: bool = False) -> Iterator[str]:
    """Endless queries whose likeliest one moves on; buckets are 7 // n wide (7 / n if ``exact``), draws outside them are dropped."""
    r, i, n = JavaRandom(seed), 0, len(queries)
    width = 7 / n if exact else 7 // n
    while True:
        x = r.next_gaussian() + (i / 10) % 7
        x = x - 7 if x >= 3.5 else x
        i += 1
        at = int((x + 3.5) // width) if width else n
        if 0 <= at < n:
            yield queries[at]


def draws(spark: SparkSession, stream: Iterator[str], n: int) -> DataFrame:
    """(i, query) of the first n draws."""
    return spark.createDataFrame([(i, next(stream)) for i in range(n)], "i int, query string")


def draw_counts(drawn: DataFrame) -> DataFrame:
    return drawn.groupBy("query").agg(F.count("*").alias("n"))


# queries: a starting point and steps

Query = tuple[Callable[[Graph], Traversal], list[Callable[[Traversal], Traversal]]]


def _hop(label: str) -> Callable[[Traversal], Traversal]:
    return lambda t: t.neighbours(label)


def _sample(t: Traversal) -> Traversal:
    return t.sample()


def _take(n: int) -> Callable[[Traversal], Traversal]:
    return lambda t: t.take(n)


def _path(start: str, *steps: str | int | None) -> Query:
    """Steps: a label to move to, a number of rows to take, None to sample."""
    return (lambda g: g.get_all(start)), [_sample if s is None else _take(s) if isinstance(s, int) else _hop(s) for s in steps]


QUERIES: dict[str, dict[str, Query]] = {
    "provenance": {"q1": _path("Entity", None, "Entity", "Entity"), "q2": _path("Agent", None, "Activity", "Entity", "Entity", "Activity", "Agent"), "q3": _path("Agent", None, "Activity")},
    "music": {"q1": _path("Area", "Artist", 1000, "Label", "Area"), "q2": _path("Artist", 100, "ArtistCredit", "Track", 100, "ArtistCredit", 100, "Artist"), "q3": _path("Artist", 100, "ArtistCredit", "Track", "Medium")},
    "tables": {"q1": _path("Region", "Nation", "Customer", None, "Order"), "q2": _path("Customer", 100, "Order", "Part", 100, "Order", 100, "Customer"), "q3": _path("Nation", "Supplier", None, "Part")},
    "demo": {"q1": _path("Entity", "Entity"), "q2": ((lambda g: g.get_all("Activity")), [_hop("Entity"), lambda t: t.where_lists(1)])},
}


@dataclass
class Config:
    """One experiment; capacity is the whole number of vertices for each partition."""

    k: int
    n_vertices: int
    n_edges: int
    prime: int = 251

    @property
    def capacity(self) -> int:
        return self.n_vertices // self.k


def execute(graph: Graph | Field, query: Query) -> tuple[int, DataFrame]:
    """(milliseconds of running it, (hop, n_paths, ipt)). Over a field paths are counted by weights and never written."""
    from quilt.functions.storage import materialise

    start, steps = query
    if isinstance(graph, Field):
        return timed(lambda: count_one(start(graph), *steps))
    ms, hops = timed(lambda: materialise(run(start(graph), *steps)[1]))
    return ms, hops


def experiment(graph: Graph | Field, dataset: str, stream: Iterator[str], n: int = DRAWS) -> DataFrame:
    """(query, draws, time_ms, ipt): each of the first n draws is run and timed; sums for each query."""
    total: dict[str, list[int]] = {}
    for _ in range(n):
        q = next(stream)
        ms, hops = execute(graph, QUERIES[dataset][q])
        ipt = int(hops.agg(F.sum("ipt")).first()[0] or 0)
        total[q] = [a + b for a, b in zip(total.get(q, [0, 0, 0]), (1, ms, ipt), strict=True)]
    rows = [(q, *sums) for q, sums in sorted(total.items())]
    return graph.vertices.sparkSession.createDataFrame(rows, "query string, draws int, time_ms long, ipt long")


Order = Callable[[DataFrame, DataFrame], DataFrame]


def experiments(vertices: DataFrame, edges: DataFrame, dataset: str, orders: dict[str, Order], partitioners: dict[str, Order], stream: Callable[[], Iterator[str]], n: int = DRAWS) -> DataFrame:
    """(arrival, partitioner, query, draws, time_ms, ipt): an experiment for every order of arrival and every partitioner.

    An order takes vertices and edges and returns vertices with ``seq``; a partitioner takes those and edges and returns (id, part); each
    experiment draws from a stream of its own. Vertices that a partitioner leaves out have no partition.
    """
    from quilt.functions.storage import materialise

    out = []
    for arrival, order in orders.items():
        arrived = materialise(order(vertices, edges))
        for name, partition in partitioners.items():
            placed = arrived.select("id", "label").join(partition(arrived, edges).select("id", "part"), "id", "left")
            done = experiment(Graph(materialise(placed), edges), dataset, stream(), n)
            out.append(done.select(F.lit(arrival).alias("arrival"), F.lit(name).alias("partitioner"), *done.columns))
    return reduce(DataFrame.union, out)


def experiment_counts(field: Field, dataset: str, drawn: list[str], names: list[str]) -> DataFrame:
    """(run, query, partitioning, n_paths, ipt): every draw is a run of its own, and all partitionings are counted in the same traversal.

    A run samples its own tenth of a frontier. ``names`` are those of the field's partitionings, in their order.
    """
    out = []
    for q in sorted(set(drawn)):
        start, steps = QUERIES[dataset][q]
        runs = tuple(i for i, x in enumerate(drawn) if x == q)
        first = start(_Runs(field, runs))
        sums = count_hops(first, *steps).select("run", "n_paths", F.posexplode("ipts").alias("p", "ipt")).groupBy("run", "p").agg(F.sum("n_paths").alias("n_paths"), F.sum("ipt").alias("ipt"))
        named = F.array(*[F.lit(n) for n in names])
        out.append(sums.select("run", F.lit(q).alias("query"), F.get(named, F.col("p")).alias("partitioning"), "n_paths", "ipt"))
    return reduce(DataFrame.union, out)


@dataclass(frozen=True)
class _Runs:
    """A field whose queries start with several runs."""

    field: Field
    runs: tuple[int, ...]

    def get_all(self, label: str) -> Walk:
        return self.field.get_all(label, self.runs)


def against_control(counts: DataFrame, control: str) -> DataFrame:
    """(arrival, partitioner, ipt, ratio): sums over all runs, and their ratio to those of ``control`` for the same order of arrival.

    Partitionings are called arrival/partitioner; no ratio where the control never crosses.
    """
    name = F.split("partitioning", "/")
    sums = counts.groupBy(F.get(name, F.lit(0)).alias("arrival"), F.get(name, F.lit(1)).alias("partitioner")).agg(F.sum("ipt").alias("ipt"))
    base = sums.where(F.col("partitioner") == control).select("arrival", F.col("ipt").alias("base"))
    return sums.join(F.broadcast(base), "arrival").select("arrival", "partitioner", "ipt", F.when(F.col("base") > 0, F.round(F.col("ipt") / F.col("base"), 9)).alias("ratio"))


def trial(graph: Graph, dataset: str) -> DataFrame:
    """(query, time_ms, n_paths, ipt) of each query once."""
    rows = []
    for q, query in QUERIES[dataset].items():
        ms, hops = execute(graph, query)
        last = hops.orderBy(F.desc("hop")).first()
        rows.append((q, ms, last.n_paths, int(hops.agg(F.sum("ipt")).first()[0] or 0)))
    return graph.vertices.sparkSession.createDataFrame(rows, "query string, time_ms long, n_paths long, ipt long")


def result_sum(results: DataFrame) -> DataFrame:
    """(time_ms, ipt): the field-wise sum, zero for no results."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return results.agg(total("time_ms"), total("ipt"))


def report(graph: Graph, dataset: str) -> str:
    """Partition sizes and a trial as text."""
    parts = ", ".join(f"{r.part}: {r['size']}" for r in graph.partitions().orderBy("part").collect())
    lines = [f"{r['query']}: {r.n_paths} paths, ipt {r.ipt}, {r.time_ms} ms" for r in trial(graph, dataset).orderBy("query").collect()]
    return "\n".join([f"partition sizes {parts}", *lines])
