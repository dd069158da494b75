"""Traversal queries over a partitioned graph as DataFrame joins, with inter-partition traversals (IPT) counted on the way.

A result is a bag: a row for each path. Every step adds a column ``ipt_<step>``: how many crossings that row caused. Vertices without
partition differ from every partition, and equal one another.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.functions.storage import materialise


@dataclass(frozen=True)
class Graph:
    """vertices(id, label, part) and edges(src, dst); ``tasks`` share the work on neighbours, else as many as Spark chooses."""

    vertices: DataFrame
    edges: DataFrame
    tasks: int | None = None

    def partition_of(self) -> DataFrame:
        return self.vertices.select("id", "part")

    def partitions(self) -> DataFrame:
        """(part, size)."""
        return self.vertices.groupBy("part").agg(F.count("*").alias("size"))

    def pairs(self, out: DataFrame, into: DataFrame) -> DataFrame:
        """(v, u): each pair once, along the edges ``out`` and against ``into``. Pairs lie by u, so that a join on it moves them no more."""
        both = out.select(F.col("src").alias("v"), F.col("dst").alias("u")).union(into.select("dst", "src"))
        return (both.repartition(self.tasks, "u") if self.tasks else both).distinct()

    def neighbours(self, label: str | None = None, of: DataFrame | None = None) -> DataFrame:
        """(v, u, u_label, u_part): each neighbour (of one label) once, whichever way edges run. Ends outside of the label's ids, or of those of ``of``(id), go before anything else."""
        out = into = self.edges
        ends = self.vertices.select(F.col("id").alias("u"), F.col("label").alias("u_label"), F.col("part").alias("u_part"))
        if label is not None:
            ends = ends.where(F.col("u_label") == label)
            within = spans(self.vertices.where(F.col("label") == label))
            out, into = out.where(between("dst", within, label)), into.where(between("src", within, label))
        if of is not None:
            lo, hi = of.agg(F.min("id"), F.max("id")).first()
            out, into = out.where(F.col("src").between(lo, hi)), into.where(F.col("dst").between(lo, hi))
        return self.pairs(out, into).join(ends, "u").select("v", "u", "u_label", "u_part")

    def point(self, v: int) -> DataFrame:
        return self.vertices.where(F.col("id") == v)

    def plus_edges(self, more: DataFrame) -> Graph:
        return replace(self, edges=self.edges.select("src", "dst").union(more.select("src", "dst")).distinct())

    # starting points

    def get_all(self, label: str) -> Traversal:
        return self.get_where(F.col("label") == label)

    def get(self, v: int) -> Traversal:
        return self.get_where(F.col("id") == v)

    def get_where(self, predicate: Column) -> Traversal:
        rows = self.vertices.where(predicate).select(F.col("id").alias("v0"), F.col("id").alias("at"), F.col("part").alias("at_part"))
        return Traversal(self, rows, 0)


@dataclass(frozen=True)
class Traversal:
    """The paths so far: v0, v1, ..., the current vertex ``at`` with its partition, and the crossings of each step."""

    graph: Graph
    rows: DataFrame
    step: int

    @property
    def columns(self) -> list[str]:
        return [f"v{i}" for i in range(self.step + 1)]

    def _on(self, rows: DataFrame) -> Traversal:
        return Traversal(self.graph, rows, self.step + 1)

    def _kept(self) -> list[Column]:
        return [F.col(c) for c in self.rows.columns if c not in ("at", "at_part")]

    def neighbours_where(self, predicate: Column) -> Traversal:
        """Neighbours that satisfy a predicate over u, u_label and u_part; each one returned from elsewhere is a crossing."""
        return self._to(self.graph.neighbours().where(predicate))

    def neighbours(self, label: str) -> Traversal:
        # the ends of paths are only known without work where no hop came before
        return self._to(self.graph.neighbours(label, None if self.step else self.rows.select(F.col("at").alias("id"))))

    def _to(self, n: DataFrame) -> Traversal:
        joined = self.rows.join(n, F.col("at") == F.col("v"))
        crossing = (~F.col("at_part").eqNullSafe(F.col("u_part"))).cast("int")
        return self._on(joined.select(*self._kept(), F.col("u").alias(f"v{self.step + 1}"), crossing.alias(f"ipt_{self.step + 1}"), F.col("u").alias("at"), F.col("u_part").alias("at_part")))

    def edges_where(self, predicate: Column) -> Traversal:
        """Incident edges that satisfy a predicate over src and dst; moves to the other end."""
        e = self.graph.edges.select("src", "dst").distinct()
        loops = F.col("src") != F.col("dst")
        ends = e.select("src", "dst", F.col("src").alias("v"), F.col("dst").alias("u")).union(e.where(loops).select("src", "dst", F.col("dst"), F.col("src")))
        parts = self.graph.vertices.select(F.col("id").alias("u"), F.col("part").alias("u_part"))
        joined = self.rows.join(ends.where(predicate), F.col("at") == F.col("v")).join(parts, "u")
        crossing = (~F.col("at_part").eqNullSafe(F.col("u_part"))).cast("int")
        return self._on(joined.select(*self._kept(), F.col("u").alias(f"v{self.step + 1}"), crossing.alias(f"ipt_{self.step + 1}"), F.col("u").alias("at"), F.col("u_part").alias("at_part")))

    def optional(self, wanted: Column, kind: str = "edge") -> Traversal:
        """An option: the edge to, or the in- or out-neighbour, ``wanted``. Crossing is counted before the edge is looked up.

        Rows stay; where there is no such edge, the new vertex is null.
        """
        parts = self.graph.vertices.select(F.col("id").alias("w"), F.col("part").alias("w_part"))
        rows = self.rows.withColumn("want", wanted.cast("int")).join(parts, F.col("want") == F.col("w"), "left")
        e = self.graph.edges.select(F.col("src").alias("e_from"), F.col("dst").alias("e_to"))
        there = {"out": e, "in": e.select(F.col("e_to").alias("e_from"), F.col("e_from").alias("e_to"))}
        there["edge"] = there["out"].union(there["in"])
        # only edges that some row asks for are made distinct
        asked = rows.select(F.col("at").alias("e_from"), F.col("want").alias("e_to")).distinct()
        found = there[kind].join(asked, ["e_from", "e_to"], "left_semi").distinct()
        rows = rows.join(found, (F.col("at") == F.col("e_from")) & (F.col("want") == F.col("e_to")), "left")
        crossing = (~F.col("at_part").eqNullSafe(F.col("w_part"))).cast("int")
        return self._on(rows.select(*self._kept(), F.col("e_to").alias(f"v{self.step + 1}"), crossing.alias(f"ipt_{self.step + 1}"), F.col("e_to").alias("at"), F.when(F.col("e_to").isNotNull(), F.col("w_part")).alias("at_part")))

    def where_lists(self, more_than: int) -> Traversal:
        """Keep starting points with more than so many results."""
        big = self.rows.groupBy("v0").agg(F.count("*").alias("_n")).where(F.col("_n") > more_than).select("v0")
        return replace(self, rows=self.rows.join(big, "v0", "left_semi"))

    def where(self, predicate: Column) -> Traversal:
        return replace(self, rows=self.rows.where(predicate))

    def sample(self) -> Traversal:
        """About a tenth of the frontier, by a fixed hash of the id instead of an unseeded draw."""
        return replace(self, rows=self.rows.where(sampled(F.col("at"))))

    def take(self, n: int) -> Traversal:
        """The first n paths in the order of their vertices."""
        return replace(self, rows=self.rows.orderBy(*self.columns).limit(n))

    def map(self, f: Callable[[DataFrame], DataFrame]) -> Traversal:
        return replace(self, rows=f(self.rows))

    # results

    def paths(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def ipt(self) -> DataFrame:
        """(n_paths, ipt). Crossings of steps before the last count once for each of their own rows, so use :func:`run` for those."""
        crossings = [F.col(f"ipt_{i}") for i in range(1, self.step + 1)]
        total = crossings[-1] if crossings else F.lit(0)
        return self.rows.agg(F.count("*").alias("n_paths"), F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("ipt"))


Spans = dict[str, tuple[int, int]]


def spans(vertices: DataFrame) -> Spans:
    """The least and the greatest id of each label: a row for each label."""
    return {r.label: (r.lo, r.hi) for r in vertices.where("id is not null").groupBy("label").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}


def between(column: str, within: Spans, label: str) -> Column:
    """Whether an end can be a vertex of the label. The labels that edges carry can't tell: vertices of two labels may share an id."""
    return F.col(column).between(*within[label]) if label in within else F.lit(False)


def sampled(v: Column) -> Column:
    return (v.cast("long") * 2654435761) % 100 > 89


def run(start: Traversal, *steps: Callable[[Traversal], Traversal]) -> tuple[Traversal, DataFrame]:
    """The final traversal, and (hop, n_paths, ipt) of each hop. Paths of a hop that others follow are written once and counted there."""
    now, hops = start, [start]
    for i, step in enumerate(steps):
        before, now = now.step, step(now)
        if now.step > before:
            if i + 1 < len(steps):
                now = replace(now, rows=materialise(now.rows))
            hops.append(now)
    counts = [h.ipt().select(F.lit(h.step).alias("hop"), "n_paths", "ipt") for h in hops]
    return now, reduce(DataFrame.union, counts)
