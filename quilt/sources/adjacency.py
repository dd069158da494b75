"""JSON adjacency lists: one top-level array of {id, label, in: [{rel, id}], out: [{rel, id}]}, and the labels of two data sets.

Reading is all or nothing: malformed JSON, a missing or wrong field, an unknown label or relation, and an id outside INT are errors.
A null inside a neighbour list ends that list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.sources import json_array

_NEIGHBOUR = "array<struct<rel:string,id:bigint>>"
SCHEMA = f"id bigint, label string, `in` {_NEIGHBOUR}, `out` {_NEIGHBOUR}"

#: Vertex labels of the provenance and music data sets, and the neighbour's label for each relation and direction.
PROVENANCE = {"AGENT": "Agent", "ACTIVITY": "Activity", "ENTITY": "Entity"}
PROVENANCE_EDGES = {
    ("WASDERIVEDFROM", "out"): "Entity",
    ("WASDERIVEDFROM", "in"): "Entity",
    ("WASGENERATEDBY", "out"): "Entity",
    ("WASGENERATEDBY", "in"): "Activity",
    ("WASASSOCIATEDWITH", "out"): "Activity",
    ("WASASSOCIATEDWITH", "in"): "Agent",
    ("USED", "out"): "Activity",
    ("USED", "in"): "Entity",
}
MUSIC = ("Album", "Area", "Artist", "ArtistAlias", "ArtistCredit", "Country", "Entry", "Label", "Medium", "Other", "Place", "Recording", "Release", "SearchHint", "Single", "Track", "Url", "Work")


def vertex_labels(dataset: str) -> dict[str, str]:
    if dataset == "provenance":
        return PROVENANCE
    if dataset == "music":
        return {**{x: x for x in MUSIC}, "": "Other"}
    raise ValueError(f"unknown data set {dataset!r}")


def _lookup(table: dict[str, str], key: Column, what: str) -> Column:
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"Unrecognised {what} label: "), F.coalesce(key, F.lit("null")))).cast("string"))


def neighbour_label(dataset: str, rel: Column, direction: str) -> Column:
    """Label of a neighbour by relation; directions are the neighbour's: entries of ``in`` point out of it."""
    if dataset == "provenance":
        return _lookup({r: label for (r, d), label in PROVENANCE_EDGES.items() if d == direction}, rel, "edge")
    return _lookup(vertex_labels(dataset), rel, "edge")


def _int(c: Column, what: str) -> Column:
    """Narrowed id; null or too large is an error."""
    return F.coalesce(c, F.raise_error(F.lit(f"Unable to properly parse {what} id")).cast("bigint")).cast("int")


def _until_null(a: Column) -> Column:
    cut = F.array_position(F.transform(a, lambda x: x.isNull()), True)
    return F.coalesce(F.when(cut > 0, F.slice(a, 1, (cut - 1).cast("int"))).otherwise(a), F.array().cast(_NEIGHBOUR))


def read_neighbourhoods(spark: SparkSession, path: str, dataset: str, lines: bool = False, split: bool = False, once: bool = True) -> DataFrame:
    """(id, label, in, out), neighbours as arrays of (id, label), once each: vertices of two labels are two, even if they share an id.

    once: else all entries of a list stay, an edge each. lines: the files hold one object a line instead of one array each. split: the files are arrays, and many tasks read each of them;
    else one task reads a file that is an array.
    """
    raw = json_array.read_array(spark, path, SCHEMA).drop("line") if split else spark.read.schema(SCHEMA).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    side = lambda name, direction: F.transform(_until_null(F.col(name)), lambda x: F.struct(_int(x["id"], "neighbour").alias("id"), neighbour_label(dataset, x["rel"], direction).alias("label")))
    out = raw.select(_int(F.col("id"), "vertex").alias("id"), _lookup(vertex_labels(dataset), F.col("label"), "vertex").alias("label"), side("`in`", "out").alias("in"), side("`out`", "in").alias("out"))
    return out.select("id", "label", F.array_distinct("in").alias("in"), F.array_distinct("out").alias("out")) if once else out


def to_vertices(n: DataFrame) -> DataFrame:
    """(id, label) of centers and neighbours; a center's own label prevails."""
    around = n.select(F.explode(F.concat("in", "out")).alias("x")).select("x.id", "x.label", F.lit(1).alias("rank"))
    return n.select("id", "label", F.lit(0).alias("rank")).union(around).groupBy("id").agg(F.min_by("label", F.struct("rank", "label")).alias("label"))


def to_edges(n: DataFrame) -> DataFrame:
    """(src, dst), up to twice for each edge: once from either end's neighbourhood."""
    return n.select(F.explode("in").alias("x"), "id").select(F.col("x.id").alias("src"), F.col("id").alias("dst")).union(n.select(F.col("id").alias("src"), F.explode("out").alias("x")).select("src", F.col("x.id")))


def neighbourhoods(v: DataFrame, e: DataFrame, once: bool = True) -> DataFrame:
    """(id, label, in, out) of a graph, neighbours as sorted arrays of ids, once each; else as often as ``e`` has an edge."""
    some = F.collect_set if once else F.collect_list
    side = lambda key, other, name: e.groupBy(F.col(key).alias("id")).agg(F.array_sort(some(other)).alias(name))
    none = F.array().cast("array<int>")
    both = v.join(side("dst", "src", "in"), "id", "left").join(side("src", "dst", "out"), "id", "left")
    return both.select("id", "label", F.coalesce("in", none).alias("in"), F.coalesce("out", none).alias("out"))


def write_partitions(v: DataFrame, path: str) -> None:
    """Store vertices by partition."""
    v.write.mode("overwrite").partitionBy("part").parquet(path)
