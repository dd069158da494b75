"""Adjacency at rest: both directions of every edge, bucketed and sorted by vertex, so that a hop reads it where it lies.

The table is partitioned by the label of the neighbour, since hops ask for one label, and bucketed by the vertex; each bucket is one file for
each label. A frontier that is shuffled by vertex into as many partitions meets its bucket without an exchange of the edges.
Buckets follow ``spark.sql.shuffle.partitions``. Storing costs one shuffle of the edges; every hop of every query after that costs none.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quilt.operators.frontier import EdgeList


def shared_folder(spark: SparkSession, prefix: str) -> str:
    """A new folder below the one that driver and executors share; a local one only where the session names none (tests)."""
    return f"{spark.sparkContext.getConf().get('spark.checkpoint.dir') or tempfile.mkdtemp(prefix='shared-')}/{prefix}-{uuid.uuid4().hex}"


@dataclass(frozen=True)
class StoredAdjacency:
    """A table (v, v_labels, u, u_first) partitioned by u_label and bucketed by v; takes the place of an edge list in a field.

    A neighbour stands once for each label that a vertex with its id has, ``u_first`` in one of these rows.
    """

    spark: SparkSession
    name: str
    path: str

    #: each neighbour is stored once
    unique = True

    @property
    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def pairs(self, label: str | None, of: str | None = None, raw: bool = False) -> DataFrame:
        """(v, u): each neighbour once; only the label's files are read."""
        t = self.table
        t = t.where("u_first") if label is None else t.where(F.col("u_label") == label)
        return (t if of is None else t.where(F.array_contains("v_labels", of))).select("v", "u")

    def drop(self) -> None:
        """Forget the table and remove its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def store(vertices: DataFrame, edges: DataFrame, unique: bool = False, buckets: int | None = None) -> StoredAdjacency:
    """Write the adjacency of vertices(id, label) and edges(src, dst); neighbours that aren't vertices are left out.

    unique: no pair of vertices is joined both ways or twice, so that nothing must be made distinct.
    """
    spark = vertices.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = vertices.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    us = labels.select(F.col("id").alias("u"), F.posexplode("labels").alias("at", "u_label")).select("u", "u_label", (F.col("at") == 0).alias("u_first"))
    pairs = EdgeList(edges, unique).pairs(None).join(us, "u").join(labels.select(F.col("id").alias("v"), F.col("labels").alias("v_labels")), "v")
    name, path = f"adjacency_{uuid.uuid4().hex}", shared_folder(spark, "adjacency")
    placed = pairs.select("v", "v_labels", "u", "u_first", "u_label").repartition(n, "v")
    placed.write.partitionBy("u_label").bucketBy(n, "v").sortBy("v", "u").option("path", path).format("parquet").saveAsTable(name)
    return StoredAdjacency(spark, name, path)
