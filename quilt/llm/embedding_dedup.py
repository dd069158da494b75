"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

A rotation is learned on a bounded sample (``sample`` vectors with the least hash of their class) so that the signs of the rotated
coordinates make balanced binary codes. Every vector is indexed: codes are cut into substrings, one table each; a vector is
filed under its substrings and those at distance one, and asked for in the same way, so two vectors meet if any of their substrings differ in at
most two bits. Those within a Hamming radius are compared by cosine in double precision. Equal vectors of a label form one
class before anything is joined, and count with their multiplicity. Vectors of each dimension have a rotation and tables of their own.

Edge cases: a vector without label, that is null or zero, or that holds a null or non-finite component links with nothing; vectors of different
dimensions don't link; links at the threshold exactly count. Null ids are kept; rows with equal ids are vectors of their own and share the id; only
the key, the embedding and the label are read, so further columns can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import components, materialise


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 40, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions, rotated so that the signs lose least; alternates codes and an orthogonal fit."""
    mean = x.mean(0)
    y = x - mean
    _, vectors = np.linalg.eigh(y.T @ y)
    v = y @ vectors[:, ::-1][:, :bits]
    r, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
        r = (u @ w).T
    return mean, vectors[:, ::-1][:, :bits] @ r


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """Packed sign bits as 64-bit integers."""
    signs = (x - mean) @ projection > 0
    return (signs.astype("u8") << np.arange(signs.shape[1], dtype="u8")).sum(1, dtype="u8")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_of(classes: DataFrame, d: int, cosine: float, sample: int, radius: int) -> DataFrame:
    """(a, b, cosine): links between classes (cid, label, x) of vectors with d components."""
    learned = np.array([r.x for r in classes.orderBy(F.xxhash64("cid"), "cid").select("x").limit(sample).collect()], "f8")
    bits = min(64, d)
    mean, projection = learn_rotation(unit(learned), bits)
    tables = min(4, max(1, bits // 4))  # at every size: fewer, longer substrings would lose pairs
    edges = [bits * t // tables for t in range(tables + 1)]
    masks = [(1 << (b - a)) - 1 for a, b in zip(edges, edges[1:], strict=False)]

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each table and substring within distance one."""
        for b in batches:
            x = unit(np.asarray(b.column(2).flatten(), "f8").reshape(-1, d)) if b.num_rows else np.zeros((0, d))
            code = codes(x, mean, projection)
            out_i, out_t, out_s = [], [], []
            for t, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
                sub = code >> np.uint64(lo) & np.uint64(masks[t])
                near = np.concatenate([[0], 1 << np.arange(hi - lo)]).astype("u8")
                out_s.append((sub[:, None] ^ near).ravel())
                out_i.append(np.repeat(np.arange(b.num_rows), len(near)))
                out_t.append(np.full(b.num_rows * len(near), t, "i4"))
            i = np.concatenate(out_i)
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(out_t)), pa.array(np.concatenate(out_s).view("i8")), pa.array(code.view("i8")[i])], names=["cid", "label", "t", "s", "code"]
            )

    filed = materialise(classes.select("cid", "label", "x").mapInArrow(file, "cid long, label string, t int, s long, code long"))
    a, b = (filed.select("label", "t", "s", F.col("cid").alias(c), F.col("code").alias(f"c{c}")) for c in ("a", "b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= radius)
    pairs = a.join(b, ["label", "t", "s"]).where(near).select("a", "b").distinct()
    x = classes.select("cid", "x")
    both = pairs.join(x.select(F.col("cid").alias("a"), F.col("x").alias("xa")), "a").join(x.select(F.col("cid").alias("b"), F.col("x").alias("xb")), "b")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u, v = (np.asarray(b.column(i).flatten(), "f8").reshape(b.num_rows, d) for i in (2, 3))
            c = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c)], names=["a", "b", "cosine"]).filter(pa.array(c >= cosine))

    return materialise(both.select("a", "b", "xa", "xb").mapInArrow(rerank, "a long, b long, cosine double"))


def link(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, sample: int = 20_000, radius: int = 18) -> tuple[DataFrame, DataFrame]:
    """(rows, links): rows (key, cid, valid) of the input; links (a, b, cosine) between classes a < b; see :func:`near_duplicates`."""
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("x").isNotNull() & good & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("valid", valid).withColumn("cid", F.when(F.col("valid"), F.xxhash64("x", "label")))
    classes = materialise(rows.where("valid").groupBy("cid").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("m"), F.min("id").alias("rep")))
    if not classes.count():
        return rows.select("id", "cid", "valid"), vectors.sparkSession.createDataFrame([], "a long, b long, cosine double")
    # a table has few dimensions, mostly one
    sizes = sorted(r.d for r in classes.select(F.size("x").alias("d")).distinct().collect())
    links = None
    for d in sizes:
        found = links_of(classes if len(sizes) == 1 else classes.where(F.size("x") == d), d, cosine, sample, radius)
        links = found if links is None else links.union(found)
    counted = materialise(classes.select("cid", "m", "rep"))
    return rows.select("id", "cid", "valid").join(counted, "cid", "left"), links


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", **options) -> DataFrame:
    """(key, n_links, component_id, kept): direct links of each vector, the smallest id reachable, and whether that is its own."""
    rows, links = link(vectors, key, embedding, label, **options)
    if "m" not in rows.columns:
        return rows.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    mult = rows.where("valid").select("cid", "m", "rep").distinct()
    ends = links.select("a", "b").union(links.select("b", "a"))
    others = ends.join(mult.select(F.col("cid").alias("b"), "m"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("m").alias("others"))
    comp = components(links).withColumnRenamed("node", "cid")
    least = comp.join(mult, "cid").groupBy("component").agg(F.min("rep").alias("least"))
    placed = comp.join(least, "component").select("cid", "least")
    per_class = materialise(mult.join(others, "cid", "left").join(placed, "cid", "left").select("cid", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("least", "rep").alias("least")))
    out = rows.join(per_class, "cid", "left")
    n_links = F.when(F.col("valid"), F.col("m") - 1 + F.col("others")).otherwise(F.lit(0)).cast("long")
    component = F.when(F.col("valid"), F.col("least")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), n_links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
