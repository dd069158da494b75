"""Sharding by a k-d tree over document metadata, with near-equal bytes in every shard.

Rows with equal texts form one unit and stay in one shard. A group that holds more than 1/``heavy`` of all bytes or rows is
first dealt into ``heavy`` salted units, so that neither a shard nor a task depends on one group. Units are split recursively at the
distributed weighted median along the dimension that is widest in the node, until a leaf is one shard of the target bytes. Medians come
from a radix descent: histograms of a bounded number of bins, narrowed until a bin is one key. Only bounded tables (a row for each
node) reach the driver or are broadcast.

Edge cases: a null text has size 1 and CRC 0; null metadata sorts first; repeated rows (even with equal ids) each get a slot; ties on a
dimension are broken by the text's CRC; an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quilt.llm.common import materialise, small_table

_CODE_BITS, _TIE_BITS = 20, 32


def _codes(low_id: int, high_id: int) -> dict[str, Column]:
    """Integer code of each dimension; equal-width for numbers, hashed for names."""
    top = 1 << _CODE_BITS
    name = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.expr(f"pmod(xxhash64({c}), {top - 1}) + 1"))
    return {
        "source": name("source"),
        "lang": name("lang"),
        "size": F.least(F.floor(F.log2(F.col("size").cast("double")) * (top // 48)), F.lit(top - 1)),
        "id": F.least(F.floor((F.coalesce("id", F.lit(low_id)) - F.lit(low_id)).cast("double") / max(1, high_id - low_id + 1) * top), F.lit(top - 1)),
    }


def _split_keys(units: DataFrame, spark, chosen: list[tuple[int, int, float]], dims: list[str], bin_bits: int = 13) -> dict[int, int]:
    """node -> key at or above which a unit goes right. chosen: (node, dimension, weight wanted on the left)."""
    total_bits = _CODE_BITS + _TIE_BITS
    want = small_table(spark, [(n, float(w)) for n, _, w in chosen], "node int, want double")
    which = {n: d for n, d, _ in chosen}
    pick = F.create_map(*[x for n, d in which.items() for x in (F.lit(n), F.lit(d))])[F.col("node")]
    key = F.coalesce(*[F.when(pick == i, F.col(f"k_{d}")) for i, d in enumerate(dims)])
    found = {n: (0, 0.0) for n in which}  # prefix of the key so far, weight below it
    done = 0
    while done < total_bits:
        step = min(bin_bits, total_bits - done)
        shift = total_bits - done - step
        rows = small_table(spark, [(n, p, b) for n, (p, b) in found.items()], "node int, prefix long, below double")
        inside = units.join(F.broadcast(rows), "node").withColumn("key", key).where(F.expr(f"shiftright(key, {total_bits - done}) = prefix"))
        bins = inside.groupBy("node", "below", F.expr(f"shiftright(key, {shift})").alias("bin")).agg(F.sum("w").alias("w"))
        run = Window.partitionBy("node").orderBy("bin")
        sums = bins.withColumn("sum", F.col("below") + F.sum("w").over(run)).join(F.broadcast(want), "node")
        # the first bin that reaches the wanted weight, else the last one
        first = sums.groupBy("node").agg(F.min(F.when(F.col("sum") >= F.col("want"), F.struct("bin", (F.col("sum") - F.col("w")).alias("b"), "w"))).alias("hit"), F.max(F.struct("bin", (F.col("sum") - F.col("w")).alias("b"), "w")).alias("last"))
        got = {r.node: (r.hit or r.last) for r in first.collect()}
        found = {n: (got[n].bin, got[n].b) if n in got else found[n] for n in found}
        done += step
        if done == total_bits:
            targets = {n: w for n, _, w in chosen}
            # of the two borders of the last bin, the one nearer to the wanted weight
            return {n: found[n][0] + (n in got and abs(got[n].b + got[n].w - targets[n]) < abs(got[n].b - targets[n])) for n in found}
    raise AssertionError


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", heavy: int = 64, slot_rows: int = 50_000) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): every row in one of ``n_shards``, or as many as ``target_bytes`` asks for.

    ``slot`` numbers the rows of a shard without gaps, from counts per hashed block of rows, so no task sorts a whole shard.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    meta = materialise(
        docs.select(
            F.col(key).alias("id"), F.octet_length(body).cast("long").alias("bytes"), F.crc32(body.cast("binary")).alias("crc"), F.xxhash64(body).alias("tkey"), F.col(text).isNull().alias("none"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source")
        ).withColumn("size", F.when(F.col("none"), F.lit(0).cast("long")).otherwise(F.col("bytes")) + 1).drop("bytes", "none")
    )
    total, n_rows, low, high = meta.agg(F.sum("size"), F.count("*"), F.min("id"), F.max("id")).first()
    if n_shards is None:
        n_shards = max(1, round((total or 0) / target_bytes)) if target_bytes else 1
    group = ["tkey", "crc", "size"]
    large = meta.groupBy(*group).agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") * heavy > (total or 0)) | (F.col("n") * heavy > n_rows)).select(*group, F.lit(True).alias("large"))
    # at most 2 * heavy groups can be that large
    rows = meta.join(F.broadcast(large), group, "left").withColumn("salt", F.when(F.col("large"), F.expr(f"cast(pmod(xxhash64(id, source, lang), {heavy}) as int)")).otherwise(F.lit(0))).drop("large")
    unit = [*group, "salt"]
    units = rows.groupBy(*unit).agg(F.sum("size").cast("double").alias("w"), F.min("source").alias("source"), F.min("lang").alias("lang"), F.min("id").alias("id"))
    codes = _codes(low or 0, high or 0)
    dims = list(codes)
    tie = F.when(F.col("salt") == 0, F.col("crc")).otherwise(F.expr(f"pmod(xxhash64(crc, salt), {1 << _TIE_BITS})"))
    units = materialise(units.select(*unit, "w", *[(c.cast("long") * F.lit(1 << _TIE_BITS) + tie).alias(f"k_{d}") for d, c in codes.items()]))

    ranges, widest0 = {0: (0, n_shards)}, None  # node -> shards it covers
    placed = units.withColumn("node", F.lit(0))
    while open_nodes := [n for n, (a, b) in ranges.items() if b - a > 1]:
        extent = placed.where(F.col("node").isin(open_nodes)) if len(open_nodes) <= 64 else placed
        seen = {r.node: r for r in extent.groupBy("node").agg(F.sum("w").alias("w"), *[f(f"k_{d}").alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "lo"), (F.max, "hi"))]).collect()}
        chosen = []
        for n in open_nodes:
            a, b = ranges[n]
            if r := seen.get(n):
                width = [(r[f"hi_{d}"] >> _TIE_BITS) - (r[f"lo_{d}"] >> _TIE_BITS) for d in dims]
                widest0 = widest0 or [max(1, w) for w in width]
                d = max(range(len(dims)), key=lambda i: (width[i] / widest0[i], -i))
                chosen.append((n, d, r.w * ((b - a) // 2) / (b - a)))
        cuts = _split_keys(placed, spark, chosen, dims) if chosen else {}
        by_dim, new, rules = {n: d for n, d, _ in chosen}, {}, []
        for n, (a, b) in ranges.items():
            if b - a > 1:
                mid = a + (b - a) // 2
                left, right = 2 * n + 1, 2 * n + 2
                new[left], new[right] = (a, mid), (mid, b)
                rules.append((n, by_dim.get(n, 0), cuts.get(n, 0), left, right))
            else:
                new[n] = (a, b)
                rules.append((n, -1, 0, n, n))
        level = small_table(spark, rules, "node int, dim int, cut long, lo int, hi int")
        key_of = F.coalesce(*[F.when(F.col("dim") == i, F.col(f"k_{d}")) for i, d in enumerate(dims)], F.lit(-1))
        placed = placed.join(F.broadcast(level), "node").withColumn("node", F.when(key_of < F.col("cut"), F.col("lo")).otherwise(F.col("hi"))).drop("dim", "cut", "lo", "hi")
        ranges = new
    leaves = small_table(spark, [(n, a) for n, (a, _) in ranges.items()], "node int, shard int")
    unit_shard = placed.join(F.broadcast(leaves), "node").select(*unit, "shard")
    out = rows.join(unit_shard, unit).withColumn("block", F.expr(f"cast(pmod(xxhash64(id, crc, size, source, lang), {max(1, -(-n_rows // slot_rows))}) as int)"))
    out = materialise(out.select("id", "size", "crc", "tkey", "source", "lang", "shard", "block"))
    counts = out.groupBy("shard", "block").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("id", "crc", "size", "tkey", "source", "lang"))
    out = out.withColumn("rank", number).join(starts, ["shard", "block"])
    return out.select(
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
