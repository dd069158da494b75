"""Helpers shared by the training-data operators: tables, checkpoints, byte-level word scanning in numpy."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``; a local one is set only where that is unset (tests).
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows from the driver, made of one literal, so that no Python worker takes part."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kind = ", ".join(f"{n}: {c.strip().split(' ')[1]}" for n, c in zip(names, schema.split(","), strict=True))
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kind}>>")).alias("x")).select("x.*")


def release(spark: SparkSession) -> None:
    """Let go of finished rounds' shuffle files now; they go only once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return a Python worker's free memory to the machine: workers stay alive between stages and would keep what their largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose worker gives its memory back at the end of each task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of ``df`` in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def without(rows: DataFrame, gone: DataFrame, on: dict[str, str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """``rows`` that have no match in ``gone``; nulls match nulls. on: column of rows -> column of gone.

    What goes is broadcast only if counted to be few, so that rows with long texts stay where they are; else both sides are shuffled.
    """
    names = fresh(rows, *[f"_gone_{i}" for i in range(len(on))])
    gone = materialise(gone.select(*[F.col(b).alias(n) for b, n in zip(on.values(), names, strict=True)]))
    match = F.lit(True)
    for a, n in zip(on, names, strict=True):
        match = match & F.col(a).eqNullSafe(F.col(n))
    return rows.join(F.broadcast(gone) if gone.count() <= broadcast_rows else gone, match, "left_anti")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, "u1"), np.zeros(1, "i8")
    at = np.frombuffer(offsets, "i8" if wide else "i4")[column.offset : column.offset + len(column) + 1].astype("i8")
    raw = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return raw[at[0] : at[-1]], at - at[0]


#: Odd multiplier of the word hash, its inverse modulo 2**64, and mixing multipliers. Any odd numbers do.
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_tables: dict[str, np.ndarray] = {}


def _power_table(kind: str, n: int) -> np.ndarray:
    if kind not in _tables or len(_tables[kind]) < n:
        _tables[kind] = _powers(_BASE if kind == "up" else _BASE_INVERSE, max(n, 1 << 19))
    return _tables[kind][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document index) of every word of the concatenated texts; words never cross texts."""
    if not len(raw):
        z = np.zeros(0, "i8")
        return z, z, z
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True, segment: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each word, from a prefix sum over the bytes of each segment."""
    out = np.empty(len(start), "u8")
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + segment)))
        out[i:j] = _hash_segment(raw[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i], lower)
        i = j
    return out


def _hash_segment(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    data = (_LOWER[raw] if lower else raw).astype("u8") + np.uint64(1)
    data = mix64(data) * _power_table("up", len(raw))
    sums = np.zeros(len(raw) + 1, "u8")
    np.cumsum(data, out=sums[1:])
    down = _power_table("down", len(raw))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype("u8") * _MIX2)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, document index) of each run of ``size`` lower-cased words; a shorter text is one run, none if it has no word."""
    start, end, doc = word_spans(raw, offsets)
    h = word_hashes(raw, start, end)
    counts = np.bincount(doc, minlength=len(offsets) - 1) if len(doc) else np.zeros(len(offsets) - 1, "i8")
    n = len(h) - size + 1
    if n > 0:
        acc = np.zeros(n, "u8")
        for k in range(size):
            acc = acc * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        whole = doc[:n] == doc[size - 1 :]
        runs, at = mix64(acc[whole]), doc[:n][whole]
    else:
        runs, at = np.zeros(0, "u8"), np.zeros(0, "i8")
    few = np.flatnonzero((counts > 0) & (counts < size))
    if len(few):
        begins = np.concatenate([[0], np.cumsum(counts)])
        extra = np.zeros(len(few), "u8")
        for i, d in enumerate(few):
            acc = np.uint64(counts[d])
            for x in h[begins[d] : begins[d + 1]]:
                acc = np.uint64((int(acc) * 0xD6E8FEB86659FD93 + int(x)) & 0xFFFFFFFFFFFFFFFF)
            extra[i] = acc
        runs, at = np.concatenate([runs, mix64(extra)]), np.concatenate([at, few])
        order = np.argsort(at, kind="stable")
        runs, at = runs[order], at[order]
    return runs, at


def squeeze(*arrays: np.ndarray) -> bytes:
    """Integer arrays as one compressed blob, byte plane by byte plane, so that rarely used high bytes cost little."""
    import zstandard

    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.itemsize, len(a))]], "i8").tobytes()
    planes = b"".join(np.ascontiguousarray(a.view("u1").reshape(len(a), a.dtype.itemsize).T).tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(head + planes)


def unsqueeze(blob) -> list[np.ndarray]:
    """The arrays of :func:`squeeze`, unsigned."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, "i8", 1)[0])
    sizes = np.frombuffer(data, "i8", 2 * n, 8).reshape(n, 2).tolist()
    out, at = [], 8 + 16 * n
    for width, count in sizes:
        planes = np.frombuffer(data, "u1", width * count, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(f"u{width}").reshape(count))
        at += width * count
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", broadcast_rows: int = 1_000_000) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link to another; alternating large and small stars.

    Every round is one job of map-side combined minima and equi-joins; links stay distributed. The table of minima is broadcast only
    while the links were counted to be few. Self-links and repeated links are fine.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    before = None
    while True:
        seen = Observation()
        e = materialise(e.observe(seen, F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")))
        now = seen.get
        if now == before:
            break
        before = now
        few = (lambda x: F.broadcast(x)) if now["n"] <= broadcast_rows else (lambda x: x)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(few(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(few(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
