"""Top-level JSON arrays of objects, read by many tasks however few and large the files are.

Spark's text reader cuts the files into byte ranges at any closing brace, in a string or not. What a range means depends on all before it:
whether it starts inside a string, and how deep. One pass sums up each range for either case (parity of quotes, change of depth, lines,
bytes); the driver composes these few numbers, one row a range, into the state each range starts with. Two more passes cut the elements:
those that lie in one range are rows at once, the pieces of those that cross borders, two a range, are put together by a shuffle of their own.
Any store that Spark reads will do. All or nothing: what isn't an array of objects is an error that names the line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quilt.functions.storage import materialise

_ESCAPED = re.compile(rb"\\.", re.S)
_BETWEEN = re.compile(rb"\s*,\s*(?=\{)")


class MalformedArray(ValueError):
    pass


@dataclass(frozen=True)
class State:
    """Where a range starts: inside a string, how deep, on which line; and whether it is the file's last."""

    inside: int
    depth: int
    line: int
    last: bool = False


def marks(raw: bytes, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(change of depth at each byte, the same for what lies in strings, whether the end lies in a string)."""
    clean = _ESCAPED.sub(b"  ", raw) if b"\\" in raw else raw
    a = np.frombuffer(clean, "u1")
    quote = a == ord('"')
    within = ((np.cumsum(quote) + inside) & 1).astype(bool)
    step = ((a == ord("{")) | (a == ord("["))).astype("i8") - ((a == ord("}")) | (a == ord("]")))
    return np.where(within, 0, step), np.where(within, step, 0), int(within[-1]) if len(a) else inside


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes, bool]]:
    """(range, bytes, whether they begin it), rows parted by the braces that the reader has taken; the last brace is left out."""
    now = None
    for batch in batches:
        files, starts = batch.column(1).to_numpy(), batch.column(2).to_numpy()
        if not len(files):
            continue
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(files)], strict=True):
            key = (int(files[a]), int(starts[a]))
            raw = "}".join(batch.column(0).slice(a, b - a).to_pylist()).encode()
            yield key, raw if key != now else b"}" + raw, key != now
            now = key


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, quotes, outside, within, lines, bytes) of each range, its last brace not counted."""
    out: dict[tuple[int, int], list[int]] = {}
    for key, raw, _ in _ranges(batches):
        sums = out.setdefault(key, [0, 0, 0, 0, 0])
        outside, within, inside = marks(raw, sums[0])
        sums[0] = inside
        sums[1] += int(outside.sum())
        sums[2] += int(within.sum())
        sums[3] += raw.count(b"\n")
        sums[4] += len(raw)
    cols = [list(c) for c in zip(*[(*k, *v) for k, v in out.items()], strict=True)] or [[]] * 7
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["file", "start", "quotes", "outside", "within", "lines", "bytes"])


def compose(rows: list, sizes: dict[int, int], names: dict[int, str]) -> dict[tuple[int, int], State]:
    """The state at the start of each range, from the sums of those before it in its file."""
    out: dict[tuple[int, int], State] = {}
    by_file: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.file, r.start)):
        by_file.setdefault(r.file, []).append(r)
    for file, ranges in by_file.items():
        inside, depth, line, seen = 0, 0, 1, 0
        for i, r in enumerate(ranges):
            last = i == len(ranges) - 1
            out[file, r.start] = State(inside, depth, line, last)
            end = inside ^ r.quotes
            # the brace that ends a range, if there is one, closes something unless a string holds it
            depth += (r.within if inside else r.outside) - (0 if last or end else 1)
            inside, line, seen = end, line + r.lines, seen + r.bytes + (0 if last else 1)
        if inside or depth or seen != sizes[file]:
            what = "a string is open" if inside else "brackets don't match" if depth else "something follows the array"
            raise MalformedArray(f"{names[file]}: {what} at the end, line {line}")
    return out


def _cut(states: dict[tuple[int, int], State], names: dict[int, str], whole: bool):
    """Elements whole (kind 1), or the pieces at both ends of each range (kinds 0 and 2), with file, start, line."""
    fields = [("file", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("line", pa.int64()), ("value", pa.string())]

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        rows = [r for r in rows if (r[2] == 1) == whole]
        cols = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, inside, depth, line, rest, first = None, 0, 0, 1, b"", True

        def closing() -> list[tuple]:
            """What is left of a range when the next begins; its last brace comes back."""
            if key is None:
                return []
            tail, at, out = rest, line, []
            if not states[key].last:
                tail += b"}"
                if not inside and depth == 2:  # the brace ends an element
                    out, at, tail = [piece(tail)], line + tail.count(b"\n"), b""
            return [*out, (*key, 2, at, tail.decode())]

        def piece(raw: bytes) -> tuple:
            if first:
                return (*key, 0, line, raw.decode())
            found = _BETWEEN.match(raw)
            if not found:
                raise MalformedArray(f"{names[key[0]]}: an object of the array should follow a comma, line {line}")
            return (*key, 1, line + raw[: found.end()].count(b"\n"), raw[found.end() :].decode())

        for now, raw, begins in _ranges(batches):
            rows = closing() if begins else []
            if begins:
                key, s = now, states[now]
                inside, depth, line, rest, first = s.inside, s.depth, s.line, b"", True
            step, _, end = marks(raw, inside)
            level = depth + np.cumsum(step)
            at = 0
            for e in (np.flatnonzero((step < 0) & (level == 1)) + 1).tolist():
                whole = rest + raw[at:e]
                rows.append(piece(whole))
                line, rest, at, first = line + whole.count(b"\n"), b"", e, False
            rest += raw[at:]
            inside, depth = end, int(level[-1]) if len(level) else depth
            yield emit(rows)
        yield emit(closing())

    return task


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): each element of the arrays at ``path`` as text, with the line where it starts."""
    text = spark.read.option("lineSep", "}").text(path)
    files = text.select(F.col("_metadata.file_path").alias("name"), F.col("_metadata.file_size").alias("size")).distinct().withColumn("file", F.xxhash64("name")).collect()
    names, sizes = {r.file: r.name for r in files}, {r.file: r.size for r in files}
    rows = text.select("value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    sums = rows.mapInArrow(_sum_up, "file long, start long, quotes long, outside long, within long, lines long, bytes long").collect()
    states = compose(sums, sizes, names)
    # cut twice rather than once and written: the elements are the files' whole text
    cut = lambda whole: rows.mapInArrow(_cut(states, names, whole), "file long, start long, kind int, line long, value string")
    return cut(True).select("file", "line", "value").union(_crossing(materialise(cut(False)), names))


def _crossing(pieces: DataFrame, names: dict[int, str]) -> DataFrame:
    """Elements whose pieces follow each other; the array's own brackets are checked."""
    # pieces up to a head belong together: two rows a range at most
    order = Window.partitionBy("file").orderBy("start", "kind")
    pieces = pieces.withColumn("nth", F.coalesce(F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = pieces.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "line", "value"))).alias("p"), F.max((F.col("kind") == 0).cast("int")).alias("ends"))
    text = joined.select("file", "nth", "ends", F.get("p", F.lit(0))["line"].alias("line"), F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    before = F.when(F.col("nth") == 0, r"^\s*\[\s*").otherwise(r"^\s*,\s*")
    body = F.regexp_replace("value", before, F.lit(""))
    opening = F.substring("value", 1, F.length("value") - F.length(body))
    where = F.concat(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.lit(None).cast("map<bigint,string>"), F.col("file")), F.lit(": line "), F.col("line").cast("string"))
    good = F.when(F.col("ends") == 1, F.regexp_like(F.col("value"), before) & F.startswith(body, F.lit("{"))).when(F.col("nth") == 0, F.regexp_like(F.col("value"), F.lit(r"^\s*\[\s*\]\s*$"))).otherwise(F.regexp_like(F.col("value"), F.lit(r"^\s*\]\s*$")))
    line = F.col("line") + F.length(opening) - F.length(F.replace(opening, F.lit("\n"), F.lit("")))
    checked = F.when(good, body).otherwise(F.raise_error(F.concat(where, F.lit(": an array of objects is expected"))))
    # filtering on the checked text keeps the check where only the closing bracket is left
    return text.select("file", line.alias("line"), checked.alias("value")).where(F.startswith(F.col("value"), F.lit("{")))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Columns of ``schema``, and ``line``; an element that doesn't fit is an error that names its line."""
    parsed = read_elements(spark, path).select("line", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("x"))
    sound = F.when(F.col("x").isNotNull() & F.col("x._bad").isNull(), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("malformed element, line "), F.col("line").cast("string"))))
    return parsed.select("line", sound.alias("x")).select("line", "x.*").drop("_bad")


def write_arrays(objects: DataFrame, path: str) -> None:
    """Objects(value) as files that are one array each, a file for each task."""

    def bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sep = "["
        for batch in batches:
            lines = []
            for value in batch.column(0).to_pylist():
                lines.append(sep + value)
                sep = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["[]" if sep == "[" else "]"], pa.string())], ["value"])

    objects.select("value").mapInArrow(bracketed, "value string").write.text(path)
