"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of each whole text are taken in one scan. Their transformed and standardised values go through cosines of random
projections, which approximate a Gaussian kernel; every partition sums its share of the normal equations, and the summed
system, whose size is fixed by the number of features, is solved once. Scores of a further part of the labelled rows are calibrated
by isotonic regression over fixed score bins. All labelled rows that may be learned from are used.

Edge cases: a null text counts as empty; empty texts are scored from their statistics; rows with a null id or a null label are scored but not
learned from; without usable labels every score is 0.5; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import materialise, text_bytes, word_hashes, word_spans

STATISTICS = ["n_bytes", "n_words", "word_bytes", "symbols", "exclamations", "upper", "digits", "punctuation", "wide", "lines", "full_stops", "distinct_words", "repeated_lines", "longest_line"]
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"


def _class(test) -> np.ndarray:
    return np.array([test(c) for c in range(256)], bool)


_CLASSES = {
    "symbols": _class(lambda c: c in SYMBOLS),
    "exclamations": _class(lambda c: c == ord("!")),
    "upper": _class(lambda c: ord("A") <= c <= ord("Z")),
    "digits": _class(lambda c: ord("0") <= c <= ord("9")),
    "punctuation": _class(lambda c: 0x21 <= c < 0x7F and not chr(c).isalnum()),
    "wide": _class(lambda c: c >= 0xC0),
    "lines": _class(lambda c: c == 0x0A),
    "full_stops": _class(lambda c: c == ord(".")),
}


def distinct_per_group(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Distinct 64-bit values in each group; the group number is folded into the value, so one plain sort suffices."""
    if not len(values):
        return np.zeros(n, "i8")
    order = np.sort((values & np.uint64((1 << 40) - 1)) | (group.astype("u8") << np.uint64(40)))
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    return np.bincount((order[new] >> np.uint64(40)).astype("i8"), minlength=n)


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Transformed statistics, one row a text, columns as in STATISTICS; every value is finite."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    counts = {}
    for name, table in _CLASSES.items():
        at = np.zeros(len(raw) + 1, "i4")
        np.cumsum(table[raw], out=at[1:])
        counts[name] = (at[offsets[1:]] - at[offsets[:-1]]).astype("f8")
    start, end, doc = word_spans(raw, offsets)
    words = np.bincount(doc, minlength=n).astype("f8")
    chars = np.bincount(doc, weights=(end - start).astype("f8"), minlength=n)
    distinct = distinct_per_group(word_hashes(raw, start, end), doc, n).astype("f8")
    breaks = np.flatnonzero(raw == 0x0A)
    begins = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    begins = begins[begins < len(raw)]
    if len(begins):
        ends = np.append(begins[1:], len(raw))
        owner = np.searchsorted(offsets, begins, side="right") - 1
        lines = distinct_per_group(word_hashes(raw, begins, ends, lower=False), owner, n).astype("f8")
        per_doc = np.bincount(owner, minlength=n).astype("f8")
        longest = np.zeros(n)
        np.maximum.at(longest, owner, (ends - begins).astype("f8"))
    else:
        lines = per_doc = longest = np.zeros(n)
    many, w = np.maximum(size, 1), np.maximum(words, 1)
    share = lambda x, of: np.log1p(100 * x / of)
    return np.column_stack(
        [np.log1p(size), np.log1p(words), np.log1p(chars / w), share(counts["symbols"], w), share(counts["exclamations"], w), share(counts["upper"], many), share(counts["digits"], many)]
        + [share(counts["punctuation"], many), share(counts["wide"], many), share(counts["lines"], w), share(counts["full_stops"], w), distinct / w, 1 - lines / np.maximum(per_doc, 1), np.log1p(longest)]
    )


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = 8 << 20) -> DataFrame:
    """(id, x array<double>): statistics of every whole text, in pieces of about ``piece`` bytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = text_bytes(b.column(1))
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + piece, side="right")) - 1)
                part = b.slice(at, to - at)
                x = statistics(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], names=["id", "x"])
                at = to

    return docs.select(F.col(key).alias("id"), text).mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, x array<double>")


class Fourier:
    """z(x) = sqrt(2 / n) cos(W (x - centre) / scale + b), and a constant."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, n: int, width: float, seed: int):
        r = np.random.default_rng(seed)
        self.centre, self.scale, self.n = centre, scale, n
        self.w, self.b = r.normal(0, 1 / width, (len(centre), n)), r.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / self.n) * np.cos(z @ self.w + self.b), np.ones(len(x))])


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators; (x, fitted y) at the pools' ends."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        pools.append([xi, xi, yi, wi])
        while len(pools) > 1 and pools[-2][2] >= pools[-1][2]:
            _, hi, y2, w2 = pools.pop()
            p = pools[-1]
            p[1], p[2], p[3] = hi, (p[2] * p[3] + y2 * w2) / (p[3] + w2), p[3] + w2
    xs = [v for p in pools for v in p[:2]]
    ys = [p[2] for p in pools for _ in range(2)]
    return np.array(xs), np.array(ys)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", features: int = 256, width: float = 4.0, ridge: float = 1e-2, bins: int = 1024, seed: int = 7) -> DataFrame:
    """(key, held_out, score) for every row of ``docs``.

    Rows with crc32(id as text) mod 4 equal to 2 are held out. Remainders 0 and 1 fit the ridge system, remainder 3 the calibration.
    """
    fold = (F.crc32(F.col("id").cast("string").cast("binary")) % 4).alias("fold")
    stats = materialise(measure(docs, key, text))
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = materialise(stats.select("id", "x", fold).where("fold <> 2").join(known, "id").select("x", "y", "fold"))
    width_x = len(STATISTICS)
    fit = known.where("fold <> 3")
    sums = fit.agg(F.count("*"), *[F.avg(F.col("x")[i]) for i in range(width_x)], *[F.stddev_pop(F.col("x")[i]) for i in range(width_x)], F.min("y"), F.max("y")).first()
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")
    if not sums[0] or sums[-1] == sums[-2]:
        return stats.select(F.col("id").alias(key), held, F.lit(0.5 if not sums[0] else float(sums[-1])).alias("score"))
    centre, scale = np.array(sums[1 : 1 + width_x]), np.maximum(np.array(sums[1 + width_x : 1 + 2 * width_x]), 1e-3)
    model = Fourier(centre, scale, features, width, seed)
    m = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((m, m + 1))
        for b in batches:
            z = model(matrix(b.column(0)))
            total += z.T @ np.column_stack([z, np.asarray(b.column(1))])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * (m + 1))
        for b in batches:
            for part in b.column(0):
                total += np.frombuffer(part.as_buffer(), "f8")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = fit.select("x", "y").mapInArrow(equations, "part binary").repartition(8).mapInArrow(added, "part binary")
    total = sum(np.frombuffer(r.part, "f8") for r in parts.collect()).reshape(m, m + 1)
    system = total[:, :m] + ridge * sums[0] / features * np.diag([1.0] * features + [0.0])
    beta = np.linalg.solve(system, total[:, m])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(matrix(b.column(1))) @ beta)], names=[b.schema.names[0], "raw"])

    calibrate = known.where("fold = 3").select("y", "x").mapInArrow(raw, "y double, raw double")
    binned = calibrate.groupBy(F.floor((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (bins / 2)).alias("bin")).agg(F.avg("raw").alias("r"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if binned:
        xs, ys = isotonic(*(np.array([b[k] for b in binned], "f8") for k in ("r", "y", "n")))
    else:
        xs, ys = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = np.clip(np.interp(model(matrix(b.column(2))) @ beta, xs, ys), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], names=[key, "held_out", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return stats.select("id", held, "x").mapInArrow(final, f"`{key}` {kind}, held_out boolean, score double")
