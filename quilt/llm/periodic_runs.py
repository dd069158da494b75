"""Periodic run detection by block matching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is at least ``least`` words and two
periods long and that no neighbouring word extends. The first ``length - q`` words of a run occur again q words later, and any stretch
of 2 * 2**k - 1 words holds a whole block of 2**k words that starts at a multiple of 2**k. So the aligned blocks of each power of two are
searched across the document by an Aho-Corasick automaton whose keys are sequences of word numbers; an occurrence at a distance that
belongs to the block's scale is a seed, which exact comparison of words extends in both directions. Every run has such a seed.

Each document is read whole and by itself, without a shuffle; memory grows with the longest document, its automaton being built for
one scale at a time and only where runs of four words recur (others can't lie in a run).

Null texts have no word. Repeated rows, equal ids and null ids each keep their row. Of runs of equal length the one that starts first is
the longest, then the one with the smaller period. Further columns are dropped, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import lean, mix64

#: A run shorter than this is none, whatever its period.
LEAST = 12
#: Words of the stretches that must recur before a block is searched at all; every run holds such stretches if ``least`` is twice as long.
GRAM = 4

Run = tuple[int, int, int]


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal if the words are."""
    different = dict.fromkeys(words)
    number = dict(zip(different, range(len(different)), strict=True))
    return np.fromiter(map(number.__getitem__, words), "i8", len(words))


def recurring(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches made of word sequences that occur more than once; a clash of hashes only adds to them."""
    n = len(ids) - GRAM + 1
    if n < 2:
        return []
    h = np.zeros(n, "u8")
    for k in range(GRAM):
        h = mix64(h + ids[k : k + n].astype("u8") + np.uint64(1))
    order = np.argsort(h)
    h = h[order]
    twice = np.flatnonzero(h[1:] == h[:-1])
    if not len(twice):
        return []
    again = np.zeros(n + 2, "i1")
    again[order[twice] + 1] = again[order[twice + 1] + 1] = 1
    edge = np.flatnonzero(np.diff(again))
    return [(int(a), int(b) + GRAM - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def scales(q: np.ndarray, least: int) -> np.ndarray:
    """The largest power of two whose aligned blocks the first stretch of a run of period q must hold."""
    window = np.maximum(q, least - q)
    return np.left_shift(1, np.frexp((window + 1) // 2)[1] - 1)


def seeds(ids: np.ndarray, stretches: list[tuple[int, int]], size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(block's start, distance) of every occurrence of an aligned block up to ``most`` words after it."""
    blocks = [(j, tuple(ids[j : j + size].tolist())) for a, b in stretches for j in range(-(-a // size) * size, b - size + 1, size)]
    if not blocks:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    starts, keys = np.empty(len(blocks), "i8"), np.empty(len(blocks), "i8")
    for i, (j, key) in enumerate(blocks):
        starts[i], keys[i] = j, automaton.get(key, i)  # equal blocks go by the first one's number
        if keys[i] == i:
            automaton.add_word(key, i)
    del blocks
    automaton.make_automaton()
    found = [(a + end - size + 1, key) for a, b in stretches if b - a >= size for end, key in automaton.iter(tuple(ids[a:b].tolist()))]
    at, which = np.array(found, "i8").reshape(-1, 2).T
    wide = np.int64(len(ids) + 1)
    place = np.sort(which * wide + at)
    first = np.searchsorted(place, keys * wide + starts, side="right")
    last = np.searchsorted(place, keys * wide + np.minimum(starts + most, len(ids)), side="right")
    n = np.maximum(last - first, 0)
    block = np.repeat(np.arange(len(starts)), n)
    hit = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return starts[block], place[hit] % wide - starts[block]


def extend(ids: np.ndarray, j: int, q: int, size: int) -> tuple[int, int]:
    """(start, end) of the widest stretch of period q around words j to j + q + size, of which the first ``size`` recur."""
    n, i, step = len(ids), j + size, 32
    while i + q < n:
        c = min(step, n - q - i)
        differ = ids[i : i + c] != ids[i + q : i + q + c]
        k = int(differ.argmax())
        if differ[k]:
            i += k
            break
        i, step = i + c, min(2 * step, 1 << 16)
    end, i, step = i + q, j, 32
    while i > 0:
        c = min(step, i)
        differ = ids[i - c : i][::-1] != ids[i - c + q : i + q][::-1]
        k = int(differ.argmax())
        if differ[k]:
            i -= k
            break
        i, step = i - c, min(2 * step, 1 << 16)
    return i, end


def runs(ids: np.ndarray, least: int = LEAST) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    if least < 2 * GRAM:
        raise ValueError(f"runs of fewer than {2 * GRAM} words aren't told by recurring stretches")
    n = len(ids)
    stretches = recurring(ids) if n >= least else []
    found: dict[tuple[int, int], int] = {}
    size = int(scales(np.arange(1, least), least).min())
    while stretches and (size < least or 2 * size - 1 <= n // 2):
        most = min(max(4 * size - 2, least - 1), n // 2)
        j, q = seeds(ids, stretches, size, most)
        mine = scales(q, least) == size
        j, q = j[mine], q[mine]
        order = np.lexsort((j, q))
        j, q = j[order], q[order]
        wide = np.int64(n + 1)
        place, done = q * wide + j, np.zeros(len(j), bool)

        def told(start: int, end: int, period: int, place=place, done=done, size=size, most=most, wide=wide) -> None:
            """Seeds inside a stretch at multiples of its period would find it again."""
            m = np.arange(period, min(most, end - start - size) + 1, period)
            first, last = np.searchsorted(place, m * wide + start), np.searchsorted(place, m * wide + end - m - size + 1)
            for a, b in zip(first[first < last].tolist(), last[first < last].tolist(), strict=True):
                done[a:b] = True

        if len(j):
            for (start, end), period in list(found.items()):
                told(start, end, period)
        for k in range(len(j)):
            if not done[k]:
                period = int(q[k])
                start, end = extend(ids, int(j[k]), period, size)
                if end - start >= max(least, 2 * period):
                    found[start, end] = min(period, found.get((start, end), period))
                    told(start, end, period)
                else:
                    a, b = np.searchsorted(place, (period * wide + start, period * wide + end - period - size + 1))
                    done[a:b] = True
        size *= 2
    return sorted((start, end - start, period) for (start, end), period in found.items())


def collapse(words: list[bytes], of: list[Run]) -> list[bytes]:
    """The words, each run reduced to its first period."""
    drop = np.zeros(len(words), bool)
    for start, length, period in of:
        drop[start + period : start + length] = True
    return [w for w, gone in zip(words, drop.tolist(), strict=True) if not gone]


OUT = "runs array<struct<start:bigint,length:bigint,period:bigint>>, n_words bigint, collapsed string"


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, runs, n_words, collapsed): all runs of each text by start and period, and the text without their repetitions, words parted by a space."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                every, counts, kept = [], [], []
                for x in piece.column(1):
                    words = (x.as_py() or "").encode().split()  # bytes split at space and U+0009 to U+000D
                    got = runs(numbered(words), least)
                    every.append([{"start": s, "length": l, "period": p} for s, l, p in got])
                    counts.append(len(words))
                    kept.append(b" ".join(collapse(words, got) if got else words).decode())
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(every, of), pa.array(counts, pa.int64()), pa.array(kept, pa.string())], ["id", "runs", "n_words", "collapsed"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(lean(task), f"id {kind}, {OUT}").withColumnRenamed("id", key)


# the query


def planted(doc_id: Column, text: Column) -> Column:
    """The text, periodic from some word on where a hash of the id says so: word i from a on becomes word a + (i - a) % p. Null ids are left alone."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.when(n > 0, F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))), " ")).otherwise(text)

    # the array of one element gives the words a name inside the lambda, so that they are split once
    once = F.transform(F.array(F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))), periodic)[0]
    return F.when(h % 10 == 0, once).otherwise(text)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_runs, the longest run, digests of the runs and of the collapsed text) of the texts after :func:`planted`."""
    edited = docs.select(F.col(key), planted(F.col(key), F.col(text)).alias(text))
    found = detect(edited, key, text)
    # sorting brings the greatest length first, then the smallest start and period
    best = F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    top = F.get(F.col("best"), F.lit(0))
    length = -top["less"]
    return found.withColumn("best", best).select(
        key,
        F.size("runs").cast("long").alias("n_runs"),
        top["start"].alias("start"),
        length.alias("length"),
        top["period"].alias("period"),
        F.floor(length * 1000 / top["period"]).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
