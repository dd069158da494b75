"""Exact removal of long repeats by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a smaller id, or earlier in the same text). Suffixes are
sampled at minimisers: of every window of ``length`` bytes, the leftmost 32-byte string with the least hash is its anchor, so equal windows
have equal anchors. All windows of one anchor form a block, at most ``2 * length - 32`` bytes that hold the whole neighbourhood of
the suffix that matters. Suffixes are ordered by the fingerprint of their leading 32 bytes, then by that of their block.

Every batch of documents yields one suffix array, cut into buckets by fingerprint. The owner of a bucket keeps a family of arrays whose
sizes are powers of two of a batch: a new batch is merge-scanned against each level, the later of two equal blocks is reported as a repeat
and leaves, and arrays of equal size class merge. Where suffixes share their leading bytes but not their block (the ends of long
matches), the blocks' windows go through a second family one by one. Only first occurrences stay in a family, and batches send
each block once, so a passage in a third of all documents is one entry; fingerprints have 128 bits.

Edge cases: null and empty texts, and those shorter than ``length``, lose nothing; texts of any length are read whole; rows with a null id are
returned whole and never matched; rows that repeat an id and its text are copies of one row and not matched with each other; rows with equal
ids and different texts are documents of their own, one after another by the hash of their texts; ties can't occur, since no two places are
equal in this order; further columns go through untouched, helper columns get free names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import _power_table, fresh, lean, materialise, mix64, squeeze, text_bytes, unsqueeze
from quilt.llm.ngram_join import pieces

GRAM = 32
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each position."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, "u8")
    raw = np.ascontiguousarray(raw)
    loads = np.ndarray((n + 24,), "<u8", raw.data, 0, (1,)).copy()
    h = loads[:n] * _M[0]
    for k in range(1, 4):
        h ^= h >> np.uint64(29)
        h += loads[8 * k : 8 * k + n] * _M[k]
    return mix64(h)


def leftmost_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the position of its leftmost minimum."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, "i8")
    rows = -(-len(h) // w)
    x = np.full(rows * w, np.iinfo("u8").max, "u8")
    x[: len(h)] = h
    x = x.reshape(rows, w)
    before = np.minimum.accumulate(x, axis=1)
    after = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1]
    column = np.arange(w, dtype="i2")
    fresh = np.zeros((rows, w), "i2")
    fresh[:, 1:] = np.where(before[:, 1:] < before[:, :-1], column[1:], 0)
    at_before = np.maximum.accumulate(fresh, axis=1)
    at_after = np.minimum.accumulate(np.where(x == after, column, np.int16(w - 1))[:, ::-1], axis=1)[:, ::-1]
    base = np.arange(rows, dtype="i8")[:, None] * w
    left, right = after.ravel()[:n], before.ravel()[w - 1 : w - 1 + n]
    return np.where(left <= right, (base + at_after).ravel()[:n], (base + at_before).ravel()[w - 1 : w - 1 + n])


def spans_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    data = mix64(raw.astype("u8") + np.uint64(1)) * _power_table("up", len(raw))
    sums = np.zeros(len(raw) + 1, "u8")
    np.cumsum(data, out=sums[1:])
    return mix64((sums[end] - sums[start]) * _power_table("down", len(raw))[start] + (end - start).astype("u8") * _M[1])


#: alt tells texts that share an id apart; it is 0 for all others, and then costs nothing when entries are packed.
ENTRY = np.dtype([("key", "u8"), ("block", "u8"), ("doc", "i8"), ("alt", "u8"), ("at", "u4"), ("n", "u2"), ("d", "u2")])
#: The order of places in the corpus.
PLACE = ("doc", "alt", "at")


def precedes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each place in ``a`` comes before the one in ``b``."""
    return (a["doc"] < b["doc"]) | ((a["doc"] == b["doc"]) & ((a["alt"] < b["alt"]) | ((a["alt"] == b["alt"]) & (a["at"] < b["at"]))))


def entries(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, alts: np.ndarray, length: int, segment: int = 1 << 18) -> np.ndarray:
    """The blocks of all texts: fingerprints, id, first window's start and number of windows."""
    out = []
    total = len(raw)
    for lo in range(0, max(0, total - length + 1), segment):
        hi = min(lo + segment, total - length + 1)
        part = raw[lo : hi + length - 1]
        h = gram_hashes(part)
        anchor = leftmost_minima(h, length - GRAM + 1)
        start = np.arange(lo, hi)
        a, z = np.searchsorted(offsets, [lo, hi - 1], side="right") - 1
        owner = np.repeat(np.arange(a, z + 1), np.diff(np.clip(offsets[a : z + 2], lo, hi)))  # the text of each window start
        valid = start + length <= offsets[owner + 1]
        new = np.ones(hi - lo, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
        new &= valid
        first = np.flatnonzero(new)
        if not len(first):
            continue
        cut = np.flatnonzero(new | ~valid)
        last = np.append(cut, hi - lo)[np.searchsorted(cut, first) + 1] if len(cut) else np.full(len(first), hi - lo)
        e = np.zeros(len(first), ENTRY)
        # least hashes are small numbers; mixed once more they spread evenly over the buckets
        e["key"], e["block"] = mix64(h[anchor[first]] ^ _M[3]), spans_hash(part, first, last - 1 + length) + (anchor[first] - first).astype("u8") * _M[2]
        e["doc"], e["alt"], e["at"], e["n"], e["d"] = ids[owner[first]], alts[owner[first]], first + lo - offsets[owner[first]], last - first, anchor[first] - first
        out.append(e)
    return np.concatenate(out) if out else np.zeros(0, ENTRY)


#: Windows of a block that go to one owner together, by their distance from the anchor, so that a hot anchor is spread over several owners.
_STRIDE = 16


def pack_windows(raw: np.ndarray, docs: np.ndarray, alts: np.ndarray, start: np.ndarray, n: np.ndarray, d: np.ndarray, at: np.ndarray, length: int, buckets: int) -> Iterator[tuple[int, bytes]]:
    """Blocks with the fingerprint of each of their windows, by owner. start: where a block begins in raw; at: in its own text."""
    # cut blocks where the windows' distance from the anchor passes a multiple of the stride
    steps = (d.astype("i8") // _STRIDE) - ((d.astype("i8") - n + 1) // _STRIDE) + 1
    b = np.repeat(np.arange(len(n)), steps)
    k = np.arange(len(b)) - np.repeat(np.cumsum(steps) - steps, steps)
    top = np.minimum(d[b].astype("i8"), (d[b].astype("i8") // _STRIDE - k) * _STRIDE + _STRIDE - 1)
    bottom = np.maximum(d[b].astype("i8") - n[b] + 1, (d[b].astype("i8") // _STRIDE - k) * _STRIDE)
    skip, count = d[b].astype("i8") - top, top - bottom + 1
    key = spans_hash(raw, start[b] + d[b], start[b] + d[b] + GRAM)
    owner = (mix64(key + (top // _STRIDE).astype("u8") * _M[3]) >> np.uint64(20)) % np.uint64(buckets)
    by = np.argsort(owner, kind="stable")
    b, skip, count, key, owner = b[by], skip[by], count[by], key[by], owner[by]
    first = start[b] + skip
    w = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    prints = spans_hash(raw, w, w + length)
    ends = np.cumsum(count)
    cuts = np.searchsorted(owner, np.arange(buckets + 1, dtype="u8"))
    for o in range(buckets):
        x, y = cuts[o], cuts[o + 1]
        if y > x:
            lo, hi = (ends[x - 1] if x else 0), ends[y - 1]
            yield o, squeeze(key[x:y], docs[b[x:y]], alts[b[x:y]], (at[b[x:y]] + skip[x:y]).astype("u4"), count[x:y].astype("u2"), prints[lo:hi])


def unpack_windows(blob) -> np.ndarray:
    """One entry a window; its key mixes the anchor's fingerprint with the window's, so that keys hardly repeat."""
    key, doc, alt, at, count, prints = unsqueeze(blob)
    e = np.zeros(len(prints), ENTRY)
    count = count.astype("i8")
    e["key"], e["block"], e["doc"], e["alt"], e["n"] = mix64(np.repeat(key, count) + prints * _M[1]), prints, np.repeat(doc.view("i8"), count), np.repeat(alt, count), 1
    e["at"] = np.repeat(at.astype("i8"), count) + np.arange(len(prints)) - np.repeat(np.cumsum(count) - count, count)
    return e


def order(e: np.ndarray) -> np.ndarray:
    """Sorted as a suffix array, by key and block; equal blocks by their place in the corpus.

    The leading bits of the key are sorted together with the row number in one plain sort; the few runs that agree in these bits are put right afterwards.
    """
    n = len(e)
    if n < 2:
        return e
    bits = np.uint64(max(1, (n - 1).bit_length()))
    packed = np.sort(e["key"] >> bits << bits | np.arange(n, dtype="u8"))
    e = e[(packed & np.uint64((1 << int(bits)) - 1)).astype("i8")]
    same = packed[1:] >> bits == packed[:-1] >> bits
    if same.any():
        run = np.zeros(n, bool)
        run[1:] |= same
        run[:-1] |= same
        part = e[run]
        e[run] = part[np.lexsort((*[part[c] for c in reversed(PLACE)], part["block"], part["key"]))]
    return e


def first_of_each(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first occurrence of each block, the others) of a sorted array."""
    if not len(e):
        return e, e
    again = np.zeros(len(e), bool)
    again[1:] = (e["key"][1:] == e["key"][:-1]) & (e["block"][1:] == e["block"][:-1])
    head = np.maximum.accumulate(np.where(again, 0, np.arange(len(e))))
    same_row = np.logical_and.reduce([e[c] == e[c][head] for c in PLACE])
    return e[~again], e[again & ~same_row]


class Family:
    """Suffix arrays in levels of geometrically growing size; equal blocks are in at most one level."""

    def __init__(self) -> None:
        self.levels: dict[int, np.ndarray] = {}

    def add(self, batch: np.ndarray) -> Iterator[np.ndarray]:
        """Merge-scan a sorted batch without repeats against every level; yields entries found to be repeats."""
        for k, level in list(self.levels.items()):
            alive_level, alive_batch = np.ones(len(level), bool), np.ones(len(batch), bool)
            # suffixes with equal leading bytes adjoin; within such a run the block is found by bisection
            keys = np.ascontiguousarray(level["key"])
            low = np.searchsorted(keys, batch["key"])
            i = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == batch["key"]) if len(keys) else np.zeros(0, "i8")
            if len(i):
                high = np.searchsorted(keys, batch["key"][i], side="right")
                j = _lower_bound(level["block"], batch["block"][i], low[i], high)
                there = (j < high) & (level["block"][np.minimum(j, len(level) - 1)] == batch["block"][i])
                i, j = i[there], j[there]
                mine, theirs = batch[i], level[j]
                later, earlier = precedes(theirs, mine), precedes(mine, theirs)
                alive_batch[i[~earlier]] = False
                alive_level[j[earlier]] = False
                yield batch[i[later]]
                yield level[j[earlier]]
            if not alive_level.all():
                self.levels[k] = level[alive_level]
            batch = batch[alive_batch]
        self._insert(batch)

    def _insert(self, array: np.ndarray) -> None:
        if not len(array):
            return
        k = len(array).bit_length()
        while k in self.levels:
            array = order(np.concatenate([self.levels.pop(k), array]))
            k = len(array).bit_length()
        self.levels[k] = array

    def merged(self) -> np.ndarray:
        return order(np.concatenate(list(self.levels.values()))) if self.levels else np.zeros(0, ENTRY)


def _lower_bound(values: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The first place in each [low, high) whose value is not below the wanted one, by bisection for all at once."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        below = open_ & (values[np.minimum(mid, len(values) - 1)] < wanted)
        low = np.where(below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    return low


#: Entries that an owner gathers before it sorts them as one batch of its family.
BATCH = 1 << 17


def gathered(batches: Iterator[pa.RecordBatch], read) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(bucket, entries, whether they end the bucket) in runs of about BATCH entries; the task's rows are sorted by bucket."""
    now, held, size = None, [], 0
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if held and (bucket != now or size >= BATCH):
                yield now, np.concatenate(held), bucket != now
                held, size = [], 0
            now = bucket
            held.append(read(blob.as_buffer()))
            size += len(held[-1])
    if held:
        yield now, np.concatenate(held), True


_FOUND = "kind int, doc long, alt long, run long"
#: Kinds of rows between the passes.
REPEAT, OPEN = 0, 1


def _found(kind: int, e: np.ndarray) -> pa.RecordBatch:
    """Blocks as rows; a run is start << 32 | anchor's distance << 16 | number of windows."""
    run = e["at"].astype("i8") << 32 | e["d"].astype("i8") << 16 | e["n"].astype("i8")
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(e), kind, "i4")), pa.array(e["doc"].astype("i8")), pa.array(e["alt"].astype("u8").view("i8")), pa.array(run)], names=["kind", "doc", "alt", "run"])


def pack(e: np.ndarray) -> bytes:
    """Entries column by column, compressed."""
    base = e["doc"].min() if len(e) else np.int64(0)
    return squeeze(np.array([base], "i8"), *[np.ascontiguousarray(e[c]) for c in ("key", "block", "alt", "at", "n", "d")], (e["doc"] - base).astype("u8"))


def unpack(blob) -> np.ndarray:
    base, key, block, alt, at, n, d, doc = unsqueeze(blob)
    e = np.empty(len(key), ENTRY)
    e["key"], e["block"], e["alt"], e["at"], e["n"], e["d"], e["doc"] = key, block, alt, at, n, d, doc.view("i8") + base.view("i8")[0]
    return e


def _send(e: np.ndarray, buckets: int) -> Iterator[tuple[int, bytes]]:
    """A sorted array, cut into buckets by the top of its key."""
    cuts = np.searchsorted(e["key"], np.array([(b << 64) // buckets for b in range(buckets)], "u8"))
    for b, (x, y) in enumerate(zip(cuts, [*cuts[1:], len(e)], strict=True)):
        if y > x:
            yield b, pack(e[x:y])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task of a bucket's owner: one family; repeats, and first blocks whose leading bytes also stand before another block."""

    def close(family: Family) -> Iterator[pa.RecordBatch]:
        e = family.merged()
        if len(e):
            same = e["key"][1:] == e["key"][:-1]
            mixed = np.zeros(len(e), bool)
            mixed[1:] |= same
            mixed[:-1] |= same
            yield _found(OPEN, e[mixed])

    family = Family()
    for bucket, e, ends in gathered(batches, unpack):
        if bucket < 0:
            yield _found(REPEAT, e)
            continue
        kept, again = first_of_each(order(e))
        for found in (again, *family.add(kept)):
            if len(found):
                yield _found(REPEAT, found)
        if ends:
            yield from close(family)
            family = Family()


def _own_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for single windows; there is nothing left open."""
    family = Family()
    for _, e, ends in gathered(batches, unpack_windows):
        kept, again = first_of_each(order(e))
        for found in (again, *family.add(kept)):
            if len(found):
                yield _found(REPEAT, found)
        if ends:
            family = Family()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjoining and overlapping runs of windows of each document as one: start << 32 | number of windows."""
    for b in batches:
        out = []
        for runs in b.column(2):
            x = np.sort(np.asarray(runs.values, "i8"))
            start = x >> 32
            reach = np.maximum.accumulate(start + (x & 0xFFFF))
            new = np.ones(len(x), bool)
            new[1:] = start[1:] > reach[:-1]
            stop = reach[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]
            out.append(start[new] << 32 | (stop - start[new]))
        lengths = np.array([len(x) for x in out], "i4")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, "i8")))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["doc", "alt", "runs"])


def _batch(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.binary())], names=["bucket", "blob"])


def _emit(e: np.ndarray, buckets: int) -> pa.RecordBatch:
    kept, again = first_of_each(order(e))
    out = list(_send(kept, buckets))
    if len(again):
        out.append((-1, pack(again)))
    return _batch(out)


#: Bytes of text whose entries one bucket holds in memory, where the input is large.
BUCKET_BYTES = 32 << 20


def survey(docs: DataFrame, key: str, text: str) -> tuple[DataFrame | None, int]:
    """(ids that stand with different texts, if there are any; bytes of all texts)."""
    rows = docs.where(F.col(key).isNotNull())
    marks = rows.select(F.col(key).cast("long").alias("several"), F.xxhash64(text).alias("h")).groupBy("several").agg(F.min("h").alias("x"), F.max("h").alias("y"))
    several = materialise(marks.where("x <> y").select("several"))
    return (None if several.isEmpty() else several), docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def with_alt(rows: DataFrame, several: DataFrame | None, key: str, text: str, name: str, broadcast_rows: int) -> DataFrame:
    """``rows`` with a column that tells texts of one id apart: a hash of the text where the id has several, else 0."""
    if several is None:
        return rows.withColumn(name, F.lit(0).cast("long"))
    (mark,) = fresh(rows, "_several")
    ids = several.select(F.col("several").alias(mark))
    joined = rows.join(F.broadcast(ids) if ids.count() <= broadcast_rows else ids, F.col(key).cast("long") == F.col(mark), "left")
    return joined.withColumn(name, F.when(F.col(mark).isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop(mark)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, buckets: int | None = None, batch_bytes: int = 8 << 20, broadcast_rows: int = 2_000_000, known: tuple[DataFrame | None, int] | None = None) -> DataFrame:
    """(doc, alt, runs array<long>): start << 32 | number of every maximal run of removed windows, a row for each text that has any.

    known: what :func:`survey` says, if that is known already.
    """
    if length < 2 * GRAM:
        raise ValueError(f"repeats of at least {2 * GRAM} bytes only")
    several, total = known or survey(docs, key, text)
    buckets = buckets or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.octet_length("text") >= length)
    rows = with_alt(rows, several, "doc", "text", "alt", broadcast_rows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, batch_bytes, 1 << 20):
            raw, offsets = text_bytes(b.column(1))
            e = entries(raw, offsets, np.asarray(b.column(0), "i8"), np.asarray(b.column(2), "i8").view("u8"), length)
            if len(e):
                yield _emit(e, buckets)

    sent = rows.mapInArrow(lean(scan), "bucket long, blob binary")
    found = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_own), _FOUND)
    found = materialise(found.groupBy("kind", "doc", "alt").agg(F.collect_list("run").alias("runs")))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in pieces(batches, batch_bytes // 8, 1 << 20):
            raw, offsets = text_bytes(whole.column(1))
            runs = whole.column(3)
            counts = np.diff(np.asarray(runs.offsets, "i8"))
            x = np.asarray(runs.flatten(), "i8")
            doc = np.repeat(np.arange(len(counts)), counts)
            at, d, n = x >> 32, x >> 16 & 0xFFFF, x & 0xFFFF
            ids, alts = np.asarray(whole.column(0), "i8"), np.asarray(whole.column(2), "i8").view("u8")
            start = offsets[:-1][doc] + at
            for lo in range(0, len(x), 1 << 13):  # a bounded number of windows at a time
                part = slice(lo, lo + (1 << 13))
                a, z = int(start[part].min()), int((start[part] + n[part]).max()) + length - 1
                yield _batch(list(pack_windows(raw[a:z], ids[doc[part]], alts[doc[part]], start[part] - a, n[part], d[part], at[part], length, buckets)))

    open_ = found.where(F.col("kind") == OPEN).select("doc", "alt", "runs")
    n_open = open_.agg(F.sum(F.size("runs"))).first()[0] or 0
    # a checked size lets the texts stay where they are; beyond it, they are shuffled to their open blocks
    again = rows.join(F.broadcast(open_) if n_open <= broadcast_rows else open_, ["doc", "alt"]).select("doc", "text", "alt", "runs").mapInArrow(lean(resolve), "bucket long, blob binary")
    more = again.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_own_windows), _FOUND)
    more = more.groupBy("doc", "alt").agg(F.collect_list("run").alias("runs"))
    both = found.where(F.col("kind") == REPEAT).select("doc", "alt", "runs").union(more)
    return materialise(both.groupBy("doc", "alt").agg(F.flatten(F.collect_list("runs")).alias("runs")).mapInArrow(lean(_merge), "doc long, alt long, runs array<long>"))


def whole_characters(data: bytes, begin: int, end: int, first: int, last: int) -> bytes:
    """Bytes ``begin`` to ``end`` of a text from ``first`` to ``last``, without the parts of characters that a cut at either end has broken."""
    if begin > first:
        while begin < end and data[begin] & 0xC0 == 0x80:
            begin += 1
    if end < last and data[end] & 0xC0 == 0x80:  # what was cut away begins inside a character
        while end > begin and data[end] & 0xC0 == 0x80:
            end -= 1
    return data[begin:end]


def cut_out(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, characters: bool = False, **options) -> DataFrame:
    """The columns of ``docs``, and four more at the end: bytes, removed bytes, removed runs, the remaining bytes.

    characters: a character that a removal cuts through is left out of the remaining bytes whole.
    """
    known, most = survey(docs, key, text), options.get("broadcast_rows", 2_000_000)
    found = repeats(docs, key, text, length, known=known, **options)
    few = (found.agg(F.sum(F.size("runs"))).first()[0] or 0) <= most
    doc, starts, mine, other = fresh(docs, "_doc", "_starts", "_mine", "_other")
    found = found.select(F.col("doc").alias(doc), F.col("alt").alias(other), F.col("runs").alias(starts))
    marked = with_alt(docs, known[0], key, text, mine, most)
    joined = marked.join(F.broadcast(found) if few else found, (F.col(key).cast("long") == F.col(doc)) & (F.col(mine) == F.col(other)), "left").select(*[F.col(f"`{c}`") for c in docs.columns], starts)
    more = fresh(docs, "_n_bytes", "_n_removed", "_n_spans", "_kept")
    names = [*docs.columns, *more]
    at_text, at_starts = docs.columns.index(text), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                raw, offsets = text_bytes(part.column(at_text))
                data = raw.tobytes()
                n_bytes, removed, spans, kept = [], [], [], []
                for i, s in enumerate(part.column(at_starts)):
                    a, z = int(offsets[i]), int(offsets[i + 1])
                    n_bytes.append(z - a)
                    if not s.is_valid:
                        removed.append(0)
                        spans.append(0)
                        kept.append(data[a:z])
                        continue
                    x = np.asarray(s.values, "i8")
                    begin, end = x >> 32, np.minimum((x >> 32) + (x & 0xFFFFFFFF) + length - 1, z - a)
                    # runs of windows may be apart while the bytes that they cover meet
                    new = np.ones(len(x), bool)
                    new[1:] = begin[1:] > end[:-1]
                    stop = end[np.append(np.flatnonzero(new)[1:] - 1, len(x) - 1)]
                    begin = begin[new]
                    removed.append(int((stop - begin).sum()))
                    spans.append(len(begin))
                    edges = [0, *np.column_stack([begin, stop]).ravel().tolist(), z - a]
                    pieces = zip(edges[::2], edges[1::2], strict=True)
                    kept.append(b"".join(whole_characters(data, a + p, a + q, a, z) if characters else data[a + p : a + q] for p, q in pieces))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(at_starts)), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=names)

    from pyspark.sql.types import StructType

    schema = StructType(list(docs.schema.fields))
    for name, kind in zip(more, ("long", "long", "long", "binary"), strict=True):
        schema = schema.add(name, kind)
    return joined.mapInArrow(lean(run), schema)


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, **options) -> DataFrame:
    """``docs`` with repeats removed from the text; a character that a removal cuts through goes whole. A null text stays null."""
    cut = cut_out(docs, key, text, length, characters=True, **options)
    _, removed, _, kept = cut.columns[len(docs.columns) :]
    whole = F.when(F.col(text).isNull(), F.lit(None)).when(F.col(removed) == 0, F.col(text)).otherwise(F.col(kept).cast("string"))
    return cut.select(*[whole.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, **options) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256)."""
    cut = cut_out(docs.select(key, text), key, text, length, **options)
    return cut.select(key, F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"), F.col("_n_spans").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"))
