"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (by the number of different sets that hold them, then hash) is cut into fragments by hash range. A fragment
sees the n-grams of all documents in its range, so it counts their frequencies exactly and alone. What it tells each document is which of its
n-grams other sets hold too; summed over fragments this bounds every overlap, and most documents drop out. The others keep the rarest of their
shared n-grams, as many as the prefix principle asks for. Sets that share one become candidate pairs, if their sizes and shared n-grams still
allow a link: first each with one leader, and, once links have merged sets into components, all pairs across components. Pairs are
verified by vertical partitioning again: sets are cut into fragments, partial overlaps counted per fragment, and summed per pair.

Equal sets form one class before pairs are made. Hashes of n-grams have 64 bits in the verification; the fragments that only select candidates
carry shortened ones, whose collisions can only add candidates.

Edge cases: null, empty and white-space texts have no n-gram and link with nothing; texts with fewer words than n are one n-gram; texts of any length
are read whole; repeated rows are one class; rows with equal ids and different texts are classes of their own, which belong to one component
through their id; a row with a null id keeps its size and links with nothing (its class and component are null); sets at the threshold exactly
link, and ties in frequency are broken by hash; an empty table gives an empty table. Only ``key`` and ``text`` are read, so further columns
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quilt.llm.common import components, give_back, lean, materialise, mix64, release, shingles, small_table, squeeze, text_bytes, unsqueeze

#: Bits of a shortened hash within its fragment, and of a row's number within its batch.
_BITS, _ROW = 28, 16
_SALT = np.uint64(0xA0761D6478BD642F)
#: Words of 64 bits in a set's sketch: how many of its hashes fall on each bit, modulo 2. Sets differ at least in as many n-grams as their sketches in bits.
_SKETCH = 16


def distinct_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of each text one after another, their offsets)."""
    h, doc = shingles(raw, offsets, size)
    n = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(n + 1))
    keep = np.ones(len(h), bool)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a > 1:
            part = h[a:b]
            part.sort()
            np.not_equal(part[1:], part[:-1], out=keep[a + 1 : b])
    sums = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], sums[at]


def signatures(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for x in (mix64(h), mix64(h ^ _SALT)):
        sums = np.zeros(len(h) + 1, "u8")
        np.cumsum(x, out=sums[1:])
        out.append(sums[at[1:]] - sums[at[:-1]])
    return out[0], out[1]


def pieces(batches: Iterator[pa.RecordBatch], most_bytes: int, most_rows: int) -> Iterator[pa.RecordBatch]:
    """The rows of a task in runs of at most so many rows and about so many bytes of text (column 1)."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        _, offsets = text_bytes(b.column(1))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + max(1, most_bytes - size), side="right")) - 1
            to = min(max(to, at + 1), at + most_rows - rows, b.num_rows)
            held.append(b.slice(at, to - at))
            size, rows, at = size + int(offsets[to] - offsets[at]), rows + to - at, to
            if size >= most_bytes or rows >= most_rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, rows = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blobs(frags: list[int], numbers: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(frags, pa.int64()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())], names=["frag", "batch", "blob"])


class _Batch:
    """Sets of several pieces of a task: ids, sizes, signatures, and the postings of those sets that are new to the batch."""

    def __init__(self) -> None:
        self.rows = self.postings = 0
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.packed: list[np.ndarray] = []
        self.seen: set[tuple[int, int]] = set()

    def add(self, b: pa.RecordBatch, size: int, fragments: int) -> None:
        h, at = distinct_sets(*text_bytes(b.column(1)), size)
        n = np.diff(at)
        one, two = signatures(h, at)
        known = np.asarray(b.column(0).is_valid())
        send = np.zeros(len(n), bool)
        for i in np.flatnonzero(known & (n > 0)).tolist():
            if (mark := (int(one[i]), int(two[i]))) not in self.seen:
                self.seen.add(mark)
                send[i] = True
        self.columns.append((np.asarray(b.column(0).fill_null(0), "i8").view("u8"), n.astype("u8"), one, two, send.astype("u8"), known.astype("u8")))
        use = np.repeat(send, n)
        token = mix64(h[use] ^ _SALT)
        place = (token >> np.uint64(32)) % np.uint64(fragments) << np.uint64(_BITS) | token & np.uint64((1 << _BITS) - 1)
        row = np.repeat(np.arange(self.rows, self.rows + len(n), dtype="u8")[send], n[send])
        self.packed.append(place << np.uint64(_ROW) | row)
        self.rows, self.postings = self.rows + len(n), self.postings + len(token)

    def send(self, number: int, fragments: int) -> pa.RecordBatch:
        """A row for each fragment with its postings and the signatures of the rows these name, and one with the batch's sets."""
        meta = np.concatenate([np.concatenate(c) for c in zip(*self.columns, strict=True)])
        one = np.concatenate([c[2] for c in self.columns])
        packed = np.concatenate(self.packed)
        self.packed = []
        packed.sort()
        cuts = np.searchsorted(packed, np.arange(fragments + 1, dtype="u8") << np.uint64(_BITS + _ROW))
        frags, blobs = [-1 - number], [meta.tobytes()]
        for f in range(fragments):
            x = packed[cuts[f] : cuts[f + 1]]
            if len(x):
                tokens, row = x >> np.uint64(_ROW) & np.uint64((1 << _BITS) - 1), x & np.uint64((1 << _ROW) - 1)
                mark = one[np.unique(row).astype("i8")]
                frags.append(f)
                # six bytes of a signature tell sets that share an n-gram apart
                blobs.append(squeeze(np.diff(tokens, prepend=np.uint64(0)).astype("u4"), row.astype("u2"), mark.astype("u4"), (mark >> np.uint64(32)).astype("u2")))
        return _blobs(frags, [number] * len(frags), blobs)


def _scatter(size: int, fragments: int, piece_bytes: int, batch_postings: int):
    """Task of the first pass: batches of sets, a row for each batch and fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, batch = TaskContext.get().partitionId() << 24, _Batch()
        for b in pieces(batches, piece_bytes, 1 << (_ROW - 2)):
            batch.add(b, size, fragments)
            if batch.postings >= batch_postings or batch.rows > (1 << _ROW) - (1 << (_ROW - 2)):
                yield batch.send(number, fragments)
                number, batch = number + 1, _Batch()
                give_back()
        if batch.rows:
            yield batch.send(number, fragments)

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task of the second pass: for each fragment, which postings other sets have too, and how many sets; sent back to their batches."""

    def flush(frag: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        tokens, rows, marks, sizes = [], [], [], []
        for _, blob in held:
            steps, row, low, high = unsqueeze(blob)
            tokens.append(np.cumsum(steps.astype("u8")))
            rows.append(row)
            mark = low.astype("u8") | high.astype("u8") << np.uint64(32)
            marks.append(mark[np.searchsorted(np.unique(row), row)])
            sizes.append(len(row))
        token, row, mark = np.concatenate(tokens), np.concatenate(rows), np.concatenate(marks)
        del tokens, rows, marks
        # tokens with their places in one plain sort; only those that occur again are looked at closer
        key = np.sort(token << np.uint64(64 - _BITS) | np.arange(len(token), dtype="u8"))
        token, place = key >> np.uint64(64 - _BITS), (key & np.uint64((1 << 64 - _BITS) - 1)).astype("i8")
        del key
        same = token[1:] == token[:-1]
        again = np.zeros(len(token), bool)
        again[1:] |= same
        again[:-1] |= same
        token, place = token[again], place[again]
        mark = mark[place]
        order = np.lexsort((mark, token))
        token, place, mark = token[order], place[order], mark[order]
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        other = first.copy()
        other[1:] |= mark[1:] != mark[:-1]
        starts = np.flatnonzero(first)
        df = np.add.reduceat(other.astype("i8"), starts) if len(starts) else np.zeros(0, "i8")
        many = np.repeat(df, np.diff(np.append(starts, len(token))))
        shared = many > 1
        token, place, many = token[shared], place[shared], np.minimum(many[shared], 65535).astype("u2")
        order = np.argsort(place)
        token, place, many = token[order], place[order], many[order]
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(place, np.concatenate([[0], ends]))
        numbers, blobs = [], []
        for i, (number, _) in enumerate(held):
            a, b = cuts[i], cuts[i + 1]
            if b > a:
                numbers.append(number)
                blobs.append(squeeze(np.diff(token[a:b], prepend=np.uint64(0)).astype("u4"), row[place[a:b]], many[a:b]))
        return _blobs([frag] * len(numbers), numbers, blobs)

    now, held = None, []
    for b in batches:
        for frag, number, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if frag < 0:  # the sets of a batch go on to the next pass
                yield _blobs([frag], [number], [blob])
                continue
            if frag != now and held:
                yield flush(now, held)
                held = []
            now = frag
            held.append((number, blob))
    if held:
        yield flush(now, held)


def _prefixes(percent: int):
    """Task of the third pass: the documents of a batch, each with the rarest shared n-grams that the prefix principle asks for."""

    def flush(meta: bytes, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        ids, n, one, two, _, known = np.frombuffer(meta, "u8").reshape(6, -1)
        keys = []
        for frag, x in held:
            steps, row, df = unsqueeze(x)
            # the order within a document: frequency, then fragment and hash
            keys.append((row, df, np.uint64(frag) << np.uint64(_BITS) | np.cumsum(steps.astype("u8"))))
        count = n.astype("i8")
        shared = np.zeros(len(n), "i8")
        if keys:
            row, df, token = (np.concatenate(c) for c in zip(*keys, strict=True))
            order = np.lexsort((token, df, row))
            row, token = row[order].astype("i8"), token[order]
            shared = np.bincount(row, minlength=len(n))
            begin = np.concatenate([[0], np.cumsum(shared)])
            wanted = np.clip(count - -(-count * percent // 100) + 1 - (count - shared), 0, shared)
            rank = np.arange(len(row)) - begin[row]
            kept = rank < wanted[row]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[kept], minlength=len(n)))]), pa.int32()), pa.array(token[kept].view("i8")))
        else:
            lists = pa.array([[]] * len(n), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids.view("i8"), mask=known == 0), pa.array(count), pa.array(one.view("i8")), pa.array(two.view("i8")), pa.array(shared), lists], names=["id", "n", "s1", "s2", "shared", "tokens"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, meta, held = None, b"", []
        for b in batches:
            for frag, number, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if number != now and now is not None:
                    yield flush(meta, held)
                    held = []
                now = number
                if frag < 0:
                    meta = blob
                else:
                    held.append((frag, blob))
        if now is not None:
            yield flush(meta, held)

    return run


#: Bytes of text whose n-grams one fragment counts at a time in memory, and the number of fragments that small inputs don't exceed: the
#: signatures and row numbers that go with the postings are sent once for each fragment.
FRAGMENT_BYTES, FEW_FRAGMENTS = 16 << 20, 64


def describe(docs: DataFrame, key: str, text: str, size: int = 5, percent: int = 75, fragments: int | None = None, piece_bytes: int = 1 << 20, batch_postings: int = 3 << 20) -> DataFrame:
    """(id, n, s1, s2, shared, tokens): a row for each document: size and signature of its set, how many of its n-grams other sets have too
    (0 where an equal set speaks for it), and the prefix of these."""
    if not fragments:
        total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        fragments = min(1 << 20, max(min(FEW_FRAGMENTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-total // FRAGMENT_BYTES)))
    schema = "frag long, batch long, blob binary"
    sent = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lean(_scatter(size, fragments, piece_bytes, batch_postings)), schema)
    counted = sent.repartition(fragments, "frag").sortWithinPartitions("frag", "batch").mapInArrow(lean(_count), schema)
    back = counted.repartition(fragments, "batch").sortWithinPartitions("batch", "frag").mapInArrow(lean(_prefixes(percent)), "id long, n long, s1 long, s2 long, shared long, tokens array<long>")
    return materialise(back)


def fragment_sets(classes: DataFrame, docs: DataFrame, key: str, text: str, size: int = 5, fragments: int = 4, broadcast_ids: int = 1_000_000) -> DataFrame:
    """(v, f, n, h, sketch): the set of each class (v, id, n, s1, s2) in fragments, its hashes sorted; the sketch is with fragment 0."""
    ids = materialise(classes.select("id").distinct())
    # the ids filter the texts before these leave the scan's task; beyond that size, by a shuffled join
    wanted = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1 << 20, 1 << 12):
            h, at = distinct_sets(*text_bytes(b.column(1)), size)
            one, two = signatures(h, at)
            bounds = [np.uint64((f << 64) // fragments) for f in range(fragments)]
            out: list[tuple] = []
            for d in np.flatnonzero(np.diff(at)).tolist():
                s = h[at[d] : at[d + 1]]
                cuts = [*np.searchsorted(s, bounds), len(s)]
                parity = np.bincount((s & np.uint64(64 * _SKETCH - 1)).astype("i8"), minlength=64 * _SKETCH) & 1
                sketch = np.packbits(parity.astype(bool)).view("i8").tolist()
                out += [(len(s), int(one[d].view("i8")), int(two[d].view("i8")), f, s[cuts[f] : cuts[f + 1]].tobytes(), None if f else sketch) for f in range(fragments)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["n", "s1", "s2", "f", "h", "sketch"])

    found = texts.mapInArrow(lean(cut), "n long, s1 long, s2 long, f int, h binary, sketch array<long>")
    # rows that repeat an id and its text give the same set again
    return materialise(found.join(classes.select("v", "n", "s1", "s2"), ["n", "s1", "s2"]).dropDuplicates(["v", "f"]).select("v", "f", "n", "h", "sketch"))


def verify(pairs: DataFrame, sets: DataFrame, percent: int = 75, block: int = 256) -> DataFrame:
    """Of ``pairs`` (hub, spoke), those whose sets reach the similarity, as (a, b, o, u); overlaps are counted in each fragment and summed.

    A hub's fragment goes once to each block of about ``block`` of its spokes, a spoke's once to each hub, so a popular hub is spread over tasks.
    """
    blocks = pairs.groupBy("hub").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    dealt = materialise(pairs.join(blocks, "hub").select("hub", "spoke", F.pmod(F.xxhash64("spoke"), F.col("blocks")).alias("salt")))
    sets = sets.drop("sketch")
    spokes = dealt.join(sets.withColumnRenamed("v", "spoke"), "spoke").select("hub", "salt", "f", "spoke", "n", "h")
    hubs = dealt.select("hub", "salt").distinct().join(sets.withColumnRenamed("v", "hub"), "hub").select("hub", "salt", "f", F.lit(None).cast("long").alias("spoke"), "n", "h")

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n_mine = np.zeros(0, "u8"), 0
        for b in batches:
            spoke, n = b.column(3).to_pylist(), b.column(4).to_pylist()
            rows: list[int] = []
            sizes: list[int] = []
            common: list[int] = []
            for i, x in enumerate(b.column(5)):
                h = np.frombuffer(x.as_buffer(), "u8")
                if spoke[i] is None:
                    mine, n_mine = h.copy(), n[i]
                    continue
                o = 0
                if len(mine) and len(h):
                    at = np.searchsorted(mine, h)
                    o = int(np.count_nonzero(mine[np.minimum(at, len(mine) - 1)] == h))
                rows.append(i)
                sizes.append(n_mine)
                common.append(o)
            if rows:
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(3).take(take), pa.array(sizes, pa.int64()), b.column(4).take(take), pa.array(common, pa.int64())], names=["hub", "spoke", "nh", "ns", "o"])

    # the hub's own row comes first in its group
    both = hubs.unionByName(spokes).repartition("hub", "salt", "f").sortWithinPartitions("hub", "salt", "f", F.col("spoke").asc_nulls_first())
    parts = both.mapInArrow(lean(overlap), "hub long, spoke long, nh long, ns long, o long")
    sums = parts.groupBy("hub", "spoke").agg((F.first("nh") + F.first("ns") - F.sum("o")).alias("u"), F.sum("o").alias("o"))
    return materialise(sums.where(100 * F.col("o") >= percent * F.col("u")).select(F.least("hub", "spoke").alias("a"), F.greatest("hub", "spoke").alias("b"), "o", "u"))


def _possible(percent: int, n: str, s: str, m: str, r: str):
    """Whether sets of n and m n-grams, of which s and r are shared with any set at all, can reach the similarity."""
    n, s, m, r = map(F.col, (n, s, m, r))
    return (100 + percent) * F.least(s, r) >= percent * (n + m)


def _meeting(held: DataFrame, sets: DataFrame, percent: int, across: bool) -> DataFrame:
    """(hub, spoke): pairs of classes that share an n-gram of their prefixes and whose sizes, shared n-grams and sketches allow a link."""
    drawn = held.join(sets.where("f = 0").select("v", "sketch"), "v")
    x, y = (drawn.select("token", *[F.col(c).alias(f"{c}{side}") for c in ("v", "n", "s", "c", "sketch")]) for side in ("a", "b"))
    unlike = sum((F.bit_count(F.col("sketcha")[i].bitwiseXOR(F.col("sketchb")[i])) for i in range(1, _SKETCH)), F.bit_count(F.col("sketcha")[0].bitwiseXOR(F.col("sketchb")[0])))
    # the overlap is half of what both sizes leave beyond the difference
    open_ = (F.col("va") < F.col("vb")) & _possible(percent, "na", "sa", "nb", "sb") & ((100 + percent) * (F.col("na") + F.col("nb") - unlike) >= 2 * percent * (F.col("na") + F.col("nb")))
    met = x.join(y, "token").where(open_ & (F.col("ca") != F.col("cb")) if across else open_)
    met = met.groupBy("va", "vb").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    # what two sets share lies in both prefixes, or behind the one that ends first: k and the longer rest bound the overlap
    rest = F.greatest(*[F.ceil(F.col(c) * percent / F.lit(100)) - 1 for c in ("na", "nb")])
    most = F.col("k") + rest
    return met.where(100 * most >= percent * (F.col("na") + F.col("nb") - most)).select(F.col("va").alias("hub"), F.col("vb").alias("spoke"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75, star_rounds: int = 6, every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members: (id, n_shingles, class_id, component_id) a row for each document; class_id is the smallest id with the same set.
    links: verified (a, b, o, u) between class ids. With ``every_link`` all of them; else enough to connect each component: pairs are left out
    only where both are in one component already. A class whose id another class has too is named by that id.
    """
    found = describe(docs, key, text, size, percent)
    told = F.size("tokens") > 0
    heads = found.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("id"), F.first(F.when(told, F.col("shared")), True).alias("s"), F.first(F.when(told, F.col("tokens")), True).alias("tokens"))
    heads = materialise(heads.where("tokens is not null").withColumn("v", F.monotonically_increasing_id()))
    postings = heads.select("v", "n", "s", F.explode("tokens").alias("token"))
    # an n-gram that only one class has in its prefix can't make a pair
    again = postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").select("token")
    held = materialise(postings.join(again, "token").select("v", "n", "s", "token", F.col("v").alias("c")))
    classes = heads.drop("tokens").join(held.select("v").distinct(), "v", "left_semi")
    sets = fragment_sets(classes, docs, key, text, size)
    release(docs.sparkSession)
    links = tested = None
    stuck = False
    for step in range(star_rounds + 1):
        if every_link:
            links = verify(materialise(_meeting(held, sets, percent, False)), sets, percent)
            break
        # pairs of different components at each token; few enough, or after the last star round, all of them are tried
        per = held.groupBy("token", "c").agg(F.count("*").alias("k"))
        open_ = per.groupBy("token").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"), F.count("*").alias("cs")).where("cs > 1")
        open_ = materialise(open_.select("token", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs"), "s"))
        cost, rows = open_.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0))).first()
        if not rows:
            break
        held = held.join(open_.select("token"), "token")
        last = stuck or step == star_rounds or cost <= 2 * rows
        if last:
            tried = _meeting(held, sets, percent, True)
        else:
            # a leader for each token, the class with the fewest n-grams of its own; every class of another component tries the leader it shares most tokens with
            lead = held.groupBy("token").agg(F.min(F.struct(F.col("n") - F.col("s"), "v", "n", "s", "c")).alias("m")).select("token", *[F.col(f"m.{x}").alias(f"l{x}") for x in ("v", "n", "s", "c")])
            star = held.join(lead, "token").where((F.col("c") != F.col("lc")) & _possible(percent, "n", "s", "ln", "ls"))
            votes = star.groupBy(F.col("lv").alias("hub"), F.col("v").alias("spoke")).agg(F.count("*").alias("votes"))
            if tested is not None:
                votes = votes.join(tested, ["hub", "spoke"], "left_anti")
            tried = votes.groupBy("spoke").agg(F.max(F.struct("votes", "hub")).alias("m")).select("m.hub", "spoke")
        if tested is not None:
            tried = tried.join(tested, ["hub", "spoke"], "left_anti")
        tried = materialise(tried)
        if not last and tried.isEmpty():
            stuck = True
            continue
        new = verify(tried, sets, percent)
        release(docs.sparkSession)
        links = new if links is None else links.union(new)
        if last:
            break
        # where leaders hardly link any more, what is left is tried at once
        stuck = 10 * new.count() < tried.count()
        turned = tried.union(tried.select(F.col("spoke").alias("hub"), F.col("hub").alias("spoke")))
        tested = turned if tested is None else tested.union(turned)
        label = components(links)
        held = held.drop("c").join(label.select(F.col("node").alias("v"), F.col("component").alias("c")), "v", "left")
        held = materialise(held.select("v", "n", "s", "token", F.coalesce("c", "v").alias("c")))
    if links is None:
        links = small_table(docs.sparkSession, [], "a long, b long, o long, u long")
    names = heads.select("v", F.col("id").alias("name"))
    for side in ("a", "b"):
        links = links.join(names.withColumnRenamed("v", side), side).drop(side).withColumnRenamed("name", side)
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o", "u"))
    # documents, classes and links together
    groups = found.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min("id").alias("class_id"))
    known = found.select("id", "n", "s1", "s2").join(groups, ["n", "s1", "s2"], "left")
    known = materialise(known.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id")))
    # classes that share an id belong together
    several = known.groupBy("id").agg(F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x < y").select("id", "x")
    edges = links.select("a", "b").union(known.join(several, "id").where("class_id <> x").select("x", "class_id"))
    comp = components(edges).select(F.col("node").alias("class_id"), "component")
    members = known.join(comp, "class_id", "left").select("id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    return members, links
