"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs (lines). A paragraph's vector has 32-bit fields: eight of its own hash, how many word triples it
has, and for each of 128 bits how many of its triples' hashes have that bit (fewer than three words are one triple). A fingerprint is the sum of
the vectors, field by field modulo 2**32, written as hexadecimal digits. So the order of paragraphs doesn't matter, equal multisets of
paragraphs have equal fingerprints, and paragraphs are inserted or deleted by adding or subtracting their own fingerprints (:func:`plus`,
:func:`minus`) without the text. Different multisets agree in the 256 bits of the first fields by chance only.

Bits of a hash taken as signs make the counts a random projection of the multiset of triples: the inner product of two projections estimates
that of the multisets, with a standard error of about 1 / sqrt(128) = 0.09 of their lengths. :func:`likeness` is 2 a.b / (a.a + b.b), the share of
common triples for texts that repeat none, 1 for equal and near 0 for unrelated texts.

DataFrame functions only. For the query rows meet their successors in buckets of ids, cut at quantiles that a pass over the ids alone
finds; the first rows of a bucket are guests of the one before, so that no bucket needs another and none is a window over everything.
Texts are shuffled once, and their sums once more. The driver sees a row for each bucket, of which there are as many as shuffle partitions.

Null texts are empty. Repeated rows and shared ids keep their rows; ties in the order of ids go by text; null ids come after all others.
Texts of any length are taken whole. Further columns don't matter, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a shingle.
SHINGLE = 3
#: Bits of the triples' hashes that are counted; two counters share a long while they are summed.
BITS = 128
#: Hashes of a paragraph, two fields each.
HASHES = 4
FIELD = (1 << 32) - 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once and has a name inside lambdas."""
    return F.transform(F.array(value), body)[0]


def _paragraphs(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _triples(paragraph: Column) -> Column:
    """Hashes of the paragraph's runs of three words; of all its words if there are fewer."""
    words = F.filter(F.split(paragraph, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    hashes = lambda ws: F.transform(ws, lambda w, i: F.xxhash64(w, *[F.get(ws, i + k) for k in range(1, SHINGLE)]))
    whole = lambda ws: F.slice(hashes(ws), 1, F.greatest(F.size(ws) - (SHINGLE - 1), F.lit(1)))
    return _let(words, whole)


def _own_fields(paragraphs: Column) -> Column:
    """Hexadecimal digits of the sums of the paragraphs' own hashes."""
    add = lambda halves: F.aggregate(halves, F.lit(0).cast("long"), lambda a, x: (a + x).bitwiseAND(F.lit(FIELD)))
    out = []
    for seed in map(F.lit, range(HASHES)):
        hashes = F.transform(paragraphs, lambda p: F.xxhash64(seed, p))  # noqa: B023
        out += [add(F.transform(hashes, lambda x: F.shiftrightunsigned(x, 32))), add(F.transform(hashes, lambda x: x.bitwiseAND(F.lit(FIELD))))]
    return F.concat(*[_digits(c) for c in out])


def _digits(c: Column, n: int = 8) -> Column:
    return F.lpad(F.lower(F.hex(c)), n, "0")


def summed(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sums): the keys must tell rows apart; triples are exploded and summed, a row for each text and task.

    ``sums`` is a struct of the digits of the paragraphs' own fields, the number of triples, and the counts of bits, two a long.
    """
    # the names of own columns can't clash with the caller's
    own = [f"_{k}" for k in range(len(keys))]
    named = [F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)]
    split = rows.select(*named, _paragraphs(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_p"))
    read = split.select(*own, _own_fields(F.col("_p")).alias("_f"), F.flatten(F.transform("_p", _triples)).alias("_t"))
    each = read.select(*own, "_f", F.explode_outer("_t").alias("_h"))
    pair = F.lit((1 << 32) | 1)
    again = F.when(F.col("_h").isNotNull(), F.xxhash64("_h"))
    counted = [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(pair)) for h in (F.col("_h"), again) for k in range(32)]
    sums = each.groupBy(*own, "_f").agg(F.count("_h").alias("_n"), *[F.coalesce(c, F.lit(0).cast("long")).alias(f"_s{i}") for i, c in enumerate(counted)])
    packed = F.array(*[F.col(f"_s{i}") for i in range(BITS // 2)])
    return sums.select(*[F.col(o).alias(k) for o, k in zip(own, keys, strict=True)], F.struct(F.col("_f").alias("own"), F.col("_n").alias("n"), packed.alias("bits")).alias("sums"))


def written(sums: Column) -> Column:
    """The fingerprint, from the struct of :func:`summed`."""
    return F.concat(sums["own"], _digits(sums["n"]), F.array_join(F.transform(sums["bits"], lambda x: _digits(x, 16)), ""))


def fingerprint(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint), a row for each row of ``docs``."""
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.monotonically_increasing_id().alias("row"))
    return summed(rows, ["k", "row"], "t").select(F.col("k").alias(key), written(F.col("sums")).alias("fingerprint"))


# arithmetic on fingerprints


def fields(f: Column) -> Column:
    """The fields as an array of longs."""
    n = 2 * HASHES + 1 + BITS
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(f, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def _join(a: Column, b: Column, sign: int) -> Column:
    return F.array_join(F.zip_with(fields(a), fields(b), lambda x, y: _digits(F.pmod(x + sign * y, F.lit(1 << 32)))), "")


def plus(a: Column, b: Column) -> Column:
    """The fingerprint of both texts' paragraphs together."""
    return _join(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return _join(a, b, -1)


def projection(f: Column) -> Column:
    """Signed sums of the bits: twice the ones less the number of triples."""
    return _let(fields(f), lambda x: F.transform(F.slice(x, 2 * HASHES + 2, BITS), lambda c: (2 * c - F.get(x, F.lit(2 * HASHES))).cast("double")))


def _projected(sums: Column) -> Column:
    """The same from the struct of :func:`summed`."""
    halves = F.flatten(F.transform(sums["bits"], lambda x: F.array(F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(FIELD)))))
    return _let(sums["n"], lambda n: F.transform(halves, lambda c: (2 * c - n).cast("double")))


def _dot(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _share(pq: Column, pp: Column, qq: Column) -> Column:
    """From inner products, 0 to 1; two empty texts are alike."""
    return F.when(pp + qq == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * pq / (pp + qq))))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 if they are equal, else the estimated share of common triples."""
    estimate = _let(projection(a), lambda p: _let(projection(b), lambda q: _share(_dot(p, q), _dot(p, p), _dot(q, q))))
    return F.when(a == b, F.lit(1.0)).otherwise(estimate)


# the query


def _cuts(ids: DataFrame, n: int) -> list[int]:
    """The greatest id of each of about n equal parts, ascending."""
    approx = ids.agg(F.percentile_approx("id", F.array(*[F.lit((i + 1) / n) for i in range(n)]), 10 * n).alias("q")).first().q
    if not approx:
        return []
    # quantiles are approximate, so what is cut at is read from the ids themselves
    found = ids.where("id is not null").groupBy(_bucket(F.col("id"), sorted({int(x) for x in approx})).alias("b")).agg(F.max("id").alias("top")).collect()
    return sorted(int(r.top) for r in found)


def _bucket(key: Column, cuts: list[int]) -> Column:
    """How many cuts lie below the id, by bisection; 0 for null."""
    if not cuts:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    at = F.from_json(F.lit(json.dumps(cuts)), "array<bigint>")
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda n, s: F.when(F.get(at, n + s - 1) < key, n + s).otherwise(n))


def followed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, rank, top, doc_id, text, following): each text with the one that comes next in descending order of ids, the first after the last.

    ``rank`` numbers the rows of a bucket from 1; ``top`` is the last bucket's number.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    cuts = _cuts(rows.select("id"), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    top = max(len(cuts) - 1, 0)
    own = rows.withColumn("own", _bucket(F.col("id"), cuts))
    # the greatest id of a bucket follows the least of the bucket above, and the greatest of all the very last
    greatest = F.col("id").eqNullSafe(F.get(F.from_json(F.lit(json.dumps(cuts)), "array<bigint>"), F.col("own")))
    here = F.struct(F.col("own").alias("bucket"), F.lit(0).alias("guest"))
    there = F.struct(F.when(F.col("own") == top, 0).otherwise(F.col("own") + 1).alias("bucket"), F.lit(1).alias("guest"))
    dealt = own.withColumn("at", F.explode(F.when(greatest, F.array(here, there)).otherwise(F.array(here)))).select("at.bucket", "at.guest", "id", "body")
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("id"), "body")
    return dealt.select("*", F.row_number().over(order).alias("rank"), F.lead("body").over(order).alias("following")).where("guest = 0").select("bucket", "rank", F.lit(top).alias("top"), "id", "body", "following")


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): each text against itself with its last third taken from the next."""
    rows = followed(docs, key, text).withColumn("n", F.length("body")).withColumn("third", F.floor(F.col("n") / 3).cast("int"))
    edited = F.concat(F.col("body").substr(F.lit(1), F.col("n") - F.col("third")), F.col("following").substr(F.lit(1), F.col("third")))
    texts = F.array(F.struct(F.lit(0).alias("which"), F.col("body").alias("t")), F.struct(F.lit(1).alias("which"), edited.alias("t")))
    both = rows.select("bucket", "rank", "top", "id", F.col("n").cast("long").alias("n_chars"), F.explode(texts).alias("x")).select("bucket", "rank", "top", "id", "n_chars", "x.which", "x.t", F.sha2("x.t", 256).alias("sha"))
    keys = ["bucket", "rank", "top", "id", "n_chars", "which", "sha"]
    prints = summed(both, keys, "t")
    # a bucket's first text is the guest of the bucket above, as before
    here = F.struct("bucket", F.lit(0).alias("guest"))
    there = F.struct(F.when(F.col("bucket") == F.col("top"), 0).otherwise(F.col("bucket") + 1).alias("bucket"), F.lit(1).alias("guest"))
    spread = prints.withColumn("at", F.explode(F.when((F.col("rank") == 1) & (F.col("which") == 0), F.array(here, there)).otherwise(F.array(here)))).select("at.*", *[k for k in keys if k != "bucket"], "sums")
    order = Window.partitionBy("bucket").orderBy("guest", "rank", "which")
    seen = spread.select("*", F.lead("sha").over(order).alias("edited_sha256"), F.lead("sums").over(order).alias("edited"), F.lead("sums", 2).over(order).alias("next"))
    kept = seen.where("guest = 0 and which = 0")
    near = _let(_projected(F.col("sums")), lambda p: _let(_dot(p, p), lambda pp: F.struct(*[_let(_projected(F.col(c)), lambda q: _share(_dot(p, q), pp, _dot(q, q))).alias(c) for c in ("edited", "next")])))
    out = kept.select("id", "n_chars", "edited_sha256", "sums", "edited", "next", near.alias("near"))
    return out.select(
        F.col("id").alias(key),
        "n_chars",
        "edited_sha256",
        written(F.col("sums")).alias("fingerprint"),
        written(F.col("edited")).alias("edited_fingerprint"),
        F.when(F.col("sums") == F.col("edited"), F.lit(1.0)).otherwise(F.col("near.edited")).alias("near_edited"),
        F.when(F.col("sums") == F.col("next"), F.lit(1.0)).otherwise(F.col("near.next")).alias("near_next"),
    )
