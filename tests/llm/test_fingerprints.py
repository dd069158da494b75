"""Fingerprints against a plain sum in Python, their arithmetic, and how well they tell likeness."""

import hashlib
import random
import re
import statistics

import xxhash
from pyspark.sql import functions as F

from quilt.llm import fingerprints as P

WORD = re.compile("[^\x20\x09-\x0d]+")
MASK = (1 << 32) - 1


def chain(*values, seed=42):
    """Spark's xxhash64 of several values: each is hashed with the last hash as its seed."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=v < 0) if isinstance(v, int) and abs(v) > 9 else v.to_bytes(4, "little")
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed


def shingles(text):
    out = []
    for p in text.split("\n"):
        words = WORD.findall(p)
        out += [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    return out


def brute(text):
    text = text or ""
    fields = []
    for seed in range(4):
        hashes = [chain(seed, p) for p in text.split("\n")]
        fields += [sum(h >> 32 for h in hashes), sum(h & MASK for h in hashes)]
    ts = [chain(*s) for s in shingles(text)]
    fields.append(len(ts))
    for hs in (ts, [xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed=42) for h in ts]):
        for k in range(32):
            fields += [sum(h >> (k + 32) & 1 for h in hs), sum(h >> k & 1 for h in hs)]
    return "".join(f"{f & MASK:08x}" for f in fields)


def follow(rows):
    """Rows in descending order of ids, ties by text, nulls last; each with the next."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1].encode()))
    return [(i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)]


def edit(t, other):
    k = len(t) // 3
    return t[: len(t) - k] + other[:k]


def prose(r, n, words=400):
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, bucket int").repartition(3)
    got = sorted(((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) for x in P.compare(docs).collect()), key=str)
    want = [(i, len(t), hashlib.sha256(edit(t, n).encode()).hexdigest(), brute(t), brute(edit(t, n))) for i, t, n in follow(rows)]
    assert got == sorted(want, key=str)


def test_query_equals_plain_sums(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "one two", "é ÿ 語\x0bx\ny", "\n\n", "a\x1cb c d", "same line here\n" * 40, prose(r, 9000)]
    texts += ["\n".join(prose(r, r.randint(0, 12)) for _ in range(r.randint(1, 6))) for _ in range(60)]
    rows = [(i * 7 - 50, t) for i, t in enumerate(texts)]
    check(spark, rows + [(6, "shared id"), (6, "another"), (6, "another"), (None, "no id"), (None, None), (2**62, "far"), (-(2**62) - 1, "near the end")])
    check(spark, [(3, "only one document here")])
    check(spark, [(None, "b"), (None, "a a a a")])
    check(spark, [(2, "x y z"), (1, "z y x w")])
    assert P.compare(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_buckets_keep_the_order(spark):
    r = random.Random(6)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        check(spark, [(r.randrange(10**12), prose(r, r.randint(1, 30))) for _ in range(300)])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_paragraphs_are_inserted_and_deleted(spark):
    r = random.Random(2)
    a, b, c = ("\n".join(prose(r, 9) for _ in range(n)) for n in (3, 5, 1))
    rows = [("a", a), ("b", b), ("c", c), ("abc", "\n".join([a, b, c])), ("cab", "\n".join([c, a, b]))]
    f = {x.name: x.fingerprint for x in P.fingerprint(spark.createDataFrame(rows, "name string, text string"), "name").collect()}
    assert f["abc"] == f["cab"] and len(set(f.values())) == 4
    one = spark.range(1).select(
        P.plus(P.plus(F.lit(f["b"]), F.lit(f["a"])), F.lit(f["c"])).alias("all"), P.minus(F.lit(f["abc"]), F.lit(f["b"])).alias("less"), P.plus(F.lit(f["a"]), F.lit(f["c"])).alias("ac"), P.minus(F.lit(f["a"]), F.lit(f["abc"])).alias("under")
    ).first()
    assert one["all"] == f["abc"] and one["less"] == one["ac"] != f["abc"]
    back = spark.range(1).select(P.plus(F.lit(one["under"]), F.lit(f["abc"])).alias("x")).first()["x"]
    assert back == f["a"]


def test_likeness_follows_common_triples(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 300)) for i in range(200)] + [(1000 + i, "all the same text here") for i in range(2)]
    got = P.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    mine = [x for x in got if x.doc_id < 1000]
    assert all(0 <= v <= 1 for x in got for v in (x.near_edited, x.near_next))
    assert abs(statistics.mean(x.near_edited for x in mine) - 2 / 3) < 0.03
    assert min(x.near_edited for x in mine) > 0.4 and max(x.near_next for x in mine) < 0.35
    same = next(x for x in got if x.doc_id == 1001)
    assert same.near_next == 1.0
