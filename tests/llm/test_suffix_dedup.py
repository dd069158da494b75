"""Removal of long repeats where ids repeat, are missing, or share different texts."""

import hashlib
import random

from pyspark.sql import functions as F

from quilt.llm import suffix_dedup


def brute(texts, length=100):
    """(bytes, removed, runs, digest) of each text in corpus order."""
    seen, out = set(), []
    for b in texts:
        gone = bytearray(len(b))
        new = []
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(w)
            new.append(w)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def test_texts_that_share_an_id_are_cut_each_by_its_own_runs(spark):
    r = random.Random(8)
    noise = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    passage, other = noise(150), noise(400)
    rows = [(1, passage), (5, "HEAD " + passage + noise(30)), (5, other), (9, noise(40) + other[100:320]), (9, noise(300)), (9, other), (12, passage + other), (12, passage + other)]
    rows += [(None, passage), (None, passage), (20, None), (21, "")]
    for i in range(30, 60):
        a = r.randrange(250)
        rows.append((i // 2, noise(20) + other[a : a + r.randint(90, 150)] + noise(10)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    marks = {x.text: x.h & (1 << 64) - 1 for x in df.select("text", F.xxhash64("text").alias("h")).collect()}
    known = sorted({x for x in rows if x[0] is not None}, key=lambda x: (x[0], marks[x[1]]))
    want = dict(zip(known, brute([(t or "").encode() for _, t in known]), strict=True))
    for options in ({"batch_bytes": 700, "buckets": 3}, {"broadcast_rows": 0}):
        cut = suffix_dedup.cut_out(df, **options)
        got = [((x.doc_id, x.text), (x._n_bytes, x._n_removed, x._n_spans, hashlib.sha256(bytes(x._kept)).hexdigest())) for x in cut.collect()]
        assert len(got) == len(rows)
        for k, v in got:
            assert v == (want[k] if k[0] is not None else (150, 0, 0, hashlib.sha256(passage.encode()).hexdigest()))


def test_many_buckets_give_the_same_result(spark):
    r = random.Random(9)
    source = "".join(r.choice("abcde \n") for _ in range(5000))
    rows = [(i, source[(a := r.randrange(4500)) : a + r.randint(50, 600)]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = dict(zip([i for i, _ in rows], brute([t.encode() for _, t in rows]), strict=True))
    for buckets in (1, 97):
        assert {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digest(df, buckets=buckets).collect()} == want


def test_characters_outside_the_cuts_stay(spark):
    """Cuts that begin or end inside characters, beside replacement characters that belong to the text."""
    r = random.Random(10)
    passage = "".join(r.choice(["a", "é", "語", "\ufffd", "😀"]) for _ in range(120))
    rows = [(1, "\ufffd head " + passage)]
    # the same leading or trailing bytes with another character: cuts stop inside it
    for i, (a, b) in enumerate([("é", "é"), ("\ufffd", "\ufffd"), ("語", "誟"), ("😀", "😁"), ("", "")]):
        rows.append((2 + i, f"\ufffdx{i}{a}" + passage + f"{b}\ufffdy{i}\ufffd"))
    rows.append((9, "èé" * 80))
    rows.append((10, "ê" + "éè" * 80 + "\ufffd"))
    want, seen = {}, set()
    for i, t in rows:
        raw, gone = t.encode(), set()
        for j in range(len(raw) - 99):
            w = raw[j : j + 100]
            gone |= set(range(j, j + 100)) if w in seen else set()
            seen.add(w)
        at, out = 0, ""
        for c in t:
            n = len(c.encode())
            out += "" if gone & set(range(at, at + n)) else c
            at += n
        want[i] = out
    got = {x.doc_id: x.text for x in suffix_dedup.strip(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == want and "\ufffd" in got[3] and sum(len(want[i]) < len(t) for i, t in rows) >= 6
