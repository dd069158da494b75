"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quilt.llm import periodic_runs as P

WORD = re.compile("[^\x20\x09-\x0d]+")


def every_run(words, least=12):
    """All runs by comparing the words with themselves at every distance."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, 2 * q):
                out.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in out.items())


def random_words(r):
    kind, k = r.random(), r.choice([1, 2, 3, 4, 30])
    words = [f"w{r.randrange(k)}" for _ in range(r.randint(0, 150))]
    for _ in range(r.randint(0, 4)):
        a, p = r.randint(0, len(words)), r.randint(1, 40)
        unit = [f"w{r.randrange(1 + 10 * (kind > 0.3))}" for _ in range(p)]
        words[a:a] = (unit * 12)[: r.randint(1, 5 * p + 14)]
    return words


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        words = random_words(r)
        assert P.runs(P.numbered([w.encode() for w in words])) == every_run(words), words


@pytest.mark.parametrize("period", [*range(1, 40), 63, 64, 100])
def test_shortest_runs_of_each_period_and_place(period):
    """Just two periods, or just twelve words, at every offset against the blocks' borders."""
    for before in range(0, 33, 1 if period < 16 else 5):
        unit = [f"u{i}" for i in range(period)]
        length = max(12, 2 * period)
        words = [f"a{i}" for i in range(before)] + (unit * 13)[:length] + [f"b{i}" for i in range(7)]
        assert P.runs(P.numbered([w.encode() for w in words])) == [(before, length, period)]
        short = words[:before] + words[before + 1 :]
        assert P.runs(P.numbered([w.encode() for w in short])) == []


def test_one_word_again_and_again_is_one_run():
    assert P.runs(np.zeros(60_000, "i8")) == [(0, 60_000, 1)]
    two = np.arange(40_000) % 2
    assert P.runs(two) == [(0, 40_000, 2)]


def test_least_is_a_parameter():
    words = [b"a", b"b"] * 5
    assert P.runs(P.numbered(words), 8) == [(0, 10, 2)]
    assert P.runs(P.numbered(words), 12) == []
    with pytest.raises(ValueError):
        P.runs(P.numbered(words), 4)


def brute(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = every_run(words)
    top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    gone = {i for s, l, q in found for i in range(s + q, s + l)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *top, None if top[1] is None else 1000 * top[1] // top[2], sha("".join(f"{s},{l},{q}\n" for s, l, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_equals_brute_force(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "one", "é ü\x0b" * 20, "a b c d " * 9, "x " * 400, "a\x1cb " * 13]
    texts += [" ".join(random_words(r)) for _ in range(60)] + [" ".join(f"v{r.randrange(900)}" for _ in range(300)) for _ in range(60)]
    rows = [(i, t, "clash", i) for i, t in enumerate(texts)] + [(None, "q w " * 30, None, 1), (None, None, None, 1), (5, texts[5], "clash", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, id int").repartition(3)
    got = sorted(map(str, (tuple(x) for x in P.digests(docs).collect())))
    assert got == sorted(str(brute(i, t)) for i, t, *_ in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows if i is not None) > 5
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.digests(empty).count() == 0


def test_operator_keeps_texts_and_spans(spark):
    docs = spark.createDataFrame([("a", "say it " * 8 + "done"), ("b", "no run here")], "name string, body string")
    got = {x.name: x for x in P.detect(docs, "name", "body").collect()}
    assert got["a"].collapsed == "say it done" and [tuple(x) for x in got["a"].runs] == [(0, 16, 2)] and got["a"].n_words == 17
    assert got["b"].collapsed == "no run here" and got["b"].runs == []
