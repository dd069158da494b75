"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from quilt.llm import spelling as S

LOWER = {c: c + 32 for c in range(65, 91)}


def distance(a, b):
    """Edit distance of two words by the full table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(counts, factor=5):
    out = {}
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and distance(v, w) == 1] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
    for w, n in counts.items():
        end = w
        while form[end] is not None:
            end = form[end]
        out[w] = (w, form[w], end, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def neighbours(r, w, letters):
    i = r.randrange(len(w) + 1)
    return r.choice([w[:i] + r.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + r.choice(letters) + w[i + 1 :]])


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "aéÿ÷z"])
def test_pairs_equal_brute_force(spark, letters):
    """Small alphabets bring repeated bigrams, many ties of frequency and every place of an edit."""
    r = random.Random(len(letters))
    words = {"".join(r.choice(letters) for _ in range(r.randint(6, 10))) for _ in range(60)} | {"a" * n for n in range(6, 13)}
    for w in sorted(words):
        words |= {neighbours(r, w, letters) for _ in range(3)}
    words = sorted(w for w in words if len(w) >= 6)
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long")
    got = sorted(tuple(x) for x in S.near_pairs(table).collect())
    assert got == sorted((a, b) for a in words for b in words if distance(a, b) == 1)


def test_forms_and_roots_equal_brute_force(spark):
    r = random.Random(9)
    base = ["".join(r.choice("abcde") for _ in range(7)) for _ in range(40)]
    counts = {}
    for w in base:
        for k in range(5):  # chains that shrink by about five a step
            counts.setdefault(w, max(5, 20_000 // 6**k + r.randint(0, 3)))
            w = neighbours(r, w, "abcde")
            if len(w) < 6:
                break
    got = {x.word: tuple(x) for x in S.group(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == brute(counts)
    assert any(got[got[x[1]][0]][1] for x in got.values() if x[1])  # a chain of two forms


def test_query_equals_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(4, 9))) for _ in range(50)]
    texts = [" ".join(r.choice([str.upper, str, str.title])(r.choice(vocabulary)) + r.choice(["", ",", "1", "-x", "×"]) for _ in range(300)) for _ in range(60)]
    texts += [None, "", "short", "ÀÉabcd ÀÉabcd", "long" * 500]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[0], None), (1, texts[1], "again")]
    seen = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode())
            if i is not None and h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    counts = {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(3)
    got = {x.word: tuple(x) for x in S.variants(docs).collect()}
    assert got == brute(counts) and len(got) > 30
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
