"""The n-gram join against brute force: shared and missing ids, links at the threshold, every link between different sets."""

import random
import re
from itertools import combinations

import numpy as np

from quilt.llm import ngram_join

WORD = re.compile("[^\x20\x09-\x0d]+")


def sets_of(text, size=5):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in WORD.findall(text or "")]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if len(w) >= size else frozenset([tuple(w)])


def linked(a, b):
    o = len(a & b)
    return bool(a) and bool(b) and 100 * o >= 75 * (len(a) + len(b) - o)


def expected(rows):
    """(id, n_shingles, component_id) of every row, by comparing all pairs."""
    known = [(i, sets_of(t)) for i, t in rows]
    parent = list(range(len(known)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in combinations(range(len(known)), 2):
        (i, a), (j, b) = known[x], known[y]
        if i is not None and j is not None and (i == j or linked(a, b)):
            parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(known):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s), None if i is None else least[find(x)]) for x, (i, s) in enumerate(known)), key=str)


def found(members):
    return sorted(((r.id, r.n_shingles, r.component_id) for r in members.collect()), key=str)


def prose(r, n):
    return " ".join(f"w{r.randrange(40)}" for _ in range(n))


def changed(r, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


def test_rows_that_share_an_id_keep_the_links_of_each_text(spark):
    r = random.Random(1)
    rows = []
    for g in range(30):
        one, two = prose(r, 60), prose(r, 80)
        rows += [(g, one), (g, two), (1000 + g, changed(r, one, 1)), (2000 + g, changed(r, two, 1)), (3000 + g, two)]
    rows += [(None, rows[0][1]), (None, None), (7777, None), (7777, rows[0][1]), (8888, ""), (8888, "")]
    r.shuffle(rows)
    members, _ = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert found(members) == expected(rows)


def test_families_of_near_copies_and_links_at_the_threshold(spark):
    r = random.Random(2)
    base = prose(r, 120)
    rows = [(i, changed(r, base, r.randrange(9))) for i in range(150)]
    rows += [(500 + i, changed(r, rows[i][1], 3)) for i in range(0, 150, 3)]
    # 7 n-grams, of which 6 are shared by sets of 7: 6 of 8; and 3 of 4
    rows += [(900, "a b c d e f g h i j k"), (901, "z b c d e f g h i j k"), (902, "a1 b1 c1 d1 e1 f1 g1 h1"), (903, "a1 b1 c1 d1 e1 f1 g1")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    members, links = ngram_join.join(docs)
    assert found(members) == expected(rows)
    assert {(902, 903), (900, 901)} <= {(x.a, x.b) for x in links.collect()}
    _, every = ngram_join.join(docs, every_link=True)
    ids = {}
    for i, t in rows:
        s = sets_of(t)
        ids[s] = min(i, ids.get(s, i))
    wanted = {(min(i, j), max(i, j)) for (a, i), (b, j) in combinations(ids.items(), 2) if linked(a, b)}
    assert {(x.a, x.b) for x in every.collect()} == wanted
    assert all(100 * x.o >= 75 * x.u for x in every.collect())


def test_equal_sets_have_equal_signatures_wherever_they_stand():
    r = random.Random(3)
    parts = [np.array(sorted(r.randrange(1 << 64) for _ in range(r.randrange(1, 400))), "u8") for _ in range(50)]
    parts = parts + parts[::-1]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    one, two = ngram_join.signatures(np.concatenate(parts), at)
    assert (one == one[::-1]).all() and (two == two[::-1]).all() and len(set(one.tolist())) == 50
