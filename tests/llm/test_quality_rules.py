"""The outlier verdict against an exact minimum-covariance-determinant search in numpy, small groups included."""

import math
import random

import numpy as np

from quilt.llm import quality_rules
from quilt.llm.quality_rules import FLOORS, chi_square

SCHEMA = "doc_id long, text string, lang string, source string"


def prose(r, n):
    return " ".join(r.choice("the of shore light carries winter stone river glass north paper engine quiet".split()) + r.choice(["", "s", "ing", "er"]) + r.choice("abcdefgh") for _ in range(n))


def statistics(row):
    n = max(1, row.n_words)
    return [math.log1p(row.n_words), 4 * math.log1p(row.word_chars / n), math.log1p(100 * row.n_symbols / n), 4 * row.n_dup_lines / row.n_lines, 8 * row.n_repeat_words / n]


def exact_mcd(x, share, r, tries=30):
    """(mean, covariance) of least determinant, by concentration steps from many random starts until nothing moves."""
    n, d = x.shape
    h = max(1, math.ceil(share * n))
    floor = np.diag(np.array(FLOORS) ** 2)
    q = quality_rules.chi_square(share, d)
    factor = share / quality_rules._chi_share(q, d + 2)
    best = None
    for _ in range(tries):
        chosen = r.choice(n, min(n, d + 1), replace=False)
        for _ in range(50):
            m, c = x[chosen].mean(0), np.cov(x[chosen].T, bias=True).reshape(d, d) * factor + floor
            z = x - m
            near = np.argsort((z @ np.linalg.inv(c) * z).sum(1), kind="stable")[:h]
            if set(near) == set(chosen):
                break
            chosen = near
        det = np.linalg.det(c)
        if best is None or det < best[0]:
            best = det, m, c
    return best[1], best[2], h


def test_verdicts_agree_with_an_exhaustive_search(spark):
    r, rows = random.Random(4), []
    sizes = {("en", "a"): 400, ("en", "b"): 90, ("en", "tiny"): 3, ("de", "a"): 150, ("de", None): 1, (None, "x"): 60}
    for (lang, source), n in sizes.items():
        for _ in range(n):
            rows.append((len(rows), prose(r, r.randint(40, 300)), lang, source))
        for _ in range(n // 6 or 1):  # a sixth of junk, of two kinds
            junk = " ".join(w + "###" for w in prose(r, 100).split()) if r.random() < 0.5 else " ".join("x" * 60 + str(r.randrange(99)) for _ in range(80))
            rows.append((len(rows), junk, lang, source))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    lines = {x.id: x for x in quality_rules.measure(docs).collect()}
    vectors = {i: np.array(statistics(lines[i])) for i, *_ in rows}
    search, limit, prior = np.random.default_rng(0), math.sqrt(chi_square(1 - 1e-6, len(FLOORS))), 50.0

    def fit(ids, up):
        m, c, h = exact_mcd(np.array([vectors[i] for i in ids]), 0.75, search)
        um, uc = up or (m, np.diag((2 * np.array(FLOORS)) ** 2))
        return (h * m + prior * um) / (h + prior), (h * c + prior * uc) / (h + prior)

    members = {}
    for i, _, lang, source in rows:
        members.setdefault(lang, {}).setdefault(source, []).append(i)
    whole = fit([i for i, *_ in rows], None)
    different = 0
    for sources in members.values():
        language = fit([i for ids in sources.values() for i in ids], whole)
        own = {source: fit(ids, language) for source, ids in sources.items()}
        d2 = {i: (vectors[i] - own[s][0]) @ np.linalg.solve(own[s][1], vectors[i] - own[s][0]) for s, ids in sources.items() for i in ids}
        wide = np.median(list(d2.values()))
        for ids in sources.values():
            middle = (len(ids) * np.median([d2[i] for i in ids]) + prior * wide) / (len(ids) + prior)
            for i in ids:
                distance = math.sqrt(d2[i] / max(1.0, middle / chi_square(0.5, len(FLOORS))))
                if abs(distance - limit) > 0.15 * limit:  # not next to the threshold
                    different += got[i].kept != (distance <= limit)
    assert different <= 0.005 * len(rows)
    junk = [i for i, t, *_ in rows if "###" in t or "xxx" in t]
    assert not any(got[i].kept for i in junk)
    assert sum(got[i].kept for i, *_ in rows) >= 0.99 * (len(rows) - len(junk))


def test_ties_and_small_tables(spark):
    same = prose(random.Random(1), 60)
    rows = [(i, same, "en", "s") for i in range(30)] + [(None, None, None, None), (31, "", "en", "s"), (31, same, None, "s")]
    got = quality_rules.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(x.kept == (x.n_words > 0) for x in got)


def test_the_determinant_falls_with_every_step(spark):
    r = random.Random(6)
    docs = spark.createDataFrame([(i, prose(r, r.randint(30, 400)) + " #" * r.choice([0, 0, 0, 30]), "en", "s") for i in range(300)], SCHEMA)
    stats = quality_rules.measure(docs)
    rows = stats.select(*[x.alias(f"x{i}") for i, x in enumerate(quality_rules.transformed())]).selectExpr("'g' as grp", "*")
    found = []
    for steps in (1, 2, 4):
        found.append(quality_rules.Estimate(rows, len(FLOORS), FLOORS, 0.75, steps, True).best().first().logdet)
    assert found[0] >= found[1] - 0.05 and found[1] >= found[2] - 0.05
