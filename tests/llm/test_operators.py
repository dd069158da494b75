"""Every operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quilt.llm import bpe, embedding_dedup, html_text, mixing, ngram_join, quality_model, quality_rules, sharding, suffix_dedup, warc
from quilt.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, t string, tokens string, _h string, size int"


def prose(r, n):
    words = ["the", "and", "of", "shore", "light", "carries", "winter", "über", "día", "stone", "river", "glass", "north", "paper", "engine", "quiet"]
    return " ".join(r.choice(words) + r.choice(["", "", "ing", "er", "ed", "s"]) + r.choice("abcdefgh") for _ in range(n))


def fixture_rows(seed=5):
    r = random.Random(seed)
    base = [prose(r, r.randint(30, 120)) for _ in range(40)]
    passage = prose(r, 60)
    texts = list(base)
    texts += [base[0]] * 6 + [base[1] + " tail"] * 3
    for i in range(25):  # near copies of one text, all different
        w = base[2].split(" ")
        w[r.randrange(len(w))] = f"x{i}"
        texts.append(" ".join(w))
    texts += [prose(r, 30) + "\n" + passage + "\n" + prose(r, 30) for _ in range(8)]
    texts += [None, "", " \t\n", "one two", "One  TWO", "a b c d", "ab" * 400, "é" * 120, "\n".join(["same line here"] * 30), "### ***\n" * 20, " ".join(["w"] * 50)]
    texts.append(prose(r, 20000))
    r.shuffle(texts)
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["hot", "hot", "a", None]), None if t is None else len(t), -i, "clash", None, "x", 3) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1], r[2], r[3]) for r in fixture_rows()]


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def unite(parent, a, b):
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)


# sharding


def test_sharding(docs, rows, empty, spark):
    got = sharding.shard(docs, n_shards=4, heavy=8, slot_rows=20).collect()
    assert sorted(x.doc_id for x in got) == sorted(x[0] for x in rows)
    size = {i: 1 if t is None else len(t.encode()) + 1 for i, t, *_ in rows}
    crc = {i: zlib.crc32((t or "").encode()) for i, t, *_ in rows}
    for x in got:
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (size[x.doc_id], crc[x.doc_id], "bytes", None)
    for s in range(4):
        slots = sorted(x.slot for x in got if x.shard == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty, n_shards=4).count() == 0
    # many texts of like size: near-equal bytes, copies stay together, a hot text is split
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot text")).otherwise(F.repeat(F.concat(F.lit("t"), (F.col("id") % 1700).cast("string")), 3)).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    out = sharding.shard(many, n_shards=16).toPandas()
    b = out.groupby("shard")["size"].sum()
    assert len(b) == 16 and b.max() / b.min() < 1.25
    cold = out[out.text_crc32 != zlib.crc32(b"hot text")]
    assert cold.groupby("text_crc32")["shard"].nunique().max() == 1
    assert sharding.shard(many, target_bytes=int(b.sum() / 5)).select("shard").distinct().count() == 5


# embeddings


def brute_links(vectors):
    ok = [v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in vectors]
    n = len(vectors)
    links, parent = [0] * n, list(range(n))
    unit = [np.array(v, "f8") / np.linalg.norm(v) if k else None for (_, v, _), k in zip(vectors, ok, strict=True)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and vectors[i][2] == vectors[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.93:
                links[i] += 1
                links[j] += 1
                unite(parent, i, j)
    least = {}
    for i in range(n):
        least[find(parent, i)] = min(least.get(find(parent, i), 1 << 60), vectors[i][0])
    return {vectors[i][0]: (links[i], least[find(parent, i)]) for i in range(n)}


def test_embeddings(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(60, 24))
    vectors = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    for k in range(250):  # neighbours at all distances around the threshold
        i = int(r.integers(60))
        vectors.append((100 + k, (base[i] + r.normal(size=24) * r.uniform(0, 0.5)).tolist(), i % 3))
    vectors += [(500 + k, base[5].tolist(), 2) for k in range(40)]
    vectors += [(600, None, 1), (601, [0.0] * 24, 1), (602, [float("nan")] * 24, 1), (603, [None] + [1.0] * 23, 1), (604, base[5].tolist(), None), (605, [1.0, 2.0], 1), (606, [float("inf")] + [1.0] * 23, 1)]
    schema = "vec_id long, embedding array<float>, label int, m long, cid long, x string"
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in vectors]
    want = brute_links(f32)
    df = spark.createDataFrame([(*v, 1, 2, "x") for v in f32], schema)
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(df).collect()}
    assert set(got) == set(want)
    found, all_ = sum(x.n_links for x in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.97 * all_
    for i, x in got.items():
        assert x.n_links <= want[i][0] and x.kept == (x.component_id == i)
    for i in range(600, 607):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    none = spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<float>, label int")
    assert [tuple(x) for x in embedding_dedup.near_duplicates(none).collect()] == [(1, 0, 1, True)]


def test_embeddings_of_a_large_table_use_the_same_tables(spark, monkeypatch):
    r = np.random.default_rng(7)
    base = r.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = r.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    partners = 0.931 * base + (1 - 0.931**2) ** 0.5 * side
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate([*base, *partners])], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(type(df), "count", lambda self: 5_000_000)  # what a table of so many classes says
    _, links = embedding_dedup.link(df)
    assert len(links.collect()) >= 0.99 * 3000


# n-gram join


def shingle_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(sets, percent=75):
    ids = sorted(sets)
    parent = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                unite(parent, a, b)
    return {i: find(parent, i) for i in ids}


def test_ngram_join(docs, rows, empty):
    sets = shingle_sets(rows)
    want = brute_components(sets)
    members, links = ngram_join.join(docs)
    got = members.collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_shingles, x.component_id) == (len(sets[x.id]), want[x.id])
    for x in links.collect():
        assert x.o == len(sets[x.a] & sets[x.b]) and 100 * x.o >= 75 * x.u
    assert ngram_join.join(empty)[0].count() == 0


def test_ngram_join_chains_and_hot_passages(spark):
    r = random.Random(9)
    text = prose(r, 80).split(" ")
    passage = prose(r, 40)
    rows = []
    for i in range(60):  # a chain: each links with the next, not with those far away
        text[i] = f"step{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, passage + " " + prose(r, r.randint(3, 60))) for i in range(150)]
    want = brute_components(shingle_sets(rows))
    members, _ = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {x.id: x.component_id for x in members.collect()} == want


# quality model


def test_quality_model(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(1200):
        good = r.random() < 0.7
        t = prose(r, r.randint(20, 120)) + "." if good else " ".join(w.upper() + "!!" for w in prose(r, r.randint(20, 120)).split())
        rows.append((i, t, "clash"))
        labels.append((i, int(good)))
    rows += [(2000, None, "c"), (2001, "", "c"), (None, "x", "c")]
    labels += [(2000, None), (None, 1), (7, labels[7][1])]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string, x string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x for x in quality_model.score(df, lab).collect()}
    assert len(got) == len(rows)
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in range(1200))
    truth = dict(labels[:1200])
    assert np.mean([(got[i].score >= 0.7) == bool(truth[i]) for i in held]) > 0.97
    assert all(0 <= x.score <= 1 for x in got.values())
    # held-out labels are never read
    flipped = spark.createDataFrame([(i, (1 - q) if i in set(held) else q) for i, q in labels[:1200]], "doc_id long, quality int")
    again = {x.doc_id: x.score for x in quality_model.score(df, flipped).collect()}
    assert max(abs(again[i] - got[i].score) for i in range(1200)) < 1e-6
    assert {x.score for x in quality_model.score(df, lab.where("false")).collect()} == {0.5}
    assert quality_model.score(df.where("false"), lab).count() == 0


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    x, y = np.sort(r.random(200)), r.random(200)
    _, ys = quality_model.isotonic(x, y, np.ones(200))
    assert (np.diff(ys) >= 0).all()


# quality rules


def base_rules(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    counts = Counter(windows)
    covered = {j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows, empty):
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows}
    for x in got:
        want = base_rules(text[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (x.base_failed and x.kept)
    assert quality_rules.judge(empty).count() == 0


def test_outliers_are_rejected_and_clean_rows_kept(spark):
    r = random.Random(3)
    rows = [(i, prose(r, r.randint(40, 300)) + ".", "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(w + "###" for w in prose(r, 100).split()), "en", "s") for i in range(80)]
    got = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert sum(got[i] for i in range(400)) >= 398
    assert not any(got[1000 + i] for i in range(80))


# mixing


def test_exponent():
    tokens = [1000.0, 100.0, 10.0, 0.0]
    a = mixing.choose_exponent(tokens, target_entropy=0.9)
    w = mixing.weights(tokens, a)
    assert abs(mixing.entropy(w) / np.log(3) - 0.9) < 1e-9 and w[3] == 0
    b = mixing.choose_exponent(tokens, repetition=4.0)
    w = mixing.weights(tokens, b)
    assert max(x * 1110 / t for x, t in zip(w, tokens[:3], strict=False)) <= 4 + 1e-9
    assert mixing.choose_exponent([5.0]) == 1.0


def test_mixing(docs, rows, empty):
    got = mixing.plan(docs, target_entropy=0.99, repetition=3.0, block_rows=4).collect()
    assert len(got) == len(rows)
    count = lambda t: len(WORD.findall(t or ""))
    total, drawn = Counter(), Counter()
    text = {i: t for i, t, *_ in rows}
    for x in got:
        assert x.n_tokens == count(text[x.doc_id])
        total[x.source] += x.n_tokens
        drawn[x.source] += x.n_tokens * x.copies
    everything = sum(total.values())
    largest = max(count(t) for t in text.values())
    weight = {x.source: x.weight for x in got}
    for s in total:
        target = min(weight[s] * everything, 3.0 * total[s])
        assert target - largest - 1 <= drawn[s] <= target + 1
    for s in total:  # whole epochs plus at most one more
        assert len({x.copies for x in got if x.source == s and x.n_tokens}) <= 2
    assert mixing.plan(empty).count() == 0 and mixing.realise(empty).count() == 0
    out = mixing.realise(docs, target_entropy=0.99, repetition=2.0, floor_one=True)
    assert out.columns == docs.columns
    copies = Counter(x.doc_id for x in out.collect())
    assert set(copies) == {x[0] for x in rows}
    repeated = rows[3][0]
    assert all(1 <= n <= 2 for i, n in copies.items() if i != repeated) and 3 <= copies[repeated] <= 6


# WARC


def test_warc(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://a b/\n", None), (4, "u", ""), (5, "u", "x" * 200_000), (None, "n", "null id"), (2, None, "<p>same</p>")]
    pages += [(100 + i, f"http://h/{i}", f"<html><body><p>page {i % 40} with text {i % 40}</p></body></html>") for i in range(200)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha string").repartition(3)
    folder = f"file://{tmp_path}/w"
    got = warc.read(warc.write(df, folder, archive_bytes=20_000), folder, payloads=True).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 1 << 60), i)
    body = {i: (h or "").encode() for i, _, h in pages}
    for x in got:
        b = body[x.page_id]
        assert x.payload_bytes == len(b) and x.payload_digest == base64.b32encode(hashlib.sha1(b).digest()).decode()
        one = first.get(b.decode())
        if x.page_id is None or one == x.page_id:
            assert x.record_type == "response" and x.refers_to is None and x.payload == b
        else:
            assert x.record_type == "revisit" and x.refers_to == one
    none = df.where("false")
    assert warc.read(warc.write(none, folder + "2"), folder + "2").count() == 0
    big = warc.read(warc.write(df, folder + "3", min_bytes=1000), folder + "3")
    assert big.where("record_type = 'revisit'").count() == 0


def test_archive_round_trip():
    records = [warc.build_record(i, "u", (f"<html>hello number {i} of many pages</html>" * 20).encode(), None, False, "2025-01-01T00:00:00Z") for i in range(60)]
    data = warc.write_archive(records)
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(data[4:8], "little") > 0
    assert list(warc.read_archive(data)) == records


# suffix arrays


def brute_cut(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((i, t) for i, t in {(i, t or "") for i, t, *_ in rows}):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            if w in seen:
                gone[j : j + length] = True
            seen.add(w)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, "u1")[~gone].tobytes()).hexdigest())
    return out


def test_suffix_dedup(docs, rows, empty):
    want = brute_cut(rows)
    got = suffix_dedup.digest(docs, batch_bytes=3000).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want[x.doc_id]
    assert suffix_dedup.digest(empty).count() == 0
    stripped = suffix_dedup.strip(docs)
    assert stripped.columns == docs.columns
    assert stripped.where("text is null").count() == sum(t is None for _, t, *_ in rows)


def test_suffix_dedup_partial_overlaps(spark):
    r = random.Random(4)
    source = "".join(r.choice("abcdefghij \n") for _ in range(3000))
    rows = []
    for i in range(120):  # pieces of all lengths around the threshold, at all offsets
        a = r.randrange(2800)
        rows.append((i, "".join(r.choice("klmnop") for _ in range(r.randint(0, 40))) + source[a : a + r.randint(80, 260)] + "".join(r.choice("qrstuv") for _ in range(r.randint(0, 40)))))
    rows += [(200, "z" * 500), (201, "xyz" * 100), (202, "z" * 99), (203, "z" * 100)]
    want = brute_cut(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({"batch_bytes": 2000, "buckets": 3}, {"broadcast_rows": 0}):
        got = {x.doc_id: tuple(x)[1:] for x in suffix_dedup.digest(df, **options).collect()}
        assert got == want


def test_minima_are_leftmost():
    r = np.random.default_rng(0)
    for w in (1, 2, 7, 69):
        h = r.integers(0, 5, 400).astype("u8")
        got = suffix_dedup.leftmost_minima(h, w)
        assert got.tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


def test_family_keeps_first_occurrences():
    r = np.random.default_rng(1)
    family, seen, repeats = suffix_dedup.Family(), {}, 0
    entries = []
    for d in range(50):
        e = np.zeros(40, suffix_dedup.ENTRY)
        e["key"], e["block"], e["doc"], e["at"], e["n"] = r.integers(0, 30, 40), r.integers(0, 6, 40), (d * 17) % 50, np.arange(40), 1
        entries.append(e)
        kept, again = suffix_dedup.first_of_each(suffix_dedup.order(e))
        repeats += len(again) + sum(len(x) for x in family.add(kept))
    everything = np.concatenate(entries)
    for x in everything:
        k = (int(x["key"]), int(x["block"]))
        seen[k] = min(seen.get(k, (1 << 60, 0)), (int(x["doc"]), int(x["at"])))
    left = family.merged()
    assert {(int(x["key"]), int(x["block"])): (int(x["doc"]), int(x["at"])) for x in left} == seen
    assert repeats == len(everything) - len(seen)


# HTML


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>Just this sentence, which is the only one that the page has and is long enough to be of use to the reader.", "Just this sentence, which is the only one that the page has and is long enough to be of use to the reader."),
        ("<html><nav><a href=x>Home</a></nav><article><h1>T&amp;T</h1><p>One\n  two<!-- c --> three.</p><p>No.</p><script>var a='</p>'</script></article><footer>&copy; us</footer>", "T&T\nOne two three.\nNo."),
        ("<body><header>Site</header><div class='ad'>Buy the best of it all now</div><main><p>The text of the main part.</p><aside>Also read the other one</aside><form>Name <input></form></main><div id=comments><p>I like the article and so do you, it is what it is.</p></div>", "The text of the main part."),
        ("<article><p>a < b and c > d</p><p><span class=promo>Sale!</span>Kept here.</p><ul><li><a href=1>Link</a></li></ul>", "a < b and c > d\nKept here."),
        ("<title>x</title><div>" + "The sea was calm and the wind was low on that day, as it had been for all of the week. " * 4 + "</div><div>Short one.</div><div><a href=q>click</a></div>", ("The sea was calm and the wind was low on that day, as it had been for all of the week. " * 4).strip() + "\nShort one."),
        ("<article><p>cut off <a hre", "cut off"),
        ("<div id=top><article><p>Inside the page's top.</p><article class=comment><p>A reader's word.</p></article></article></div>", "Inside the page's top."),
        ("<!-- never closed <p>text", ""),
    ],
)
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_a_class_name_does_not_silence_the_page():
    prose = "This is what the reporter had to say about it, and it was more than they would have said if they had not been there at the time. " * 3
    for mark in ("article-title", "post-meta", "entry-head", "content-top", "story"):
        assert html_text.main_text(f"<div class='{mark}'><h1>T</h1></div><p>{prose}</p>") == f"T\n{prose.strip()}"
    assert html_text.main_text(f"<div class=content><p>{prose}</p></div><article><p>The article.</p></article><p>{prose}</p>") == f"{prose.strip()}\nThe article."
    assert html_text.main_text("<div class=content><p>" + "日本語の文章" * 20 + "</p></div>") == "日本語の文章" * 20


def test_html_operator(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<article><p>Grüße</p></article>", "y"), (2, "u", "<article><p>Grüße</p></article>", "y")], "page_id long, url string, html string, text string")
    assert sorted(tuple(x) for x in html_text.extract(df).collect()) == sorted([(1, None, "", 0), (2, "u", "Grüße", 5), (2, "u", "Grüße", 5)], key=str)
    assert html_text.extract(df.where("false")).count() == 0


# BPE


@pytest.fixture(scope="module")
def coders():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    lib.no_truncation()
    lib.no_padding()
    return bpe.transducer(vocabulary()), lib


def test_bpe_equals_the_library(coders):
    t, lib = coders
    r = random.Random(1)
    pool = "abcdefghijklmnopqrstuvwxyzthethe  ''sdllve1234567890½²Ⅷ٣\t\n\x85\xa0　!?<|>ΣσςİıßŉÀàééà中文字🙂ǅก̀_-#\x00"
    for _ in range(400):
        x = "".join(r.choice(pool) for _ in range(r.randint(0, 120)))
        if r.random() < 0.2:
            x += "<|endoftext|>" + x[:7] + "<|startoftext|>"
        ids = lib.encode(x, add_special_tokens=False).ids
        assert t.encode(x) == ids
        assert " ".join(t.token_strings(ids)) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_streams_long_words_in_constant_memory(coders):
    t, lib = coders
    r = random.Random(2)
    for word in ("a" * 30000, "th" * 9000, "".join(r.choice("theandionsrt") for _ in range(30000))):
        assert t.encode(word) == lib.encode(word, add_special_tokens=False).ids
        small = list(t.stream_word(word[i : i + 7].encode() for i in range(0, len(word), 7)))
        assert small == lib.encode(word, add_special_tokens=False).ids
    assert "".join(t.decode_stream(t.encode("héllo 🙂 wörld"))).split() == ["héllo", "🙂", "wörld"]


def test_bpe_operator(docs, rows, empty, coders):
    _, lib = coders
    text = {i: t or "" for i, t, *_ in rows}
    got = bpe.digests(docs, vocabulary()).collect()
    assert len(got) == len(rows)
    for x in got:
        ids = lib.encode(text[x.doc_id], add_special_tokens=False).ids
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty, vocabulary()).count() == 0
    assert bpe.encode(docs, vocabulary()).where("size(ids) > 0 and decoded = ''").count() == 0
