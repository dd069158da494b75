"""The pipeline's stages against brute force, and its contract."""

from collections import Counter

import corpus_pipeline
from quilt.llm import mixing, ngram_join, quality_rules, suffix_dedup
from tests.llm.test_operators import SCHEMA, brute_components, brute_cut, fixture_rows, shingle_sets


def test_stages(spark, tmp_path):
    docs = spark.createDataFrame(fixture_rows(8) + [(None, "null id " * 40, "en", "a", 5, 1, "c", None, "x", 3)], SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_join", "suffix_dedup", "mixing", "bpe"]
    before = docs.collect()
    stage = dict(corpus_pipeline.STAGES)

    # quality: exactly the rejected rows go
    kept = stage["quality_rules"](spark, docs, "")
    assert kept.columns == docs.columns
    verdict = {(x.doc_id, x.n_words): x.kept for x in quality_rules.judge(docs).collect()}
    want = Counter(x.doc_id for x in before if verdict[(x.doc_id, len((x.text or "").split()))])
    assert Counter(x.doc_id for x in kept.collect()) == want

    # near duplicates: the smallest id of each component, once
    rows = docs.where("doc_id is not null")
    once = stage["ngram_join"](spark, docs, "")
    assert once.columns == docs.columns
    comp = brute_components(shingle_sets([(x.doc_id, x.text) for x in rows.collect()]))
    assert Counter(x.doc_id for x in once.collect()) == Counter([None, *{i for i in comp if comp[i] == i}])

    # repeats: lengths after the cut
    cut = stage["suffix_dedup"](spark, once, "")
    assert cut.columns == docs.columns
    sizes = brute_cut([(x.doc_id, x.text) for x in once.collect() if x.doc_id is not None])
    for x in cut.collect():
        if x.doc_id is not None and x.text is not None:
            n, gone, *_ = sizes[x.doc_id]
            assert n - gone - 6 <= len(x.text.encode()) <= n - gone and x.n_chars == len(x.text)

    # mixing: nothing is lost, nothing comes more than twice
    mixed = stage["mixing"](spark, cut, "")
    assert mixed.columns == docs.columns
    copies = Counter(x.doc_id for x in mixed.collect())
    assert set(copies) == {x.doc_id for x in cut.collect()} and max(copies.values()) <= 2
    out = stage["bpe"](spark, mixed, "")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == mixed.count()


def test_run_and_empty(spark, tmp_path):
    rows = fixture_rows(3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert 0 < out.count() <= 2 * len(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_modules_have_docstrings():
    for m in (mixing, ngram_join, quality_rules, suffix_dedup):
        assert "empty table" in m.__doc__
