"""Stages of the pipeline against brute force on the smallest tables, and on awkward rows."""

import pytest

import corpus_pipeline as P
from tesseraql.llm import bpe, decontaminate, langid

from test_decontaminate import least
from test_simhash import brute_components, brute_fingerprint
from test_substrings import brute as brute_repeats

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(i, t) for i, t in docs if t and any(map(str.isalpha, t))]
    ids = [i for i, _ in docs]
    roots = brute_components(ids, [brute_fingerprint(t) for _, t in docs])
    docs = sorted((i, t) for (i, t), c in zip(docs, roots) if i == c)
    cut = {i: (gone, kept) for i, _, gone, kept in brute_repeats(docs, 35)}
    docs = [(i, cut[i][1] if cut[i][0] else t) for i, t in docs]
    block = decontaminate.Block(list(enumerate(items)), decontaminate.BUDGET)
    flagged = {i for i, t in docs if block.search(decontaminate.normal(t))}
    for i, t in docs[:25]:  # the search itself, against all distances
        n = decontaminate.normal(t)[:3000]
        near = {k for k, x in enumerate(items[:6]) if least(x, n) <= int(0.1 * len(x))}
        assert near == {k for k in block.search(n) if k < 6}
    coder = bpe.encoder(bpe.default_path())
    want = {i: coder.encode(t) for i, t in docs if i not in flagged}
    got = {r.doc_id: r.ids for r in P.run(spark, SF).collect()}
    assert got == want and flagged


@pytest.mark.parametrize("stage", range(len(P.STAGES)))
def test_awkward_rows(spark, stage):
    rows = [(1, "a few words", "en", "s", 11), (1, "a few words", "en", "s", 11), (None, None, None, None, None), (2, "", None, "s", 0), (3, "123", "de", None, 3), (None, "words of a text", "en", "s", 15), (4, "long " * 20_000, "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        out = P.STAGES[stage][1](spark, docs, SF)
        if stage < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        found = out.collect()
        assert len(found) <= len(data)
        if stage == 0 and data:
            assert len(found) == 4
        if stage == 1 and data:
            assert sorted((r.doc_id or -1) for r in found) == [-1, 1, 2, 3, 4]
        if stage in (2, 3, 4):
            assert len(found) == len(data)


def test_language_stage_keeps_labelled_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert P.language(spark, docs, SF).count() == docs.where(docs.text.rlike(r"\p{L}")).count()
    assert langid.SAMPLE_SYMBOLS > 0
