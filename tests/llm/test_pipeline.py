"""The pipeline's stages, each against what its operator says of its own input."""

from __future__ import annotations

import pytest

import corpus_pipeline
from fleetnet.llm import mixing, passages, pieces, quality
from fleetnet.llm.common import stored, table
from test_nearcopies import plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SF)))
    return docs


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_in_order(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]
    assert all(d.columns == results[0].columns for d in results[:-1])


def test_rejected_documents_go(spark, results):
    scores = quality.scored(results[0], quality.fit(results[0], table(spark, SF, "labels")))
    assert ids(results[1]) == ids(scores.filter("score >= 0.5")) and len(ids(results[1])) < results[0].count()


def test_one_of_each_group_stays(results):
    """Against all pairs of likeness 4/5 or more over five-word shingles, counted in plain Python."""
    want = plain_groups({r.doc_id: r.text for r in results[1].collect()})
    assert ids(results[2]) == sorted(set(want.values())) and len(set(want.values())) < len(want)


def test_passages_are_cut(results):
    before = {r.doc_id: r.text for r in results[2].collect()}
    gone = {r.doc_id: r for r in passages.removed(results[2], corpus_pipeline.PASSAGE_BYTES, corpus_pipeline.ANCHOR_BYTES).collect()}
    for r in results[3].collect():
        if not gone[r.doc_id].n_removed:
            assert r.text == before[r.doc_id]
        assert abs(len(r.text.encode()) - gone[r.doc_id].n_bytes + gone[r.doc_id].n_removed) <= 6 * (gone[r.doc_id].n_spans + 1) and r.n_chars == len(r.text)
    assert ids(results[3]) == ids(results[2])


def test_sampled_and_encoded(results):
    assert ids(results[4]) == ids(mixing.mixture(results[3]).filter("sampled"))
    assert ids(results[5]) == ids(results[4]) and results[5].filter("not lossless").count() == 0
    back = {r.doc_id: r.text for r in pieces.decoded(results[5]).collect()}
    assert back == {r.doc_id: r.text for r in results[4].collect()}


def test_run_gives_the_last_stage(spark, results):
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids for r in results[5].collect()}


def test_empty_documents(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0
