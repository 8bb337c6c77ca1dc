"""The pipeline stage by stage, each against its operator's plain version."""

import corpus_pipeline
import pytest
from llm.common import written
from test_similar import kept_ids
from test_suffix_dedup import brute as brute_cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, sample):
    docs, out = sample, [sample]
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "pipeline-test")
        out.append(docs)
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "simhash_near_dedup", "suffix_array_dedup", "packing"]
    assert all(d.columns == stages[0].columns for d in stages[1:5])
    assert stages[5].columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_near_duplicates_keep_the_smallest(stages):
    """By five words at a similarity of 0.8, as stages on word shingles owe; two bits of three words bind op10 alone."""
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    assert sorted(r.doc_id for r in stages[3].collect()) == kept_ids(rows)


def test_cut_texts(stages):
    import hashlib

    before = [(r.doc_id, r.text) for r in stages[3].collect()]
    after = {r.doc_id: r for r in stages[4].collect()}
    for doc, _, _, _, sha in brute_cut(before):
        own = after[doc]
        assert own.n_chars == len(own.text)
        if own.text.isascii():
            assert hashlib.sha256(own.text.encode()).hexdigest() == sha


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[5].collect()))


def test_stages_take_empty_tables_and_edges(spark, edge, nothing):
    for docs in (nothing, edge):
        now = docs
        for name, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF), "pipeline-edge")
            assert name == "packing" or now.columns == docs.columns
