from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from sealwright.llm import common, language, mixing, packing, pii
from tests.llm.test_near_copies import slow_kept


@pytest.fixture(scope="module")
def docs(spark, sf):
    extra = spark.createDataFrame(
        [(None, "null id but words enough to be told as English text of some kind", "en", None, 3), (90_001, None, "en", "src0", 0), (90_002, "12 34 !!", None, "src1", 8), (90_003, "the and of to in is that", None, "src1", 3)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return common.stage(spark.read.parquet(f"{sf}/documents.parquet").unionByName(extra), "pipeline-input")


def test_stages_in_order(spark, docs, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "personal_data", "source_mixing", "packing"]
    got = {}
    for name, step in corpus_pipeline.STAGES:
        before, docs = docs, common.stage(step(spark, docs, sf), name)
        got[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            rows, kept = before.collect(), {r.doc_id: r.lang for r in docs.collect()}
            assert {r.doc_id for r in rows} - set(kept) == {90_001, 90_002}
            assert kept[90_003] is not None
        if name == "simhash_near_dedup":
            # one of each class of five-word shingle sets with a similarity of 0.8 or more, by all pairs
            want = slow_kept([(r.doc_id, r.text) for r in before.collect()])
            assert Counter((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == want
        if name == "personal_data":
            was = {r.doc_id: r.text for r in before.collect()}
            for r in docs.collect():
                assert not pii.base_spans(r.text)
                if not pii.base_spans(was[r.doc_id]):
                    assert r.text == was[r.doc_id]
        if name == "source_mixing":
            count = lambda table: sum(len(re.findall(common.WORD, r.text)) for r in table.collect())
            assert abs(count(docs) - 1.5 * count(before)) <= 64 * 21
        if name == "packing":
            want = sum(len(x) // 2 for x in (list(packing.tokens.encoded([r.text.encode()], packing.tokens.default_tokenizer(), 2))[0] for r in before.collect()))
            assert sum(r.length for r in docs.collect()) == want


def test_run_and_empty_input(spark, sf, tmp_path):
    found = corpus_pipeline.run(spark, sf)
    assert found.count() > 0
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert language.UNKNOWN == "und" and mixing.CAP == 2
