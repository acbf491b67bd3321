"""The pipeline's stages on the small table."""

import corpus_pipeline
from tidegrid.llm.common import kept, table

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, SF), "test")
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = packed.filter("piece = 0").count()
    assert whole == counts[4]


def test_clean_documents_stay(spark):
    labels = table(spark, SF, "labels").filter("quality = 1")
    docs = table(spark, SF, "documents")
    stays = corpus_pipeline.quality_classifier(spark, docs, SF)
    clean = docs.join(labels, "doc_id", "left_semi")
    assert clean.join(stays, "doc_id", "left_semi").count() >= 0.97 * clean.count()


def test_odd_rows_pass_all_stages(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            docs = kept(stage(spark, docs, SF), "test")
        docs.count()
