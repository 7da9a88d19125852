"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from vecrec.llm.quality import quality_report
from vecrec.session import cut_lineage


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, docs, sf))
        assert after.schema.names == docs.schema.names, name
        before, kept = {r.doc_id for r in docs.collect()}, {r.doc_id for r in after.collect()}
        assert kept <= before and len(kept) > 0.7 * len(before), name
        if name == "quality":
            assert kept == {r.doc_id for r in quality_report(docs).where("kept").collect()}
        if name == "near_duplicates":
            texts = [r.text for r in after.collect()]
            assert len(texts) == len(set(texts))
        if name == "mixture":
            assert kept == before
        docs = after
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count()
    assert sorted(r.start + r.n_tokens for r in last)[:-1] == sorted(r.start for r in last)[1:]
