import corpus_pipeline
from llm_fixtures import SF_SMALL, edge, empty  # noqa: F401

import __spark_entry__ as entry
from crisismap.llm.common import stored


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF_SMALL), f"test-{name}")
        assert after.columns == docs.columns and after.count() <= docs.count()
        assert after.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").count() == 0
        docs = after
    assert 0.5 * before < docs.count() < before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_edges(spark, edge, empty):
    for docs in (edge.drop("score"), empty):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SF_SMALL).collect()


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(entry.oracle_sql()) <= names
