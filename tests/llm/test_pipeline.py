import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_pass_documents_on(spark):
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = d.columns, d.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf).cache()
        assert d.columns == columns, name
        assert 0 < d.count() <= before
        before = d.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, d, sf)
    assert packed.select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_no_documents(spark, docs):
    sf = "/root/testdata/sf0.001"
    d = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, sf)
    assert d.count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in entry.queries()} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
