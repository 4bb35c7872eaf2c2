import corpus_pipeline
from starling.llm import exact_dedup, order_minhash


def test_stages(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, docs, path), "test")
        assert out.columns == docs.columns
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(set(ids)) == len(ids) and set(ids) <= seen
        if name == "exact dedup":
            assert set(ids) == {r["doc_id"] for r in exact_dedup.find_copies(docs).where("kept").collect()}
        if name == "near dedup":
            assert set(ids) == {r["doc_id"] for r in order_minhash.find_near(docs).where("kept").collect()}
        docs, seen = out, set(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == seen
    assert corpus_pipeline.run(spark, path).count() == packed.count()
