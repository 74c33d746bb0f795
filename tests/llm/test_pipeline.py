import corpus_pipeline


def test_pipeline_on_the_smallest_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "mixing", "packing"]
    out = corpus_pipeline.run(spark, d)
    assert out.where("offset < 0 or length <= 0").count() == 0 and out.count() > 0
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, d)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
