import corpus_pipeline

SF = "/root/testdata/sf0.01"


def test_stages_one_after_another(spark, tmp_path):
    from test_minhash_forest import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        seen[name] = ({r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    a, b = seen[names[0]]
    good = [i for i in a if labels.get(i) == 1]
    assert sum(i in b for i in good) >= 0.98 * len(good)
    a, b = seen[names[1]]
    groups = brute([(i, r.text) for i, r in a.items()], corpus_pipeline.NEAR)
    assert set(b) == {i for i in a if groups[i][1] == i}
    a, b = seen[names[2]]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {i for i in a if any(t in a[i].text for t in items)} <= set(a) - set(b)
    assert len(b) >= 0.9 * len(a)
    a, b = seen[names[3]]
    assert set(a) == set(b) and all(b[i].n_chars == len(b[i].text) for i in b if a[i].n_chars == len(a[i].text))
    a, b = seen[names[4]]
    assert set(a) == set(b) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in b.values())
    whole = {(r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == {(r.doc_id, tuple(r.token_ids)) for r in b.values()}
