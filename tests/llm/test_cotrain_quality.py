import numpy as np
from pyspark.sql import functions as F

from stratalens.llm.cotrain_quality import CoTraining, co_train, filter_quality, fit, score_quality


def test_scores_of_labelled_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    model = fit(docs, labels.where("doc_id % 2 = 0"))
    out = score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id")
    good, bad = out.where("quality = 1"), out.where("quality = 0")
    assert good.where("kept").count() >= 0.98 * good.count()
    assert bad.where("NOT kept").count() >= 0.8 * bad.count()


def test_views_teach_each_other():
    """With few labels, each of two independent views profits from what the other is sure of."""
    rng = np.random.default_rng(3)
    y = (np.arange(4000) % 2).astype(float)
    views = [rng.normal(size=(4000, 12)) + np.outer(y - 0.5, np.r_[2.5, np.zeros(11)]) for _ in range(2)]
    few, pool = slice(0, 30), slice(30, 2000)

    def error(rounds):
        model = co_train([v[few] for v in views], y[few], [v[pool] for v in views], CoTraining(rounds=rounds, grow=0.2, ridge=1.0, confident=0.9))
        _, _, both = model.scores(views[0][2000:], views[1][2000:])
        return np.mean((both >= 0.5) != y[2000:])

    assert error(5) <= error(0) and error(5) < 0.12


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fit(odd, none) is None
    assert score_quality(odd, None).where("kept").count() == 11
    rows = [(i, ("good words here " if i % 2 else "### $$$ %%% ") * 20, "en", "s", 10) for i in range(60)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (1, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    model = fit(train, labels)
    out = score_quality(odd, model).collect()
    assert len(out) == 11 and all(0 <= r.score <= 1 for r in out)
    kept = filter_quality(train.withColumn("score", F.lit(0)), labels)
    assert kept.columns == [*train.columns, "score"] and {r.doc_id % 2 for r in kept.collect()} == {1} and kept.count() == 30
    assert filter_quality(empty, none).collect() == []


def test_sample_holds_one_row_of_a_repeated_id(spark, monkeypatch):
    from stratalens.llm import cotrain_quality

    rows = [(i % 20 if i < 300 else 7, f"text {i % 90}", "en", "s", i % 11) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(cotrain_quality, "co_train", lambda views, y, pool, rules: seen.append((len(y), len(pool[0]), views[0].tobytes())))
    cotrain_quality.fit(docs, labels)
    cotrain_quality.fit(docs.repartition(5, "n_chars"), labels)
    assert seen[0] == seen[1] and seen[0][:2] == (12, 8)
