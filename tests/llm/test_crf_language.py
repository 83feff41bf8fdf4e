import itertools
import zlib

import numpy as np
import pyarrow as pa

from stratalens.llm.crf_language import Training, _features, fit, held_out, identify, letter_runs, marginals, sequences, train
from stratalens.llm.wordhash import text_buffers


def test_marginals_by_brute_force():
    rng = np.random.default_rng(2)
    for lengths in ([1], [5], [3, 1, 4], [2, 6]):
        k, n = 3, sum(lengths)
        e, a = rng.normal(size=(n, k)), rng.normal(size=(k, k))
        first = np.zeros(n, dtype=bool)
        first[np.cumsum([0, *lengths[:-1]])] = True
        want = np.zeros((n, k))
        for start, length in zip(np.cumsum([0, *lengths[:-1]]), lengths, strict=True):
            total = 0.0
            for path in itertools.product(range(k), repeat=length):
                p = np.exp(sum(e[start + i, y] for i, y in enumerate(path)) + sum(a[u, v] for u, v in itertools.pairwise(path)))
                total += p
                for i, y in enumerate(path):
                    want[start + i, y] += p
            want[start : start + length] /= total
        assert np.allclose(marginals(e, a, first), want)


def test_held_out_accuracy(documents):
    field = fit(documents)
    out = {r.doc_id: r for r in identify(documents, field).withColumn("held", held_out()).collect()}
    rows = documents.collect()
    assert all(out[r.doc_id].held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if out[r.doc_id].held]
    right = sum(out[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out.values())


def test_code_switched_words(spark, documents):
    field = fit(documents)
    texts = {}
    for r in documents.collect():
        texts.setdefault(r.lang, " ".join(r.text.replace("|", " ").split()[:30]))
    mixed = spark.createDataFrame([(1, f"{texts['en']} {texts['de']}")], "doc_id long, text string")
    spans = identify(mixed, field, spans=True).first().spans
    share = {lang: sum(s.end_word - s.first_word for s in spans if s.lang == lang) for lang in ("en", "de")}
    assert min(share.values()) >= 20


def test_odd_rows(spark, odd, empty, documents):
    field = fit(documents)
    rows = {r.doc_id: r for r in identify(odd, field).where("doc_id IS NOT NULL").collect()}
    assert [rows[i].lang_pred for i in (2, 3, 4)] == ["und"] * 3 and rows[7].lang_pred != "und" and rows[8].lang_pred != "und"
    assert identify(odd, field).count() == 11 and identify(empty, field).collect() == []
    digits = spark.createDataFrame([(1, "123 — 456 !"), (2, "\U0001f600")], "doc_id long, text string")
    assert {r.lang_pred for r in identify(digits, field).collect()} == {"und"}
    assert fit(empty) is None and train([]) is None
    assert {r.lang_pred for r in identify(odd, None).collect()} == {"und"}


def test_words_with_inner_signs_and_texts_of_few_words():
    """Every sequence has its full length, whatever the words: none is dropped or cut."""
    french = ["l'eau d'un qu'il s'est n'a c'est j'ai l'or d'or a1b — x.y"] * 3
    junk = ["1234 5678 90 " * 50 + "zq", "1 2 3 zw"]
    samples = [("fr", t) for t in french] + [("junk", t) for t in junk] + [("en", "the man said that it was his own house on a hill")]
    by = [[letter_runs(t) for g, t in samples if g == lang] for lang in ("en", "fr", "junk")]
    assert by[1][0][:4] == ["l", "eau", "d", "un"] and by[1][0][-4:] == ["a", "b", "x", "y"] and by[2] == [["zq"], ["zw"]]
    training = Training(sequences=200)
    lines, labels = sequences(by, training)
    assert labels.shape == (200, 24) and set(np.unique(labels)) == {0, 1, 2}
    assert set(np.diff(_features(*text_buffers(pa.array(lines, pa.large_string())))[4])) == {24}
    for line, gold in zip(lines, labels, strict=True):
        assert all(any(w in text for text in by[y]) for w, y in zip(line.split(), gold, strict=True))
    field = train(samples, training)
    assert field.languages == ["en", "fr", "junk"] and all(np.abs(field.weights[3][:, y]).max() > 0.5 for y in range(3))
    off = field.transitions - np.diag(np.diag(field.transitions))
    assert min(np.diag(field.transitions)) > off.max()


def test_apostrophe_language_is_learned(spark):
    french = "l'eau d'un qu'il s'est n'a c'est j'ai l'or d'or m'a t'en qu'on"
    english = "the man said that it was his own house on a hill by the sea"
    field = train([("fr", french), ("en", english)] * 5, Training(sequences=300))
    frame = spark.createDataFrame([(1, "qu'il n'a d'eau"), (2, "the house was his")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in identify(frame, field).collect()} == {1: "fr", 2: "en"}


def test_sample_holds_one_row_of_a_repeated_id(spark, monkeypatch):
    """A hot id neither fills a language's sample nor lends its language to its other rows; the bound holds over all languages."""
    from stratalens.llm import crf_language

    hot = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5)
    rows = [(hot, f"hot text {i % 7}", "en") for i in range(400)] + [(hot, "no language", None)]
    rows += [(i, f"word {i}", ("en", "fr", "de")[i % 3]) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = []
    monkeypatch.setattr(crf_language, "train", lambda samples, training: seen.append(samples))
    crf_language.fit(docs)
    crf_language.fit(docs, Training(per_language=20, most=30))
    every, few = seen
    assert sum("hot" in text for _, text in every) == 1 and not any(text == "no language" for _, text in every)
    assert len(every) == 1 + sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(100, 400))
    assert sorted(lang for lang, _ in few) == ["de"] * 10 + ["en"] * 10 + ["fr"] * 10
