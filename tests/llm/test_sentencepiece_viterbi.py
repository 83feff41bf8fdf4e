import itertools
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pytest
import sentencepiece

from stratalens.llm.sentencepiece_viterbi import Pieces, _encoder, decode, decoded, encode, encode_words, load_pieces, marked_words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_ids_are_the_librarys(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = decoded(encode(documents, MODEL, keep=["lang"], round_trip=True), MODEL).collect()
    assert len(out) == documents.count()
    for r in out:
        assert r.token_ids == library.encode(r.text) and r.decoded == r.text and r.round_trip


@pytest.mark.parametrize("text", ["a  b", "   ", "\n", " lead\n\n tail ", "tab\there", "日本語 \U0001f600", "▁", "a▁b ▁▁", "x" * 3000, "éé\u0000\\"])
def test_round_trip(text):
    pieces = load_pieces(MODEL)
    ids = [i for w in marked_words(text) for i in encode_words([w], pieces)[w]]
    assert decode(ids, pieces) == text
    if "▁" not in text:
        assert ids == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)


def test_unigram_scores_by_brute_force():
    scores = {"a": -3.0, "b": -2.5, "ab": -4.0, "ba": -5.6, "aba": -6.9, "c": -1.0, "bc": -3.4, "abc": -6.2}
    pieces = Pieces(scores, {p: i for i, p in enumerate(scores)}, [0] * 256, [], merges=False)
    words = ["".join(p) for n in range(1, 7) for p in itertools.product("abc", repeat=n)]
    got = encode_words(words, pieces)
    names = list(scores)

    def best(word):
        if not word:
            return 0.0
        return max(scores[word[:i]] + best(word[i:]) for i in range(1, len(word) + 1) if word[:i] in scores)

    for word in words[:400]:
        cut = [names[i] for i in got[word]]
        assert "".join(cut) == word and abs(sum(scores[p] for p in cut) - best(word)) < 1e-9


def test_odd_rows(odd, empty):
    rows = decoded(encode(odd, MODEL), MODEL).collect()
    assert len(rows) == 11 and all(r.decoded == (r.text or "") for r in rows)
    assert [r.token_ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert decoded(encode(empty, MODEL), MODEL).collect() == []


def test_memory_of_a_batch_of_frequent_words():
    """3 MB of text in 3,000 rows: no object for each of its million words."""
    pieces = load_pieces(MODEL)
    pieces.prepare()
    batch = pa.RecordBatch.from_pydict({"doc_id": range(3000), "text": ["ab cd " * 166] * 3000})
    encoder = _encoder(SimpleNamespace(value=[pieces]), True)
    tracemalloc.start()
    rows = sum(out.num_rows for out in encoder([batch]) if all(out.column("round_trip").to_pylist()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 3000 and peak < 40e6
