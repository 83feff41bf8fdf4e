import random
import re
import zlib
from collections import Counter

import pytest

from stratalens.llm.queries import op11_spelling_variants
from stratalens.llm.spelling_variants import Spelling, neighbours, variants, vocabulary

SF = "/root/testdata/sf0.001"


def counted(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{doc}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            found[word] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(words):
    out, form = {}, {}
    for w, n in words.items():
        close = [v for v in words if near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
        out[w] = (n, len(close), form[w], words[best] if form[w] else None)
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def as_rows(frame):
    rows = frame.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_against_all_pairs(spark, documents):
    want = brute(counted([(r.doc_id, r.text) for r in documents.collect()]))
    assert as_rows(op11_spelling_variants(spark, SF)) == want
    assert any(w[2] for w in want.values())


@pytest.mark.parametrize("sent_bytes", [16 << 20, 640])
def test_dense_vocabulary_in_rounds(spark, sent_bytes):
    """Words of few letters, most of which are near to many, chains of forms, letters at both ends of the alphabet."""
    rng = random.Random(9)
    words = {"".join(rng.choices("abzÀÿ×", k=rng.choice([6, 6, 7, 8]))): 5 ** rng.randrange(1, 9) for _ in range(900)}
    words |= {"a" * k: 5 ** (k - 4) for k in range(6, 16)}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_rows(variants(frame, Spelling(sent_bytes=sent_bytes))) == brute(words)
    pairs = neighbours(frame, Spelling(sent_bytes=sent_bytes)).collect()
    assert len(pairs) == len({frozenset(p) for p in pairs}) and all(near(*p) for p in pairs)


def test_odd_rows(spark, odd, empty):
    found = {r.word: r.n for r in vocabulary(odd, Spelling(least=1)).collect()}
    assert found == {"wörter": 20000, "straßen": 20000, "epsilon": 2}
    assert vocabulary(empty).collect() == [] and variants(vocabulary(empty)).collect() == []
    assert as_rows(variants(vocabulary(odd), Spelling())) == {w: (20000, 0, None, None, w) for w in ("wörter", "straßen")}
