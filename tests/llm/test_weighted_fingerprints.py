import hashlib
import re
from collections import Counter

from stratalens.llm.weighted_fingerprints import edited, edited_likeness, fingerprints


def likeness(a, b):
    count = lambda t: Counter(w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w)
    a, b = count(a), count(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def same(a, b):
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) / 4)


def test_collisions_equal_generalised_jaccard(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    marks = {r.doc_id: r.fingerprint for r in fingerprints(documents).collect()}
    errors = []
    for r in edited_likeness(documents).collect():
        order = sorted(texts, reverse=True)
        following = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        changed = edited(texts[r.doc_id], following)
        assert r.n_chars == len(texts[r.doc_id]) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == marks[r.doc_id] and r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        errors += [r.near_edited - likeness(texts[r.doc_id], changed), r.near_next - likeness(texts[r.doc_id], following)]
    assert abs(sum(errors) / len(errors)) < 0.01
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.05


def test_edit():
    assert edited("abcde", "XYZ") == "abcXY" and edited("abcd", "X") == "abX" and edited("", "x") == "" and edited("a", "x") == "a"


def test_order_does_not_depend_on_partitions(documents):
    one = sorted(map(tuple, edited_likeness(documents.repartition(1)).collect()))
    many = sorted(map(tuple, edited_likeness(documents.repartition(9, "source")).collect()))
    assert one == many


def test_odd_rows(spark, odd, empty):
    rows = edited_likeness(odd).collect()
    assert len(rows) == 11
    blank = {r.fingerprint for r in rows if r.doc_id in (2, 3, 4)}
    assert blank == {"ffff" * 128} and len({r.fingerprint for r in rows if r.doc_id in (5, 6)}) == 1
    assert all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in rows)
    assert edited_likeness(empty).collect() == [] and fingerprints(empty).collect() == []
    lone = edited_likeness(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).first()
    assert lone.near_next == 1.0
