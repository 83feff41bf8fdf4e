import random
import re

import pytest

from stratalens.llm.linking import components
from stratalens.llm.minhash_forest import Forest, drop_near_duplicates, near_duplicates


def shingle_set(text, k):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if len(words) < k:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*[words[i:] for i in range(k)]))


def brute(rows, forest):
    sets = {i: shingle_set(t, forest.words) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= forest.percent * (len(sets[a]) + len(sets[b]) - both):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in ids}


def found(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


@pytest.mark.parametrize("forest", [Forest(), Forest(words=5, percent=80)])
def test_equals_all_pairs_on_documents(documents, forest):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    out = near_duplicates(documents, forest)
    assert found(out) == brute(rows, forest)
    assert out.where("kept <> (doc_id = component_id)").isEmpty()


def test_dense_groups_stars_and_chains(spark):
    """Edited copies of one text: a star whose members are alike only through its centre, and a chain."""
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    rows, n = [(0, " ".join(base))], 1
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(5, 115), 2):
            words[at] = f"x{n}-{at}"
        rows.append((n, " ".join(words)))
        n += 1
    words = [f"c{i}" for i in range(100)]
    for step in range(40):
        words = [*words[1:], f"d{step}"]
        rows.append((n, " ".join(words)))
        n += 1
    forest = Forest(near=3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(frame, forest)) == brute(rows, forest)


def test_odd_rows(odd, empty):
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(odd).collect()), key=str)
    assert rows == sorted(
        [(1, 4, 1, True), (1, 4, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True),
         (6, 1, 5, False), (None, 1, None, True), (None, 0, None, True), (7, 3, 7, True), (8, 2, 8, True)], key=str,
    )
    assert near_duplicates(empty).collect() == []
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "7", "8", "None", "None"])


def test_both_ways_to_components_agree(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    frame = spark.createDataFrame(links, "a long, b long")
    small, large = components(frame), components(frame, one_task=0)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    assert components(spark.createDataFrame([], "a long, b long"), one_task=0).collect() == []


def test_one_id_with_several_texts(spark):
    """A link of one text is a link of the id; what is dropped leaves a copy of every text."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "xyz")
    rows = [(3, one), (5, one), (5, two), (9, two), (9, three), (9, two), (4, three + " end"), (7, ""), (7, " "), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.component_id) for r in found if r.n_shingles) == [(3, 3), (4, 3), (5, 3), (5, 3), (9, 3), (9, 3), (9, 3)]
    kept = sorted((r.doc_id, r.text.strip()) for r in drop_near_duplicates(frame).collect())
    assert kept == sorted([(3, one), (5, two), (4, three + " end"), (5, ""), (7, "")])
