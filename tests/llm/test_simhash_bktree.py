import random
import re

import xxhash

from stratalens.llm.queries import op12_simhash_bktree
from stratalens.llm.simhash_bktree import Near, Tree, drop_near, near_fingerprints

SF = "/root/testdata/sf0.001"


def plain(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=2):
    """rows (doc_id, fingerprint): the smallest id reachable, by all pairs; rows of one id are linked."""
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    marks = {}
    for i, p in rows:
        marks.setdefault(p, []).append(i)
    points = list(marks)
    for n, p in enumerate(points):
        near = [q for q in points[n:] if (p ^ q).bit_count() <= radius]
        for i in {i for q in near for i in marks[q]} | set(marks[p]):
            u, v = find(i), find(marks[p][0])
            root[max(u, v)] = min(u, v)
    return {i: find(i) for i in root}


def test_documents_against_all_pairs(spark, documents):
    rows = [(r.doc_id, plain(r.text)) for r in documents.collect()]
    want = brute(rows)
    found = op12_simhash_bktree(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in found) == sorted((i, f"{p:016x}", want[i]) for i, p in rows)
    kept = {r.doc_id for r in drop_near(documents).collect()}
    assert kept == {i for i, c in want.items() if i == c}


def test_hash_is_sparks_own(spark):
    from stratalens.llm.simhash_bktree import shingle_hashes

    theirs = spark.sql("SELECT xxhash64('one two three') AS h").first().h
    assert shingle_hashes("One  two\tthree", 3) == [theirs & (1 << 64) - 1]


def clusters(rng, n):
    points = []
    for _ in range(n // 40):
        centre = rng.getrandbits(64)
        for _ in range(40):
            point = centre
            for bit in rng.sample(range(64), rng.randrange(4)):
                point ^= 1 << bit
            points.append(point)
    return points


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(3)
    points = list(dict.fromkeys(clusters(rng, 600)))
    tree = Tree()
    for p in points:
        tree.add(p)
    again = Tree.of(tree.points, tree.parents, tree.edges)
    for p in points[::7]:
        want = {i for i, q in enumerate(points) if (p ^ q).bit_count() <= 2}
        assert set(tree.within(p, 2)) == set(again.within(p, 2)) == want


def test_cut_runs_and_rounds_lose_no_link(spark, monkeypatch):
    """One dense cluster whose keys are cut by partitions and by small trees, sent in several rounds."""
    from stratalens.llm import simhash_bktree

    rng = random.Random(5)
    points = clusters(rng, 400)
    centre = rng.getrandbits(64)
    points += [centre ^ (a << 1) ^ (b << 60) for a in range(64) for b in range(8)]  # several share the middle blocks
    rows = [(1000 - i if i % 3 else i, p) for i, p in enumerate(points)]  # with repeated ids
    want = brute(rows)
    frame = spark.createDataFrame([(i, str(p)) for i, p in rows], "doc_id long, text string").repartition(7)

    def reader(k):
        import numpy as np
        import pyarrow as pa

        def read(batches):
            for batch in batches:
                fps = np.array([int(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

        return read

    monkeypatch.setattr(simhash_bktree, "_fingerprinter", reader)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for near in (Near(), Near(tree=20, sent_bytes=100_000), Near(blocks=3, tree=16)):
            found = near_fingerprints(frame, near).collect()
            assert len(found) == len(rows) and {r.doc_id: r.component_id for r in found} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_odd_rows(spark, odd, empty):
    found = near_fingerprints(odd).collect()
    assert len(found) == odd.count()
    by_id = {r.doc_id: r for r in found}
    assert {i: by_id[i].component_id for i in by_id} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 7, 8: 8, None: None}
    assert all(by_id[i].fp == 0 for i in (2, 3, 4))
    assert near_fingerprints(empty).collect() == []
    kept = drop_near(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "1", "2", "5", "7", "8", "None", "None"])
    two = spark.createDataFrame([(3, "a b c d"), (5, "a b c d"), (5, "x y z"), (9, "x y z"), (4, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_fingerprints(two).collect()) == [(3, 3), (4, 4), (5, 3), (5, 3), (9, 3)]
