import itertools

import numpy as np
import pyarrow as pa

from stratalens.llm.decontaminate import Overlap, contamination, decontaminate, longest_overlap, missed, short_masks, with_overlaps
from stratalens.llm.wordhash import words

ITEM = "what is the name of the river that flows past the old stone mill near town"


def flags(frame):
    return {r.doc_id: r.item_ids for r in frame.collect()}


def test_exact_passages_of_documents(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r.item_id: r.text for r in bench.collect()}
    got = flags(contamination(documents, bench))
    for r in documents.collect():
        assert {i for i, t in items.items() if t in r.text} <= set(got[r.doc_id])
    assert sum(bool(v) for v in got.values()) < 0.2 * len(got)


def test_substitutions_case_and_punctuation(spark):
    words = ITEM.split()
    every = lambda k: " ".join("zz" if i % k == k - 1 else w for i, w in enumerate(words))
    docs = [
        (1, f"a b c {ITEM} d e f"), (2, ITEM.upper().replace(" ", ", ")), (3, f"before {every(5)} after"), (4, f"x {every(6)}"),
        (5, every(2)), (6, " ".join(words[:6])), (7, " ".join(reversed(words))), (8, None), (9, ""),
        (10, f"{ITEM} and {ITEM}"),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, "exactly five words stand here")], "item_id long, text string")
    got = flags(contamination(frame, bench))
    assert got == {1: [1], 2: [1], 3: [1], 4: [1], 5: [], 6: [], 7: [], 8: [], 9: [], 10: [1]}
    assert flags(contamination(spark.createDataFrame([(1, "so exactly FIVE words stand here.")], "doc_id long, text string"), bench)) == {1: [4]}
    blocks = with_overlaps(frame, bench.union(bench), "matches", Overlap(block=1))
    assert {r.doc_id for r in blocks.where("size(matches) > 0").collect()} == {1, 2, 3, 4, 10}
    place = with_overlaps(frame.where("doc_id = 1"), bench, "matches").first().matches[0]
    assert (place.item_id, place.doc_token, place.item_token) == (1, 3, 0) and place.length >= 16 and place.equal >= 16


def test_longest_overlap_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 30)) < 0.7
        best = max(
            (b - a for a in range(len(equal)) for b in range(a + 1, len(equal) + 1) if 100 * equal[a:b].sum() >= 80 * (b - a)),
            default=0,
        )
        a, b = longest_overlap(equal, 80)
        assert b - a == best and 100 * equal[a:b].sum() >= 80 * (b - a)


def test_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (None, ITEM)], "item_id long, text string")
    out = decontaminate(odd, bench)
    assert out.columns == odd.columns and out.count() == 9
    assert decontaminate(empty, bench).collect() == []
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(odd, none).count() == 11 and contamination(odd, none).where("contaminated").isEmpty()


def test_masks_meet_every_pattern_of_substitutions():
    # 13 or more tokens: what is longer holds one of these stretches, since one half of it is at least as equal as the whole.
    assert [missed(Overlap().masks, n, s) for n, s in ((13, 2), (14, 2), (15, 3), (16, 3), (20, 4), (25, 5))] == [[]] * 6
    for n in range(5, 13):
        whole = ["0" * at + m + "0" * (n - at - len(m)) for m, at in short_masks(n, 80)]
        assert missed(tuple(whole), n, n // 5) == [] and min(m.count("1") for m in whole) >= 4


def test_substitutions_at_any_place(spark):
    words = [f"w{chr(97 + i)}" for i in range(20)]
    bench = spark.createDataFrame([(n, " ".join(f"{w}{chr(96 + n)}" for w in words[:n])) for n in range(5, 21)], "item_id long, text string")
    docs, want = [], {}
    for n, k in [(n, k) for n in range(5, 21) for k in (n // 5, n // 5 + 1)]:
        for places in itertools.islice(itertools.combinations(range(n), k), 0, None, 1 if k < 3 else 17):
            edited = " ".join("zz" if i in places else f"{w}{chr(96 + n)}" for i, w in enumerate(words[:n]))
            docs.append((len(docs), f"before {edited} after"))
            best = longest_overlap(np.array([i not in places for i in range(n)]), 80)
            want[len(docs) - 1] = [n] if best[1] - best[0] >= min(n, 13) else []
    assert sum(map(bool, want.values())) > 400 and not all(want.values())
    assert flags(contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)) == want


def test_short_items_and_scripts_without_blanks(spark):
    han = "河流经过老磨坊旁边的城镇叫什么名字"
    thai = "แม่น้ำที่ไหลผ่านโรงสีเก่าชื่ออะไร"
    items = [(1, "quokka"), (2, "red quokka"), (3, "one, red quokka!"), (4, "see one red quokka"), (5, "we see one red quokka"), (6, han), (7, thai), (8, "貓"), (9, "?!")]
    docs = [
        (1, "a Quokka."), (2, "the red quokka sat"), (3, "one red -- quokka"), (4, "they see one red quokka"), (5, "we see one blue quokka"),
        (6, f"前面的文字{han}后面的文字"), (7, f"前{han[:4]}山{han[5:11]}水{han[12:]}后"), (8, f"ก่อน{thai}หลัง"), (9, "quokkas redquokka"),
        (10, "黑貓白狗"), (11, han[:10]), (12, "ones"), (13, "? !"),
    ]
    want = {
        1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4, 5], 5: [1, 5], 6: [6], 7: [6], 8: [7], 9: [], 10: [8], 11: [], 12: [], 13: [],
    }
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert flags(contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench)) == want


def test_tokens_of_mixed_scripts():
    text = "Das ÄÖ貓x한국어 カナ。ไทย𠀀é"
    _, starts, stops, _ = words(pa.array([text, None, "貓", "貓"]), plain=True)
    data = (text + "貓貓").encode()
    assert [data[a:b].decode() for a, b in zip(starts, stops, strict=True)] == ["Das", "ÄÖ", "貓", "x한국어", "カ", "ナ", "。", "ไ", "ท", "ย", "𠀀", "é", "貓", "貓"]
