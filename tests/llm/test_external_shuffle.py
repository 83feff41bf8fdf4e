from collections import Counter

from pyspark.sql import functions as F

from stratalens.llm.external_shuffle import external_shuffle, write_shards


def test_places(spark, documents):
    rows = external_shuffle(documents, bucket_bytes=20_000).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.collect())
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(24)) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    again = external_shuffle(documents.repartition(7, "source"), bucket_bytes=20_000).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    other = external_shuffle(documents, bucket_bytes=20_000, seed=18).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} != {(r.doc_id, r.shard, r.slot) for r in other}


def test_order_is_random(documents):
    rows = sorted(external_shuffle(documents, shards=1, bucket_bytes=20_000).collect(), key=lambda r: r.slot)
    ids = [r.doc_id for r in rows]
    rising = sum(a < b for a, b in zip(ids, ids[1:], strict=False))
    assert 0.35 * len(ids) < rising < 0.65 * len(ids)


def test_hot_rows_spread_alike_in_any_partitions(spark):
    equal = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "repeat('x', 100) AS text", "1 AS more")
    unlike = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "repeat('x', 100) AS text", "id AS more")
    texts = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "repeat(string(id), 30) AS text", "1 AS more")
    for frame in (equal, unlike, texts):
        rows = external_shuffle(frame, shards=5, bucket_bytes=10_000).collect()
        hot = Counter(r.shard for r in rows if r.doc_id == 7)
        assert len(rows) == 3000 and len(hot) == 5 and max(hot.values()) < 300
        assert Counter(r[:3] for r in rows) == Counter(tuple(r) for r in frame.collect())
        other = external_shuffle(frame.repartition(11, "more").sortWithinPartitions(F.desc("more")), shards=5, bucket_bytes=10_000)
        assert {r.slot * 5 + r.shard: r[:3] for r in rows} == {r.slot * 5 + r.shard: r[:3] for r in other.collect()}


def test_few_large_rows_spread(spark):
    """An id heavy in bytes but not in rows."""
    large = spark.range(20).selectExpr("-1L AS doc_id", "repeat('y', 50000) AS text")
    frame = spark.range(2000).selectExpr("id AS doc_id", "'z' AS text").union(large)
    rows = external_shuffle(frame, shards=4, bucket_bytes=100_000).collect()
    assert len({r.shard for r in rows if r.doc_id == -1}) > 1 and len(rows) == 2020


def test_odd_rows_and_files(spark, odd, empty, tmp_path):
    out = external_shuffle(odd, shards=3)
    assert out.columns == [*odd.columns, "shard_", "slot_"]
    assert sorted(map(str, (r[:5] for r in out.collect()))) == sorted(map(str, (r[:5] for r in odd.collect())))
    assert external_shuffle(empty).collect() == []
    plain = odd.select("doc_id", "text")
    write_shards(external_shuffle(plain, shards=3), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 11
