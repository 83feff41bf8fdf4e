"""Sharding by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each bucket and write."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stratalens.llm.shared import stored

HELPERS = ["bucket", "key", "copy", "tie"]


def _shuffler(seed: int, shards: int, rows: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Fisher-Yates over one bucket; its rows take the places that begin at the bucket's base."""
    full, more = divmod(rows, shards)

    def shuffle(bucket: pa.Table, base: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([(c, "ascending") for c in ("key", "copy", "tie")])
        order = np.arange(bucket.num_rows)
        generator = np.random.Generator(np.random.PCG64([seed, bucket["bucket"][0].as_py() if bucket.num_rows else 0]))
        generator.shuffle(order)  # numpy's shuffle of a one-dimensional array is Fisher-Yates
        start = base["base"][0].as_py() if base.num_rows else 0
        place = start + np.arange(bucket.num_rows, dtype=np.int64)
        split = more * (full + 1)
        late = np.maximum(place - split, 0)
        shard = np.where(place < split, place // (full + 1), more + late // max(full, 1))
        slot = np.where(place < split, place % (full + 1), late % max(full, 1))
        out = bucket.take(pa.array(order)).drop_columns(HELPERS)
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    return shuffle


def external_shuffle(
    docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = 8 << 20, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """docs, all columns, with shard (int) and slot (long): one random order of all rows, cut into shards.

    Pass one scatters whole records over buckets of about ``bucket_bytes`` by a seeded hash of id and text; pass two sorts a
    bucket, shuffles it with a generator seeded by seed and bucket, and gives its rows the places after those of the
    buckets before it. The shards are consecutive cuts of these places, sizes at most one apart and the larger first; slots
    count from 0 in each. The order depends on the rows and the seed alone, however the input is partitioned. Rows of one
    id and text that outweigh a bucket, in rows or bytes, are counted and dealt out again by their number among equal
    rows, so that they spread too. Equal rows are alike in all columns, so it does not matter which of them goes where;
    rows of one id and text that differ elsewhere stand by a hash of all columns. Null ids are an id like any
    other, a null text counts 0 bytes. Columns must be such as Spark can hash and group, so no maps. Columns of docs
    that are called shard or slot keep their names and the new ones get an underscore. No rows in: none out.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_name, text_name = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    size = F.coalesce(F.octet_length(text_name), F.lit(0)).cast("long") + 8
    rows, total = own.agg(F.count("*"), F.sum(size)).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    per_bucket = max(1, rows // buckets)
    same = ["key", "tie"]
    keyed = own.withColumns({"key": F.xxhash64(id_name, text_name), "tie": F.xxhash64(*own.columns)})
    heavy = (
        keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
        .where((F.col("n") > 1) & ((F.col("n") > per_bucket) | (F.col("bytes") > bucket_bytes)))
    )
    # At most two groups a bucket are heavy; Spark broadcasts the written table only while it is below its size limit.
    heavy = stored(heavy.select("key"), "heavy")
    first = F.lit(0).cast("long")
    if heavy.isEmpty():
        dealt = keyed.withColumn("copy", first)
    else:
        equal = keyed.join(heavy, "key", "left_semi").groupBy(*own.columns, *same).agg(F.count("*").alias("n"))
        numbered = equal.withColumn("number", F.explode(F.sequence(first, F.col("n") - 1)))
        numbered = numbered.select(*own.columns, *same, F.xxhash64("tie", "number").alias("copy"))
        dealt = keyed.join(heavy, "key", "left_anti").select(*own.columns, *same, first.alias("copy")).union(numbered)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key", "copy"), F.lit(buckets)))
    counts = stored(dealt.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", shard int, slot long"
    out = dealt.groupBy("bucket").cogroup(bases.groupBy("bucket")).applyInArrow(_shuffler(seed, shards, rows), schema)
    taken = {n.lower() for n in names}
    return out.toDF(*names, *[n + "_" if n in taken else n for n in ("shard", "slot")])


def write_shards(shuffled: DataFrame, path: str) -> None:
    """The shuffled rows as Parquet, one folder per shard, each task's rows by slot."""
    shuffled.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
