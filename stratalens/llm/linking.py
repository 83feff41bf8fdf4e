"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stratalens.llm.shared import discard, stored

ONE_TASK = 200_000  # links, 3 MB


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array([root(x) for x in ids], pa.int64())], names=["id", "component"]
    )


def components(links: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(id, component) for every id that has a link (a, b); component is the smallest id reachable.

    A graph of at most `one_task` links is solved by union-find in one task, a larger one in rounds of shuffles; the
    rows are the same. Each round links every node's larger neighbours to the smallest of its neighbourhood, then its smaller ones; the
    number of rounds grows with the logarithm of the longest chain. Stars around one id are joined on a table with one
    row per id, which Spark can split where an id is hot. No links: no rows.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(_union_find, "id long, component long")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v")
        after = stored(small.where("u <> v").distinct(), "small_star")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(edges, large)
        edges = after
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def repeated_ids(rows: DataFrame, kind: Column) -> DataFrame:
    """The doc_ids (column doc_id, distinct) whose rows differ in `kind`."""
    seen = rows.groupBy("doc_id").agg(F.min(kind).alias("least"), F.max(kind).alias("most"))
    return seen.where("least <> most").select("doc_id")
