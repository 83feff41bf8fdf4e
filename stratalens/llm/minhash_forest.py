"""Near duplicates by an LSH forest: several sorted signature orders whose neighbours are the candidates."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.linking import components, repeated_ids
from stratalens.llm.shared import discard, stored
from stratalens.llm.wordhash import chunks, distinct, mix, shingles, words

PER_TREE = 8
CLOSE = 2  # places within which crowded rows are candidates
BROADCAST_IDS = 2_000_000  # ids that a semi join may broadcast: 16 MB
BLOCK = 512  # sets on one side of an exact comparison


@dataclass(frozen=True)
class Forest:
    """Parameters of the forest.

    words: words per shingle. percent: similarity of a link, in hundredths. trees: sorted orders, of 8 minimum hashes
    (16 bits each) apiece. shortest: hashes that neighbours must share, counted from the order's first. near: how many
    places on in an order a candidate can stand; rows that share `shortest` hashes with a row further on are settled
    by an exact step (`_among`).
    """

    words: int = 3
    percent: int = 85
    trees: int = 20
    shortest: int = 4
    near: int = 8

    def __post_init__(self) -> None:
        if not 1 <= self.shortest <= 4:
            raise ValueError("shortest is 1 to 4 hashes")

    @property
    def estimate_floor(self) -> float:
        """4.5 standard deviations below the wanted similarity."""
        s = self.percent / 100
        return s - 4.5 * math.sqrt(s * (1 - s) / (self.trees * PER_TREE))


def _identity(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each set, as two sums over its members."""
    return np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)


def _profiler(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Set size, a 128-bit hash of the set, and the signature of each text."""
    count = forest.trees * PER_TREE
    rng = np.random.Generator(np.random.PCG64(7))
    factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                hashes, _, _, bounds = words(chunk.column(1))
                sets = distinct(*shingles(hashes, bounds, forest.words))
                sizes = np.array([len(s) for s in sets], np.int64)
                signature = np.full((len(sets), count), 0xFFFF, np.uint16)
                first, second = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if some := np.flatnonzero(sizes).tolist():
                    flat = np.concatenate([sets[i] for i in some])
                    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    first[some], second[some] = _identity(flat, starts)
                    low = (flat & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                    high = (flat >> np.uint64(32)).astype(np.uint32)
                    for j in range(count):
                        a = int(factors[j])
                        value = low * np.uint32(a & 0xFFFFFFFF | 1)
                        value ^= high
                        value *= np.uint32(a >> 32 | 1)
                        least = np.minimum.reduceat(value, starts)
                        signature[some, j] = mix(least.astype(np.uint64)) >> np.uint64(48)
                raw = signature.astype(">u2").tobytes()
                width = 2 * count
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column(0),
                        chunk.column(2),
                        pa.array(sizes),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.array([raw[i * width : (i + 1) * width] for i in range(len(sets))], pa.binary()),
                    ],
                    names=["doc_id", "mark", "n_shingles", "h1", "h2", "signature"],
                )

    return profile


def _set_maker(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The shingle set of each text that has one, with its hash and size."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                hashes, _, _, bounds = words(chunk.column(1))
                sets = [s for s in distinct(*shingles(hashes, bounds, k)) if len(s)]
                if not sets:
                    continue
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets)
                first, second = _identity(flat, offsets[:-1])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)), pa.array(np.diff(offsets)), lists],
                    names=["h1", "h2", "n_shingles", "set"],
                )

    return make


OUT = "kind int, a long, b long, tree int, prefix long, pid int, key binary"
PAIR, EDGE, CROWDED = 0, 1, 2


def _compare(tree: np.ndarray, prefix: np.ndarray, ids: np.ndarray, new: int, near: int) -> Iterator[pa.RecordBatch]:
    """Candidates among consecutive rows of an order: those at most `near` places apart with an equal prefix.

    Rows with an equal one just beyond that distance come out as CROWDED; two of them are a candidate at CLOSE places. The first len - new rows were seen before.
    """
    n, old = len(ids), len(ids) - new

    def equal_at(step: int, lo: int) -> np.ndarray:
        same = (tree[lo : n - step] == tree[lo + step :]) & (prefix[lo : n - step] == prefix[lo + step :])
        return np.flatnonzero(same) + lo

    crowded = np.zeros(n, dtype=bool)
    if n > near + 1:
        left = equal_at(near + 1, 0)
        crowded[left] = True
        crowded[left + near + 1] = True
    for step in range(1, near + 1):
        lo = max(old - step, 0)
        if n - step > lo:
            left = equal_at(step, lo)
            if step > CLOSE:
                left = left[~(crowded[left] & crowded[left + step])]
            if len(left):
                a, b = ids[left], ids[left + step]
                yield _rows(PAIR, np.minimum(a, b), np.maximum(a, b), tree[left], prefix[left])
    if crowded.any():
        at = np.flatnonzero(crowded)
        yield _rows(CROWDED, ids[at], ids[at], tree[at], prefix[at])


def _rows(kind: int, a, b, tree, prefix, pid: int = -1, keys: list | None = None) -> pa.RecordBatch:
    n = len(a)
    arrays = [
        pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), pa.array(tree.astype(np.int32)),
        pa.array(prefix), pa.array(np.full(n, pid, np.int32)),
        pa.array(keys, pa.binary()) if keys is not None else pa.nulls(n, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "a", "b", "tree", "prefix", "pid", "key"])


def _scanner(forest: Forest, edges: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Walks one partition of the sorted orders. With edges, its first and last rows come out too."""
    keep, cut = forest.near + 1, 2 * forest.shortest

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId() if edges else -1
        tree, prefix, ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(1).to_pylist()
            more = np.frombuffer(b"".join(k[:cut].ljust(8, b"\0") for k in keys), np.int64)
            tree = np.concatenate([tree, batch.column(0).to_numpy()])
            prefix = np.concatenate([prefix, more])
            ids = np.concatenate([ids, batch.column(2).to_numpy()])
            if edges and seen < keep:
                m = min(keep - seen, batch.num_rows)
                at = len(ids) - batch.num_rows
                yield _rows(EDGE, ids[at : at + m], np.arange(seen, seen + m), tree[at : at + m], prefix[at : at + m], pid)
            seen += batch.num_rows
            yield from _compare(tree, prefix, ids, batch.num_rows, forest.near)
            tree, prefix, ids = tree[-keep:], prefix[-keep:], ids[-keep:]
        if edges and seen > keep:
            m = min(keep, seen - keep)
            yield _rows(EDGE, ids[-m:], np.arange(seen - m, seen), tree[-m:], prefix[-m:], pid)

    return scan


def _edge_scanner(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is not None and table.num_rows:
            columns = [table.column(i).to_numpy() for i in range(3)]
            yield from _compare(*columns, table.num_rows, forest.near)

    return scan


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Share of equal hashes of two signatures."""
    for batch in batches:
        if batch.num_rows:
            left, right = (
                np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array((left == right).mean(axis=1))], names=["a", "b", "est"]
            )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    fits = 100 * both >= percent * (F.size("set_a") + F.size("set_b") - both)
    small = F.least(F.size("set_a"), F.size("set_b")) * 100 >= percent * F.greatest(F.size("set_a"), F.size("set_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(small).where(fits).select("a", "b")


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    left = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
    right = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return (
        pairs.join(left, "a", "left").join(right, "b", "left")
        .where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")
    )


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


NODE = ["h1", "h2", "n_shingles"]  # what names a set; their hash is the set's id


def _sets(texts: DataFrame, ids: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """The shingle sets with these ids, each once, made from the text of the smallest doc_id that has the set.

    Up to BROADCAST_IDS ids go to the texts; more are joined by a shuffle of both.
    """
    ids = stored(ids.join(classes.select("id", "doc"), "id"), "ids")
    some = F.broadcast if ids.count() <= BROADCAST_IDS else lambda df: df
    wanted = texts.join(some(ids.select(F.col("doc").alias("doc_id")).distinct()), "doc_id", "left_semi").select("doc_id", "text")
    made = wanted.mapInArrow(_set_maker(forest.words), "h1 long, h2 long, n_shingles long, set array<long>")
    made = made.select(F.xxhash64(*NODE).alias("id"), "set")
    return stored(made.join(some(ids.select("id")), "id", "left_semi").distinct(), "sets")


def _linked_sets(texts: DataFrame, forest: Forest) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, classes, labels): every row's set; the distinct sets with the smallest doc_id that has each; components of linked sets by set id."""
    profile = stored(
        texts.mapInArrow(
            _profiler(forest), "doc_id long, mark long, n_shingles long, h1 long, h2 long, signature binary"
        ).withColumn("node", F.xxhash64(*NODE)).drop("h1", "h2"),
        "profile",
    )
    usable = profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(usable.groupBy(F.col("node").alias("id"), "signature").agg(F.min("doc_id").alias("doc")), "classes")
    orders = classes.select(
        "id", F.posexplode(F.array(*[F.substring("signature", 2 * PER_TREE * t + 1, 2 * PER_TREE) for t in range(forest.trees)]))
        .alias("tree", "key"),
    ).select("tree", "key", "id")
    walked = stored(
        orders.repartitionByRange("tree", "key", "id").sortWithinPartitions("tree", "key", "id")
        .mapInArrow(_scanner(forest, edges=True), OUT),
        "walked",
    )
    edges = walked.where(F.col("kind") == EDGE).select("tree", "prefix", "a", "pid", "b")
    joined = edges.repartition(1).sortWithinPartitions("pid", "b").select("tree", "prefix", "a").mapInArrow(
        _edge_scanner(forest), OUT
    )
    found = walked.where(F.col("kind") != EDGE).union(joined)
    signatures = classes.select("id", "signature")
    pairs = found.where(F.col("kind") == PAIR).where("a <> b").select("a", "b").distinct()
    likely = stored(
        pairs.join(signatures.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
        .join(signatures.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
        .select("a", "b", "sa", "sb").mapInArrow(_estimate, "a long, b long, est double")
        .where(F.col("est") >= forest.estimate_floor),
        "likely",
    )
    crowd = stored(
        found.where(F.col("kind") == CROWDED).select("tree", "prefix", F.col("a").alias("id")).distinct(), "crowd"
    )
    sets = _sets(texts, likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, forest)
    ends = likely.select("est", F.col("a").alias("x"), F.col("b").alias("y")).union(likely.select("est", "b", "a"))
    best = ends.groupBy("x").agg(F.max(F.struct("est", F.col("y"))).alias("m"))
    best = best.select(F.least("x", "m.y").alias("a"), F.greatest("x", "m.y").alias("b")).distinct()
    links = stored(_confirmed(best, sets, forest.percent), "links_a")
    labels = stored(components(links), "labels_a")
    more = stored(_confirmed(_labelled(likely, labels), sets, forest.percent), "links_b")
    links_ab = links.union(more)
    labels_ab = stored(components(links_ab), "labels_b")
    discard(labels, likely, sets, walked)
    crowded = stored(_crowded(crowd, labels_ab), "crowded")
    final = labels_ab
    if not crowded.isEmpty():
        rest = stored(_among(crowded, texts, classes, forest), "links_c")
        final = stored(components(rest.union(labels_ab.select(F.col("id").alias("a"), F.col("component").alias("b")))), "labels_c")
    discard(crowd)
    return profile, classes, final


def near_duplicates(
    docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each document.

    Words are runs of bytes other than white space, A-Z lower-cased; a text's set is its distinct shingles of
    ``forest.words`` words, its whole sequence if it has fewer, nothing for null or wordless texts, which link to
    nothing. Documents link where 100 * intersection >= percent * union. component_id is the smallest doc_id reachable
    and kept says that it is the document's own. Texts with equal sets are one class first, so copies never meet in
    pairs. Each tree of the forest sorts the classes by its own eight minimum hashes; a class's candidates are its
    neighbours in an order that share a prefix of `forest.shortest` hashes. Signatures weed out
    candidates, each class's likeliest one is confirmed on the full sets, then every candidate that still joins two
    components. Where a prefix is shared by more classes than an order's neighbourhood holds and several components,
    `_among` looks for the rest exactly. Rows with a null doc_id come back with a null component and kept true;
    rows that repeat a doc_id come back as often, and a link of any of their texts is a link of the id (a wordless row
    of such an id stands alone). An empty table gives no rows.
    """
    profile, classes, labels = _linked_sets(_docs(docs, id_col, text_col), forest)
    known = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "node")
    several = stored(known.join(repeated_ids(known, F.col("node")), "doc_id", "left_semi").distinct(), "several")
    if not several.isEmpty():
        hubs = several.groupBy("doc_id").agg(F.min("node").alias("b"))
        same = several.join(hubs, "doc_id").select(F.col("node").alias("a"), "b")
        labels = components(same.union(labels.select(F.col("id").alias("a"), F.col("component").alias("b"))))
    of = _owners(classes, labels)
    least = of.groupBy("of").agg(F.min("doc").alias("least"))
    owners = of.join(least, "of").select(F.col("id").alias("node"), "least")
    out = profile.select("doc_id", "n_shingles", "node").join(owners, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def _owners(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, doc, of): the component of each set."""
    named = labels.select(F.col("id").alias("labelled"), "component")
    joined = classes.join(named, classes["id"] == named["labelled"], "left")
    return joined.select("id", "doc", F.coalesce("component", "id").alias("of"))


def drop_near_duplicates(docs: DataFrame, forest: Forest = Forest(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of linked texts, all columns: one with the smallest doc_id.

    Here the rows of a repeated doc_id are texts of their own: each stays unless a text linked to it stays, so no text goes without a
    copy. Of equal rows one stays, likewise of the wordless rows of one doc_id. Rows with a null doc_id all stay.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    id_name, text_name = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    profile, classes, labels = _linked_sets(_docs(docs, id_col, text_col), forest)
    chosen = _owners(classes, labels).groupBy("of").agg(F.min(F.struct("doc", "id")).alias("m"))
    chosen = chosen.select(F.col("m.doc").alias("doc_id"), F.col("m.id").alias("node"))
    bare = profile.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "node").distinct()
    rows = profile.join(chosen.union(bare), ["doc_id", "node"]).groupBy("doc_id", "node").agg(F.min("mark").alias("kept_mark"))
    kept = stored(rows.select(F.col("doc_id").alias("kept_id"), "kept_mark"), "kept")
    marked = own.withColumn("mark", F.xxhash64(text_name))
    same = (F.col(id_name).cast("long") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark"))
    once = marked.join(kept, same, "left_semi").dropDuplicates([id_name, "mark"]).drop("mark")
    return once.union(own.where(F.col(id_name).isNull())).toDF(*names)


def _crowded(crowd: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree, prefix, id, c): the rows of regions that hold more than a neighbourhood and more than one component."""
    named = crowd.join(labels, "id", "left").select("tree", "prefix", "id", F.coalesce("component", "id").alias("c"))
    mixed = named.groupBy("tree", "prefix").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    return named.join(mixed.select("tree", "prefix"), ["tree", "prefix"], "left_semi")


def _among(crowded: DataFrame, texts: DataFrame, classes: DataFrame, forest: Forest) -> DataFrame:
    """Links between different components that share a crowded region: exact, and without rows for pairs.

    Regions that share rows are one group. A group's rows go to blocks of about BLOCK sets, a large component's in blocks of
    their own; two blocks that hold more than one component meet in a task, which multiplies their incidence matrices
    and returns at most one link for any two components. Blocks of one component never meet.
    """
    hubs = crowded.groupBy("tree", "prefix").agg(F.min("id").alias("b"))
    groups = components(crowded.join(hubs, ["tree", "prefix"]).select(F.col("id").alias("a"), "b"))
    members = stored(
        crowded.select("id", "c").distinct().join(groups, "id").select("id", "c", F.col("component").alias("g")), "members"
    )
    sizes = members.groupBy("g", "c").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") <= BLOCK).groupBy("g").agg(F.sum("n").alias("total"))
    large = F.col("n") > BLOCK
    parts = F.ceil(F.when(large, F.col("n")).otherwise(F.col("total")) / BLOCK).cast("long")
    part = F.pmod(F.xxhash64(F.when(large, F.col("id")).otherwise(F.col("c"))), parts)
    placed = stored(
        members.join(sizes, ["g", "c"]).join(small, "g", "left")
        .select("id", "c", "g", F.struct(F.when(large, F.col("c")).otherwise(-1).alias("of"), part.alias("part")).alias("block")),
        "placed",
    )
    blocks = placed.groupBy("g", "block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    one, two = blocks.toDF("g", "x", "lo", "hi"), blocks.toDF("g", "y", "lo2", "hi2")
    meet = one.join(two, "g").where("x <= y AND NOT (lo = hi AND lo2 = hi2 AND lo = lo2)")
    meet = stored(meet.select("g", "x", "y"), "meet")
    left = placed.join(meet, (placed["g"] == meet["g"]) & (placed["block"] == meet["x"])).select("id", "c", placed["g"], "x", "y", F.lit(0).alias("side"))
    right = placed.join(meet.where("x <> y"), (placed["g"] == meet["g"]) & (placed["block"] == meet["y"]))
    right = right.select("id", "c", placed["g"], "x", "y", F.lit(1).alias("side"))
    sets = _sets(texts, members.select("id").distinct(), classes, forest)
    rows = left.union(right).join(sets, "id").select("g", "x", "y", "side", "id", "c", "set")
    return rows.groupBy("g", "x", "y").applyInArrow(_matcher(forest.percent), "a long, b long")


def _matcher(percent: int) -> Callable[[pa.Table], pa.Table]:
    def match(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        side, ids, comps = (rows[c].to_numpy() for c in ("side", "id", "c"))
        lists = rows["set"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        _, token, counts = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        sizes = np.diff(lists.offsets.to_numpy())
        shared = np.flatnonzero(counts > 1)
        column = np.full(len(counts), -1)
        column[shared] = np.arange(len(shared))
        of = column[token]
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if (side == 1).any() else a
        both = np.zeros((len(a), len(b)), np.float32)
        for start in range(0, len(shared), 4096):
            used = (of >= start) & (of < start + 4096)
            held = np.zeros((len(ids), 4096), np.float32)
            held[owner[used], of[used] - start] = 1
            both += held[a] @ held[b].T
        links = 100 * both >= percent * (sizes[a][:, None] + sizes[b][None, :] - both)
        links &= comps[a][:, None] != comps[b][None, :]
        i, j = np.nonzero(links)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        for u, v in zip(a[i].tolist(), b[j].tolist(), strict=True):
            found.setdefault((min(comps[u], comps[v]), max(comps[u], comps[v])), (int(ids[u]), int(ids[v])))
        pairs = list(found.values())
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    return match
