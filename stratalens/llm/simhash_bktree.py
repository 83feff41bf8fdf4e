"""Near duplicates by SimHash: fingerprints at few differing bits are found in BK-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.linking import components, repeated_ids
from stratalens.llm.shared import discard, stored
from stratalens.llm.wordhash import chunks

SEED = 42
ALL = (1 << 64) - 1
NODE_BYTES = 21  # of a tree that is sent: fingerprint, id, parent and edge


@dataclass(frozen=True)
class Near:
    """Parameters of the search.

    words: words per shingle. radius: differing bits of a link, at most. blocks: the fingerprint's bits are cut into so
    many blocks; two fingerprints within the radius agree in blocks - radius of them, whole. tree: nodes of one tree.
    sent_bytes: trees broadcast at once; more are sent in several rounds.
    """

    words: int = 3
    radius: int = 2
    blocks: int = 5
    tree: int = 4096
    sent_bytes: int = 16 << 20

    def __post_init__(self) -> None:
        if not 0 <= self.radius < self.blocks <= 64:
            raise ValueError("blocks must be more than radius, and 64 at most")

    @property
    def masks(self) -> list[int]:
        """The bits of each choice of blocks - radius blocks."""
        cuts = [64 * i // self.blocks for i in range(self.blocks + 1)]
        of = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
        return [sum(chosen) for chosen in combinations(of, self.blocks - self.radius)]


def simhash(hashes: list[int], starts: np.ndarray) -> np.ndarray:
    """One fingerprint per group of shingle hashes: a bit is 1 if it is set in over half of them."""
    each = np.array(hashes, np.uint64)
    sizes = np.diff(np.append(starts, len(each)))
    out = np.zeros(len(starts), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((each >> np.uint64(bit)).astype(np.uint8) & np.uint8(1), starts, dtype=np.int64)
        out |= (2 * ones > sizes).astype(np.uint64) << np.uint64(bit)
    return out


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 of each k-word shingle, with repeats; of the whole sequence if there are fewer words, none without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(joined, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :])]


def _fingerprinter(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch):
                found = [shingle_hashes(text, k) for text in chunk.column(1).to_pylist()]
                sizes = np.array([len(f) for f in found])
                out = np.zeros(len(found), np.uint64)
                if some := np.flatnonzero(sizes).tolist():
                    starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    out[some] = simhash([h for f in found for h in f], starts)
                yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return fingerprint


class Tree:
    """A BK-tree: a node's children are keyed by their distance in bits from it."""

    def __init__(self) -> None:
        self.points: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parents: list[int] = []
        self.edges: list[int] = []

    @classmethod
    def of(cls, points: list[int], parents: list[int], edges: list[int]) -> Tree:
        """The tree of which these are the nodes, in the order in which they were added."""
        tree = cls()
        tree.points, tree.parents, tree.edges = points, parents, edges
        tree.children = [{} for _ in points]
        for node in range(1, len(points)):
            tree.children[parents[node]][edges[node]] = node
        return tree

    def add(self, point: int) -> None:
        at, points, children = 0, self.points, self.children
        new = len(points)
        if new:
            while (below := children[at].get(edge := (point ^ points[at]).bit_count())) is not None:
                at = below
            children[at][edge] = new
        points.append(point)
        children.append({})
        self.parents.append(at if new else -1)
        self.edges.append(edge if new else 0)

    def within(self, point: int, radius: int) -> list[int]:
        """Nodes at most `radius` bits from the point; an edge leads there only if its distance is within the radius of the parent's."""
        points, children, found = self.points, self.children, []
        todo = [0] if points else []
        while todo:
            at = todo.pop()
            far = (point ^ points[at]).bit_count()
            if far <= radius:
                found.append(at)
            if below := children[at]:
                todo += [below[k] for k in range(far - radius, far + radius + 1) if k in below]
        return found


class Forest:
    """Union-find over ids; ``links`` are the pairs that joined two sets."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))


WALKED = "a long, b long, fam int, agreed long, pid int, seq int, fps array<long>, ids array<long>, parents array<int>, edges array<int>"
NAMES = [part.split()[0] for part in WALKED.split(", ")]
LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), LONGS, LONGS, INTS, INTS]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), TYPES)], names=NAMES)


def _signed(points: Iterable[int]) -> list[int]:
    return [p - (1 << 64) if p >> 63 else p for p in points]


def _walker(near: Near) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trees of the runs of equal keys in one sorted partition.

    Each fingerprint is looked up in its run's tree before it is added. Rows are links (a, b), or the tree of a run that
    may go on beyond the partition or has more than near.tree nodes.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, first = TaskContext.get().partitionId(), 0, True
        key, points, ids = None, [], []
        out: list[tuple] = []

        def close(whole: bool) -> None:
            nonlocal seq
            if len(points) > 1 or not whole and points:
                tree, sets = Tree(), Forest()
                for i, point in enumerate(points):
                    for node in tree.within(point, near.radius):
                        sets.join(ids[i], ids[node])
                    tree.add(point)
                out.extend((a, b, *[None] * 8) for a, b in sets.links)
                if not whole:
                    out.append((None, None, *key, pid, seq, _signed(points), list(ids), tree.parents, tree.edges))
                    seq += 1
            points.clear()
            ids.clear()

        cut = False  # the run has given off a tree already
        for batch in batches:
            if not batch.num_rows:
                continue
            fam, agreed, fp, own = (batch.column(i).to_numpy() for i in range(4))
            new = np.ones(len(fp), bool)
            new[1:] = (fam[1:] != fam[:-1]) | (agreed[1:] != agreed[:-1])
            at = np.flatnonzero(new)
            ends = np.append(at[1:], len(fp))
            keep = ends - at > 1  # a lone row inside the batch meets nobody
            keep[0] = keep[-1] = True
            for a, b in zip(at[keep].tolist(), ends[keep].tolist(), strict=True):
                run = (int(fam[a]), int(agreed[a]))
                if run != key:
                    if key is not None:
                        close(whole=not (first or cut))
                        first = False
                    key, cut = run, False
                for i in range(a, b, near.tree):
                    stop = min(i + near.tree, b)
                    if len(points) + stop - i > near.tree:
                        close(whole=False)
                        cut = True
                    points += fp[i:stop].view(np.uint64).tolist()
                    ids += own[i:stop].tolist()
            if len(out) >= 10_000:
                yield _batch(out)
                out.clear()
        if key is not None:
            close(whole=False)
        if out:
            yield _batch(out)

    return walk


def _across(trees: dict[tuple[int, int], list[tuple]], radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between a tree's nodes and the given trees of the same key that come before it."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                key, place, sets = (row["fam"], row["agreed"]), (row["pid"], row["seq"]), Forest()
                if key not in built:
                    built.clear()
                    built[key] = [(at, Tree.of([p & ALL for p in fps], up, edges), own) for at, fps, own, up, edges in trees.get(key, [])]
                for at, tree, own in built[key]:
                    if at < place:
                        for point, x in zip(row["fps"], row["ids"], strict=True):
                            for node in tree.within(point & ALL, radius):
                                sets.join(x, own[node])
                if sets.links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*sets.links)], names=["a", "b"])

    return search


def _between(pieces: DataFrame, near: Near) -> list[DataFrame]:
    """Links between trees of one key: the trees are broadcast, sent_bytes at most in a round, and every other tree of the key is held against them."""
    several = pieces.groupBy("fam", "agreed").agg(F.count("*").alias("n")).where("n > 1").select("fam", "agreed")
    parts = stored(pieces.join(several, ["fam", "agreed"], "left_semi").withColumn("deal", F.xxhash64("fam", "agreed", "pid", "seq")), "pieces")
    n_trees, nodes = parts.agg(F.count("*"), F.sum(F.size("fps"))).first()
    links = []
    rounds = -(-(nodes or 0) * NODE_BYTES // near.sent_bytes)
    tasks = max(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), (nodes or 0) // near.tree)
    for turn in range(rounds):
        trees: dict[tuple[int, int], list[tuple]] = {}
        for r in parts.where(F.pmod("deal", F.lit(rounds)) == turn).toLocalIterator():
            trees.setdefault((r.fam, r.agreed), []).append(((r.pid, r.seq), r.fps, r.ids, r.parents, r.edges))
        keys = parts.sparkSession.createDataFrame(list(trees) or [(-1, 0)], "fam int, agreed long")
        asked = parts.join(F.broadcast(keys), ["fam", "agreed"], "left_semi").repartition(min(n_trees, tasks))
        sent = parts.sparkSession.sparkContext.broadcast(trees)
        links.append(stored(asked.mapInArrow(_sent(sent, near.radius), "a long, b long"), "between"))
        sent.unpersist()
    discard(parts)
    return links


def _sent(sent, radius: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _across(sent.value, radius)(batches)


def near_fingerprints(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for each document.

    fp is the SimHash of the text's word shingles with repeats (see ``shingle_hashes``), as a signed long; null, empty and
    wordless texts have 0 and link like any other. Fingerprints link at ``near.radius`` or fewer differing bits;
    component_id is the smallest doc_id reachable. Equal fingerprints are one class, so copies never meet in pairs.

    A class is filed under each choice of blocks - radius of its fingerprint's blocks, since two within the radius
    agree in one such choice. Rows sorted by key, then fingerprint, form runs; each run is a shard with a BK-tree of
    its own. A run that lies within one task is searched there. One that is cut, by the border of a sorted partition or after
    near.tree nodes, leaves its trees, and these are broadcast (``_between``). Tasks return at most as many links as
    they have rows, and those keep every connection.

    Rows with a null doc_id come back with a null component and link nothing; rows that repeat a doc_id come back as often,
    and a link of any of their texts is a link of the id. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = stored(texts.mapInArrow(_fingerprinter(near.words), "doc_id long, fp long"), "fingerprints")
    known = marks.where("doc_id IS NOT NULL")
    classes = stored(known.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
    keys = [F.struct(F.lit(i).alias("fam"), F.col("fp").bitwiseAND(F.lit(_signed([m])[0]).cast("long")).alias("agreed")) for i, m in enumerate(near.masks)]
    filed = classes.select("fp", "id", F.inline(F.array(*keys))).select("fam", "agreed", "fp", "id")
    order = ["fam", "agreed", "fp"]
    walked = stored(filed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walker(near), WALKED), "walked")
    links = walked.where("a IS NOT NULL").select("a", "b")
    between = _between(walked.where("a IS NULL").drop("a", "b"), near)
    for more in between:
        links = links.union(more)
    twice = known.join(repeated_ids(known, F.col("fp")), "doc_id", "left_semi").distinct().join(classes, "fp")
    labels = components(links.union(twice.select(F.col("doc_id").alias("a"), F.col("id").alias("b"))))
    owners = classes.join(labels.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
    owners = owners.select("fp", F.coalesce("component", "id").alias("component"))
    owners = stored(owners, "owners")
    discard(walked, classes, *between)
    out = marks.join(owners.withColumnRenamed("fp", "of"), F.col("fp") == F.col("of"), "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))


def drop_near(docs: DataFrame, near: Near = Near(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component; rows with a null id all stay."""
    found = near_fingerprints(docs, near, id_col, text_col).where("doc_id <> component_id")
    gone = stored(found.select(F.col("doc_id").alias("_gone_id")).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone["_gone_id"], "left_anti")
