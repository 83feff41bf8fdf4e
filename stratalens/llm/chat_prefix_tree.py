"""Chat formatting as a prefix tree: shared first turns are emitted once, depth-first, with positions and attention."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.shared import checkpointed, stored

#: The template: a turn is OPEN[answers?] role newline text CLOSE[answers?], its role and text escaped.
OPEN = {False: "[INST]", True: "<s>"}
CLOSE = {False: "[/INST]", True: "</s>"}
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"(\[INST\]|<s>)(.*?)\n(.*?)(\[/INST\]|</s>)", re.DOTALL)


def escape(text: str) -> str:
    """Reversible, and free of control strings: a backslash is doubled and one goes into each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's formatted text, and where its loss begins and ends (both 0 unless an assistant says it)."""
    answers = role == "assistant"
    head = OPEN[answers] + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE[answers], len(head) * answers, (len(head) + len(body)) * answers


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(m[2]), unescape(m[3])) for m in _TURN.finditer(formatted)]


def _hash(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(len(p).to_bytes(8, "big") + p for p in parts), digest_size=16).digest()


_TURNS = pa.list_(pa.struct([
    ("node", pa.binary()), ("text", pa.string()), ("units", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())
]))


def _formatter(tokenizer_file: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len
        if tokenizer_file:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_file)
            tokenizer.encode_special_tokens = True
            count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
        for batch in batches:
            out = []
            for turns in batch.column(1).to_pylist():
                node, made = b"", []
                for turn in turns:
                    text, start, end = format_turn(turn["role"], turn["text"])
                    node = _hash(node, turn["role"].encode(), turn["text"].encode())
                    made.append({"node": node, "text": text, "units": count(text), "loss_start": start, "loss_end": end})
                out.append(made)
            leaves = pa.array([m[-1]["node"] for m in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), leaves, pa.array(out, _TURNS)], names=["conv_id", "leaf", "turns"])

    return run


SUMMARY = (
    "pid int, units long, first array<binary>, first_units array<long>, last array<binary>, last_units array<long>, "
    "last_starts array<long>"
)
NODE = (
    "node_id binary, parent_id binary, tree_id binary, depth int, start long, end long, position long, "
    "attends array<struct<start: bigint, end: bigint>>"
)


def _shared(a: list, b: list) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per partition of sorted paths: what it emits on its own, its first path, and its last with starts."""
    path, starts, units, total, first = [], [], [], 0, None
    for batch in batches:
        for new, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = _shared(path, new)
            starts = starts[:n]
            for size in sizes[n:]:
                starts.append(total)
                total += size
            path, units = new, sizes
            first = first or (new, sizes)
    if first:
        row = {
            "pid": TaskContext.get().partitionId(), "units": total, "first": first[0], "first_units": first[1],
            "last": path, "last_units": units, "last_starts": starts,
        }
        kinds = {"pid": pa.int32(), "units": pa.int64(), "first": pa.list_(pa.binary()), "last": pa.list_(pa.binary())}
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], kinds.get(k, pa.list_(pa.int64()))) for k, v in row.items()], names=list(row)
        )


def _chain(rows: list) -> dict[int, tuple[int, list[int]]]:
    """Per partition: the offset of its first new unit, and the starts of the turns that it shares with those before.

    A partition's own count includes its first path whole; the turns that earlier ones emitted are taken off.
    """
    out, offset = {}, 0
    path: list = []
    starts: list[int] = []
    for row in sorted(rows, key=lambda r: r.pid):
        n = _shared(path, row.first)
        given = starts[:n]
        skipped = sum(row.first_units[:n])
        out[row.pid] = (offset - skipped, given)
        ahead = _shared(row.first, row.last)
        starts = [given[i] if i < min(n, ahead) else s + offset - skipped for i, s in enumerate(row.last_starts)]
        path, offset = row.last, offset + row.units - skipped
    return out


def _placer(chain: dict[int, tuple[int, list[int]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every turn that no earlier path has, with its place in the stream and the intervals of its ancestors."""

    def intervals(starts: list[int], sizes: list[int]) -> list[dict]:
        out: list[dict] = []
        for start, size in zip(starts, sizes, strict=True):
            if out and out[-1]["end"] == start:
                out[-1]["end"] = start + size
            else:
                out.append({"start": start, "end": start + size})
        return out

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, path, starts, total, begun = TaskContext.get().partitionId(), [], [], 0, False
        for batch in batches:
            rows = []
            for new, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                offset, given = chain[pid]
                n = _shared(path, new)
                if not begun:
                    n, starts, total, begun = len(given), list(given), sum(sizes[: len(given)]), True
                starts = starts[:n]
                attends, position = intervals(starts, sizes[:n]), sum(sizes[:n])
                for depth in range(n, len(new)):
                    start = offset + total
                    rows.append({
                        "node_id": new[depth], "parent_id": new[depth - 1] if depth else None, "tree_id": new[0],
                        "depth": depth, "start": start, "end": start + sizes[depth], "position": position,
                        "attends": [dict(i) for i in attends],
                    })
                    if attends and attends[-1]["end"] == start:
                        attends[-1]["end"] = start + sizes[depth]
                    else:
                        attends.append({"start": start, "end": start + sizes[depth]})
                    starts.append(start)
                    total += sizes[depth]
                    position += sizes[depth]
                path = new
            interval = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("node_id", pa.binary()), ("parent_id", pa.binary()), ("tree_id", pa.binary()), ("depth", pa.int32()),
                ("start", pa.int64()), ("end", pa.int64()), ("position", pa.int64()), ("attends", interval),
            ]))

    return place


def prefix_tree(turns: DataFrame, tokenizer_file: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, conversations) of a table of turns (conv_id, turn, role, text).

    nodes, one row per distinct sequence of first turns: node_id, parent_id, tree_id (its first turn), depth, text (the
    formatted turn), loss_start and loss_end (code points of the text under the loss mask; equal: none), start and end (its
    units' places in one depth-first stream), position (of its first unit in the conversation; the next ones follow), attends (the
    intervals of the stream that its units see before their own turn: exactly its ancestors). conversations: conv_id,
    node_id of the last turn, path (node_ids from the first turn). Units are code points, or tokens of each formatted
    turn with a tokenizer file that every executor can read.

    Turns stand by turn, then role, then text; null roles and texts count as empty; repeated turns are turns of their
    own; a null conv_id is a conversation of its own. Conversations with equal turns share one path. Paths are sorted by ranges, so
    a first turn that many conversations share spreads over partitions; the driver sees one row per partition.
    """
    said = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("turns"))
    kind = turns.schema["conv_id"].dataType.simpleString()
    formed = stored(
        gathered.mapInArrow(
            _formatter(tokenizer_file),
            f"conv_id {kind}, leaf binary, turns array<struct<node: binary, text: string, units: bigint, loss_start: bigint, loss_end: bigint>>",
        ),
        "formed",
    )
    paths = formed.select("leaf", F.col("turns.node").alias("path"), F.col("turns.units").alias("units"))
    paths = paths.groupBy("leaf").agg(F.first("path").alias("path"), F.first("units").alias("units")).select("path", "units")
    order = checkpointed(paths.repartitionByRange("path").sortWithinPartitions("path"))
    chain = _chain(order.mapInArrow(_summarise, SUMMARY).collect())  # one row per partition
    places = order.mapInArrow(_placer(chain), NODE)
    texts = formed.select(F.explode("turns").alias("t")).select(F.col("t.node").alias("node_id"), "t.text", "t.loss_start", "t.loss_end")
    texts = texts.groupBy("node_id").agg(*[F.first(c).alias(c) for c in ("text", "loss_start", "loss_end")])
    nodes = stored(places.join(texts, "node_id"), "nodes")
    return nodes, formed.select("conv_id", F.col("leaf").alias("node_id"), F.col("turns.node").alias("path"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for nodes in batch.column(1).to_pylist():
            formatted = "".join(n["text"] for n in nodes)
            said = parse(formatted)
            loss = "".join(unescape(n["text"][n["loss_start"] : n["loss_end"]]) for n in nodes)
            out["n_turns"].append(len(said))
            out["turns_sha256"].append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest())
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hashlib.sha256(loss.encode()).hexdigest())
            out["formatted_chars"].append(len(formatted))
        arrays = [pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv_id", *out])


def read_back(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Each conversation put together again from the tree's turns and parsed: digests of its turns and its loss."""
    steps = conversations.select("conv_id", F.posexplode("path").alias("depth", "node_id"))
    found = steps.join(nodes.select("node_id", "text", "loss_start", "loss_end"), "node_id")
    whole = found.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("depth", "text", "loss_start", "loss_end"))).alias("nodes")
    )
    kind = conversations.schema["conv_id"].dataType.simpleString()
    return whole.mapInArrow(
        _reader,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
