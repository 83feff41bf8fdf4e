"""Benchmark decontamination by spaced seeds: hashes that ignore fixed token positions tolerate substitutions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.shared import fresh, received, sent
from stratalens.llm.wordhash import chunks, words

#: Each mask has eight ones. Every pattern of at most 20 % substitutions over 13 or more tokens leaves room for one of
#: them (a test enumerates 13 tokens with 2, 15 with 3, 20 with 4 and 25 with 5; all longer ones hold one of these).
MASKS = (
    "1110110111", "1110010010111", "111101111", "11010101111", "1111111001", "101100011111", "110100110111",
    "1111100010011", "100011011111", "111111000011", "101010111011", "110011110011", "11111000111",
)

MATCH = pa.struct([
    ("item_id", pa.int64()), ("doc_token", pa.int32()), ("item_token", pa.int32()),
    ("length", pa.int32()), ("equal", pa.int32()),
])
MATCHES = "array<struct<item_id: bigint, doc_token: int, item_token: int, length: int, equal: int>>"


@dataclass(frozen=True)
class Overlap:
    """What counts as a leak, and how much of the benchmark goes to the executors at once.

    tokens: aligned tokens that an overlap needs (all of an item that has fewer). percent: share of them that must be
    equal. shortest: items with fewer tokens are never matched. masks: for items of `tokens` tokens and more, at any of
    their positions; MASKS find all overlaps at these defaults (no ``missed`` patterns), other limits need others.
    block: benchmark tokens in one broadcast; a larger benchmark is scanned for in several such blocks.
    """

    tokens: int = 13
    percent: int = 80
    shortest: int = 1
    masks: tuple[str, ...] = MASKS
    block: int = 500_000
    factors: tuple[int, ...] = field(
        default=tuple(int(x) | 1 for x in np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 64))
    )


def _seeds(tokens: np.ndarray, mask: str, factors: tuple[int, ...]) -> np.ndarray:
    """The mask's hash at every position where it fits."""
    n = len(tokens) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), np.uint64)
    for i, c in enumerate(mask):
        if c == "1" and n > 0:
            out += tokens[i : i + n] * np.uint64(factors[i])
    return out


def short_masks(n: int, percent: int) -> list[tuple[str, int]]:
    """(mask, its place) over a whole item of n tokens: whichever tokens are substituted, one mask meets equal ones only.

    The item is cut into groups; a mask leaves out as many of them as there can be substitutions.
    """
    spare = n * (100 - percent) // 100
    groups = np.array_split(np.arange(n), min(n, max(5, spare + 3)))
    out = []
    for left_out in combinations(range(len(groups)), spare):
        kept = [i for g, group in enumerate(groups) if g not in left_out for i in group.tolist()]
        out.append(("".join("01"[i in kept] for i in range(kept[0], kept[-1] + 1)), kept[0]))
    return out


def missed(masks: tuple[str, ...], n: int, substitutions: int) -> list[tuple[int, ...]]:
    """The places of substitutions in n aligned tokens for which no mask meets equal tokens only."""
    ones = [sum(1 << (i + at) for i, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)]
    patterns = ((p, sum(1 << i for i in p)) for p in combinations(range(n), substitutions))
    return [p for p, bits in patterns if all(bits & m for m in ones)]


@dataclass(frozen=True)
class _Block:
    """Items: ids, all tokens, and where each item's begin. seeds: per mask, its hashes over the items.

    seeds hold the mask, the hashes' shift to a place in the bitmap, the bitmap, the sorted hashes and the token of each.
    """

    ids: list[int]
    tokens: np.ndarray
    starts: np.ndarray
    seeds: list[tuple[str, np.uint64, np.ndarray, np.ndarray, np.ndarray]]


def _block(items: list[tuple[int, np.ndarray]], overlap: Overlap) -> _Block:
    flat = np.concatenate([tokens for _, tokens in items])
    lengths = np.array([len(tokens) for _, tokens in items])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    places: dict[str, list[np.ndarray]] = {}
    for mask in overlap.masks:
        fits = np.repeat(np.where(lengths >= overlap.tokens, starts[1:] - len(mask), -1), lengths)
        places.setdefault(mask, []).append(np.flatnonzero(np.arange(len(flat)) <= fits))
    for n in np.unique(lengths[lengths < overlap.tokens]).tolist():
        for mask, at in short_masks(n, overlap.percent):
            places.setdefault(mask, []).append(starts[:-1][lengths == n] + at)
    seeds = []
    for mask, parts in places.items():
        place = np.concatenate(parts)
        if len(place):
            hashes = _seeds(flat, mask, overlap.factors)[place]
            order = np.argsort(hashes, kind="stable")
            shift = np.uint64(64 - min(22, max(12, len(place).bit_length() + 6)))
            bitmap = np.zeros(1 << (64 - int(shift)), dtype=bool)
            bitmap[(hashes >> shift).astype(np.int64)] = True
            seeds.append((mask, shift, bitmap, hashes[order], place[order].astype(np.int32)))
    return _Block([i for i, _ in items], flat, starts, seeds)


def longest_overlap(equal: np.ndarray, percent: int) -> tuple[int, int]:
    """[start, end) of the longest stretch with at least percent of its tokens equal; the first of several."""
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    best, left = (0, 0), 0
    ahead = np.maximum.accumulate(sums[::-1])[::-1]
    right = 0
    while left < len(sums) and right < len(sums):
        if ahead[right] >= sums[left]:
            if right - left > best[1] - best[0]:
                best = (left, right)
            right += 1
        else:
            left += 1
            right = max(right, left)
    return best


def _pieces(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of about `limit` in sum, at least one row each."""
    sums = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = int(np.searchsorted(sums, (sums[start - 1] if start else 0) + limit, "right"))
        stop = max(stop, start + 1)
        yield slice(start, stop)
        start = stop


def _each(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows that stand for `sizes` entries each: every entry's row, and its number in the row."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]


def _distinct(rows: np.ndarray) -> np.ndarray:
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])] if len(rows) else rows


def _holds_overlap(equal: np.ndarray, sizes: np.ndarray, need: np.ndarray, percent: int) -> np.ndarray:
    """For each diagonal (sizes of them, end to end): has some stretch of `need` or more tokens percent of them equal?"""
    row, at = _each(sizes + 1)
    steps = np.zeros(len(row), np.int64)
    steps[at > 0] = np.where(equal, 100 - percent, -percent)
    sums = np.cumsum(steps)
    sums -= sums[at == 0][row] + row * (200 * (int(sizes.max()) + 1))  # each row's sums lie below the last row's
    least = np.minimum.accumulate(sums)
    long = np.flatnonzero(at >= need[row])
    return np.bincount(row[long], sums[long] >= least[long - need[row[long]]], len(sizes)) > 0


def _scanner(block, overlap: Overlap, column: str, text: str) -> Callable:
    def diagonals(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct (text, item, token of the texts that faces the item's first) of all equal hashes."""
        starts = received(block).starts
        found = [np.zeros((0, 3), np.int64)]
        for mask, shift, bitmap, hashes, place in received(block).seeds:
            seeds = _seeds(tokens, mask, overlap.factors)
            at = np.flatnonzero(bitmap[(seeds >> shift).astype(np.int64)])
            low, high = np.searchsorted(hashes, seeds[at], "left"), np.searchsorted(hashes, seeds[at], "right")
            doc = np.searchsorted(bounds, at, "right") - 1
            hit = (high > low) & (at + len(mask) <= bounds[doc + 1])
            at, low, high, doc = at[hit], low[hit], high[hit], doc[hit]
            for piece in _pieces(high - low, 1 << 20):
                row, j = _each((high - low)[piece])
                token = place[low[piece][row] + j]
                item = np.searchsorted(starts, token, "right") - 1
                found.append(_distinct(np.column_stack([doc[piece][row], item, at[piece][row] - token + starts[item]])))
        return _distinct(np.concatenate(found))

    def matches(tokens: np.ndarray, bounds: np.ndarray) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(bounds) - 1)]
        ids, wanted, starts = received(block).ids, received(block).tokens, received(block).starts
        doc, item, diagonal = diagonals(tokens, bounds).T
        length = starts[item + 1] - starts[item]
        start, stop = np.maximum(diagonal, bounds[doc]), np.minimum(diagonal + length, bounds[doc + 1])
        need = np.minimum(overlap.tokens, length)
        full = stop - start >= need
        doc, item, diagonal, start, stop, need = (x[full] for x in (doc, item, diagonal, start, stop, need))
        for piece in _pieces(stop - start, 1 << 20):
            sizes = (stop - start)[piece]
            row, j = _each(sizes)
            ours = start[piece][row] + j
            equal = tokens[ours] == wanted[ours - diagonal[piece][row] + starts[item[piece]][row]]
            ends = np.cumsum(sizes)
            for r in np.flatnonzero(_holds_overlap(equal, sizes, need[piece], overlap.percent)).tolist():
                i, same = piece.start + r, equal[ends[r] - sizes[r] : ends[r]]
                a, b = longest_overlap(same, overlap.percent)
                out[doc[i]].append({
                    "item_id": ids[item[i]], "doc_token": int(start[i] + a - bounds[doc[i]]),
                    "item_token": int(start[i] - diagonal[i] + a), "length": b - a, "equal": int(same[a:b].sum()),
                })
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, text):
                tokens, _, _, bounds = words(chunk.column(chunk.schema.get_field_index(text)), plain=True)
                found = pa.array(matches(tokens, bounds), pa.list_(MATCH))
                yield pa.RecordBatch.from_arrays([*chunk.columns, found], names=[*chunk.schema.names, column])

    return scan


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes, _, _, bounds = words(batch.column(1), plain=True)
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item_id", "tokens"])


def with_overlaps(
    docs: DataFrame, benchmark: DataFrame, column: str, overlap: Overlap = Overlap(), text_col: str = "text"
) -> DataFrame:
    """docs with the benchmark overlaps of each text in `column`; no shuffle, whatever the number of hits.

    Tokens are runs of letters, digits and non-ASCII characters, lower-cased (ASCII); in scripts without blanks between words,
    single code points. Items of one to four tokens match where all their tokens follow each other, unchanged. Every mask is hashed at every position of
    every text and item; equal hashes name a diagonal, on which the longest stretch with enough equal tokens is
    verified. Null, empty and wordless texts or items match nothing; repeated items each match.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_tokens, "item_id long, tokens array<long>")
    blocks: list[list] = [[]]
    held, names = 0, []
    out = docs

    def flush() -> None:
        nonlocal out
        if blocks[-1]:
            block = sent(spark, _block(blocks[-1], overlap))
            names.append(fresh(out, column))
            schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema] + [f"`{names[-1]}` {MATCHES}"])
            out = out.mapInArrow(_scanner(block, overlap, names[-1], text_col), schema)
            blocks[-1] = []

    for row in items.orderBy("item_id").toLocalIterator():
        tokens = np.array(row.tokens, np.int64).view(np.uint64)
        if len(tokens) >= overlap.shortest:
            blocks[-1].append((row.item_id, tokens))
            held += len(tokens)
        if held >= overlap.block:
            flush()
            held = 0
    flush()
    if not names:
        return out.withColumn(column, F.array().cast(MATCHES))
    return out.withColumn(column, F.concat(*[F.col(f"`{n}`") for n in names])).drop(*[n for n in names if n != column])


def contamination(docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """(doc_id, contaminated, item_ids, n_overlaps, longest) for every document, in the rows' own number.

    item_ids are the items that the text overlaps, in order, without repeats; longest is the longest overlap's tokens
    (0 for none).
    """
    plain = docs.select("doc_id", "text")
    found = with_overlaps(plain, benchmark, "matches", overlap)
    return found.select(
        "doc_id", (F.size("matches") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct("matches.item_id")).alias("item_ids"), F.size("matches").cast("long").alias("n_overlaps"),
        F.coalesce(F.array_max("matches.length"), F.lit(0)).cast("long").alias("longest"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, overlap: Overlap = Overlap()) -> DataFrame:
    """The rows of docs, all columns kept, whose text overlaps no benchmark item."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    found = with_overlaps(own, benchmark, "overlaps", overlap, f"c{names.index('text')}")
    return found.where(F.size("overlaps") == 0).select(*own.columns).toDF(*names)
