"""Spelling variants: words one edit apart, found by probing edits against Bloom filters of the vocabulary."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.shared import discard, stored
from stratalens.llm.wordhash import chunks, mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
FACTOR = 0x9E3779B97F4A7C15 | 1
BITS = 12  # of a filter for each word
PLACES = 6  # bits that a word sets in its block
BLOCK_BITS = 512
HELD = 200_000  # words that a task counts before it gives them off
PROBES = 1 << 20  # edits hashed at once


@dataclass(frozen=True)
class Spelling:
    """Parameters: least code points and occurrences of a word; how many times as frequent its form is; bytes of filters sent at once."""

    length: int = 6
    least: int = 5
    times: int = 5
    sent_bytes: int = 16 << 20


def _counter(damage: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of words, by parts of a partition. damage: see ``vocabulary``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        of: dict[str, tuple[str, bytes]] = {}  # a run as written: lower-cased, and its bytes

        def give() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            of.clear()
            return out

        for batch in batches:
            for chunk in chunks(batch):
                for doc, text in zip(chunk.column(0).to_pylist(), chunk.column(1).to_pylist(), strict=True):
                    head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for run, n in Counter(RUN.findall(text or "")).items():
                        if run not in of:
                            word = run.translate(LOWER)
                            of[run] = word, word.encode()
                        word, raw = of[run]
                        if damage:
                            h = zlib.crc32(raw, head)
                            if h % damage == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                        held[word] += n
                if len(held) + len(of) > HELD:
                    yield give()
        if held:
            yield give()

    return count


def vocabulary(docs: DataFrame, spelling: Spelling = Spelling(), damage: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts, runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, that are long and frequent enough.

    damage: if not 0, a run whose crc32 of ``<doc_id>:<run>`` is divisible by it loses the code point at that crc32 modulo its
    length, for trials; a null doc_id is written as nothing. Null texts have no words.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    counts = texts.mapInArrow(_counter(damage), "word string, n long").where(F.char_length("word") >= spelling.length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= spelling.least)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, FACTOR, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _code(points: np.ndarray) -> np.ndarray:
    """A random number for each code point."""
    return mix(points.astype(np.uint64) + np.uint64(0x1234567))


def word_hashes(points: np.ndarray) -> np.ndarray:
    """One hash per row of code points: the sum of each one's number times a power of its place."""
    return (_code(points) * _powers(points.shape[1])).sum(axis=1, dtype=np.uint64)


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each hash, and its bits there."""
    spread = mix(hashes)
    block = ((spread >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    other = mix(spread ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return block, [(other >> np.uint64(9 * i)) & np.uint64(BLOCK_BITS - 1) for i in range(PLACES)]


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Each length and the numbers of its words."""
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def _filer(blocks: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(length, block, w0..w7): the bits of each word; blocks: how many a length's filter has."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in _by_length(words):
                block, bits = _places(word_hashes(_matrix([words[i] for i in at.tolist()])), blocks[length])
                rows = np.zeros((len(at), BLOCK_BITS // 64), np.uint64)
                for bit in bits:
                    rows[np.arange(len(at)), (bit >> np.uint64(6)).astype(int)] |= np.uint64(1) << (bit & np.uint64(63))
                columns = [pa.array(rows[:, i].view(np.int64)) for i in range(rows.shape[1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), length, np.int32)), pa.array(block.astype(np.int64)), *columns],
                    names=["length", "block", *[f"w{i}" for i in range(rows.shape[1])]],
                )

    return file


def _edits(points: np.ndarray, signs: np.ndarray) -> Iterator[tuple[str, int, np.ndarray]]:
    """(kind, place, hashes) of edits of words of one length: without the code point at a place, or with a greater sign for it.

    Hashes of replacements have a column for each sign. Each pair of neighbours comes up once: the longer word probes for the
    shorter one, and of two of one length the one with the smaller code point probes.
    """
    terms, powers, codes = _code(points), _powers(points.shape[1]), _code(signs)
    whole = terms * powers
    total = whole.sum(axis=1, dtype=np.uint64)
    before = np.zeros(len(points), np.uint64)
    inverse = np.uint64(pow(FACTOR, -1, 1 << 64))
    for at in range(points.shape[1]):
        after = (total - before - whole[:, at]) * inverse
        yield "delete", at, before + after
        yield "replace", at, (total - whole[:, at])[:, None] + codes[None, :] * powers[at]
        before = before + whole[:, at]


def _hits(hashes: np.ndarray, shard: tuple[int, int, np.ndarray]) -> np.ndarray:
    """Which hashes may be of words of the shard: (first block, all blocks of the length's filter, rows of words)."""
    first, blocks, rows = shard
    block, bits = _places(hashes, blocks)
    inside = (block >= first) & (block < first + len(rows))
    at = np.flatnonzero(inside)
    for bit in bits:
        word = rows[(block[at] - np.uint64(first)).astype(np.int64), (bit[at] >> np.uint64(6)).astype(np.int64)]
        at = at[(word >> (bit[at] & np.uint64(63))) & np.uint64(1) == 1]
    return at


def _prober(sent, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, other): the edits that the sent filters let pass."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        signs = np.array(sent.value[0], np.uint32)
        for length, first, blocks, raw in sent.value[1]:
            shards.setdefault(length, []).append((first, blocks, np.frombuffer(raw, np.uint64).reshape(-1, BLOCK_BITS // 64)))
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, at in _by_length(words):
                own, step = at.tolist(), max(1, PROBES // (len(signs) + 1))
                if not shards.get(length) and not shards.get(length - 1):
                    continue
                for cut in range(0, len(own), step):
                    some = [words[i] for i in own[cut : cut + step]]
                    points, found = _matrix(some), []
                    for kind, place, hashes in _edits(points, signs):
                        if kind == "delete":
                            for shard in shards.get(length - 1, []) if length > least else []:
                                found += [(some[i], some[i][:place] + some[i][place + 1 :]) for i in _hits(hashes, shard).tolist()]
                        elif length in shards:
                            row, column = np.nonzero(points[:, place][:, None] < signs[None, :])
                            for shard in shards[length]:
                                for i in _hits(hashes[row, column], shard).tolist():
                                    w = some[row[i]]
                                    found.append((w, w[:place] + chr(signs[column[i]]) + w[place + 1 :]))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*found)], names=["word", "other"])

    return probe


def neighbours(words: DataFrame, spelling: Spelling = Spelling()) -> DataFrame:
    """(word, other), each once and in one order: distinct words that differ by one inserted, deleted or replaced code point.

    words: a column `word` of distinct words of letters as in ``vocabulary``. Each length has a blocked Bloom filter over its
    words. Filters are cut into shards of consecutive blocks and broadcast, spelling.sent_bytes at most in a round, and in every round
    each word's edits are probed against the shards that are sent. Edits that pass are joined with the words, which
    removes the false ones.
    """
    spark = words.sparkSession
    sizes = {r.length: r.n for r in words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    blocks = {length: math.ceil(n * BITS / BLOCK_BITS) for length, n in sizes.items()}
    columns = [f"w{i}" for i in range(BLOCK_BITS // 64)]
    rows = words.select("word").mapInArrow(_filer(blocks), "length int, block long, " + ", ".join(f"{c} long" for c in columns))
    filters = stored(rows.groupBy("length", "block").agg(*[F.bit_or(c).alias(c) for c in columns]), "filters")
    letters = F.explode(F.array_distinct(F.split("word", "")))
    signs = [ord(r.sign) for r in words.select(letters.alias("sign")).where("sign <> ''").distinct().orderBy("sign").collect()]
    room = max(1, spelling.sent_bytes // (BLOCK_BITS // 8))
    rounds, taken = [[]], 0
    for length, count in sorted(blocks.items()):
        first = 0
        while first < count:
            if taken == room:
                rounds.append([])
                taken = 0
            size = min(room - taken, count - first)
            rounds[-1].append((length, first, size))
            first, taken = first + size, taken + size
    passed = []
    for shards in rounds:
        sent_rows = []
        for length, first, size in shards:
            held = np.zeros((size, len(columns)), np.int64)
            part = filters.where((F.col("length") == length) & F.col("block").between(first, first + size - 1))
            for batch in part.select("block", *columns).toArrow().to_batches():
                held[batch.column(0).to_numpy() - first] = np.column_stack([batch.column(i + 1).to_numpy() for i in range(len(columns))])
            sent_rows.append((length, first, blocks[length], held.tobytes()))
        sent = spark.sparkContext.broadcast((signs, sent_rows))
        spread = words.select("word").repartition("word")
        passed.append(stored(spread.mapInArrow(_prober(sent, spelling.length), "word string, other string"), "passed"))
        sent.unpersist()
    possible = passed[0]
    for more in passed[1:]:
        possible = possible.union(more)
    met = words.select(F.col("word").alias("other"))
    return possible.join(met, "other", "left_semi").select("word", "other").distinct()


def _roots(forms: DataFrame, most: int, times: int) -> DataFrame:
    """(word, root) from (word, form): each round doubles the forms followed. A form is `times` as frequent, so chains are short."""
    chain = max(1, math.ceil(math.log(max(most, 2), times))) if times > 1 else 64
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(max(1, math.ceil(math.log2(chain + 1)))):
        far = roots.select(F.col("word").alias("of"), F.col("root").alias("far"))
        roots = roots.join(far, F.col("root") == F.col("of"), "left").select("word", F.coalesce("far", "root").alias("root"))
    return roots


def variants(words: DataFrame, spelling: Spelling = Spelling()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of a vocabulary (word, n), words distinct.

    Near words differ by one inserted, deleted or replaced code point. form is the near word of greatest n, of several the
    least by code points, if its n is at least spelling.times that of the word (2 or more, so that forms lead to ever more
    frequent words); else null. root: the last word that forms lead to, the word itself if it has none. An empty
    vocabulary gives no rows.
    """
    if spelling.times < 2:
        raise ValueError("times must be at least 2")
    words = stored(words.select("word", "n"), "words")
    pairs = stored(neighbours(words, spelling), "near")
    both = pairs.select("word", "other").union(pairs.select("other", "word"))
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = both.join(other, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    )
    fits = -F.col("best.less") >= spelling.times * F.col("n")
    own = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"),
    )
    own = stored(own, "forms")
    discard(pairs)
    most = own.agg(F.max("n")).first()[0] or 0
    roots = _roots(own.where("form IS NOT NULL"), most, spelling.times).select(F.col("word").alias("of"), "root")
    out = own.join(roots, F.col("word") == F.col("of"), "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
