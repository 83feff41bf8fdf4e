"""Document fingerprints by consistent weighted sampling: equal samples are as frequent as generalised Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from stratalens.llm.shared import stored
from stratalens.llm.wordhash import CHUNK_BYTES, chunks, mix, shingles, words

SAMPLES = 128
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 63, (3, SAMPLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_UNIT = np.float32(2.0**-32)


def _noise(terms: np.ndarray, which: int) -> np.ndarray:
    """64 random bits for each term and sample."""
    x = terms[:, None] * _FACTORS[which, :]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two uniform numbers above 0 from each 64 bits."""
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float32)
    high = (x >> np.uint64(32)).astype(np.float32)
    return (low + np.float32(0.5)) * _UNIT, (high + np.float32(0.5)) * _UNIT


def _keys(terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each weighted term and sample, an integer that orders as ln a and ends in a hash of (term, t).

    r and c are Gamma(2, 1), beta is uniform: t = floor(ln w / r + beta), ln a = ln c - r (t - beta) - r. The least a
    among a text's terms is its sample, which two texts share with the probability of their generalised Jaccard.
    """
    out = np.empty((len(terms), SAMPLES), np.int64)
    for i in range(0, len(terms), 1024):
        part, w = terms[i : i + 1024], np.log(weights[i : i + 1024].astype(np.float32))[:, None]
        u, v = _halves(_noise(part, 0))
        r = -(np.log(u) + np.log(v))
        u, v = _halves(_noise(part, 1))
        c = -(np.log(u) + np.log(v))
        beta = _halves(_noise(part, 2))[0]
        t = np.floor(w / r + beta)
        bits = (np.log(c) - r * (t - beta) - r).astype(np.float32).view(np.int32)
        bits ^= (bits >> 31) & np.int32(0x7FFFFFFF)
        tag = mix(part[:, None] + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        out[i : i + 1024] = (bits.astype(np.int64) << 32) | tag.view(np.int64)
    return out


def signatures(texts: pa.Array, words_per_term: int = 1) -> np.ndarray:
    """16-bit samples of each text, its distinct terms weighted by their counts; all 65535 for a text without words."""
    hashes, _, _, bounds = words(texts)
    values, at = shingles(hashes, bounds, words_per_term)
    out = np.full((len(texts), SAMPLES), 0xFFFF, np.uint16)
    terms, counts, sizes = [], [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        term, count = np.unique(values[a:b], return_counts=True)
        terms.append(term)
        counts.append(count)
        sizes.append(len(term))
    sizes = np.array(sizes, np.int64)
    if not sizes.sum():
        return out
    terms, counts = np.concatenate(terms), np.concatenate(counts)
    pairs = mix(terms + mix(counts.astype(np.uint64)))
    _, first, inverse = np.unique(pairs, return_index=True, return_inverse=True)
    keys = _keys(terms[first], counts[first])
    some = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes[some])])
    begin = 0
    while begin < len(some):
        end = max(int(np.searchsorted(starts, starts[begin] + 8192, "right")) - 1, begin + 1)
        if end == begin + 1:  # a long text: in pieces
            least = np.full(SAMPLES, np.iinfo(np.int64).max)
            for i in range(int(starts[begin]), int(starts[end]), 8192):
                least = np.minimum(least, keys[inverse[i : min(i + 8192, int(starts[end]))]].min(axis=0))
            out[some[begin]] = (least & 0xFFFF).astype(np.uint16)
        else:
            block = keys[inverse[starts[begin] : starts[end]]]
            least = np.minimum.reduceat(block, starts[begin:end] - starts[begin], axis=0)
            out[some[begin:end]] = (least & 0xFFFF).astype(np.uint16)
        begin = end
    return out


def _binary(signature: np.ndarray) -> pa.Array:
    raw, width = signature.astype(">u2").tobytes(), 2 * SAMPLES
    return pa.array([raw[i * width : (i + 1) * width] for i in range(len(signature))], pa.binary())


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch):
            yield pa.RecordBatch.from_arrays([chunk.column(0), _binary(signatures(chunk.column(1)))], names=["id", "f"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): 128 samples of four hex digits each. Equal word counts give equal fingerprints.

    Null, empty and wordless texts all have the fingerprint of f's. Repeated rows each come back. No shuffle.
    """
    made = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = made.schema["doc_id"].dataType.simpleString()
    return made.mapInArrow(_fingerprint, f"id {kind}, f binary").select(
        F.col("id").alias("doc_id"), F.lower(F.hex("f")).alias("fingerprint")
    )


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW = (
    "edge int, pid int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, text string, following string"
)
NAMES = [part.split()[0] for part in ROW.split(", ")]


def _judged(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
    changed = [edited(a, b) for a, b in zip(texts, following, strict=True)]
    other = signatures(pa.array(changed, pa.large_string()))
    n = len(ids)
    return pa.RecordBatch.from_arrays([
        pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int32()), pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), _binary(own), _binary(other),
        pa.array((own == other).mean(axis=1)), pa.array((own == after).mean(axis=1)),
        pa.nulls(n, pa.string()), pa.nulls(n, pa.string()),
    ], names=NAMES)


def _edge(pid: int, which: int, doc_id, text: str) -> pa.RecordBatch:
    values = [which, pid, doc_id, None, None, None, None, None, None, text, None]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=NAMES)


FIRST, LAST = 1, 2


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order, each judged with the next; the ends come out as they are."""
    pid = TaskContext.get().partitionId()
    held: list = []  # (ids, texts, signatures) of the last row so far
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = 0
        while start < len(ids):
            stop, taken = start, 0
            while stop < len(ids) and (stop == start or taken < CHUNK_BYTES):
                taken += len(texts[stop])
                stop += 1
            part = texts[start:stop]
            own = signatures(pa.array(part, pa.large_string()))
            if held:
                yield _judged([held[0], *ids[start : stop - 1]], [held[1], *part[:-1]], part, np.vstack([held[2], own[:-1]]), own)
            else:
                yield _edge(pid, FIRST, ids[start], texts[start])
                if stop - start > 1:
                    yield _judged(ids[start : stop - 1], part[:-1], part[1:], own[:-1], own[1:])
            held = [ids[stop - 1], part[-1], own[-1:]]
            start = stop
    if held:
        yield _edge(pid, LAST, held[0], held[1])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            ids, texts, after = (batch.column(i).to_pylist() for i in range(3))
            own, other = (signatures(pa.array(t, pa.large_string())) for t in (texts, after))
            yield _judged(ids, texts, after, own, other)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    Documents stand by descending doc_id (ties by a hash of the text, nulls last), the first after the last. (doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): near is the share of equal samples. One
    shuffle puts the documents in order by ranges of ids; a range's last document meets the next range's first in a
    table of one row per range. Null texts count as empty; two texts without words are alike (1), one of them is not (0, up to
    the samples' 16 bits). A lone document is its own next. No rows in: none out.
    """
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    walked = stored(
        plain.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk, ROW),
        "fingerprints",
    )
    ends = walked.where("edge > 0").groupBy("pid").agg(
        F.max(F.when(F.col("edge") == LAST, F.col("doc_id"))).alias("doc_id"),
        F.max(F.when(F.col("edge") == LAST, F.col("text"))).alias("text"),
        F.max(F.when(F.col("edge") == FIRST, F.col("text"))).alias("head"),
    )
    ranges = Window.orderBy("pid")
    around = ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    meet = ends.select("doc_id", "text", F.coalesce(F.lead("head").over(ranges), F.first("head").over(around)).alias("following"))
    rows = walked.where("edge = 0").drop("edge", "pid", "text", "following")
    return rows.union(meet.mapInArrow(_across, ROW).drop("edge", "pid", "text", "following")).withColumns(
        {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    )
