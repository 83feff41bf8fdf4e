"""Hashes of words and shingles for whole Arrow batches at once, with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z read as a-z. A word's hash is a polynomial over its
bytes (each byte mapped to a random 64-bit number), taken from running sums, so no loop goes over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Code points of scripts without blanks between words, first and last: Thai to Tibetan, Myanmar, Khmer, Tai Le and New
#: Tai Lue, Tai Tham and Balinese, CJK signs with kana, Bopomofo and Han (not Hangul), Yi, Javanese, Myanmar and Tai Viet,
#: Han, full-width forms, kana and Han beyond the first plane.
_UNSPACED = np.array([
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19FF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F),
    (0x2E80, 0x312F), (0x3190, 0x9FFF), (0xA000, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF),
    (0xFE30, 0xFE4F), (0xFF00, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
])
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers 0..n-1 of the base or of its inverse, modulo 2**64."""
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def chunks(batch: pa.RecordBatch, column: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` bytes of text each (a longer text is a slice of its own)."""
    _, ends = text_buffers(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + size, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True that does not cross a text's end."""
    n = len(inside)
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | breaks[1:n]
    last[:-1] &= ~inside[1:] | breaks[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _unspaced(data: np.ndarray) -> np.ndarray:
    """Where in UTF-8 bytes each code point of a script without blanks begins, and where it ends."""
    at = np.flatnonzero(data >= 0xE0)  # the lead bytes of three and four bytes; all such scripts are among them
    if not len(at):
        return at
    four = data[at] >= 0xF0
    size = np.where(four, 4, 3)
    point = np.where(four, data[at] & 0x07, data[at] & 0x0F).astype(np.int64)
    for i in (1, 2, 3):
        more = size > i
        point[more] = point[more] << 6 | (data[at[more] + i] & 0x3F)
    row = np.searchsorted(_UNSPACED[:, 0], point, "right") - 1
    inside = (row >= 0) & (point <= _UNSPACED[row, 1])
    return np.concatenate([at[inside], at[inside] + size[inside]])


def words(texts: pa.Array, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start byte, end byte) of each word, and for each text where its words begin (n + 1 numbers).

    plain: ASCII signs and controls also part words, so that punctuation does not count, and each code point of a script
    without blanks between words (Chinese, Japanese, Thai, ...) is a word of its own.
    """
    data, ends = text_buffers(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(ends), np.int64)
    if plain:
        starts, stops = runs(_LETTER[data], np.concatenate([ends, _unspaced(data)]))
    else:
        starts, stops = runs(~_SPACE[data], ends)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("up", n), out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * _power("down", n)[starts])
    return hashes, starts, stops, np.searchsorted(starts, ends)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles, with repeats, and where each text's begin.

    A text of fewer words has its whole sequence as its only shingle; a text without words has none.
    """
    counts = np.diff(bounds)
    rolled = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for i in range(k):
        rolled = rolled * np.uint64(_BASE) + hashes[i : len(hashes) - k + 1 + i]
    rolled = mix(rolled + np.uint64(k))
    short = (counts < k) & (counts > 0)
    sizes = np.where(short, 1, np.maximum(counts - k + 1, 0))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(out_bounds[-1], np.uint64)
    owner = np.repeat(np.arange(len(counts)), sizes)
    take = bounds[:-1][owner] + (np.arange(len(out)) - out_bounds[:-1][owner])
    whole = ~short[owner]
    out[whole] = rolled[take[whole]]
    for i in np.flatnonzero(short):
        value = 0
        for h in hashes[bounds[i] : bounds[i + 1]].tolist():
            value = (value * _BASE + h) & 0xFFFFFFFFFFFFFFFF
        out[out_bounds[i]] = mix(np.array([value + int(counts[i]) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
    return out, out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct values, sorted."""
    return [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
