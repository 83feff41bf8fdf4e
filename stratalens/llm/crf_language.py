"""Language identification of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stratalens.llm.shared import received, sent
from stratalens.llm.wordhash import chunks, runs, text_buffers

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
BUCKETS = 1 << 16  # weights of each feature family, by hash
PARTS = 64  # parts in which a language's documents are ranked before they are ranked together
_MUL = [np.uint32(x) for x in (0x01000193, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)]


@dataclass(frozen=True)
class Training:
    """per_language: documents that a language's sample holds at most, the first by a hash of doc_id. most: the same for all
    languages together. sequences: code-switched sequences of `length` words made of spans of 3 to 12 words from these documents. A word is a run of
    letters (``l'eau`` is two), as where texts are labelled; runs without a letter are left out. rounds: gradient steps.
    ridge: weight of the squared norm.
    """

    per_language: int = 150
    most: int = 15_000
    sequences: int = 2500
    length: int = 24
    rounds: int = 40
    ridge: float = 1e-6


@dataclass
class Field:
    """A trained field: weights of n-grams of two to four bytes and of whole words, and transitions, per language."""

    languages: list[str]
    weights: list[np.ndarray]
    transitions: np.ndarray


def _features(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of each text's words: first and last gram place, each place's n-gram buckets, the words' lexicon buckets, bounds.

    Letters are ASCII letters (lower-cased) and all non-ASCII bytes; everything else is a word's edge. N-grams may hold
    the edge before the word (prefixes) and after it (suffixes) but nothing beyond; bucket 0 stands for none.
    """
    n = len(data)
    folded = np.full(n + len(ends) + 4, 0x20, np.uint8)
    places = np.arange(n) + np.repeat(np.arange(1, len(ends)), np.diff(ends))  # one edge before each text
    folded[places] = _FOLD[data]
    starts, stops = runs(folded != 0x20, np.array([0, len(folded)]))
    bounds = np.searchsorted(starts, ends + np.arange(len(ends)))
    x = folded.astype(np.uint32)
    edge = folded == 0x20
    size = len(folded) - 4
    grams, key = [], x[:size].copy()
    valid = np.ones(size, dtype=bool)
    for k in (1, 2, 3):
        key = (key * _MUL[0]) ^ (x[k : size + k] * _MUL[k])
        if k > 1:
            valid = valid & ~edge[k - 1 : size + k - 1]
        else:
            valid = ~(edge[:size] & edge[1 : size + 1])
        hashed = (key ^ (key >> np.uint32(15))) * _MUL[1]
        grams.append(np.where(valid, 1 + (hashed >> np.uint32(8)) % np.uint32(BUCKETS - 1), 0).astype(np.int32))
    powers = np.cumprod(np.full(max(len(x), 1), _MUL[0] | np.uint32(1), np.uint32), dtype=np.uint32)
    inverse = np.cumprod(np.full(max(len(x), 1), pow(int(_MUL[0]) | 1, -1, 1 << 32), np.uint32), dtype=np.uint32)
    sums = np.concatenate([np.zeros(1, np.uint32), np.cumsum((x * _MUL[3] + np.uint32(1)) * powers, dtype=np.uint32)])
    word = (sums[stops] - sums[starts]) * inverse[starts] if len(starts) else np.zeros(0, np.uint32)
    word ^= word >> np.uint32(15)
    word = word * _MUL[1]
    lexicon = (1 + (word >> np.uint32(8)) % np.uint32(BUCKETS - 1)).astype(np.int32)
    return starts - 1, stops, lexicon, grams, bounds


def _emissions(model_weights: list[np.ndarray], first, stop, lexicon, grams) -> np.ndarray:
    each = model_weights[0][grams[0]] + model_weights[1][grams[1]] + model_weights[2][grams[2]]
    cuts = np.column_stack([first, stop]).ravel()
    cuts = np.minimum(cuts, len(each) - 1)
    return np.add.reduceat(each, cuts, axis=0)[::2] + model_weights[3][lexicon]


def marginals(emissions: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over one long row of words: each word's label probabilities. first: words that begin a text.

    The row is cut into about sqrt(n) blocks; the products of their step matrices carry messages across blocks, so all
    blocks move in step and no Python loop is longer than the root. At a text's first word the message is reset, so
    texts don't touch. Exact, whatever the lengths.
    """
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k))
    m = int(np.ceil(np.sqrt(n)))
    blocks = -(-n // m)
    e = np.ones((blocks * m, k))
    e[:n] = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    new = np.zeros(blocks * m, dtype=bool)
    new[:n] = first
    new[n:] = True  # what pads the last block sends no message back
    e, new = e.reshape(blocks, m, k), new.reshape(blocks, m)
    step = np.exp(transitions - transitions.max())
    flat = np.full((k, k), 1.0 / k)
    whole = np.tile(np.eye(k), (blocks, 1, 1))
    for t in range(m):
        moved = whole @ step
        at = new[:, t]
        if at.any():
            moved[at] = whole[at] @ flat
        whole = moved * e[:, t, None, :]
        whole /= whole.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((blocks, k)), np.empty((blocks, k))
    message = np.ones(k) / k
    for b in range(blocks):
        ahead[b] = message
        message = message @ whole[b]
        message /= message.sum()
    message = np.ones(k) / k
    for b in range(blocks - 1, -1, -1):
        behind[b] = message
        message = whole[b] @ message
        message /= message.sum()
    alpha = np.empty((blocks, m, k))
    for t in range(m):
        moved = ahead @ step
        moved[new[:, t]] = ahead[new[:, t]].sum(axis=1, keepdims=True) / k
        ahead = moved * e[:, t]
        ahead /= ahead.sum(axis=1, keepdims=True)
        alpha[:, t] = ahead
    for t in range(m - 1, -1, -1):
        alpha[:, t] *= behind
        seen = e[:, t] * behind
        moved = seen @ step.T
        moved[new[:, t]] = seen[new[:, t]].sum(axis=1, keepdims=True) / k
        behind = moved / moved.sum(axis=1, keepdims=True)
    out = alpha.reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


_RUN = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def letter_runs(text: str) -> list[str]:
    """The words of ``_features`` that have a letter."""
    return [w for w in _RUN.findall(text) if any(c.isalpha() for c in w)]


def sequences(by: list[list[list[str]]], training: Training) -> tuple[list[str], np.ndarray]:
    """Lines of `length` words each, and each word's language: spans of the texts (lists of words) of each language."""
    rng = np.random.Generator(np.random.PCG64(3))
    lines, labels = [], []
    for _ in range(training.sequences):
        line: list[str] = []
        gold: list[int] = []
        one = rng.random() < 0.5  # half the sequences keep to one language
        y = int(rng.integers(len(by)))
        while len(line) < training.length:
            if not one:
                y = int(rng.integers(len(by)))
            words = by[y][int(rng.integers(len(by[y])))]
            at, size = int(rng.integers(len(words))), int(rng.integers(3, 13))
            line += words[at : at + size]
            gold += [y] * len(words[at : at + size])
        lines.append(" ".join(line[: training.length]))
        labels.append(gold[: training.length])
    return lines, np.array(labels)


def train(samples: list[tuple[str, str]], training: Training = Training()) -> Field | None:
    """A field from (language, text) pairs, fitted to code-switched sequences made of their spans; None without samples."""
    languages = sorted({lang for lang, _ in samples})
    by = {lang: [w for text in (t for g, t in samples if g == lang) if (w := letter_runs(text))] for lang in languages}
    languages = [lang for lang in languages if by[lang]]
    if not languages:
        return None
    k, width, lines_n = len(languages), training.length, training.sequences
    lines, gold = sequences([by[lang] for lang in languages], training)
    data, ends = text_buffers(pa.array(lines, pa.large_string()))
    first, stop, lexicon, grams, _ = _features(data, ends)  # width words in each line
    weights = [np.zeros((BUCKETS, k), np.float32) for _ in range(4)]
    transitions = np.zeros((k, k))
    squares = [np.full_like(w, 1e-8) for w in weights]
    trans_squares = np.full_like(transitions, 1e-8)
    owner = np.repeat(np.arange(len(first)), stop - first)
    gram_at = np.concatenate([np.arange(a, b) for a, b in zip(first.tolist(), stop.tolist(), strict=True)])
    used = [g[gram_at] for g in grams]
    truth = np.eye(k)[gold]
    empirical = np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:])
    begins = np.zeros(len(first), dtype=bool)
    begins[::width] = True
    for _ in range(training.rounds):
        e = _emissions(weights, first, stop, lexicon, grams)
        p = marginals(e.astype(np.float64), transitions, begins).reshape(lines_n, width, k)
        expected = _pair_counts(e.reshape(lines_n, width, k), transitions)
        error = ((truth - p) / lines_n).reshape(-1, k)
        for f, bucket in enumerate([*used, lexicon]):
            rows = error[owner] if f < 3 else error
            gradient = np.stack([np.bincount(bucket, rows[:, y], BUCKETS) for y in range(k)], axis=1)
            gradient -= training.ridge * weights[f]
            gradient[0] = 0
            squares[f] += gradient.astype(np.float32) ** 2
            weights[f] += (0.3 * gradient / np.sqrt(squares[f])).astype(np.float32) * (squares[f] > 1e-8)
        gradient = (empirical - expected) / lines_n - training.ridge * transitions
        trans_squares += gradient**2
        transitions += 0.3 * gradient / np.sqrt(trans_squares)
    return Field(languages, weights, transitions)


def _pair_counts(emissions: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Expected transitions over equally long sequences."""
    s, length, k = emissions.shape
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    step = np.exp(transitions - transitions.max())
    alpha = np.empty((s, length, k))
    message = np.ones((s, k)) / k
    for t in range(length):
        message = (message @ step if t else message) * e[:, t]
        message /= message.sum(axis=1, keepdims=True)
        alpha[:, t] = message
    behind, out = np.ones((s, k)), np.zeros((k, k))
    for t in range(length - 1, 0, -1):
        seen = e[:, t] * behind
        pair = alpha[:, t - 1, :, None] * step[None] * seen[:, None, :]
        out += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        behind = seen @ step.T
        behind /= behind.sum(axis=1, keepdims=True)
    return out


_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _labeller(shared, spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = received(shared)
        for batch in batches:
            for chunk in chunks(batch):
                texts = chunk.column(1)
                data, ends = text_buffers(texts)
                n = len(ends) - 1
                first, stop, lexicon, grams, bounds = _features(data, ends)
                names, scores = ["und"] * n, np.zeros(n)
                runs_of: list[list[dict]] = [[] for _ in range(n)]
                if len(first):
                    begins = np.zeros(len(first), dtype=bool)
                    begins[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
                    p = marginals(_emissions(field.weights, first, stop, lexicon, grams).astype(np.float64), field.transitions, begins)
                    some = np.flatnonzero(np.diff(bounds))
                    mean = np.add.reduceat(p, bounds[:-1][some], axis=0) / np.diff(bounds)[some, None]
                    sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
                    letters = sums[ends[1:]] - sums[ends[:-1]]
                    best = p.argmax(axis=1)
                    for row, i in enumerate(some.tolist()):
                        if letters[i] or any(c.isalpha() for c in texts[i].as_py()):
                            y = int(mean[row].argmax())
                            names[i], scores[i] = field.languages[y], min(float(mean[row, y]), 1.0)
                            if spans:
                                a, b = int(bounds[i]), int(bounds[i + 1])
                                cuts = [a, *(np.flatnonzero(np.diff(best[a:b])) + a + 1).tolist(), b]
                                runs_of[i] = [
                                    {"first_word": u - a, "end_word": v - a, "lang": field.languages[int(best[u])]}
                                    for u, v in zip(cuts[:-1], cuts[1:], strict=True)
                                ]
                columns = [chunk.column(0), pa.array(names), pa.array(scores)]
                if spans:
                    kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))
                    columns.append(pa.array(runs_of, kind))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "spans"][: len(columns)])

    return label


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is outside the training fold: crc32 of its id's digits is divisible by five. A null id is."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, training: Training = Training()) -> Field | None:
    """A field from the labelled documents of the training fold, whole texts: at most ``per_language`` of each language and
    ``most`` in all, the same number of each then.

    An id with several rows gives one of them, with its own language: the one with the least hash of its text.
    """
    sign = F.xxhash64("text")
    fold = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    ids = fold.groupBy("doc_id").agg(F.min(F.struct(sign.alias("sign"), "lang")).alias("row")).select("doc_id", "row.*")
    spread = F.xxhash64("doc_id")
    chosen = ids.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))
    for keys in (["lang", "part"], ["lang"]):  # the least of each part hold the least of all
        order = Window.partitionBy(*keys).orderBy(spread, "doc_id")
        chosen = chosen.withColumn("n", F.row_number().over(order)).where(F.col("n") <= training.per_language)
    chosen = chosen.orderBy("n", spread, "doc_id").limit(training.most).select("doc_id", "lang", "sign")
    rows = fold.select("doc_id", "lang", "text", sign.alias("sign")).join(F.broadcast(chosen), ["doc_id", "lang", "sign"])
    samples = rows.groupBy("doc_id", "lang", "sign").agg(F.min("text").alias("text")).collect()
    return train([(r.lang, r.text) for r in sorted(samples, key=lambda r: (r.lang, r.doc_id, r.text))], training)


def identify(docs: DataFrame, field: Field | None, spans: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) of every document from its text alone; with spans, also runs of equally labelled words.

    Every word's label probabilities come from forward-backward over the whole text; the document's language has the greatest mean and
    score is that mean. ``und`` with score 0 for a null text, one without a letter, or without a trained field.
    """
    rows = docs.select("doc_id", "text")
    if field is None:
        out = rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
        kind = "array<struct<first_word: int, end_word: int, lang: string>>"
        return out.withColumn("spans", F.array().cast(kind)) if spans else out
    shared = sent(docs.sparkSession, field)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double"
    schema += ", spans array<struct<first_word: int, end_word: int, lang: string>>" if spans else ""
    return rows.mapInArrow(_labeller(shared, spans), schema)
