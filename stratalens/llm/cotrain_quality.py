"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then score together."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.shared import received, sent
from stratalens.llm.wordhash import chunks, text_buffers, words

_KIND = np.full(256, 7, np.int64)  # other signs
_KIND[0x80:] = 0
_KIND[[*range(0x61, 0x7B)]] = 1
_KIND[[*range(0x41, 0x5B)]] = 2
_KIND[[*range(0x30, 0x3A)]] = 3
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 4
_KIND[0x0A] = 5
_KIND[[ord(c) for c in ".,;:'\"-()?!"]] = 6
TEXT_SIZE = 128 + 64 + 8
META_SIZE = 16 + 64 + 24


@dataclass(frozen=True)
class CoTraining:
    """labelled, unlabelled: rows of each that training holds at most, the first by a hash of doc_id. rounds: exchanges
    of pseudo-labels. confident: probability from which a view's guess may become the other's label. grow: most guesses of
    each class that a view hands over in a round, as a share of the unlabelled rows. ridge: of both logistic regressions.
    threshold: combined score below which a document is rejected.
    """

    labelled: int = 4000
    unlabelled: int = 4000
    rounds: int = 4
    confident: float = 0.97
    grow: float = 0.05
    ridge: float = 3.0
    threshold: float = 0.5


def text_view(texts: pa.Array) -> np.ndarray:
    """Byte shares, shares of neighbouring byte kinds, and word and line statistics of whole texts (null: empty)."""
    data, ends = text_buffers(texts)
    n = len(ends) - 1
    out = np.zeros((n, TEXT_SIZE), np.float32)
    sizes = np.maximum(np.diff(ends), 1)
    owner = np.repeat(np.arange(n), np.diff(ends))
    folded = np.where(data < 128, data, 0).astype(np.int64)
    out[:, :128] = np.bincount(owner * 128 + folded, minlength=n * 128).reshape(n, 128) / sizes[:, None]
    kinds = _KIND[data]
    if len(kinds) > 1:
        same = owner[:-1] == owner[1:]
        pairs = (owner[:-1] * 64 + kinds[:-1] * 8 + kinds[1:])[same]
        out[:, 128:192] = np.bincount(pairs, minlength=n * 64).reshape(n, 64) / sizes[:, None]
    hashes, starts, stops, bounds = words(texts)
    lengths = (stops - starts).astype(np.float64)
    lines = np.bincount(owner[data == 0x0A], minlength=n) + 1
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if b > a:
            _, counts = np.unique(hashes[a:b], return_counts=True)
            own = lengths[a:b]
            out[i, 192:] = [
                np.log1p(b - a) / 10, len(counts) / (b - a), counts.max() / (b - a), (counts == 1).sum() / (b - a),
                own.mean() / 20, own.std() / 20, lines[i] / (b - a), np.sqrt(len(counts) / (b - a) * np.log1p(b - a) / 10),
            ]
    return np.sqrt(out)


def meta_view(langs: list, sources: list, sizes: list) -> np.ndarray:
    """One-hot buckets of language and source, and the recorded length in binary steps (nulls in buckets of their own)."""
    out = np.zeros((len(langs), META_SIZE), np.float32)
    for i, (lang, source, size) in enumerate(zip(langs, sources, sizes, strict=True)):
        out[i, 0 if lang is None else 1 + zlib.crc32(str(lang).encode()) % 15] = 1
        out[i, 16 + (0 if source is None else 1 + zlib.crc32(str(source).encode()) % 63)] = 1
        out[i, 80 + (0 if size is None else min(1 + max(int(size), 0).bit_length(), 23))] = 1
    return out


@dataclass
class Linear:
    """Standardised logistic regression."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]) @ self.weights


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float) -> Linear:
    """Newton's method on the penalised likelihood; the constant is not penalised."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(15):
        p = sigmoid(z @ w)
        gradient = z.T @ (weight * (y - p)) - penalty * w
        hessian = (z * (weight * p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w += step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-4:
            break
    return Linear(mean, scale, w)


@dataclass
class Classifier:
    """Both views, the calibration of each (slope, constant), and the combination of the calibrated logits."""

    text: Linear
    meta: Linear
    calibration: list[tuple[float, float]]
    combination: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality by text, by metadata, and by both."""
        logits = [a * v.logits(x) + b for v, x, (a, b) in zip((self.text, self.meta), (text, meta), self.calibration, strict=True)]
        both = np.column_stack([*logits, np.ones(len(text))]) @ self.combination
        return sigmoid(logits[0]), sigmoid(logits[1]), sigmoid(both)


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rules: CoTraining = CoTraining()) -> Classifier | None:
    """A classifier from labelled rows (views and y) and a pool of unlabelled ones (views).

    Every fifth labelled row is kept for calibration and combination. In a round each view is fitted to its labels and hands
    the other its most confident guesses about the pool, each class in proportion to its share of the labels.
    None with fewer than ten labelled rows or a single class.
    """
    if len(y) < 10 or y.min() == y.max():
        return None
    fold = np.arange(len(y)) % 5 == 4
    if y[~fold].min() == y[~fold].max() or y[fold].min() == y[fold].max():
        fold = np.zeros(len(y), dtype=bool)
    share = float(y[~fold].mean())
    guesses = [np.full(len(pool[0]), -1.0), np.full(len(pool[0]), -1.0)]  # what each view has been told

    def fitted(v: int) -> Linear:
        told = guesses[v] >= 0
        x = np.vstack([views[v][~fold], pool[v][told]])
        labels = np.concatenate([y[~fold], guesses[v][told]])
        weight = np.concatenate([np.ones(int((~fold).sum())), np.full(int(told.sum()), 0.3)])
        return fit_linear(x, labels, weight, rules.ridge)

    for _ in range(rules.rounds):
        if not len(pool[0]):
            break
        models = [fitted(0), fitted(1)]
        for v in (0, 1):
            p = sigmoid(models[v].logits(pool[v]))
            for label, sure, part in ((1.0, p, share), (0.0, 1 - p, 1 - share)):
                most = max(1, int(rules.grow * len(p) * part))
                free = np.flatnonzero((guesses[1 - v] < 0) & (sure >= rules.confident))
                chosen = free[np.argsort(-sure[free], kind="stable")[:most]]
                guesses[1 - v][chosen] = label
    text, meta = fitted(0), fitted(1)
    held = fold if fold.any() else ~fold
    ones = np.ones(int(held.sum()))
    calibration = []
    for model, view in zip((text, meta), views, strict=True):
        logit = model.logits(view[held])[:, None]
        line = fit_linear(logit, y[held], ones, 0.1)
        slope = float(line.weights[0] / line.scale[0])
        calibration.append((slope, float(line.weights[1] - slope * line.mean[0])))
    calibrated = np.column_stack([a * m.logits(v[held]) + b for m, v, (a, b) in zip((text, meta), views, calibration, strict=True)])
    both = fit_linear(calibrated, y[held], ones, 0.1)
    weights = both.weights[:2] / both.scale
    return Classifier(text, meta, calibration, np.append(weights, both.weights[2] - weights @ both.mean))


def _views(chunk: pa.RecordBatch, text: int, meta: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return text_view(chunk.column(text)), meta_view(*[chunk.column(i).to_pylist() for i in meta])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch):
            views = _views(chunk, 1, [2, 3, 4])
            columns = [pa.array([row.tobytes() for row in v.astype(np.float32)], pa.binary()) for v in views]
            yield pa.RecordBatch.from_arrays([chunk.column(0), chunk.column(5), *columns], names=["doc_id", "y", "text_view", "meta_view"])


def fit(docs: DataFrame, labels: DataFrame, rules: CoTraining = CoTraining()) -> Classifier | None:
    """A classifier from bounded samples: labelled documents (label: mean quality of at least one half) and others.

    An id with several rows gives one of them to the sample.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
    known = known.agg((F.avg("quality") >= 0.5).cast("double").alias("y"))
    spread = F.xxhash64(F.lit(41), "doc_id")
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    seen = ids.join(known, "doc_id", "left_semi").distinct().join(known, "doc_id").orderBy(spread, "doc_id").limit(rules.labelled)
    other = ids.join(known, "doc_id", "left_anti").distinct().orderBy(spread, "doc_id").limit(rules.unlabelled)
    sample = seen.select("doc_id", "y").union(other.select("doc_id", F.lit(None).cast("double")))
    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    rows = rows.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "lang", "source", "n_chars", "y")
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(_extract, f"doc_id {kind}, y double, text_view binary, meta_view binary")
    views = ["text_view", "meta_view"]
    one = F.min_by(F.struct("y", *views), F.struct(F.xxhash64(*views), *views)).alias("row")  # of each id, whichever order rows come in
    made = made.groupBy("doc_id").agg(one).select("doc_id", "row.*").collect()
    made.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), str(r.doc_id), bytes(r.text_view), bytes(r.meta_view)))
    take = lambda rows, name, size: np.frombuffer(b"".join(bytes(getattr(r, name)) for r in rows), np.float32).reshape(len(rows), size)
    labelled, pool = [r for r in made if r.y is not None], [r for r in made if r.y is None]
    return co_train(
        [take(labelled, "text_view", TEXT_SIZE), take(labelled, "meta_view", META_SIZE)], np.array([r.y for r in labelled]),
        [take(pool, "text_view", TEXT_SIZE), take(pool, "meta_view", META_SIZE)], rules,
    )


SCORES = ("text_score", "meta_score", "score")


def _scorer(shared, places: tuple[int, list[int]], text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, text_col):
                found = received(shared).scores(*_views(chunk, *places))
                names = [*chunk.schema.names, *(f"_{s}" for s in SCORES)]
                yield pa.RecordBatch.from_arrays([*chunk.columns, *(pa.array(s.astype(np.float64)) for s in found)], names=names)

    return score


def _scored(own: DataFrame, model: Classifier | None, at: dict[str, int]) -> DataFrame:
    if model is None:
        return own.withColumns({f"_{s}": F.lit(1.0) for s in SCORES})
    shared = sent(own.sparkSession, model)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    places = (at["text"], [at["lang"], at["source"], at["n_chars"]])
    return own.mapInArrow(_scorer(shared, places, f"c{at['text']}"), schema + "".join(f", _{s} double" for s in SCORES))


def score_quality(docs: DataFrame, model: Classifier | None, rules: CoTraining = CoTraining()) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) for every document; without a model all scores are 1.

    Null and empty texts have a text view of zeros, nulls among the metadata buckets of their own; repeated rows each come
    back. kept: score at or above the threshold.
    """
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars").toDF(*[f"c{i}" for i in range(5)])
    out = _scored(plain, model, {"text": 1, "lang": 2, "source": 3, "n_chars": 4})
    return out.select(
        F.col("c0").alias("doc_id"), *[F.col(f"_{s}").alias(s) for s in SCORES], (F.col("_score") >= rules.threshold).alias("kept")
    )


def filter_quality(docs: DataFrame, labels: DataFrame, rules: CoTraining = CoTraining()) -> DataFrame:
    """The rows of docs, all columns, that the classifier fitted to labels does not reject."""
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = _scored(own, fit(docs, labels, rules), {c: names.index(c) for c in ("text", "lang", "source", "n_chars")})
    return out.where(F.col("_score") >= rules.threshold).select(*own.columns).toDF(*names)
