"""SentencePiece encoding and decoding: a forward pass over a trie of distinct marked words, shared by common prefixes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, islice, pairwise
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.shared import received, sent
from stratalens.llm.wordhash import chunks

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")
LITERAL = "\n" + MARK  # stands for the mark's own character in a text
SLICE_BYTES = 2 << 20  # of text whose distinct words make one trie
KEPT_WORDS = 80_000  # words whose ids a worker remembers
KEPT_PAIRS = 300_000  # likewise pairs of pieces
KEPT_STEPS = 300_000  # likewise steps of the automaton


@dataclass
class Pieces:
    """A model's pieces. scores: piece to score, of ordinary pieces; ids: piece to id; raw: bytes of each id.

    merges: the scores rank merges (a BPE model), so that a text's pieces are those of its merges; else they are
    log-probabilities and the pieces have the greatest sum.

    An automaton finds the pieces that end at a position. Its states are the beginnings of pieces: the state of a prefix
    is the longest of them that the prefix ends with. Pieces are numbered in the order of scores; the number after the
    last one stands for no piece.
    """

    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    raw: list[bytes]
    merges: bool
    floor: float = 0.0
    names: list[str] = field(default_factory=list)  # by number, an empty one for no piece
    steps: list[dict[str, int]] = field(default_factory=list)  # of a state: character to state
    fails: list[int] = field(default_factory=list)  # of a state: the longest other state that it ends with
    ends: list[tuple] = field(default_factory=list)  # of a state: length and number of the pieces it ends with, longest first
    added: int = 0  # steps along fails that were remembered
    edges: dict[int, tuple[list, list]] = field(default_factory=dict)  # of the pieces met in this worker
    pairs: dict[int, bool] = field(default_factory=dict)  # met before in this worker
    words: dict[str, list[int]] = field(default_factory=dict)  # encoded before in this worker

    def __post_init__(self) -> None:
        self.floor = min(self.scores.values(), default=0.0) - 10.0
        self.names = [*self.scores, ""]

    def prepare(self) -> None:
        """Build the automaton, where it is used."""
        if self.steps:
            return
        steps, own = [{}], [len(self.scores)]
        for number, piece in enumerate(self.scores):
            state = 0
            for c in piece:
                if c not in steps[state]:
                    steps[state][c] = len(steps)
                    steps.append({})
                    own.append(len(self.scores))
                state = steps[state][c]
            own[state] = number
        self.fails, self.ends = [0] * len(steps), [()] * len(steps)
        queue = list(steps[0].values())
        for state in queue:
            shorter = self.ends[self.fails[state]]
            piece = self.names[own[state]]
            self.ends[state] = ((len(piece), own[state]), *shorter) if piece else shorter
            for c, longer in steps[state].items():
                other = self.fails[state]
                while other and c not in steps[other]:
                    other = self.fails[other]
                self.fails[longer] = steps[other].get(c, 0)
                queue.append(longer)
        self.steps = steps

    def step(self, state: int, c: str) -> int:
        """The state after one more character."""
        at = state
        while at and c not in self.steps[at]:
            at = self.fails[at]
        found = self.steps[at].get(c, 0)
        if self.added < KEPT_STEPS:
            self.steps[state][c] = found
            self.added += 1
        return found


def load_pieces(model_file: str) -> Pieces:
    """The pieces of a SentencePiece model with byte fallback (read where the driver runs)."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_file, "rb") as file:
        proto.ParseFromString(file.read())
    scores, ids, byte_ids, raw = {}, {}, [0] * 256, []
    for i, piece in enumerate(proto.pieces):
        if piece.type == 6:
            byte_ids[int(piece.piece[3:5], 16)] = i
            raw.append(bytes([int(piece.piece[3:5], 16)]))
        elif piece.type == 1:
            scores[piece.piece], ids[piece.piece] = piece.score, i
            raw.append(piece.piece.replace(MARK, " ").encode())
        else:
            raw.append(b"")
    return Pieces(scores, ids, byte_ids, raw, proto.trainer_spec.model_type == 2)


def merged(symbols: Iterable[str], scores: dict[str, float]) -> list[str]:
    """The symbols after all merges: always the pair with the best score, the first of several."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None and (best is None or score > best):
                best, at = score, i
        if best is None:
            break
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    return symbols


def _edges(number: int, pieces: Pieces) -> tuple[list[tuple[str, float]], list[tuple[str, float]]]:
    """The symbols that stand first, and those that stand last, while the piece's characters are merged, each with the
    score of the merge that ends it (minus infinity for what is left in the end)."""
    known = pieces.edges.get(number)
    if known is None:
        symbols, scores = list(pieces.names[number]), pieces.scores
        firsts: list[tuple[str, float]] = []
        lasts: list[tuple[str, float]] = []
        while len(symbols) > 1:
            options = [(scores[u + v], -i) for i, (u, v) in enumerate(pairwise(symbols)) if u + v in scores]
            if not options:
                break
            score, at = max(options)
            if at == 0:
                firsts.append((symbols[0], score))
            if -at == len(symbols) - 2:
                lasts.append((symbols[-1], score))
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
        firsts.append((symbols[0], -inf))
        lasts.append((symbols[-1], -inf))
        known = pieces.edges[number] = (firsts, lasts) if len(symbols) == 1 else ([], [])
    return known


def _follows(pair: int, pieces: Pieces) -> bool:
    """Whether merging the characters of both pieces of a pair gives just these two (or, with no left one, just the right one).

    Merges come in the order of their scores, so only the symbols on both sides of the border matter: the two stay
    apart unless the merge across it beats, at some point, the merges that end either neighbour.
    """
    if len(pieces.pairs) > KEPT_PAIRS:
        pieces.pairs.clear()
    left, right = divmod(pair, len(pieces.names))
    starts = _edges(right, pieces)[0]
    fits = bool(starts)
    if pieces.names[left] and fits:
        ends, scores, i, j = _edges(left, pieces)[1], pieces.scores, 0, 0
        fits = bool(ends)
        while fits:
            (u, end), (v, other) = ends[i], starts[j]
            across = scores.get(u + v)
            if across is not None and across > end and across >= other:
                fits = False
            elif end == other == -inf:
                break
            elif end >= other:
                i += 1
            else:
                j += 1
    pieces.pairs[pair] = fits
    return fits


def encode_words(words: Iterable[str], pieces: Pieces) -> dict[str, list[int]]:
    """Ids of distinct words. The sorted words are a trie, walked depth-first: a word's forward states begin after its common
    prefix with the word before.

    The forward state of a prefix is the last piece of its best segmentation, that segmentation's score (in a unigram model)
    and the state of the automaton that tells which pieces end here: two numbers, or three, a code point of the longest word.
    In a BPE model exactly one last piece is admissible, the one that stays apart from the piece before it when their
    characters are merged (a text's merges restrict to those of each two neighbouring pieces), so the path is
    the merges' own result. A character outside the vocabulary is its UTF-8 bytes.
    """
    pieces.prepare()
    out: dict[str, list[int]] = {}
    names, steps, ends, pairs, merges = pieces.names, pieces.steps, pieces.ends, pieces.pairs, pieces.merges
    size, none = len(names), len(names) - 1
    lengths, scores = [*map(len, names[:-1]), 1], [*pieces.scores.values(), pieces.floor]
    numbers = [pieces.ids.get(name) for name in names]
    lasts, sums, states, before = [none], [0.0], [0], ""
    for word in sorted(words):
        if word == LITERAL:
            out[word] = [pieces.byte_ids[b] for b in MARK.encode()]
            continue
        common = 0
        for a, b in zip(before, word, strict=False):
            if a != b:
                break
            common += 1
        del lasts[common + 1 :], sums[common + 1 :], states[common + 1 :]
        state, i = states[common], common
        for c in word[common:]:
            i += 1
            after = steps[state].get(c)
            state = pieces.step(state, c) if after is None else after
            last = none  # a character outside the vocabulary
            if merges:
                for length, piece in ends[state]:
                    pair = lasts[i - length] * size + piece
                    fits = pairs.get(pair)
                    if fits or fits is None and _follows(pair, pieces):
                        last = piece
                        break
            else:
                best = -inf
                for length, piece in ends[state]:
                    if (score := sums[i - length] + scores[piece]) > best:
                        best, last = score, piece
                sums.append(sums[i - 1] + pieces.floor if last == none else best)
            lasts.append(last)
            states.append(state)
        ids: list[int] = []
        while i:
            last = lasts[i]
            if numbers[last] is None:
                ids.extend(pieces.byte_ids[b] for b in reversed(word[i - 1].encode()))
            else:
                ids.append(numbers[last])
            i -= lengths[last]
        ids.reverse()
        out[word] = ids
        before = word
    return out


def marked_words(text: str) -> list[str]:
    """The text's words with a mark for each space and one before the first; line ends are words of their own."""
    text = text or ""
    if MARK in text:
        first, *rest = text.split(MARK)
        return [*WORD.findall(MARK + first.replace(" ", MARK)), *(w for part in rest for w in (LITERAL, *WORD.findall(part.replace(" ", MARK))))]
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def decode(ids: Iterable[int], pieces: Pieces) -> str:
    """The text of the ids: pieces and bytes in order, without the first mark."""
    text = b"".join([pieces.raw[i] for i in ids]).decode(errors="replace")
    return text[1:] if text.startswith(" ") else text


def _numbered(text: str | None, place: dict[str, int]) -> np.ndarray:
    """The text's words by their numbers in `place`, which takes in new ones."""
    return np.array([place.setdefault(word, len(place)) for word in marked_words(text)], np.int32)


def _ids_of(place: dict[str, int], counts: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words of `place` in a row, and where each word's begin and how many they are.

    Of the new words the worker remembers those that occur more than once, up to KEPT_WORDS.
    """
    known = pieces.words
    new = encode_words([w for w in place if w not in known], pieces)
    parts = [known[w] if w in known else new[w] for w in place]
    sizes = np.fromiter(map(len, parts), np.int32, len(parts))
    flat = np.fromiter(chain.from_iterable(parts), np.int32, int(sizes.sum()))
    again = (w for w, count in zip(place, counts, strict=True) if count > 1 and w in new)
    known.update((w, new[w]) for w in islice(again, max(0, KEPT_WORDS - len(known))))
    return flat, np.cumsum(sizes, dtype=np.int32) - sizes, sizes


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one span after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _encoder(shared, round_trip: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = received(shared)
        for batch in batches:
            for chunk in chunks(batch, size=SLICE_BYTES):
                # Only distinct words are held, and the ids of one text at a time are numbers of Python.
                place: dict[str, int] = {}
                orders = [_numbered(text.as_py(), place) for text in chunk.column(1)]
                flat, starts, sizes = _ids_of(place, np.bincount(np.concatenate(orders), minlength=len(place)), pieces)
                del place
                parts = [flat[_spans(starts[order], sizes[order])] for order in orders]
                bounds = np.concatenate([[0], np.cumsum([len(part) for part in parts])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts)))
                columns, names = [*chunk.columns, ids], [*chunk.schema.names, "token_ids"]
                if round_trip:
                    texts = zip(parts, chunk.column(1), strict=True)
                    back = [decode(part.tolist(), pieces) == (text.as_py() or "") for part, text in texts]
                    columns.append(pa.array(back, pa.bool_()))
                    names.append("round_trip")
                del orders, parts
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return encode


def _decoder(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: Pieces = received(shared)
        for batch in batches:
            at = batch.schema.get_field_index("token_ids")
            decoded = [decode(ids, pieces) if ids else "" for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def encode(
    docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (),
    round_trip: bool = False,
) -> DataFrame:
    """(doc_id, text, columns to keep, token_ids) of whole texts; null, empty: no ids. No shuffle; the model's pieces are broadcast.

    With round_trip a further column says whether the ids, decoded in the same pass, give the text (null: empty).

    Each chunk of texts (2 MB) sorts its distinct words that the worker doesn't remember.
    U+2581 in a text is written as bytes, so that decoding gives back every text.
    """
    pieces = sent(docs.sparkSession, load_pieces(model_file))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    schema += ", token_ids array<int>" + ", round_trip boolean" * round_trip
    return rows.mapInArrow(_encoder(pieces, round_trip), schema)


def decoded(encoded: DataFrame, model_file: str) -> DataFrame:
    """The encoded rows with a further column, decoded: the text of token_ids (null or no ids: empty)."""
    pieces = sent(encoded.sparkSession, load_pieces(model_file))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoder(pieces), f"{schema}, decoded string")
