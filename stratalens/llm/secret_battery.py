"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from stratalens.llm.shared import discard, stored
from stratalens.llm.wordhash import chunks, runs, text_buffers

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")

#: Alphabets from the narrowest: a string's encoding is the first that holds all its characters.
ENCODINGS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_CODES = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ENCODINGS.items()}

FOUND = "struct<start: bigint, kind: int, end: bigint>"
CANDIDATE = "struct<start: bigint, end: bigint, stratum: int, evidence: int>"


@dataclass(frozen=True)
class Battery:
    """shortest: characters of a candidate. reject: a candidate is out where a test's p-value for uniform randomness
    is below this. strata: lengths at which a new stratum begins; each controls its false discoveries at `rate`.
    """

    shortest: int = 20
    reject: float = 1e-4
    rate: float = 0.01
    strata: tuple[int, ...] = (20, 28, 40, 64, 128)


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_TOKEN = _mask(ENCODINGS["base64"] + "-_")
_HEX = _mask(ENCODINGS["hex"])


def _upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(text: str) -> tuple[str, float, float, float] | None:
    """(encoding, p of uniformity, p of runs, p of serial correlation) of a string under uniform randomness.

    None where no encoding holds all its characters (trailing '=' aside). The chi-squared p-value is by the cube-root
    approximation; runs are counted about the alphabet's middle; the correlation is that of neighbouring code values.
    """
    body = text.rstrip("=")
    name = next((e for e, codes in _CODES.items() if all(c in codes for c in body)), None)
    if name is None or len(body) < 2:
        return None
    codes, size, n = _CODES[name], len(ENCODINGS[name]), len(body)
    values = np.array([codes[c] for c in body])
    chi = float(((np.bincount(values, minlength=size) - n / size) ** 2).sum() * size / n)
    df = size - 1
    uniform = _upper(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = values >= size / 2
    up, down = int(high.sum()), int(n - high.sum())
    if up and down:
        mean = 1 + 2 * up * down / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        of_runs = 2 * _upper(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / spread)
    else:
        of_runs = 2.0 ** (1 - n)
    centred = values - (size - 1) / 2
    serial = 2 * _upper(abs(float((centred[1:] * centred[:-1]).sum())) / ((size * size - 1) / 12 * math.sqrt(n - 1)))
    return name, uniform, min(of_runs, 1.0), min(serial, 1.0)


#: What a run of '+' or '/' with '-' or '_', which no encoding holds, is split into: the longest parts in each alphabet.
_PARTS = [re.compile(f"[A-Za-z0-9{signs}]+") for signs in ("+/", "_-", "")]


def parts(run: str, shortest: int) -> list[tuple[int, int]]:
    """Places of the strings to test in a run of token characters: all of it, or where no encoding holds it its parts of
    base64, base64url and base62 characters; parts may overlap."""
    if not (("+" in run or "/" in run) and ("-" in run or "_" in run)):
        return [(0, len(run))] if len(run) >= shortest else []
    return sorted({m.span() for p in _PARTS for m in p.finditer(run) if m.end() - m.start() >= shortest})


def _classes(data: np.ndarray) -> np.ndarray:
    """Bytes as classes 0..63: one per token character, 63 for the rest."""
    table = np.full(256, 64, np.int64)
    table[np.flatnonzero(_TOKEN)] = np.arange(int(_TOKEN.sum())) % 64
    table[ord("=")] = 64
    return table[data]


_WIDTH = 65


def _pair_counter(shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of neighbouring character classes over all the partition's texts, strings as long as a candidate aside."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_WIDTH * _WIDTH, np.int64)
        for batch in batches:
            for chunk in chunks(batch, batch.schema.names[0]):
                data, ends = text_buffers(chunk.column(0))
                if len(data) < 2:
                    continue
                kinds = _classes(data)
                starts, stops = runs(_TOKEN[data], ends)
                steps = np.zeros(len(data) + 1, np.int64)
                long = stops - starts >= shortest
                np.add.at(steps, starts[long], 1)
                np.add.at(steps, stops[long], -1)
                plain = np.cumsum(steps[:-1]) == 0
                total += np.bincount((kinds[:-1] * _WIDTH + kinds[1:])[plain[1:]], minlength=_WIDTH * _WIDTH)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["pair", "n"])

    return count


def text_model(docs: DataFrame, text_col: str = "text", shortest: int = 20) -> np.ndarray:
    """Log-probabilities of each character class after another in ordinary text: the pairs of all texts but for strings
    that are long enough to be candidates, smoothed by eight pairs of the classes' own shares."""
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(_pair_counter(shortest), "pair long, n long")
    counts = np.zeros((_WIDTH, _WIDTH))
    for pair, n in counted.groupBy("pair").agg(F.sum("n")).collect():  # 65 * 65 rows at most
        counts[pair // _WIDTH, pair % _WIDTH] += n
    share = (counts.sum(axis=0) + 0.5) / (counts.sum() + 0.5 * _WIDTH)
    return np.log((counts + 8 * share) / (counts.sum(axis=1, keepdims=True) + 8))


def _chunk_scanner(model, battery_of: Battery) -> Callable[[pa.Array], tuple[list[list], list[list]]]:
    """For each text: its pattern spans, and all candidates with their evidence, 0 for those that the battery rejects.

    Evidence: four times the log-likelihood ratio of uniform randomness to the corpus's own character pairs, rounded
    down; exp(-ratio) bounds the chance that ordinary text looks so random (Markov's inequality).
    """
    strata = np.array(battery_of.strata)

    def scan_chunk(column: pa.Array) -> tuple[list[list], list[list]]:
        data, ends = text_buffers(column)
        raw = data.tobytes()
        count = len(ends) - 1
        found: list[list] = [[] for _ in range(count)]
        candidates: list[list] = [[] for _ in range(count)]
        begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points that begin before each byte

        def points(doc: int, start: int, stop: int) -> tuple[int, int]:
            a = int(begun[start] - begun[ends[doc]])
            return a, a + stop - start

        starts, stops = runs(_HEX[data], ends) if len(data) else (np.zeros(0, int), np.zeros(0, int))
        long = stops - starts >= 24
        for a, b, doc in zip(starts[long].tolist(), stops[long].tolist(), (np.searchsorted(ends, starts[long], "right") - 1).tolist(), strict=True):
            p, q = points(doc, a, b)
            found[doc].append((p, 2, q))
        signs = np.flatnonzero((data == ord(":")) | (data == ord("=")))
        for doc in np.unique(np.searchsorted(ends, signs, "right") - 1).tolist():
            text = raw[ends[doc] : ends[doc + 1]].decode()
            found[doc] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        at = raw.find(b"AKIA")
        while at >= 0:
            doc = int(np.searchsorted(ends, at, "right")) - 1
            text = raw[ends[doc] : ends[doc + 1]].decode()
            found[doc] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
            at = raw.find(b"AKIA", int(ends[doc + 1]))
        starts, stops = runs(_TOKEN[data], ends) if len(data) else (starts, stops)
        long = stops - starts >= battery_of.shortest
        for a, b, doc in zip(starts[long].tolist(), stops[long].tolist(), (np.searchsorted(ends, starts[long], "right") - 1).tolist(), strict=True):
            for u, v in ((a + u, a + v) for u, v in parts(raw[a:b].decode(), battery_of.shortest)):
                tested = battery(raw[u:v].decode())
                if tested is None:
                    continue
                ratio = 0.0
                if min(tested[1:]) >= battery_of.reject:
                    kinds = _classes(data[max(u - 1, int(ends[doc])) : v])
                    ratio = (len(kinds) - 1) * -math.log(len(ENCODINGS[tested[0]])) - float(model.value[kinds[:-1], kinds[1:]].sum())
                p, q = points(doc, u, v)
                stratum = int(np.searchsorted(strata, v - u, "right")) - 1
                candidates[doc].append((p, q, stratum, int(max(0.0, min(ratio, 500.0)) * 4)))
        return found, candidates

    return scan_chunk


def _scanner(model, battery_of: Battery, text_col: str) -> Callable:
    scan_chunk = _chunk_scanner(model, battery_of)
    found_type = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    candidate_type = pa.list_(
        pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("evidence", pa.int32())])
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for chunk in chunks(batch, text_col):
                found, candidates = scan_chunk(chunk.column(place))
                found = [[{"start": a, "kind": k, "end": b} for a, k, b in sorted(f)] for f in found]
                candidates = [[dict(zip(("start", "end", "stratum", "evidence"), c, strict=True)) for c in cs] for cs in candidates]
                yield pa.RecordBatch.from_arrays(
                    [*chunk.columns, pa.array(found, found_type), pa.array(candidates, candidate_type)],
                    names=[*chunk.schema.names, "_found", "_candidates"],
                )

    return scan


def scan(docs: DataFrame, battery_of: Battery, model: np.ndarray, text_col: str) -> DataFrame:
    """docs with _found (pattern spans) and _candidates (strings that the battery tested)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(
        _scanner(shared, battery_of, text_col), f"{schema}, _found array<{FOUND}>, _candidates array<{CANDIDATE}>"
    )


def evidence_floors(scanned: DataFrame, battery_of: Battery) -> list[int]:
    """Per stratum, the least evidence at which the Benjamini-Hochberg rule still calls a candidate a secret.

    The rule's number of tests is that of all candidates, those that the battery rejects with a p-value of 1 among them.
    Counts are over all documents, by stratum and rounded evidence (some 2,000 values each), so the driver sees a
    bounded table. A stratum without discoveries gets a floor that nothing reaches.
    """
    counts = (
        scanned.select(F.explode("_candidates").alias("c")).groupBy("c.stratum", "c.evidence").agg(F.count("*").alias("n"))
    )
    by_stratum: dict[int, list[tuple[int, int]]] = {}
    for stratum, evidence, n in counts.collect():
        by_stratum.setdefault(stratum, []).append((evidence, n))
    floors = []
    for s in range(len(battery_of.strata)):
        rows = sorted(by_stratum.get(s, []), reverse=True)
        total, above, floor = sum(n for _, n in rows), 0, 1 << 30
        for evidence, n in rows:
            above += n
            if math.exp(-evidence / 4) <= battery_of.rate * above / total:
                floor = evidence
        floors.append(floor)
    return floors


def merged_spans(found: list[tuple], candidates: list[tuple], floors: list[int]) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end) of a text: the patterns', then those of candidates at or above their stratum's floor
    that touch none of these (overlapping ones as one), by start and kind. Work is linear but for the sorting."""
    starts, stops = [], []  # the patterns' spans as disjoint stretches
    for a, _, b in sorted(found):
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    random: list[list[int]] = []
    for a, b, stratum, evidence in sorted(candidates):
        if evidence < floors[stratum]:
            continue
        before = bisect_left(starts, b) - 1
        if before >= 0 and stops[before] > a:
            continue
        if random and random[-1][1] > a:
            random[-1][1] = max(random[-1][1], b)
        else:
            random.append([a, b])
    return sorted([*found, *((a, 3, b) for a, b in random)])


def _span_adder(floors: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, candidates = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_found", "_candidates"))
            spans = [
                merged_spans([tuple(f.values()) for f in fs], [tuple(c.values()) for c in cs], floors)
                for fs, cs in zip(found, candidates, strict=True)
            ]
            rows = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, "_spans"])

    return add


def _cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with a mark for each span; overlapping spans get one."""
    out, at = [], 0
    for start, _, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def _redactor(model, battery_of: Battery, floors: list[int], text_col: str, mark: str) -> Callable:
    """Batches with spans cut from the text, and _hit where there were any."""
    scan_chunk = _chunk_scanner(model, battery_of)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text_col)
            for chunk in chunks(batch, text_col):
                texts = chunk.column(place)
                spans = [merged_spans(f, c, floors) for f, c in zip(*scan_chunk(texts), strict=True)]
                hit = pa.array([bool(s) for s in spans], pa.bool_())
                clean = [_cut(texts[i].as_py(), s, mark) for i, s in enumerate(spans) if s]
                if clean:
                    texts = pc.replace_with_mask(texts, hit, pa.array(clean, texts.type))
                columns = [*chunk.columns[:place], texts, *chunk.columns[place + 1 :], hit]
                yield pa.RecordBatch.from_arrays(columns, names=[*chunk.schema.names, "_hit"])

    return redact


def _written(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )))


def secrets(docs: DataFrame, battery_of: Battery = Battery(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) for each document, in the rows' own number.

    Spans are kind:start:end in code points, end exclusive, by start and then kind. The patterns' spans always stay.
    The battery adds runs of 20 or more base64 characters whose tests don't reject uniform randomness in the narrowest
    encoding that holds them, if the corpus's own character pairs make them unlikely enough for the false-discovery
    rate of their length. A run that no encoding holds ('+' or '/' with '-' or '_') is tested in ``parts``. Null texts count as empty: no spans. Repeated rows each come back.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = text_model(plain, shortest=battery_of.shortest)
    scanned = stored(scan(plain, battery_of, model, "text").drop("text"), "secrets")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema) + f", _spans array<{FOUND}>"
    spanned = scanned.mapInArrow(_span_adder(evidence_floors(scanned, battery_of)), schema)
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return spanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(_written(F.col("_found")).cast("binary"), 256).alias("base_sha256"), _written(F.col("_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, battery_of: Battery = Battery(), text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of ``secrets`` in the text replaced by the mark; n_chars, if there, is counted anew.

    Overlapping spans become one mark. Texts without secrets, nulls among them, are left as they are.
    """
    names = docs.columns
    own = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text_name = f"c{names.index(text_col)}"
    model = text_model(own, text_name, battery_of.shortest)
    narrow = stored(scan(own.select(text_name), battery_of, model, text_name).drop(text_name), "secrets")
    floors = evidence_floors(narrow, battery_of)
    discard(narrow)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + ", _hit boolean"
    shared = own.sparkSession.sparkContext.broadcast(model)
    clean = own.mapInArrow(_redactor(shared, battery_of, floors, text_name, mark), schema)
    if "n_chars" in names:
        count = f"c{names.index('n_chars')}"
        length = F.length(text_name).cast(own.schema[count].dataType)
        clean = clean.withColumn(count, F.when(F.col("_hit"), length).otherwise(F.col(count)))
    return clean.select(*own.columns).toDF(*names)
