"""Repair of conversation structure: the cheapest edits, by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import inf

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from stratalens.llm.shared import stored

FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3  # a row's first fault
FAULTS = {"blank": BLANK, "duplicate": DUPLICATE, "truncated": TRUNCATED}
DELETE, INSERT, KEEP, REROLE, CUT = 4, 3, 0, 3, 3  # costs; CUT: of a truncated row that stays
START, SYSTEM, USER, ASSISTANT = range(4)  # what the repaired rows so far end with
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that a new or relabelled row has after each state.
NEXT = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
WHOLE = {START: 0, ASSISTANT: 0}  # a repaired conversation is (s?(ua)+)?
PIECE = 64  # rows searched at once
NOT_BLANK = "[^\\x20\\x09-\\x0D]"

Row = tuple[str, int, int]  # role initial, fault, how many equal rows stand here


class Search:
    """Iterative-deepening A* over the edits of consecutive rows.

    ends: cost of what follows, by the state in which the rows may end. last: no rows follow, so that rows may be
    inserted after them; else such rows are left to what follows, and an edit list ends with the last row's edit.
    The estimate of what is left is the sum of what each row costs whatever its neighbours are. The table of failed
    states holds what each (row, state) that was searched in vain must cost at least; it holds for every start, since
    it says nothing of the way there.
    """

    def __init__(self, rows: list[Row], ends: dict[int, int], last: bool) -> None:
        self.rows, self.ends, self.last = rows, ends, last
        least = [min(ends.values())]
        for _, fault, n in reversed(rows):
            least.append(least[-1] + (DELETE * n if fault in (BLANK, DUPLICATE) else CUT if fault == TRUNCATED else 0))
        self.least = least[::-1]
        self.failed: dict[tuple[int, int], float] = {}

    def reachable(self, start: int) -> bool:
        """Whether the rows can end in any of the ends."""
        if self.ends.keys() & {USER, ASSISTANT} or self.last or start in self.ends:
            return True
        opening = any(initial == "s" and fault in (FINE, TRUNCATED) for initial, fault, _ in self.rows)
        return SYSTEM in self.ends and start == START and opening

    def edits(self, at: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edits, cost, next row, next state) in ASCII order of the edit's initial."""
        new = STEPS[state, NEXT[state][0]]
        if at == len(self.rows):
            return [("I", INSERT, at, new)] if self.last else []
        initial, fault, n = self.rows[at]
        out = [("D" * n, DELETE * n, at + 1, state), ("I", INSERT, at, new)]
        if fault in (FINE, TRUNCATED):
            extra = CUT if fault == TRUNCATED else 0
            if (state, initial) in STEPS:
                out.append(("K", KEEP + extra, at + 1, STEPS[state, initial]))
            out.append(("R", REROLE + extra, at + 1, new))
        return out

    def best(self, start: int) -> tuple[int, str, int] | None:
        """(cost, edits, last state) of the cheapest edits from a state, the ASCII-least of several; None if there are none."""
        bound: float = self.least[0]
        while self.reachable(start):
            found = self._deepen(start, bound)
            if isinstance(found, tuple):
                return found
            bound = found
        return None

    def _deepen(self, start: int, bound: float) -> tuple[int, str, int] | float:
        """The first accepting edits, depth first, whose estimated cost stays within the bound; else the next bound."""
        end, trail = len(self.rows), []
        path = [[0, start, 0, iter(self.edits(0, start)), inf]]
        while True:
            frame = path[-1]
            spent = frame[2]
            for edit, cost, at, state in frame[3]:
                total = spent + cost
                if at == end and state in self.ends:
                    if total + self.ends[state] <= bound:
                        return total + self.ends[state], "".join([*trail, edit]), state
                    frame[4] = min(frame[4], total + self.ends[state])
                if at == end and not self.last:
                    continue
                estimate = total + max(self.least[at], self.failed.get((at, state), 0))
                if estimate > bound:
                    frame[4] = min(frame[4], estimate)
                    continue
                trail.append(edit)
                path.append([at, state, total, iter(self.edits(at, state)), inf])
                break
            else:
                at, state, spent, _, over = path.pop()
                self.failed[at, state] = over - spent
                if not path:
                    return over
                trail.pop()
                path[-1][4] = min(path[-1][4], over)


def repaired(rows: list[tuple[str, str]], runs: list[Row], audit: str, state: int) -> Iterator[tuple[str, str]]:
    """(role, text) of the rows that the edits leave. rows: role and text of each run of equal rows."""
    at = taken = 0
    for edit in audit:
        if edit == "I":
            yield NEXT[state], ""
            state = STEPS[state, NEXT[state][0]]
            continue
        role, text = rows[at]
        if edit in "KR":
            role = NEXT[state] if edit == "R" else role
            yield role, text
            state = STEPS[state, role[0]]
        taken += 1
        if taken == runs[at][2]:
            at, taken = at + 1, 0


def _digest(digest, rows: Iterator[tuple[str, str]], begun: bool) -> bool:
    for role, text in rows:
        digest.update(f"{chr(10) * begun}{role}:{text}".encode())
        begun = True
    return begun


OUT = (
    "conv string, cost long, audit string, sha string, illegal long, pid int, seq int, "
    "roles array<string>, texts array<string>, faults array<int>, copies array<long>"
)
COLUMNS = [c.split()[0] for c in OUT.replace(", ", ",").split(",")]
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(),
         pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _runs(roles: list[str], faults: list[int], copies: list[int]) -> list[Row]:
    return [(role[:1], fault, n) for role, fault, n in zip(roles, faults, copies, strict=True)]


def _illegal(before: str | None, runs: list[Row]) -> int:
    """Neighbours whose initials don't go together; before: the initial of the row before the first."""
    found = sum(n - 1 for _, _, n in runs)
    for initial, _, _ in runs:
        found += before is not None and before + initial not in ("su", "ua", "au")
        before = initial
    return found


def _walker(piece: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Repairs each conversation that lies whole inside a sorted partition and has at most `piece` runs; others come out in pieces."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seq, first, cut = TaskContext.get().partitionId(), 0, True, False
        conv, held, out = None, [], []

        def close(whole: bool) -> None:
            nonlocal seq
            roles, texts, faults, copies = map(list, zip(*held))
            if whole:
                runs = _runs(roles, faults, copies)
                cost, audit, _ = Search(runs, WHOLE, True).best(START)
                digest = hashlib.sha256()
                _digest(digest, repaired(list(zip(roles, texts)), runs, audit, START), False)
                out.append((conv, cost, audit, digest.hexdigest(), _illegal(None, runs), *[None] * 6))
            else:
                out.append((conv, None, None, None, None, pid, seq, roles, texts, faults, copies))
                seq += 1
            held.clear()

        for batch in batches:
            for c, role, text, fault, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if c != conv:
                    if held:
                        close(whole=not (first or cut))
                        first = False
                    conv, cut = c, False
                elif len(held) == piece:
                    close(whole=False)
                    cut = True
                held.append((role, text, fault, n))
            if len(out) >= 2000:
                yield _batch(out, COLUMNS, TYPES)
                out.clear()
        if held:
            close(whole=False)
        if out:
            yield _batch(out, COLUMNS, TYPES)

    return walk


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cost of a piece from each state to each other (-1: no way), 16 numbers."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            runs = _runs(r["roles"], r["faults"], r["copies"])
            table = [-1] * 16
            for end in range(4):
                search = Search(runs, {end: 0}, False)
                for start in range(4):
                    if found := search.best(start):
                        table[4 * start + end] = found[0]
            rows.append((r["conv"], r["pid"], r["seq"], table))
        if rows:
            yield _batch(rows, ["conv", "pid", "seq", "table"], [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())])


#: Cost of the rows to insert after the last row, by the state that it leaves.
AFTER_LAST = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the pieces of a conversation from last to first: the least cost of all that follows a piece, by state (-1: no way)."""
    conv, after = object(), {}
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if r["conv"] != conv:
                conv, after = r["conv"], dict(AFTER_LAST)
                last = True
            rows.append((r["conv"], r["pid"], r["seq"], last, [after.get(s, -1) for s in range(4)]))
            last, table = False, r["table"]
            ways = {s: [table[4 * s + e] + c for e, c in after.items() if table[4 * s + e] >= 0] for s in range(4)}
            after = {s: min(w) for s, w in ways.items() if w}
        if rows:
            yield _batch(rows, ["b_conv", "b_pid", "b_seq", "is_last", "after"], [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64())])


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a piece from each state, given what follows it costs; cost is that of the piece and all after it."""
    names = ["conv", "pid", "seq", "costs", "audits", "ends", "roles", "texts", "faults", "copies"]
    longs, strings, ints = pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32())
    types = [pa.string(), pa.int32(), pa.int32(), longs, strings, ints, strings, strings, ints, longs]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            runs = _runs(r["roles"], r["faults"], r["copies"])
            ends = WHOLE if r["is_last"] else {s: c for s, c in enumerate(r["after"]) if c >= 0}
            search = Search(runs, ends, r["is_last"])
            found = [search.best(s) or (-1, None, 0) for s in range(4)]
            rows.append((r["conv"], r["pid"], r["seq"], *map(list, zip(*found)), r["roles"], r["texts"], r["faults"], r["copies"]))
        if rows:
            yield _batch(rows, names, types)


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the chosen edits through the pieces of each conversation, first to last."""
    open_, conv = False, None
    out: list[tuple] = []

    def close() -> None:
        out.append((conv, cost, "".join(audit), digest.hexdigest(), illegal))

    for batch in batches:
        for r in batch.to_pylist():
            if not open_ or r["conv"] != conv:
                if open_:
                    close()
                open_, conv, cost = True, r["conv"], r["costs"][START]
                audit, digest, begun, state, illegal, before = [], hashlib.sha256(), False, START, 0, None
            edits, runs = r["audits"][state], _runs(r["roles"], r["faults"], r["copies"])
            begun = _digest(digest, repaired(list(zip(r["roles"], r["texts"])), runs, edits, state), begun)
            audit.append(edits)
            illegal += _illegal(before, runs)
            state, before = r["ends"][state], runs[-1][0]
        if out:
            yield _batch(out, COLUMNS[:5], TYPES[:5])
            out.clear()
    if open_:
        close()
        yield _batch(out, COLUMNS[:5], TYPES[:5])


def with_faults(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text, fault, copies, again): the distinct rows of (conv, turn, role, text), their copies counted.

    Of equal rows that are neither blank nor seen before, the first stands alone and the others, duplicates all, are a row
    of their own (again = 1).
    """
    rows = turns.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("mark", F.sha2(F.col("text").cast("binary"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    met = rows.groupBy("conv", "role", "mark").agg(F.min(place).alias("first"), F.count("*").alias("several")).where("several > 1")
    met = met.select(F.col("conv").alias("m_conv"), F.col("role").alias("m_role"), F.col("mark").alias("m_mark"), "first")
    same = F.col("conv").eqNullSafe(F.col("m_conv")) & (F.col("role") == F.col("m_role")) & (F.col("mark") == F.col("m_mark"))
    rows = rows.join(met, same, "left")
    seen = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    closed = F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")
    fault = F.when(~F.col("text").rlike(NOT_BLANK), BLANK).when(seen, DUPLICATE).when(~closed, TRUNCATED).otherwise(FINE)
    rows = rows.select("conv", "turn", "role", "text", "n", fault.alias("fault"))

    def part(again: int, fault: Column, copies: Column) -> Column:
        return F.struct(F.lit(again).alias("again"), fault.alias("fault"), copies.cast("long").alias("copies"))

    split = (F.col("n") > 1) & F.col("fault").isin(FINE, TRUNCATED)
    parts = F.when(split, F.array(part(0, F.col("fault"), F.lit(1)), part(1, F.lit(DUPLICATE), F.col("n") - 1)))
    parts = parts.otherwise(F.array(part(0, F.col("fault"), F.col("n"))))
    return rows.select("conv", "turn", "role", "text", F.inline(parts))


def repair(turns: DataFrame, piece: int = PIECE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation with rows.

    conv is conv_col as a string. A conversation's rows stand by turn, nulls first, then by role and text; null
    roles and texts are one space. A row's first fault counts: blank (no character but white space), duplicate (role and
    text stood before), truncated (its last character that is not white space is none of ``.!?``). gaps: numbers missing
    between the least and greatest turn. illegal: neighbouring rows whose roles' initials are none of su, ua, au.

    audit: the initials of the cheapest edits that leave role initials ``(s?(ua)+)?``; of several the ASCII-least.
    Keep costs 0, Rerole (to user or assistant) 3, Delete 4 and is due for blank and duplicate rows, Insert (an empty
    user or assistant row) 3; a truncated row that stays costs 3 more. The audit tells the repaired rows, since after each
    state one role can be inserted or given. repaired_sha256 is over their ``role:text``, joined by newlines.

    Equal rows are counted first and stand as one. Sorted by ranges of (conv, turn, role, text), a long conversation spreads over partitions. One
    that is whole in its partition and has at most `piece` distinct rows is searched there (``Search``); others are cut into pieces, for
    which the search gives the cost from each state to each other. A backward pass over these 16 numbers a piece gives the cost of
    all that follows; with it each piece is searched again from each state, and a forward pass follows the states.
    Both passes stream the pieces of a conversation through one task without holding them, since its digest runs over
    all its text in order. A null conv_id is a conversation like any other. An empty table gives no rows.
    """
    clean = turns.select(
        F.col(conv_col).cast("string").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))],
    )
    rows = stored(with_faults(clean), "faults")
    order = ["conv", "turn", "role", "text", "again"]
    walked = stored(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv", "role", "text", "fault", "copies").mapInArrow(_walker(piece), OUT),
        "repaired",
    )
    done = walked.where("cost IS NOT NULL").select("conv", "cost", "audit", "sha", "illegal")
    pieces = walked.where("cost IS NULL").select("conv", "pid", "seq", "roles", "texts", "faults", "copies")
    key = ["conv", "pid", "seq"]
    tables = stored(pieces.select(*key, "roles", "faults", "copies").mapInArrow(_costs, "conv string, pid int, seq int, table array<long>"), "tables")
    down = [F.col("conv"), F.col("pid").desc(), F.col("seq").desc()]
    back = tables.repartition("conv").sortWithinPartitions(*down).mapInArrow(
        _backward, "b_conv string, b_pid int, b_seq int, is_last boolean, after array<long>"
    )
    met = (F.col("pid") == F.col("b_pid")) & (F.col("seq") == F.col("b_seq"))
    chosen = pieces.join(back.drop("b_conv"), met).mapInArrow(
        _choices,
        "conv string, pid int, seq int, costs array<long>, audits array<string>, ends array<int>, "
        "roles array<string>, texts array<string>, faults array<int>, copies array<long>",
    )
    rest = chosen.repartition("conv").sortWithinPartitions(*key).mapInArrow(_forward, "conv string, cost long, audit string, sha string, illegal long")
    found = done.union(rest).select(F.col("conv").alias("f_conv"), "cost", "audit", F.col("sha").alias("repaired_sha256"), "illegal")
    counts = _counts(rows)
    return counts.join(found, F.col("conv").eqNullSafe(F.col("f_conv"))).drop("f_conv")


def _counts(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated), from sums per turn, then per conversation."""
    sums = [F.coalesce(F.sum(F.when(F.col("fault") == code, F.col("copies"))), F.lit(0)).alias(name) for name, code in FAULTS.items()]
    turns = rows.groupBy("conv", "turn").agg(*sums)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    return turns.groupBy("conv").agg(gaps, *[F.sum(name).alias(name) for name in FAULTS])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): rows with faults put in by a hash of conv_id and turn (null: one space), for trials of ``repair``.

    Of 20 hash values 0 drops the row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it and 4 makes its role user. Null
    roles and texts become one space.
    """
    space = F.lit(" ")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c), space) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    rows = rows.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times))
    return rows.drop("col")
