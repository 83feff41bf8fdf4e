import hashlib
import heapq
import random
import re
import zlib

import pytest

from stratalens.llm.dialog_repair import Search, repair
from stratalens.llm.queries import op13_structure_repair

SF = "/root/testdata/sf0.01"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANKS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Cheapest edits by Dijkstra over (cost, edits), states as the roles so far; rows are (role, text)."""
    faults = faults_of(rows)
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, at, last, made = heapq.heappop(queue)
        if at == len(rows) and last in ("", "a"):
            text = "\n".join(f"{r}:{t}" for r, t in made)
            return cost, edits, hashlib.sha256(text.encode()).hexdigest()
        if (at, last) in done:
            continue
        done.add((at, last))
        for n in after[last].replace("s", ""):
            heapq.heappush(queue, (cost + 3, edits + "I", at, n, (*made, (names[n], ""))))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(queue, (cost + 4, edits + "D", at + 1, last, made))
            if faults[at] in ("", "truncated"):
                more = 3 * (faults[at] == "truncated")
                if role[:1] and role[:1] in after[last]:
                    heapq.heappush(queue, (cost + more, edits + "K", at + 1, role[0], (*made, rows[at])))
                for n in after[last].replace("s", ""):
                    heapq.heappush(queue, (cost + 3 + more, edits + "R", at + 1, n, (*made, (names[n], text))))


def expected(turns):
    """turns: (turn or None, role, text) in order."""
    rows = [(r, t) for _, r, t in turns]
    faults, known = faults_of(rows), [t for t, _, _ in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, *brute(rows))


def in_order(turns):
    return sorted(turns, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def as_rows(frame, key):
    fields = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r[key]: tuple(r[f] for f in fields) for r in frame.collect()}


def test_query_against_brute_force(spark):
    conversations = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        rows = conversations.setdefault(r.conv_id, [])
        kind = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", r.text)}.get(kind, r.text)
        rows += [(r.turn, "user" if kind == 4 else r.role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = op13_structure_repair(spark, SF)
    want = {c: expected(in_order(rows)) for c, rows in conversations.items()}
    assert as_rows(found, "conv_id") == want and len({w[6] for w in want.values()}) > 20


def noisy(rng, n):
    roles = ["user", "assistant", "system", "tool", "", " ", "usher"]
    texts = ["Yes.", "No", "", " ", "Why?", "a.\n", "b", "Well! ", "c.", "d.", "e.", "f."]
    return [(rng.choice([None, *range(n)]), rng.choices(roles, [8, 8, 2, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize("piece", [1, 5, 64])
def test_pieces_and_long_conversations(spark, piece):
    """Random rows with nulls, ties and repeats; every cut into pieces gives the same."""
    rng = random.Random(11)
    conversations = {c: noisy(rng, n) for c, n in enumerate([*range(1, 40), 150, 400])} | {None: noisy(rng, 30)}
    rows = [(c, *r) for c, turns in conversations.items() for r in turns]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = as_rows(repair(frame, piece), "conv")
    assert found == {None if c is None else str(c): expected(in_order(t)) for c, t in conversations.items()}


def test_hot_conversation_of_equal_rows(spark):
    frame = spark.range(30_000).selectExpr("7L AS conv_id", "id % 2 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "'Yes.' AS text")
    found = as_rows(repair(frame), "conv")["7"]
    assert found[:6] == (0, 0, 29_998, 0, 29_998, 4 * 29_998) and found[6] == "K" + "D" * 14_999 + "K" + "D" * 14_999


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, fault int"
    empty = spark.createDataFrame([], schema)
    assert repair(empty).collect() == []
    odd = spark.createDataFrame([(1, None, None, None, "x", 1), (2, 3, "user", "Hi." * 100_000, "x", None), (2, 5, "assistant", "Yes", None, 2)], schema)
    found = as_rows(repair(odd), "conv")
    assert found["1"][:7] == (0, 1, 0, 0, 0, 4, "D") and found["2"][:7] == (1, 0, 0, 1, 0, 3, "KK")


def test_search_from_every_state():
    """Costs between states equal those of a plain search over all states."""
    rng = random.Random(4)
    for _ in range(60):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 1, 2, 3]), 1) for _ in range(rng.randrange(1, 7))]
        for end in range(4):
            search = Search(rows, {end: 0}, False)
            for start in range(4):
                costs = {(0, start): 0}
                for at in range(len(rows)):
                    for _ in range(4):
                        for state in range(4):
                            if (at, state) in costs:
                                for _, cost, to, then in search.edits(at, state):
                                    costs[to, then] = min(costs.get((to, then), 10**9), costs[at, state] + cost)
                best = search.best(start)
                assert (best and best[0]) == costs.get((len(rows), end))
