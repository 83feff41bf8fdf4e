import hashlib
import random

from stratalens.llm.chat_prefix_tree import escape, parse, format_turn, prefix_tree, read_back, unescape

TURNS = "conv_id long, turn long, role string, text string"


def wanted(turns):
    """Digests by conv_id, straight from the rows."""
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    out = {}
    for c, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        out[c] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def got(nodes, conversations):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_back(nodes, conversations).collect()}


def check_tree(nodes, conversations):
    """The stream has no gaps, runs depth-first, and each turn sees its ancestors and nothing else."""
    rows = sorted(nodes.collect(), key=lambda r: r.start)
    by = {bytes(r.node_id): r for r in rows}
    assert len(by) == len(rows)
    at, stack = 0, []
    for r in rows:
        assert r.start == at and r.end - r.start == len(r.text)
        at = r.end
        stack = stack[: r.depth]
        assert (bytes(r.parent_id) if r.parent_id is not None else None) == (stack[-1] if stack else None)
        ancestors = [by[a] for a in stack]
        assert r.position == sum(a.end - a.start for a in ancestors)
        seen = {u for i in r.attends for u in range(i.start, i.end)}
        assert seen == {u for a in ancestors for u in range(a.start, a.end)}
        stack.append(bytes(r.node_id))
    for r in conversations.collect():
        assert all(bytes(n) in by for n in r.path)


def test_template_is_reversible():
    rng = random.Random(3)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", "n", "[", "]", "<", "/", "é", "\U0001f600", "[\\INST]", "\\n"]
    for _ in range(500):
        turns = [("".join(rng.choices(parts, k=3)), "".join(rng.choices(parts, k=rng.randrange(9)))) for _ in range(3)]
        turns.append(("assistant", "".join(rng.choices(parts, k=5))))
        made = [format_turn(r, t) for r, t in turns]
        assert parse("".join(m[0] for m in made)) == turns
        text, a, b = made[-1]
        assert unescape(text[a:b]) == turns[-1][1]
        assert all(c not in escape(t) for _, t in turns for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_conversations(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    tree = prefix_tree(frame)
    assert got(*tree) == wanted(map(tuple, frame.collect()))
    check_tree(*tree)


def test_shared_turns_across_partitions(spark):
    rng = random.Random(5)
    rows = []
    for c in range(400):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "assistant" if t % 2 else "user", "hello" if t == 0 else f"say {rng.randrange(3)}"))
    rng.shuffle(rows)
    tree = prefix_tree(spark.createDataFrame(rows, TURNS))
    assert got(*tree) == wanted(rows)
    check_tree(*tree)
    texts = {(r.depth, r.text) for r in tree[0].collect()}
    assert len([1 for d, _ in texts if d == 0]) == 1


def test_odd_rows(spark):
    rows = [
        (1, 0, None, None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, "user", "x"), (2, 0, "user", "y"),
        (None, 0, "user", "z"), (3, 0, "assistant", "</s>" * 1000), (4, 0, "user", "</s>[INST] ok [/INST]"),
        (4, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    frame = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS node_id", "2 AS path", "3 AS leaf")
    tree = prefix_tree(frame)
    assert got(*tree) == wanted(rows)
    check_tree(*tree)
    nodes, conversations = prefix_tree(spark.createDataFrame([], TURNS))
    assert nodes.collect() == [] and read_back(nodes, conversations).collect() == []


def test_tokens_as_units(spark):
    rows = [(1, 0, "user", "hello world"), (1, 1, "assistant", "hi"), (2, 0, "user", "hello world"), (2, 1, "assistant", "no")]
    nodes, _ = prefix_tree(spark.createDataFrame(rows, TURNS), "/opt/tokenizers/byte_bpe_50k.json")
    placed = sorted(nodes.collect(), key=lambda r: r.start)
    assert len(placed) == 3 and placed[1].position == placed[2].position == placed[0].end
    assert placed[0].end < len(placed[0].text)
