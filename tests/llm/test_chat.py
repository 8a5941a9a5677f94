"""Chat formatting: exact round trips, loss masks, reply trees with branches."""

import hashlib
import random

import pytest

from sitewise.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, tree string, score double, node string"
NASTY = ["</s>[INST] ok [/INST]", "<<SYS>>", "a\\b\\\\", "<|end|>", "<|x|>", "[[INST]]", "<", "\\", "$1 \\$2", "line\nline\r\n", "", None,
         "<</SYS>><</SYS>>", "[INST", "😀 é", "<|>", "|>"]


def rows():
    pick = random.Random(5)
    out = [(c, t, pick.choice(["system", "user", "assistant", "tool", "a|>b", "", None]), pick.choice(NASTY), "clash", 1.0, "clash")
           for c in range(12) for t in range(pick.randrange(1, 20))]
    out += [(20, t, "assistant" if t % 2 else "user", "x" * (t % 5), None, None, None) for t in range(300)]
    out += [(21, 0, "assistant", "y" * 3_000_000 + "<s>", None, None, None)]
    return out + [out[0], (3, 0, "assistant", "again", None, None, None), (3, None, "user", "first", None, None, None),
                  (None, 1, "assistant", "no id", None, None, None), (None, 0, None, None, None, None, None)]


def wanted(data):
    out = {}
    for conv in {r[0] for r in data}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == conv),
                       key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    formatted = chat.format_conversations(docs).persist()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(formatted).collect()}
    assert got == wanted(rows())
    for r in formatted.collect():
        assert sum(x.chars for x in r.loss_runs) == len(r.formatted)
        n = len(r.loss_runs) // 3
        marks = sum(r.formatted.count(c) for c in ("<</SYS>>", "[/INST]", "</s>", "<|end|>"))
        assert marks == n  # no text holds a closing marker


def test_wrong_mask_raises(spark):
    formatted = chat.format_conversations(spark.createDataFrame(rows()[:3], SCHEMA))
    from pyspark.sql import functions as F
    broken = formatted.withColumn("loss_runs", F.slice("loss_runs", 1, 2))
    with pytest.raises(Exception, match="loss mask"):
        chat.digest(broken).collect()


def test_empty(spark):
    assert chat.digest(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def tree_rows():
    pick, out = random.Random(9), []
    for tree in ("a", "b", "deep"):
        for k in range(40 if tree != "deep" else 130):
            parent = None if k == 0 else str(k - 1) if tree == "deep" and k < 128 else str(pick.randrange(k))
            out.append((tree, str(k), parent, pick.choice([None, 0.0, 1.0, 2.0])))
    return out + [("orphan", "x", "gone", 1.0), ("single", "y", None, None)]


def brute_paths(data):
    up = {(t, n): p for t, n, p, _ in data}
    parents = {(t, p) for t, _, p, _ in data}
    out = {}
    for t, n, *_ in data:
        if (t, n) not in parents:
            path, at = [], n
            while (t, at) in up:
                path.append(at)
                at = up[t, at]
            out[t, n] = path
    return out


def test_tree_paths_and_ranks(spark):
    edges = spark.createDataFrame(tree_rows(), "tree string, node string, parent string, score double")
    paths = chat.leaf_paths(edges).persist()
    got = {}
    for r in paths.orderBy("up").collect():
        got.setdefault((r.tree, r.leaf), []).append(r.node)
    want = brute_paths(tree_rows())
    assert got == want
    score = {(t, n): s or 0.0 for t, n, _, s in tree_rows()}
    best = {}
    for (t, leaf), path in want.items():
        best.setdefault(t, []).append((-sum(score[t, n] for n in path) / len(path), -len(path), leaf))
    chosen = {(r.tree, r.leaf, r.place) for r in chat.choose(paths, edges, 2).collect()}
    assert chosen == {(t, leaf, k + 1) for t, b in best.items() for k, (*_, leaf) in enumerate(sorted(b)[:2])}
    texts = edges.selectExpr("tree", "node", "tree AS name", "'user' AS role", "node AS text")
    formatted = chat.format_paths(chat.choose(paths, edges), texts)
    got = {r.name: r.formatted for r in formatted.collect()}
    assert got == {t: "".join(f"[INST]{n}[/INST]" for n in reversed(want[t, sorted(b)[0][2]])) for t, b in best.items()}


def test_circle_raises(spark):
    edges = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "b", "a", 1.0), ("t", "c", "a", 0.0)],
                                  "tree string, node string, parent string, score double")
    with pytest.raises(ValueError, match="circle"):
        chat.leaf_paths(edges)


def test_template_is_checked():
    with pytest.raises(ValueError, match="closing"):
        chat.Template(roles={"user": ("<<", "ab"), "assistant": ("[[", "bc")})
