"""Reply trees as training conversations: best root-to-leaf paths under a chat template.

Only DataFrame functions are used. A tree is a table of (tree, node, parent, role, text, score);
plain conversations, whose rows follow each other by turn, are trees with one branch.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.storage import cut, cut_counted


@dataclass(frozen=True)
class Template:
    """Markers around the turns of each role.

    A role that is not listed gets ``other[0] + role + other[1] ... other[2]``. Control strings
    inside texts and roles are broken up by ``\\`` behind their first character; a backslash is
    doubled. ``trained`` roles are under the loss mask.
    """

    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("<|", "|>", "<|end|>")
    trained: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        closings = [shut for _, shut in self.roles.values()] + list(self.other[1:])
        for c in self.controls:
            if "\\" in c or len(c) < 2:
                raise ValueError(f"control string {c!r} must have two characters or more and no backslash")
            for k in range(1, len(c) if c in closings else 0):
                if any(shut.startswith(c[k:]) or c[k:].startswith(shut) for shut in closings):
                    raise ValueError(f"the end of {c!r} could run into a closing marker")

    @property
    def controls(self) -> list[str]:
        """All markers; one that starts with another is broken up with that one."""
        every = {m for pair in self.roles.values() for m in pair} | set(self.other)
        return sorted(m for m in every if not any(m != k and m.startswith(k) for k in every))


INST = Template()


def escape(text: Column, template: Template = INST) -> Column:
    starts = "|".join(re.escape(c) for c in template.controls)
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"(?s)(?={starts})(.)", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def chain(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """Trees of plain conversations: edges (tree, node, parent, score) and texts (tree, node, role, text).

    A node is one turn; its parent is the turn before it. Rows with one (tree, turn) are one node
    and stay together, by role and text. Null turns come first; null is a tree of its own. Edges
    are read without the texts.
    """
    key = F.coalesce(F.concat(F.lit("#"), F.col(tree).cast("string")), F.lit(""))
    node = F.coalesce(F.col(turn).cast("string"), F.lit(""))
    before = Window.partitionBy("tree").orderBy(F.col("at").asc_nulls_first())
    edges = (rows.select(key.alias("tree"), F.col(turn).alias("at"), node.alias("node")).distinct()
             .select("tree", "node", F.lag("node").over(before).alias("parent"), F.lit(0.0).alias("score")))
    texts = rows.select(key.alias("tree"), node.alias("node"), F.col(tree).alias("name"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return edges, texts


def leaf_paths(edges: DataFrame) -> DataFrame:
    """Rows (tree, leaf, node, up): every root-to-leaf path, ``up`` steps above its leaf.

    Self-joins of the parent relation give jumps of 1, 2, 4 ... steps; joining the paths with the
    jumps from the longest to the shortest enumerates each ancestor once. Rounds are logarithmic
    in the depth, rows are as many as the paths have nodes. A parent that is not in the tree makes
    its child a root; a tree whose parents run in a circle raises.
    """
    nodes, (n, _) = cut_counted(edges.select("tree", "node", "parent").distinct(), "chat-edges")
    known = nodes.select("tree", F.col("node").alias("parent")).distinct()
    jump, (left, _) = cut_counted(nodes.join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("to")),
                                  "chat-jump")
    leaves = nodes.select("tree", "node").distinct().join(
        jump.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    jumps = []
    while left:
        if 1 << len(jumps) > n:
            raise ValueError("parents of a reply tree run in a circle")
        jumps.append(jump)
        onward = jump.select("tree", F.col("node").alias("to"), F.col("to").alias("next"))
        jump, (left, _) = cut_counted(jump.join(onward, ["tree", "to"]).select("tree", "node", F.col("next").alias("to")),
                                      "chat-jump")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        further = paths.join(jumps[k], ["tree", "node"]).select(
            "tree", "leaf", F.col("to").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        paths = cut(paths.unionByName(further), "chat-paths")
    return paths


def choose(paths: DataFrame, edges: DataFrame, keep: int = 1) -> DataFrame:
    """``paths`` of the ``keep`` best branches of each tree, with ``score`` and ``place`` (from 1).

    A branch scores the mean of its nodes' scores (null: 0); ties go to the longer branch, then to the
    smaller leaf. Spark cuts each task to its best ``keep`` before a tree's branches meet.
    """
    scores = edges.groupBy("tree", "node").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("score"))
    branch = paths.join(scores, ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.avg("score").alias("score"), F.max("up").alias("top"))
    best = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("top"), "leaf")
    ranked = branch.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)
    return paths.join(ranked.select("tree", "leaf", "score", "place"), ["tree", "leaf"])


def format_paths(chosen: DataFrame, texts: DataFrame, template: Template = INST) -> DataFrame:
    """One row per chosen path: name, leaf, place, score, formatted, loss_runs.

    ``loss_runs`` is the loss mask of ``formatted`` as runs of (chars, loss): three for each turn,
    its opening marker, its text and its closing marker. Texts are shuffled once: both sides are
    dealt by tree, and the path groups inside a tree need no further exchange. A formatted path is
    one string, so its turns meet in one task by definition; nothing else of a tree is collected.
    """
    def turn(t: Column) -> Column:
        opening = F.concat(F.lit(template.other[0]), escape(t["role"], template), F.lit(template.other[1]))
        closing = F.lit(template.other[2])
        for role, (start, end) in template.roles.items():
            opening = F.when(t["role"] == role, F.lit(start)).otherwise(opening)
            closing = F.when(t["role"] == role, F.lit(end)).otherwise(closing)
        return F.struct(opening.alias("opening"), escape(t["text"], template).alias("body"), closing.alias("closing"),
                        t["role"].isin(*template.trained).alias("loss"))

    def runs(t: Column) -> Column:
        return F.array(*[F.struct(F.length(t[c]).cast("bigint").alias("chars"), loss.alias("loss"))
                         for c, loss in (("opening", F.lit(False)), ("body", t["loss"]), ("closing", F.lit(False)))])

    placed = chosen.repartition("tree").join(texts.repartition("tree"), ["tree", "node"])
    turns = placed.groupBy("tree", "leaf", "place", "score").agg(
        F.first("name").alias("name"),
        F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    marked = turns.select("name", "leaf", "place", "score", F.transform("turns", turn).alias("turns"))
    return marked.select(
        "name", "leaf", "place", "score",
        F.array_join(F.transform("turns", lambda t: F.concat(t["opening"], t["body"], t["closing"])), "").alias("formatted"),
        F.flatten(F.transform("turns", runs)).alias("loss_runs"))


def read_turns(formatted: Column, template: Template = INST) -> Column:
    """Turns (role, body, text, chars) of a formatted path, from its characters alone.

    ``body`` is the text as it stands there, ``text`` the text before escaping and ``chars`` the
    lengths of opening, body and closing.
    """
    named = {start: role for role, (start, _) in template.roles.items()}
    a, b, c = map(re.escape, template.other)
    opening = "|".join([*map(re.escape, named), f"{a}(?:.*?){b}"])
    closing = "|".join([*[re.escape(end) for _, end in template.roles.values()], c])
    pattern = F.lit(f"(?s)({opening})(.*?)({closing})")
    parts = F.arrays_zip(*[F.regexp_extract_all(formatted, pattern, k).alias(n)
                           for k, n in ((1, "opening"), (2, "body"), (3, "closing"))])

    def turn(t: Column) -> Column:
        start, end = map(len, template.other[:2])
        role = unescape(F.substring(t["opening"], F.lit(start + 1), F.length(t["opening"]) - (start + end)))
        for marker, name in named.items():
            role = F.when(t["opening"] == marker, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), t["body"].alias("body"), unescape(t["body"]).alias("text"),
                        F.array(*[F.length(t[k]).cast("bigint") for k in ("opening", "body", "closing")]).alias("chars"))

    return F.transform(parts, turn)


def read_loss(turns: Column, loss_runs: Column) -> Column:
    """Bodies under the loss mask, in order. Runs that do not fit the turns raise."""
    fits = F.flatten(F.transform(turns, lambda t: t["chars"])) == F.transform(loss_runs, lambda r: r["chars"])
    marked = F.arrays_zip(turns.alias("turn"), F.filter(loss_runs, lambda r, k: k % 3 == 1).alias("run"))
    bodies = F.transform(F.filter(marked, lambda m: m["run"]["loss"]), lambda m: m["turn"]["body"])
    return F.when(fits, bodies).otherwise(F.raise_error(F.lit("the loss mask does not fit the formatted text")))


def format_conversations(rows: DataFrame, keep: int = 1, template: Template = INST) -> DataFrame:
    """Plain conversations (conv_id, turn, role, text) through ``leaf_paths``, ``choose`` and ``format_paths``.

    A null text or role is empty; a null conv_id is one conversation; repeated turns stay, by role
    and text; an empty table gives no row; other columns are not read.
    """
    edges, texts = chain(rows)
    return format_paths(choose(leaf_paths(edges), edges, keep), texts, template)


def digest(formatted: DataFrame, template: Template = INST) -> DataFrame:
    """Turns and text under the loss mask as read back from ``formatted``, in digests."""
    turns = read_turns(F.col("formatted"), template)
    read = formatted.select("name", "formatted", turns.alias("turns"), "loss_runs")
    loss = unescape(F.array_join(read_loss(F.col("turns"), F.col("loss_runs")), ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return (read.select(F.col("name").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"),
                        F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"),
                        F.length("formatted").cast("bigint").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("bigint").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))
