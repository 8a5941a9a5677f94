"""Merge trees: at which edge length two nodes of a weighted graph come together.

A merge tree is a table of links ``node, up, height``: ``node`` joins the component of ``up``
once edges of length ``height`` are in. It has one row for each node but the roots and answers the
same as the graph for every threshold, so no table of nodes and thresholds is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sitewise.operators.blocks import rooted
from sitewise.operators.graph import _follow
from sitewise.storage import cut, cut_counted

# height between components that no edge joins
NEVER = 1 << 62


def merge_links(edges: DataFrame) -> DataFrame:
    """Links of the graph ``u, v, d`` by contraction; a node is at most log2(nodes) links below its root.

    A component's shortest edge is the first at which it joins anything. Along a chain of such
    choices lengths only fall, so each component hangs directly below the end of its chain, at
    the length of its own choice. Every round leaves at most half of the components.
    """
    left = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d")
               .groupBy("u", "v").agg(F.min("d").alias("d"))
               .select("u", "v", F.col("u").alias("cu"), F.col("v").alias("cv"), "d"), "merge-left")
    links = left.select(F.col("u").alias("node"), F.col("v").alias("up"), F.col("d").alias("height")).limit(0)
    rank = F.struct("d", F.xxhash64("u", "v"), "u", "v")
    while True:
        ends = left.select(F.col("cu").alias("c"), F.col("cv").alias("to"), "u", "v", "d").unionByName(
            left.select(F.col("cv").alias("c"), F.col("cu").alias("to"), "u", "v", "d"))
        best = ends.groupBy("c").agg(F.min_by(F.struct("to", "d"), rank).alias("e")).select("c", "e.*")
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        # two components may pick the same edge; the smaller one is then the end of the chain
        hooked = best.join(back, "to").select(
            "c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.lit(None)).otherwise(F.col("to")).alias("up"),
            F.col("d").alias("height"), F.col("c").alias("label"))
        hooked, (size, _) = cut_counted(hooked, "merge-hook")
        if not size:
            return links
        label = _follow(hooked, "c", "up", [], ["label"], "merge-label")
        links = links.unionByName(label.where("label <> c").select(
            F.col("c").alias("node"), F.col("label").alias("up"), "height"))
        for side in ("cu", "cv"):
            left = left.join(label.select(F.col("c").alias(side), "label"), side).withColumn(side, F.col("label")).drop("label")
        left = cut(left.where("cu <> cv"), "merge-left")


def climb(rows: DataFrame, at: str, links: DataFrame, passes) -> DataFrame:
    """``rows`` with ``at`` moved up the links while ``passes(height of the link)`` holds; null stays null.

    Two steps for each written table; links of ``merge_links`` end after log2(nodes) steps.
    """
    step = links.select(F.col("node").alias(at), F.col("up").alias("__up"), F.col("height").alias("__height"))
    moves = F.col("__up").isNotNull() & passes(F.col("__height"))
    while True:
        columns = rows.columns
        for _ in range(2):
            rows = (rows.join(step, at, "left").withColumn("__moved", moves)
                    .withColumn(at, F.when(F.col("__moved"), F.col("__up")).otherwise(F.col(at)))
                    .select(*columns, "__moved"))
        seen = Observation()
        rows = cut(rows.observe(seen, F.count_if("__moved").alias("n")), "merge-climb").select(*columns)
        if not seen.get["n"]:
            return rows


def merge_order(edges: DataFrame) -> DataFrame:
    """Nodes in an order in which every component of every threshold is one run: node, pos, height.

    ``height`` is the length at which the node's run joins what stands before it, so nodes at
    ``i < j`` come together at the largest height after ``i`` up to ``j`` (``NEVER`` if they do
    not). It is the preorder of the links made rising towards the root, shorter links first.
    """
    links = cut(merge_links(edges), "merge-links")
    rising = climb(links, "up", links, lambda height: height <= F.col("height"))
    roots = links.select(F.col("up").alias("node")).distinct().join(links, "node", "left_anti").select("node")
    tree = rooted(rising.select(F.col("up").alias("u"), F.col("node").alias("v"), "height"), roots, ["height"])
    return tree.select("node", F.col("pre").alias("pos")).join(links.select("node", "height"), "node", "left").select(
        "node", "pos", F.coalesce("height", F.lit(NEVER)).alias("height"))
