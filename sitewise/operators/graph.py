"""Iterative graph jobs: components, spanning forests, shortest paths.

Every round is a handful of joins and aggregates over edge tables whose result is written to
the shared folder, so lineage stays short and a lost executor costs one round at most. No
neighbour list is ever collected: a hub with a third of all edges is a skewed join key that
adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sitewise.storage import cut, cut_counted

# Components that make WORK pairs are a task of their own; larger ones are dealt to tasks by SOURCES, as every
# task gets a copy of the edges. A task holds the edges of one component and a table of TABLE distances at a time,
# which leaves it in pieces; components with more than COMPONENT_EDGES are worked on by joins instead.
WORK = 1 << 22
SOURCES = 512
TABLE = 1 << 23
PIECE = 1 << 18
COMPONENT_EDGES = 1 << 20
# path sums have this many digits; up to EXACT they are whole numbers of their last digit in a double
DIGITS = 10
EXACT = 9e5


def _mirrored(edges: DataFrame, key: list[str]) -> DataFrame:
    return edges.select(*key, "u", "v").unionByName(
        edges.select(*key, F.col("v").alias("u"), F.col("u").alias("v")))


def component_labels(edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Smallest reachable node of every node that has an edge: ``key..., node, label``.

    Alternating star contraction: nodes above the centre of a neighbourhood are re-attached to
    the smallest neighbour, then the nodes below it, until every component is a star. The number
    of rounds is logarithmic in the size of the graph.
    """
    key = key or []
    stars, signature = cut_counted(edges.where("u <> v").select(
        *key, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "stars", fingerprint=True)
    while True:
        both = _mirrored(stars, key)
        low = both.groupBy(*key, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.join(low, [*key, "u"]).where("v > u")
                 .select(*key, F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy(*key, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*key, "u"])
        small = (small.where("v <> m").select(*key, F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(small.select(*key, "u", F.col("m").alias("v")))).distinct()
        stars, state = cut_counted(small, "stars", fingerprint=True)
        if state == signature:
            break
        signature = state
    return (stars.select(*key, F.col("u").alias("node"), F.col("v").alias("label"))
            .unionByName(stars.select(*key, F.col("v").alias("node"), F.col("v").alias("label"))
                         .distinct()))


def _twice(pointers: DataFrame, key: str, to: str, sums: list[str], carry: list[str] = ()) -> DataFrame:
    """Every pointer ``key`` -> ``to`` followed once more; ``sums`` add up, ``carry`` is taken over."""
    step = pointers.select(F.col(key).alias(to), F.col(to).alias("__to"),
                           *[F.col(c).alias(f"__{c}") for c in [*sums, *carry]])
    rest = [c for c in pointers.columns if c not in (key, to, *sums, *carry)]
    return pointers.join(step, to, "left").select(
        key, *rest, F.col("__to").alias(to), *[(F.col(c) + F.coalesce(f"__{c}", F.lit(0))).alias(c) for c in sums],
        *[F.coalesce(f"__{c}", c).alias(c) for c in carry])


def _follow(pointers: DataFrame, key: str, to: str, sums: list[str], carry: list[str] = (), label: str = "jump") -> DataFrame:
    """Written ``pointers`` followed to their ends by doubling, two doublings for each table."""
    left = 1
    while left:
        seen = Observation()
        far = _twice(_twice(pointers, key, to, sums, carry), key, to, sums, carry)
        pointers = cut(far.observe(seen, F.count(to).alias("n")), label)
        left = seen.get["n"]
    return pointers.drop(to)


def spanning_forest(edges: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Minimum spanning forest per ``key`` under the strict edge order ``order`` (Boruvka).

    ``edges`` has key columns, ``u``, ``v`` and the order columns, which must be unique per key.
    Each round every component keeps its smallest outgoing edge; the chosen edges are contracted
    by following each component's choice to its end. Every round leaves at most half of them.
    """
    columns = [*key, "u", "v", *order]
    def at(node: str) -> F.Column:
        return F.struct(*key, F.col(node).alias("node"))
    left = cut(edges.select(*columns, at("u").alias("cu"), at("v").alias("cv")).where("u <> v"), "forest-edges")
    chosen_all = left.select(*columns).limit(0)
    while True:
        ends = left.select(F.col("cu").alias("c"), F.col("cv").alias("to"), *columns).unionByName(
            left.select(F.col("cv").alias("c"), F.col("cu").alias("to"), *columns))
        best = ends.groupBy("c").agg(F.min_by(F.struct("to", *columns), F.struct(*order)).alias("e")).select("c", "e.*")
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        # two components may pick the same edge; the smaller one is then the end of the pointers
        hooked, (size, _) = cut_counted(best.join(back, "to").withColumn("up", F.when(
            (F.col("back") != F.col("c")) | (F.col("c") > F.col("to")), F.col("to"))).select("c", "up", *columns), "forest-hook")
        if not size:
            return chosen_all
        chosen_all = chosen_all.unionByName(hooked.where("up IS NOT NULL").select(*columns))
        label = _follow(hooked.select("c", "up", F.col("c").alias("label")), "c", "up", [], ["label"], "forest-label")
        for side in ("cu", "cv"):
            left = left.join(label.select(F.col("c").alias(side), "label"), side).withColumn(side, F.col("label")).drop("label")
        left = cut(left.where("cu <> cv"), "forest-edges")


def _component_paths(sources: np.ndarray, u: np.ndarray, v: np.ndarray, units: np.ndarray, cells: int
                     ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sources, nodes of a connected component and the table nodes x sources of distances, ``cells`` at a time.

    Nodes are put in breadth-first order, in which a path goes down and up again; a sweep over the
    nodes each way follows that for all sources at once, and sweeps go on until nothing changes.
    """
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    near: list[list[tuple[int, float]]] = [[] for _ in ids]
    for a, b, w in zip(ends[:len(u)].tolist(), ends[len(u):].tolist(), units.tolist()):
        near[a].append((b, w))
        near[b].append((a, w))
    order, place = [0], {0: 0}
    for node in order:
        for other, _ in near[node]:
            if other not in place:
                place[other] = len(order)
                order.append(other)
    arcs = [[(place[b], w) for b, w in near[node]] for node in order]
    arcs = ([(p, q, w) for p in range(len(order) - 1, -1, -1) for q, w in arcs[p] if q > p]
            + [(p, q, w) for p in range(len(order)) for q, w in arcs[p] if q < p])
    at = {x: place[k] for k, x in enumerate(ids.tolist())}
    width = max(1, cells // len(order))
    for start in range(0, len(sources), width):
        some = sources[start:start + width]
        table = np.full((len(order), len(some)), np.inf)
        table[[at[x] for x in some.tolist()], np.arange(len(some))] = 0.0
        rows, other = list(table), np.empty(len(some))
        while True:
            before = table.copy()
            for p, q, w in arcs:
                np.add(rows[q], w, out=other)
                np.minimum(rows[p], other, out=rows[p])
            if np.array_equal(before, table):
                break
        yield some, ids[order], table


def _path_task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Paths of some components, a piece at a time: rows are edges, or sources in ``u``."""
    rows = pd.concat(list(parts), ignore_index=True)
    start = rows[~rows["edge"]].groupby("label")["u"]
    held, rest = [], PIECE
    for label, own in rows[rows["edge"]].groupby("label"):
        if label not in start.groups:
            continue
        units = np.rint(own["distance"].to_numpy() * 10 ** DIGITS)
        for src, nodes, table in _component_paths(start.get_group(label).to_numpy(), own["u"].to_numpy(), own["v"].to_numpy(), units, TABLE):
            # all sources of a node side by side, which files store in few bits
            step = max(1, PIECE // len(src))
            for k in range(0, len(nodes), step):
                some = nodes[k:k + step]
                held.append((np.tile(src, len(some)), np.repeat(some, len(src)), table[k:k + step].ravel() / 10 ** DIGITS))
                rest -= len(held[-1][2])
                if rest <= 0:
                    yield _paths(held)
                    held, rest = [], PIECE
    if held:
        yield _paths(held)


def _paths(held: list[tuple]) -> pd.DataFrame:
    src, node, dist = (np.concatenate(part) for part in zip(*held))
    return pd.DataFrame({"src": src, "node": node, "dist": dist})


def shortest_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None,
                   component_edges: int = COMPONENT_EDGES, work: int = WORK) -> DataFrame:
    """Weighted distances ``src, node, dist`` from every source (all nodes by default).

    Path sums are rounded to ten digits, so that equally long paths compare as equal. Pairs are
    quadratic in a component: beyond ``work`` pairs its sources are dealt to tasks, at least SOURCES
    to each, which get its edges, so that a pair is made once and never shuffled and copies of edges
    are few beside the pairs. Components with more than ``component_edges`` edges, or whose sums are
    not exact at the tenth digit, go by ``wide_paths``.
    """
    spark = nodes.sparkSession
    starts = (sources if sources is not None else nodes).select(F.col("node_id").alias("src")).distinct()
    ends = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), "distance")
    labels = cut(component_labels(ends), "path-labels")
    def placed(df: DataFrame, node: Column) -> DataFrame:
        return df.withColumn("node", node).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).drop("node")
    exact = (F.col("u").isNotNull() & F.col("v").isNotNull() & F.col("distance").between(0, EXACT)
             & (F.col("distance") == F.round("distance", DIGITS)))
    inside = cut(placed(ends, F.coalesce("u", "v")).where("label IS NOT NULL AND (u IS NULL OR v IS NULL OR u <> v)"), "path-edges")
    starts = cut(placed(starts, F.col("src")), "path-sources")
    size = inside.groupBy("label").agg(F.count(F.lit(1)).alias("m"), (
        F.bool_and(F.coalesce(exact, F.lit(False))) & (F.sum("distance") <= EXACT)).alias("exact"))
    size = starts.groupBy("label").agg(F.count(F.lit(1)).alias("k")).join(size, "label").withColumn(
        "fits", F.coalesce(F.col("exact"), F.lit(False)) & (F.col("m") <= component_edges))
    size = cut(size.withColumn("chunks", F.least(F.ceil(F.col("k") / SOURCES), F.ceil(F.col("k") * F.col("m") / work)).cast("int")), "path-sizes")
    facts = size.agg(F.sum(F.when(F.col("fits") & (F.col("chunks") == 1), F.col("k") * F.col("m"))).alias("small"),
                     F.count_if(~F.col("fits")).alias("wide")).first()
    # components with one chunk share tasks by their hash; other hashes are keys of their own
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bins = max(tasks, -(-(facts["small"] or 0) // work))
    key = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(F.xxhash64("label"))
    dealt = size.where("fits").select("label", "chunks", key.alias("bin"))
    own = starts.join(dealt, "label").select("bin", F.pmod(F.xxhash64("src"), F.col("chunks")).cast("int").alias("chunk"), "label",
                                             F.lit(False).alias("edge"), F.col("src").alias("u"), F.col("src").alias("v"), F.lit(0.0).alias("distance"))
    given = inside.join(dealt.toDF(*dealt.columns), "label").select(
        "bin", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "label", F.lit(True).alias("edge"), "u", "v", F.col("distance").cast("double"))
    kind = starts.schema["src"].dataType.simpleString()
    # rows are few bytes, which adaptive execution would put together, while the work grows with the pairs
    inner = own.unionByName(given).repartition(tasks, "bin", "chunk").groupBy("bin", "chunk").applyInPandas(
        _path_task, f"src {kind}, node {kind}, dist double")
    alone = starts.join(size, "label", "left_anti").select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"))
    out = inner.unionByName(alone)
    if facts["wide"]:
        large = size.where("NOT fits").select("label")
        out = out.unionByName(wide_paths(starts.join(large, "label", "left_semi"), inside.join(large, "label", "left_semi")))
    return out


def wide_paths(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """``shortest_paths`` from ``sources(src)`` over edges ``u, v, distance`` by joins.

    Frontier relaxation: only pairs improved in the last round are extended.
    """
    arcs = cut(edges.select("u", "v", "distance").unionByName(
        edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "distance")), "arcs")
    start = sources.select("src", F.col("src").alias("node"), F.lit(0.0).alias("dist"))
    known = cut(start.withColumn("fresh", F.lit(True)), "paths")
    while True:
        frontier = known.where("fresh")
        reached = (frontier.join(arcs, frontier["node"] == arcs["u"])
                   .select("src", F.col("v").alias("node"),
                           F.round(F.col("dist") + F.col("distance"), 10).alias("dist")))
        merged = (known.select("src", "node", "dist", F.col("dist").alias("old"))
                  .unionByName(reached.withColumn("old", F.lit(None).cast("double")))
                  .groupBy("src", "node").agg(F.min("dist").alias("dist"), F.max("old").alias("old")))
        total = merged.withColumn("fresh", F.col("old").isNull() | (F.col("dist") < F.col("old"))).drop("old")
        seen = Observation()
        known = cut(total.observe(seen, F.count_if("fresh").alias("n")), "paths")
        if seen.get["n"] == 0:
            return known.drop("fresh")
