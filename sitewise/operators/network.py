"""Haplotype network construction as Spark jobs.

Definitions follow the published methods: the union of all minimum spanning trees (exact
randomised minimum spanning tree network), the minimum spanning network with a tolerance, the
edge frequency of randomised minimum spanning trees, and the mutation-inclusion network rooted at
a reference.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.sequence import single_line
from sitewise.operators.graph import spanning_forest
from sitewise.operators.mergetree import climb, merge_links, merge_order
from sitewise.operators.pairs import _placed, _split, block_pairs, codes, compare
from sitewise.storage import cut


def _local_forest(distance: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of one block's complete graph (Prim on a dense matrix)."""
    n = distance.shape[0]
    best, origin = distance[0].astype(float), np.zeros(n, dtype=int)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    ends = []
    for _ in range(n - 1):
        nearest = int(np.argmin(np.where(outside, best, np.inf)))
        ends.append((origin[nearest], nearest, best[nearest]))
        outside[nearest] = False
        closer = distance[nearest] < best
        best = np.where(closer, distance[nearest], best)
        origin = np.where(closer, nearest, origin)
    a = np.array(ends, dtype=float).reshape(-1, 3)
    return a[:, 0].astype(int), a[:, 1].astype(int), a[:, 2].astype(int)


def distance_forest(nodes: DataFrame) -> DataFrame:
    """Edges ``u, v, d`` that connect the nodes at every distance threshold.

    Each pair of blocks contributes the spanning tree of its own rows. A spanning forest of a
    part keeps the part's threshold components, so the union keeps those of the complete graph
    although only block-size edges leave a task.
    """
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        idx, x = pdf["idx"].to_numpy(), codes(pdf["sequence"])
        if len(idx) < 2:
            return pd.DataFrame({"u": [], "v": [], "d": []}).astype("int64")
        a, b, d = _local_forest(compare(x, x, None)[1])
        return pd.DataFrame({"u": np.maximum(idx[a], idx[b]), "v": np.minimum(idx[a], idx[b]), "d": d})

    placed = block_pairs(_placed(nodes.select("idx", "sequence"), "idx"), "idx", "__block", "__blocks")
    return placed.groupBy("__lo", "__hi").applyInPandas(work, "u bigint, v bigint, d bigint").distinct()


def _gaps(placed: DataFrame) -> DataFrame:
    """One row for each pair of blocks that are no neighbours: the largest height between them."""
    peaks = cut(placed.groupBy("__block", "__blocks").agg(F.max("height").alias("peak")), "block-peaks")
    after = peaks.select(F.col("__block").alias("__lo"), F.explode(F.sequence(
        F.lit(0), F.col("__blocks") - 1)).alias("__hi")).where("__lo < __hi")
    between = Window.partitionBy("__lo").orderBy("__hi").rowsBetween(Window.unboundedPreceding, -1)
    return (after.join(peaks.select(F.col("__block").alias("__hi"), "peak"), "__hi")
            .select("__lo", "__hi", F.max("peak").over(between).alias("height")).where("height IS NOT NULL"))


def _meeting(left: pd.DataFrame, right: pd.DataFrame, gap: int) -> np.ndarray:
    """Heights at which the rows of one block meet those of another, or of the same block; rows are in order."""
    if left is right:
        h = left["height"].to_numpy()
        above = np.maximum.accumulate(np.triu(np.broadcast_to(h, (len(h), len(h))), 1), axis=1)
        return np.maximum(above, above.T)
    tail = left["height"].to_numpy()[1:][::-1]
    leaving = np.r_[np.maximum.accumulate(tail)[::-1], 0].astype("int64")
    coming = np.maximum.accumulate(right["height"].to_numpy())
    return np.maximum(np.maximum(leaving[:, None], coming[None, :]), gap)


def spanning_network(nodes: DataFrame, epsilon: float = 0) -> DataFrame:
    """Every edge that joins different components of the graph of edges shorter than d - epsilon.

    With ``epsilon`` 0 this is the union of all minimum spanning trees. With a tolerance it is
    our reading of the minimum spanning network of Bandelt et al. (1999). ``nodes`` has idx and
    sequence; the result ``u < v, distance`` leaves the block tasks already filtered, so the
    complete distance matrix is never written.

    Blocks are runs of the order of the merge tree. Two nodes come together at the largest height
    between them, which a pair of blocks knows from its own heights and one number for all
    blocks between; so a node carries its place and its height and nothing for each threshold.
    """
    if not 0 <= epsilon <= 9999:
        raise ValueError("epsilon must be between 0 and 9999")
    nodes = nodes.select("idx", "sequence")
    order = merge_order(distance_forest(nodes)).withColumnRenamed("node", "idx")
    placed = _placed(cut(nodes.join(order, "idx"), "merge-placed"), "idx", "pos")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        between = pdf["idx"].isna()
        gap = int(pdf.loc[between, "height"].max()) if between.any() else 0
        pdf = pdf[~between].sort_values("pos")
        left, right, _ = _split(pdf)
        d = compare(codes(left["sequence"]), codes(right["sequence"]), None)[1]
        li, ri = left["idx"].to_numpy(dtype="int64"), right["idx"].to_numpy(dtype="int64")
        a, b = np.nonzero((_meeting(left, right, gap) >= d - epsilon) & (li[:, None] != ri[None, :]))
        u, v = np.minimum(li[a], ri[b]), np.maximum(li[a], ri[b])
        return pd.DataFrame({"u": u, "v": v, "distance": d[a, b]}).drop_duplicates(["u", "v"])

    every = block_pairs(placed, "idx", "__block", "__blocks").drop("__blocks").unionByName(
        _gaps(placed), allowMissingColumns=True)
    return every.groupBy("__lo", "__hi").applyInPandas(work, "u bigint, v bigint, distance bigint")


def tie_classes(network: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(settled, tied)`` edges of a network by what equally long edges can do to a spanning tree.

    All shorter edges are contracted, once for every tree order: ``cu`` and ``cv`` are the ends'
    components below the edge's length. Edges of one length in one component are a class; where
    a class is a tree of contracted ends, every spanning tree of minimal length takes all of it.
    Edges inside a contracted end are in neither table: no minimal tree has them.
    """
    edges = cut(network.select("u", "v", "distance"), "tie-edges")
    links = cut(merge_links(edges.select("u", "v", F.col("distance").alias("d"))), "merge-links")
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"), "distance").distinct().withColumn("at", F.col("node"))
    below = climb(ends, "at", links, lambda height: height < F.col("distance"))
    inside = climb(below.withColumn("c", F.col("at")), "at", links, lambda height: height <= F.col("distance"))
    def end(node: str, to: str, *more) -> DataFrame:
        return inside.select(F.col("node").alias(node), "distance", F.col("c").alias(to), *more)
    joined = (edges.join(end("u", "cu", F.col("at").alias("class")), ["u", "distance"]).join(end("v", "cv"), ["v", "distance"])
              .where("cu <> cv"))
    vertices = joined.select("distance", "class", F.explode(F.array("cu", "cv")).alias("c")).distinct().groupBy("distance", "class").agg(
        F.count(F.lit(1)).alias("vertices"))
    sizes = joined.groupBy("distance", "class").agg(F.count(F.lit(1)).alias("links")).join(vertices, ["distance", "class"])
    marked = cut(joined.join(sizes.select("distance", "class", (F.col("links") < F.col("vertices")).alias("settled")), ["distance", "class"]),
                 "tie-classes")
    return marked.where("settled").select("u", "v", "distance"), marked.where("NOT settled").select("u", "v", "distance", "cu", "cv")


def random_mst_frequency(network: DataFrame, replicates: int, seed: int) -> DataFrame:
    """How often each edge appears in a minimum spanning tree built under a random node order.

    Ties between equally long edges follow the random order of their ends, so only edges of the
    exact network can ever be chosen. Only edges in tie classes are drawn, one keyed forest for
    each replicate and length over the contracted ends; the others are in every tree.
    """
    if not 1 <= replicates <= 1000:
        raise ValueError("replicates must be between 1 and 1000")
    def draw(node: str) -> F.Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(node).cast("string")))
    settled, tied = tie_classes(network)
    keyed = (tied.select(F.col("u").alias("a"), F.col("v").alias("b"), "distance", F.col("cu").alias("u"), F.col("cv").alias("v"),
                         F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
             .withColumn("__a", draw("a")).withColumn("__b", draw("b"))
             .withColumn("lo", F.least("__a", "__b")).withColumn("hi", F.greatest("__a", "__b")))
    forest = spanning_forest(keyed, ["rep", "distance"], ["lo", "hi", "a", "b"])
    drawn = forest.groupBy(F.col("a").alias("u"), F.col("b").alias("v"), "distance").agg(F.count(F.lit(1)).alias("count"))
    return (settled.withColumn("count", F.lit(replicates).cast("bigint")).unionByName(drawn)
            .withColumn("frequency", F.col("count") / F.lit(float(replicates))))


def base_token(base: F.Column) -> F.Column:
    """Mutation tokens use plain letters; a gap is spelled out."""
    return F.when(base == "-", "GAP").otherwise(base)


def mutations_from_alignment(samples: DataFrame, mask: DataFrame | None = None,
                             reference: str | None = None) -> DataFrame:
    """Differences to the reference sample (the first one by default): sample_idx, pos, ref, alt."""
    ref_row = samples.where(F.col("sample") == reference) if reference is not None else samples
    ref = ref_row.agg(F.min_by(F.upper("sequence"), "sample_idx")).scalar()
    pairs = (samples.select("sample_idx", "sample", F.split(F.upper("sequence"), "").alias("s"),
                            F.split(ref, "").alias("r"))
             .select("sample_idx", "sample", F.posexplode(F.arrays_zip("s", "r")).alias("p", "z"))
             .where(F.col("z.s") != F.col("z.r"))
             .select("sample_idx", "sample", (F.col("p") + 1).cast("bigint").alias("pos"),
                     base_token(F.col("z.r")).alias("ref"), base_token(F.col("z.s")).alias("alt")))
    return pairs.join(mask.select("pos"), "pos", "left_semi") if mask is not None else pairs


def mutation_tokens(mutations: DataFrame) -> DataFrame:
    """``pos(SNP:ref->alt);...`` per sample; bounded by the alignment length."""
    token = F.concat(F.col("pos").cast("string"), F.lit("(SNP:"), "ref", F.lit("->"), "alt", F.lit(")"))
    return mutations.groupBy("sample_idx", "sample").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("pos", token.alias("t")))), lambda x: x["t"]), ";").alias("tokens"))


def mutation_sets(nodes: DataFrame, mutations: DataFrame) -> DataFrame:
    """Mutation table restricted to one representative per haplotype: idx, pos, alt."""
    return mutations.join(nodes.select(F.col("idx").alias("sample_idx")), "sample_idx", "left_semi").select(
        F.col("sample_idx").alias("idx"), "pos", "alt")


def inclusion_network(haplotypes: DataFrame, sets: DataFrame) -> DataFrame:
    """Parent of each haplotype: the largest strict subset of its mutations.

    ``haplotypes`` has idx, n and date. Ties go to the earlier date, the higher count and the
    lower idx; the reference (no mutations) roots the network. Our tie rule, after Li et al.
    (2023). Candidates meet on the *rarest* mutation of the smaller set, so a mutation carried by
    a third of all haplotypes brings together few pairs.
    """
    spread = sets.groupBy("pos", "alt").agg(F.count(F.lit(1)).alias("carriers"))
    token = F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("alt"))
    packed = cut(sets.join(spread, ["pos", "alt"]).groupBy("idx").agg(
        F.sort_array(F.collect_list(token)).alias("tokens"), F.count(F.lit(1)).alias("size"),
        F.min_by(token, F.struct("carriers", token.alias("t"))).alias("rarest")), "mutation-sets")
    child = sets.select(F.col("idx").alias("child"), token.alias("rarest"))
    sized = packed.select(F.col("idx").alias("child"), F.col("size").alias("child_size"), F.col("tokens").alias("child_tokens"))
    parent = packed.select(F.col("idx").alias("parent"), "size", "tokens", "rarest")
    pairs = (child.join(parent, "rarest").where("child <> parent").drop("rarest")
             .join(sized, "child").where("size < child_size")
             .where(F.size(F.array_except("tokens", "child_tokens")) == 0)
             .join(haplotypes.select(F.col("idx").alias("parent"), "n", "date"), "parent")
             .select("child", "parent", "size", "n", "date"))
    best = pairs.groupBy("child").agg(F.min(F.struct(
        (-F.col("size")).alias("s"), "date", (-F.col("n")).alias("f"), "parent"))["parent"].alias("parent"))
    root = (haplotypes.join(packed.select("idx"), "idx", "left_anti").agg(F.min("idx"))).scalar()
    size_of = packed.select(F.col("idx").alias("parent"), F.col("size").alias("parent_size"))
    return (sized.select("child", "child_size").join(best, "child", "left")
            .withColumn("parent", F.coalesce("parent", root))
            .join(size_of, "parent", "left").where("parent IS NOT NULL")
            .select("parent", "child", (F.col("child_size") - F.coalesce("parent_size", F.lit(0))).alias("distance")))


def alias_samples(samples: DataFrame, index: str) -> DataFrame:
    """Private aliases S0000001, ... in input order."""
    return samples.withColumn("alias", F.format_string("S%07d", F.col(index)))


def resolve_aliases(aliases: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(resolved, unknown)``: names for used aliases, and aliases nobody owns."""
    return (used.join(aliases.select("alias", "sample"), "alias"),
            used.select("alias").distinct().join(aliases, "alias", "left_anti"))


def refresh_metadata(assignments: DataFrame, traits: DataFrame) -> DataFrame:
    """Group and value per assigned sample after a metadata change; topology is not touched."""
    keep = assignments.select(F.trim("sample").alias("sample"), F.trim("haplotype").alias("haplotype")).where(
        "sample <> '' AND haplotype <> ''")
    joined = keep.join(traits.select(F.trim("sample").alias("sample"), "discrete", "continuous"), "sample", "left")
    return joined.select("sample", "haplotype",
                         F.coalesce(F.nullif(F.trim("discrete"), F.lit("")), F.lit("Default")).alias("grp"),
                         F.coalesce(F.trim("continuous"), F.lit("")).alias("value"))


def viewer_field(col: F.Column) -> F.Column:
    return F.translate(single_line(col), ";", "_")
