"""Descriptive topology of a haplotype network (undirected projection)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.operators.blocks import Structure, distance_sums, pair_counts
from sitewise.operators.graph import component_labels
from sitewise.storage import cut, dense_index


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("edge_index", "distance",
                        F.explode(F.array("source", "target")).alias("node_id"))


def _arcs(edges: DataFrame) -> DataFrame:
    return edges.select("edge_index", F.col("source").alias("u"), F.col("target").alias("v"), "distance").unionByName(
        edges.select("edge_index", F.col("target").alias("u"), F.col("source").alias("v"), "distance"))


def validate_network(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Integrity violations as rows ``code, ref``."""
    text = lambda c: F.col(c).cast("string")
    known = nodes.select("node_id").distinct()
    duplicate = (nodes.groupBy("node_id").count().where("count > 1")
                 .select(F.lit("duplicate_node").alias("code"), text("node_id").alias("ref")))
    bad_freq = (nodes.where("frequency IS NULL OR isnan(frequency) OR frequency < 0 OR frequency = double('inf')")
                .select(F.lit("bad_frequency").alias("code"), text("node_id").alias("ref")))
    dangling = (_ends(edges).join(known, "node_id", "left_anti").select("edge_index").distinct()
                .select(F.lit("dangling_edge").alias("code"), text("edge_index").alias("ref")))
    loops = edges.where("source = target").select(F.lit("self_loop").alias("code"), text("edge_index").alias("ref"))
    pair = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    parallel = (pair.where("a <> b").groupBy("a", "b").count().where("count > 1")
                .select(F.lit("parallel_edge").alias("code"), F.concat_ws("-", "a", "b").alias("ref")))
    distance = (edges.where("distance IS NULL OR isnan(distance) OR distance <= 0 OR distance = double('inf')")
                .select(F.lit("bad_distance").alias("code"), text("edge_index").alias("ref")))
    indexes = (edges.groupBy("edge_index").count().where("count > 1")
               .select(F.lit("duplicate_edge_index").alias("code"), text("edge_index").alias("ref")))
    out = duplicate
    for part in (bad_freq, dangling, loops, parallel, distance, indexes):
        out = out.unionByName(part)
    return out


def flag_intermediate(nodes: DataFrame, rule: str, members: DataFrame | None = None,
                      groups: DataFrame | None = None) -> DataFrame:
    """``frequency``: declared frequency <= 0, or a label that is present but empty.

    ``viewer``: the first member starts with ``IN`` and every active group is ``Default``.
    """
    if rule == "frequency":
        empty = F.col("label").isNotNull() & (F.trim("label") == "")
        return nodes.withColumn("is_intermediate", F.coalesce(F.col("frequency") <= 0, F.lit(False)) | empty)
    if rule != "viewer":
        raise ValueError("rule is 'frequency' or 'viewer'")
    first = members.groupBy("node_id").agg(F.min_by(F.trim("sample"), "ord").alias("first"))
    plain = (members.join(groups, "sample", "left").groupBy("node_id")
             .agg(F.bool_and(F.coalesce("grp", F.lit("Default")) == "Default").alias("plain")))
    return (nodes.join(first, "node_id", "left").join(plain, "node_id", "left")
            .withColumn("is_intermediate", F.coalesce(F.col("first").rlike("^IN") & F.col("plain"), F.lit(False)))
            .drop("first", "plain"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node_id, component`` numbered by the first node of each component."""
    labels = component_labels(edges.select(F.col("source").alias("u"), F.col("target").alias("v")))
    tagged = (nodes.select("node_id").join(labels.withColumnRenamed("node", "node_id"), "node_id", "left")
              .withColumn("label", F.coalesce("label", "node_id")))
    tagged = cut(tagged, "components")
    numbers = dense_index(tagged.select("label").distinct(), "label", "component")
    return tagged.join(numbers, "label").select("node_id", "component")


def graph_metrics(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    size = nodes.agg(F.count(F.lit(1)).alias("node_count"),
                     F.count_if(~F.col("is_intermediate")).alias("observed_node_count"))
    m = edges.agg(F.count(F.lit(1))).scalar()
    c = components.agg(F.coalesce(F.max("component"), F.lit(0))).scalar()
    n = F.col("node_count")
    return (size.withColumn("edge_count", m).withColumn("component_count", c)
            .withColumn("density", F.when(n < 2, 0.0).otherwise(
                2.0 * F.col("edge_count") / (n * (n - 1)).cast("double")))
            .withColumn("cycle_rank", F.when(n > 0, F.col("edge_count") - n + F.col("component_count")).otherwise(0))
            .withColumn("intermediate_node_count", n - F.col("observed_node_count")))


def node_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and summed mutation distance; isolated nodes have zero."""
    per = _ends(edges).groupBy("node_id").agg(
        F.count(F.lit(1)).alias("degree"), F.sum("distance").alias("distance_sum"))
    return (nodes.select("node_id").join(per, "node_id", "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0)))
            .withColumn("distance_sum", F.coalesce("distance_sum", F.lit(0.0))))


def closeness(nodes: DataFrame, structure: Structure, scores: DataFrame) -> DataFrame:
    """r/sum(d) * r/(N-1) with r the number of reachable other nodes; 0 when isolated.

    Sums come from the blocks of the network (``blocks.distance_sums``): linear rows, no pairs.
    """
    per = distance_sums(structure, scores).select(
        F.col("node").alias("node_id"), F.col("reached").cast("double").alias("r"), F.col("total").alias("d"))
    n = nodes.agg(F.count(F.lit(1))).scalar()
    ok = (F.col("n") > 1) & (F.col("r") > 0) & (F.col("d") > 0)
    return (nodes.select("node_id").join(per, "node_id", "left").withColumn("n", n)
            .select("node_id", F.when(ok, F.col("r") / F.col("d") * F.col("r") / (F.col("n") - 1)).otherwise(0.0).alias("closeness")))


def betweenness(nodes: DataFrame, edges: DataFrame, structure: Structure, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weighted node and edge betweenness, normalised for a simple undirected graph.

    Bridges, trees and cut vertices count in closed form, other paths inside their block.
    """
    node_pairs, edge_pairs = pair_counts(structure, scores)
    n = nodes.agg(F.count(F.lit(1)).cast("double")).scalar()
    node_out = (nodes.select("node_id").join(node_pairs.withColumnRenamed("node", "node_id"), "node_id", "left").withColumn("n", n)
                .select("node_id", F.when(F.col("n") > 2, F.coalesce("pairs", F.lit(0.0))
                                          / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0).alias("betweenness")))
    edge_out = (edges.select("edge_index").join(edge_pairs, "edge_index", "left").withColumn("n", n)
                .select("edge_index", (F.coalesce("pairs", F.lit(0.0)) / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0.0)))
                        .alias("betweenness")))
    return node_out, edge_out


def annotate_nodes(nodes: DataFrame, members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Haplotype of each node: the only distinct one of its members, else a known label."""
    clean = assignments.select(F.trim("sample").alias("sample"), F.trim("haplotype").alias("haplotype")).where(
        "sample <> '' AND haplotype <> ''")
    per = (members.join(clean, "sample").groupBy("node_id")
           .agg(F.min("haplotype").alias("lo"), F.max("haplotype").alias("hi")))
    known = clean.select(F.col("haplotype").alias("label")).distinct().withColumn("known", F.lit(True))
    return (nodes.join(per, "node_id", "left").join(known, "label", "left")
            .withColumn("haplotype", F.when(F.col("lo") == F.col("hi"), F.col("lo"))
                        .when(F.col("known"), F.col("label")).otherwise(""))
            .drop("lo", "hi", "known"))


def node_trait_values(members: DataFrame, traits: DataFrame) -> DataFrame:
    """Distinct non-blank trait values per node in first-seen member order (long form)."""
    return (members.join(traits.select("sample", F.trim("trait").alias("trait"), F.trim("value").alias("value")), "sample")
            .where("trait <> '' AND value <> ''").groupBy("node_id", "trait", "value")
            .agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")))


def label_edges(edges: DataFrame, annotated: DataFrame) -> DataFrame:
    def side(s: str) -> DataFrame:
        return annotated.select(F.col("node_id").alias(s), F.col("haplotype").alias(f"{s}_haplotype"))
    return edges.join(side("source"), "source").join(side("target"), "target")


def structural_role(metrics: DataFrame) -> DataFrame:
    """Role labels of mapped nodes (columns haplotype, frequency, degree, articulation_point)."""
    mapped = metrics.where("haplotype <> ''")
    top = mapped.agg(F.max("frequency").alias("f"), F.max("degree").alias("d"))
    out = mapped.withColumn("__f", top.select("f").scalar()).withColumn("__d", top.select("d").scalar())
    roles = F.concat_ws(
        "; ",
        F.when((F.col("__f") > 0) & (F.col("frequency") == F.col("__f")), "Most frequent"),
        F.when((F.col("__d") > 0) & (F.col("degree") == F.col("__d")), "Highest-degree node"),
        F.when(F.col("articulation_point"), "Articulation/structural bridge"))
    return out.withColumn("role", F.when(roles == "", "Peripheral/general").otherwise(roles)).drop("__f", "__d")


def degree_histogram(metrics: DataFrame) -> DataFrame:
    return metrics.where("haplotype <> ''").groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def hub_ranking(metrics: DataFrame, k: int = 20) -> DataFrame:
    return (metrics.where("haplotype <> '' AND betweenness > 0")
            .orderBy(F.desc("betweenness"), "node_id").limit(k))


def dominant_haplotype(metrics: DataFrame) -> DataFrame:
    """The mapped node with the largest frequency, then degree, then the earliest node."""
    best = F.max_by(F.struct("node_id", "haplotype", "frequency", "degree"),
                    F.struct("frequency", "degree", -F.col("node_id")))
    return metrics.where("haplotype <> ''").agg(best.alias("b")).where("b IS NOT NULL").select("b.*")


def mapped_bridges(labelled: DataFrame, bridges: DataFrame) -> DataFrame:
    return (labelled.join(bridges, "edge_index", "left_semi")
            .where("source_haplotype <> '' AND target_haplotype <> ''"))


def unmapped_nodes(annotated: DataFrame) -> DataFrame:
    return annotated.agg(F.count_if(~F.col("is_intermediate") & (F.col("haplotype") == "")).alias("unmapped_observed"),
                         F.count_if(F.col("haplotype") != "").alias("mapped"))


def search_nodes(nodes: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """First node (in order) with a member or haplotype containing ``text``, any case."""
    needle = text.strip().lower()
    hits = (members.where(F.lower(F.trim("sample")).contains(needle)).select("node_id")
            .unionByName(nodes.where(F.lower("haplotype").contains(needle)).select("node_id")))
    return nodes.join(hits.distinct(), "node_id", "left_semi").orderBy("node_id").limit(1)


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove nodes and the edges incident to them."""
    kept = edges.join(gone.select(F.col("node_id").alias("source")), "source", "left_anti").join(
        gone.select(F.col("node_id").alias("target")), "target", "left_anti")
    return nodes.join(gone, "node_id", "left_anti"), kept


def drop_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove edges named by unordered endpoint pairs ``a, b``."""
    pairs = gone.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b"))
    return (edges.withColumn("__a", F.least("source", "target")).withColumn("__b", F.greatest("source", "target"))
            .join(pairs, ["__a", "__b"], "left_anti").drop("__a", "__b"))
