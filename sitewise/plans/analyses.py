"""Composed analyses: each returns the tables of one report, all of them lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewise.functions.transforms import Conversion, convert_column
from sitewise.operators import distance as ds
from sitewise.operators import diversity as dv
from sitewise.operators import haplotypes as hp
from sitewise.operators import network as nw
from sitewise.operators import ordination as od
from sitewise.operators import quality as ql
from sitewise.operators import samples as sm
from sitewise.operators import structure as st
from sitewise.operators import topology as tp
from sitewise.operators.blocks import block_scores, cut_points, decompose
from sitewise.operators.scan import numbered
from sitewise.schema import COMPLETE
from sitewise.storage import cut


def require_alignment(samples: DataFrame, alphabet: str | None = None) -> None:
    """Raise unless names are unique and sequences are non-empty, equally long and of the alphabet."""
    facts = sm.validate_alignment(samples).first()
    if not facts["aligned"]:
        raise ValueError(f"not an alignment: {facts.asDict()}")
    if alphabet:
        bad = sm.symbol_violations(samples, alphabet).orderBy("sample_idx").limit(5).collect()
        if bad:
            raise ValueError("unsupported symbols: " + "; ".join(f"{r['sample']}: {r['symbols']}" for r in bad))


def analyze_diversity(samples: DataFrame, group: str | None, policy: str = COMPLETE,
                      permutations: int = 999, seed: int = 1729) -> dict[str, DataFrame]:
    """Quality, diversity, differentiation and warnings of an alignment."""
    require_alignment(samples, "diversity")
    table = cut(dv.group_diversity(samples, group, policy), "group-diversity")
    warnings = dv.diversity_warnings(table, policy)
    bins = dv.mismatch_distribution(samples, group)
    out = {
        "sample_quality": ql.sample_quality(samples), "site_quality": ql.site_quality(samples, policy),
        "quality": ql.quality_report(samples, policy), "diversity": table,
        "mismatch": bins, "mismatch_summary": dv.mismatch_summary(bins),
    }
    if group:
        out |= {"private_haplotypes": dv.private_haplotypes(samples, group),
                "pairwise_fst": st.pairwise_fst(samples, group, policy),
                "global_fst": st.global_fst(samples, group, policy), "amova": st.amova(samples, group),
                "permutation": st.permutation_test(samples, group, permutations, seed, policy)}
    out["warnings"] = warnings.unionByName(st.structure_warnings(samples, group, policy))
    return out


def analyze_distance(samples: DataFrame, min_sites: int = 1, min_coverage: float = 0.5,
                     axes: int = 2) -> dict[str, DataFrame]:
    """Distances of distinct sequences (with their multiplicity) and their ordination."""
    require_alignment(samples)
    rows = cut(ds.distinct_sequences(samples), "distinct")
    pairs = cut(ds.p_distance(rows, min_sites, min_coverage), "pairs")
    coordinates, spectrum = od.pcoa(pairs, rows, axes)
    members = samples.select("sample_idx", "sample", F.sha2(ds.as_dna(F.col("sequence")), 256).alias("f")).join(
        rows.select("idx", F.sha2("sequence", 256).alias("f")), "f").drop("f")
    facts = ds.distance_summary(pairs)
    warnings = facts.where("unavailable > 0").select(F.lit("distance").alias("scope"), F.lit("pairs_below_coverage").alias("code")).unionByName(
        sm.symbol_violations(samples, "distance").limit(1).select(F.lit("distance").alias("scope"), F.lit("unrecognised_symbols").alias("code"))).unionByName(od.ordination_warnings(spectrum, rows, facts))
    return {"sequences": rows, "members": members, "pairs": pairs, "called": ds.called_sites(rows), "summary": facts,
            "low_coverage": ds.low_coverage_examples(pairs), "coordinates": coordinates, "spectrum": spectrum, "warnings": warnings}


def sample_distances(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The matrix of every two samples (sample_idx i < j) from distances of distinct sequences.

    The result is quadratic in the samples; statistics should use ``pairs`` and multiplicities.
    """
    both = pairs.select("i", "j", "distance").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    own = members.select("idx").distinct().select(F.col("idx").alias("i"), F.col("idx").alias("j"), F.lit(0.0).alias("distance"))
    left = members.select(F.col("idx").alias("i"), F.col("sample_idx").alias("a"))
    right = members.select(F.col("idx").alias("j"), F.col("sample_idx").alias("b"))
    return both.unionByName(own).join(left, "i").join(right, "j").where("a < b").select("a", "b", "distance")


def analyze_topology(nodes: DataFrame, edges: DataFrame, members: DataFrame, assignments: DataFrame,
                     traits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Graph, node and edge metrics with haplotype annotations and roles."""
    nodes, edges = cut(nodes, "nodes"), cut(edges, "edges")  # every rule and measure below reads them
    problems = tp.validate_network(nodes, edges)
    first = problems.limit(5).collect()
    if first:
        raise ValueError("invalid network: " + ", ".join(f"{r['code']} {r['ref']}" for r in first))
    if "is_intermediate" not in nodes.columns:
        nodes = tp.flag_intermediate(nodes, "frequency")
    components = cut(tp.connected_components(nodes, edges), "components")
    structure = decompose(edges)
    scores = block_scores(structure)
    node_between, edge_between = tp.betweenness(nodes, edges, structure, scores)
    bridges, articulation = cut_points(structure)
    annotated = cut(tp.annotate_nodes(nodes, members, assignments), "annotated")
    flag = articulation.withColumn("articulation_point", F.lit(True))
    metrics = (annotated.join(tp.node_degree(nodes, edges), "node_id").join(tp.closeness(nodes, structure, scores), "node_id")
               .join(node_between, "node_id").join(components, "node_id").join(flag, "node_id", "left")
               .withColumn("articulation_point", F.coalesce("articulation_point", F.lit(False))))
    metrics = cut(metrics, "node-metrics")
    edge_metrics = (tp.label_edges(edges, annotated).join(edge_between, "edge_index")
                    .join(bridges.withColumn("bridge", F.lit(True)), "edge_index", "left")
                    .withColumn("bridge", F.coalesce("bridge", F.lit(False))))
    out = {"graph": tp.graph_metrics(nodes, edges, components), "nodes": metrics, "edges": edge_metrics,
           "roles": tp.structural_role(metrics), "degree_histogram": tp.degree_histogram(metrics),
           "hubs": tp.hub_ranking(metrics), "dominant": tp.dominant_haplotype(metrics),
           "bridges": edge_metrics.where("bridge AND source_haplotype <> '' AND target_haplotype <> ''"),
           "unmapped": tp.unmapped_nodes(annotated)}
    if traits is not None:
        out["node_traits"] = tp.node_trait_values(members, traits)
    return out


def build_network(samples: DataFrame, method: str = "rmst", *, epsilon: float = 0, replicates: int = 100, seed: int = 1729,
                  exclude_ambiguous: bool = True, reference: str | None = None,
                  dates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Haplotype network by ``rmst``, ``rmst_random``, ``msn`` or ``inclusion``: nodes, members, edges."""
    require_alignment(samples)
    nodes, members = ds.network_haplotypes(samples, exclude_ambiguous, as_rna=method == "inclusion")
    if method in ("rmst", "msn"):
        edges = nw.spanning_network(nodes, epsilon if method == "msn" else 0)
    elif method == "rmst_random":
        edges = nw.random_mst_frequency(cut(nw.spanning_network(nodes), "network"), replicates, seed)
    elif method == "inclusion":
        mask = ds.site_mask(samples, exclude_ambiguous)
        sets = cut(nw.mutation_sets(nodes, nw.mutations_from_alignment(samples, mask, reference)), "sets")
        dated = dates if dates is not None else nodes.select("idx", F.lit("2000-01-01").alias("date"))
        edges = nw.inclusion_network(nodes.select("idx", "n").join(dated, "idx", "left").withColumn(
            "date", F.coalesce("date", F.lit("9999-12-31"))), sets)
    else:
        raise ValueError(f"unknown method {method!r}")
    return {"nodes": nodes, "members": members, "edges": edges}


def network_tables(network: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A built network as ``(nodes, members, edges)`` in the form the topology and sinks take."""
    nodes = network["nodes"].select(F.col("idx").alias("node_id"), F.lit(None).cast("string").alias("label"),
                                    F.col("n").cast("double").alias("frequency"))
    members = network["members"].select(F.col("idx").alias("node_id"), F.col("sample_idx").alias("ord"), "sample")
    ends = ("parent", "child") if "parent" in network["edges"].columns else ("u", "v")
    # dense edge numbers in endpoint order; an edge is unique per pair of ends
    ends_of = network["edges"].select(F.col(ends[0]).alias("source"), F.col(ends[1]).alias("target"), F.col("distance").cast("double").alias("distance"))
    edges = numbered(ends_of, ["source", "target"], "edge_index")
    return nodes, members, edges


@dataclass(frozen=True)
class TraitColumn:
    column: str
    name: str
    kind: str = "discrete"
    conversion: Conversion = field(default_factory=Conversion)


def calculate_haplotypes(samples: DataFrame, traits: DataFrame) -> dict[str, DataFrame]:
    """Haplotypes, assignments and their trait summaries."""
    require_alignment(samples, "haplotype")
    haplotypes, assignments = hp.identify_haplotypes(samples)
    with_traits = hp.haplotype_traits(cut(assignments, "assignments"), traits)
    return {"haplotypes": haplotypes, "assignments": with_traits,
            "summary": hp.haplotype_summary(with_traits), "values": hp.haplotype_trait_values(with_traits)}


def import_metadata(samples: DataFrame, meta: DataFrame, name: str, columns: list[TraitColumn],
                    existing: DataFrame | None = None) -> dict[str, DataFrame]:
    """Validate, convert and attach a wide metadata table; values come back in long form.

    ``errors`` lists cells that cannot be converted, ``differences`` names on one side only,
    ``duplicates`` repeated samples; ``traits`` is the merged long table.
    """
    names = [c.name.strip() for c in columns]
    if not columns or any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError("trait columns need distinct, non-empty names")
    if name in {c.column for c in columns} or not any(c.kind == "discrete" for c in columns):
        raise ValueError("the name column is no trait, and at least one discrete trait is required")
    usable = meta.withColumn("sample", F.trim(name)).where("sample <> ''")
    errors: DataFrame | None = None
    parts: list[DataFrame] = []
    for c in columns:
        if c.kind == "continuous":
            done = convert_column(usable, c.column, c.conversion, "__value")
            value = F.coalesce(F.col("__value").cast("string"), F.lit(""))
            bad = done.where("__value_error").select(F.lit(c.name).alias("trait"), "sample", F.col(c.column).cast("string").alias("value"))
            errors = bad if errors is None else errors.unionByName(bad)
            parts.append(done.select("sample", F.lit(c.name).alias("trait"), value.alias("value")))
        else:
            parts.append(usable.select("sample", F.lit(c.name).alias("trait"), F.trim(F.coalesce(F.col(c.column).cast("string"), F.lit(""))).alias("value")))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    merged = sm.merge_traits(existing, long) if existing is not None else long
    if errors is None:
        errors = long.limit(0).select("trait", "sample", "value")
    return {"traits": merged, "errors": errors, "duplicates": sm.duplicates(usable, "sample"),
            "differences": sm.name_differences(samples, usable)}
