"""Allele counts, haplotype and nucleotide diversity, Tajima's D, mismatch distributions.

Everything that the literature defines over sample pairs is computed from allele counts where
an exact closed form exists; only pairwise deletion and mismatch histograms need pairs, and
those are taken over distinct sequences with multiplicities (see ``pairs``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.functions.sequence import (
    as_dna, cells, harmonic, is_callable, site_runs, tajima_d, take_sites)
from sitewise.operators.haplotypes import collapse
from sitewise.operators.pairs import group_pair_sums, mismatch_counts
from sitewise.schema import COMPLETE, MISSING_GROUP, OVERALL, PAIRWISE, check_policy
from sitewise.storage import cut, dense_index


def group_label(group: str | Column) -> Column:
    col = F.col(group) if isinstance(group, str) else group
    return F.coalesce(F.nullif(F.trim(col), F.lit("")), F.lit(MISSING_GROUP))


def grouped(samples: DataFrame, group: str | None) -> DataFrame:
    """Samples with a normalised sequence and a group label ``grp``."""
    label = group_label(group) if group else F.lit(OVERALL)
    return samples.select("sample_idx", "sample", label.alias("grp"),
                          as_dna(F.col("sequence")).alias("sequence"))


def site_counts(samples: DataFrame, group: str | None = None) -> DataFrame:
    """Allele-count cube: symbol counts per site, overall and per group, in one pass.

    The cells are combined before the shuffle to at most groups x sites x symbols rows per
    task; the overall rows are rolled up from that small table.
    """
    counts = (cells(grouped(samples, group), "grp", normalise=False)
              .groupBy("grp", "pos", "base").agg(F.count(F.lit(1)).alias("n")))
    if group is None:
        return counts.select(F.lit("overall").alias("scope"), "grp", "pos", "base", "n")
    return (counts.groupingSets([["pos", "base"], ["grp", "pos", "base"]], "grp", "pos", "base")
            .agg(F.sum("n").alias("n"), F.grouping("grp").alias("__all"))
            .select(F.when(F.col("__all") == 1, "overall").otherwise("group").alias("scope"),
                    F.when(F.col("__all") == 1, OVERALL).otherwise(F.col("grp")).alias("grp"),
                    "pos", "base", "n"))


def scope_sites(counts: DataFrame) -> DataFrame:
    """Per scope and site: total and called samples, alleles and the number of differing pairs."""
    n = F.col("n").cast("double")
    called = is_callable(F.col("base"))
    sites = counts.groupBy("scope", "grp", "pos").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(called, F.col("n"))), F.lit(0)).alias("called"),
        F.count_if(called).alias("alleles"),
        F.coalesce(F.sum(F.when(called, n * n)), F.lit(0.0)).alias("__sq"))
    c = F.col("called").cast("double")
    return (sites.withColumn("pair_differences", (c * c - F.col("__sq")) / 2.0)
            .withColumn("complete", F.col("called") == F.col("total")).drop("__sq"))


def complete_sites(samples: DataFrame, group: str | None = None) -> DataFrame:
    """Sites callable in every member of each scope."""
    return (scope_sites(site_counts(samples, group)).where("complete")
            .select("scope", "grp", "pos", "alleles"))


def overall_complete(counts: DataFrame) -> DataFrame:
    return scope_sites(counts).where("scope = 'overall' AND complete").select("pos", "alleles")


def site_statistics(counts: DataFrame) -> DataFrame:
    """Per scope: the site sums from which both deletion policies follow."""
    seg = F.col("alleles") >= 2
    comp = F.col("complete")
    enough = F.col("called") >= 2
    zero = F.lit(0.0)
    return scope_sites(counts).groupBy("scope", "grp").agg(
        F.max("total").alias("n"),
        F.count_if(comp).alias("complete_sites"),
        F.count_if(comp & seg).alias("complete_segregating"),
        F.coalesce(F.sum(F.when(comp, F.col("pair_differences"))), zero).alias("pair_differences"),
        F.count_if(enough).alias("pairwise_sites"),
        F.count_if(enough & seg).alias("pairwise_segregating"),
        F.coalesce(F.sum(F.when(enough & seg, 1.0 / harmonic(F.col("called")))), zero)
        .alias("theta_sum"))


def segregating_sites(samples: DataFrame, group: str | None, policy: str) -> DataFrame:
    """Callable and segregating site counts per scope."""
    p = check_policy(policy)
    return site_statistics(site_counts(samples, group)).select(
        "scope", "grp", F.col("n").alias("sample_count"),
        F.col(f"{p}_sites").alias("callable_site_count"),
        F.col(f"{p}_segregating").alias("segregating_site_count"))


def _pairs_of(n: Column) -> Column:
    nd = n.cast("double")
    return nd * (nd - 1.0) / 2.0


def nucleotide_diversity(samples: DataFrame, group: str | None, policy: str) -> DataFrame:
    """pi per scope with the number of comparable pairs."""
    check_policy(policy)
    if policy == PAIRWISE:
        return pairwise_pi(samples, group)
    stats = site_statistics(site_counts(samples, group))
    usable = (F.col("n") >= 2) & (F.col("complete_sites") > 0)
    return stats.select(
        "scope", "grp",
        F.when(usable, _pairs_of(F.col("n"))).otherwise(0).cast("bigint")
        .alias("comparable_pair_count"),
        F.when(usable, F.col("pair_differences") / _pairs_of(F.col("n")) / F.col("complete_sites"))
        .alias("nucleotide_diversity"))


def pairwise_pi(samples: DataFrame, group: str | None) -> DataFrame:
    """pi under pairwise deletion: the mean p-distance of all comparable pairs."""
    sums = group_pair_sums(grouped(samples, group))
    within = sums.where("grp_a = grp_b").select(
        F.lit("group" if group else "overall").alias("scope"), F.col("grp_a").alias("grp"),
        "pairs", "distance_sum")
    if group:
        overall = sums.agg(F.sum("pairs").alias("pairs"), F.sum("distance_sum").alias("distance_sum"))
        within = within.unionByName(
            overall.select(F.lit("overall").alias("scope"), F.lit(OVERALL).alias("grp"),
                           "pairs", "distance_sum"))
    return within.select("scope", "grp", F.col("pairs").alias("comparable_pair_count"),
                         (F.col("distance_sum") / F.nullif("pairs", F.lit(0)))
                         .alias("nucleotide_diversity"))


def watterson_theta(samples: DataFrame, group: str | None, policy: str) -> DataFrame:
    check_policy(policy)
    stats = site_statistics(site_counts(samples, group))
    return stats.select("scope", "grp", _theta(policy).alias("watterson_theta"))


def _theta(policy: str) -> Column:
    n = F.col("n")
    if policy == COMPLETE:
        return F.when((n >= 2) & (F.col("complete_sites") > 0),
                      F.col("complete_segregating") / (harmonic(n) * F.col("complete_sites")))
    return F.when((n >= 2) & (F.col("pairwise_sites") > 0),
                  F.col("theta_sum") / F.col("pairwise_sites"))


def _k() -> Column:
    return F.when((F.col("n") >= 2) & (F.col("complete_sites") > 0),
                  F.col("pair_differences") / _pairs_of(F.col("n")))


def mean_pairwise_differences(samples: DataFrame, group: str | None) -> DataFrame:
    stats = site_statistics(site_counts(samples, group))
    return stats.select("scope", "grp", _k().alias("mean_pairwise_differences"))


def tajimas_d(samples: DataFrame, group: str | None) -> DataFrame:
    stats = site_statistics(site_counts(samples, group))
    return stats.select("scope", "grp",
                        F.col("complete_sites").alias("tajima_callable_site_count"),
                        tajima_d(F.col("n"), F.col("complete_segregating"), _k())
                        .alias("tajima_d"))


def signatures(samples: DataFrame, group: str | None, counts: DataFrame | None = None) -> DataFrame:
    """Distinct sequences over globally complete sites, per group, with counts and first sample."""
    counts = counts if counts is not None else cut(site_counts(samples, group), "site-counts")
    runs = site_runs(overall_complete(counts).select("pos"))
    masked = grouped(samples, group).withColumn("__runs", runs).withColumn(
        "sequence", take_sites(F.col("sequence"), F.col("__runs")))
    return collapse(masked, "grp")


def signature_labels(per_group: DataFrame) -> DataFrame:
    """Labels H1, H2, ... of signatures in first-observation order."""
    first = per_group.groupBy("fingerprint").agg(
        F.min("first_idx").alias("first_idx"), F.count(F.lit(1)).alias("groups"))
    return dense_index(first, "first_idx", "hap_idx").withColumn(
        "haplotype", F.concat(F.lit("H"), F.col("hap_idx").cast("string")))


def haplotype_metrics(per_group: DataFrame) -> DataFrame:
    """Richness, Hd and private counts per group and overall, from the signature table."""
    n = F.col("n").cast("double")
    across = per_group.groupBy("fingerprint").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    private = per_group.join(across.select("fingerprint", "groups"), "fingerprint")
    rows = (private.select(F.lit("group").alias("scope"), "grp", "n", "groups")
            .unionByName(across.select(F.lit("overall").alias("scope"),
                                       F.lit(OVERALL).alias("grp"), "n", "groups")))
    total = F.sum(n)
    return rows.groupBy("scope", "grp").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("haplotype_richness"),
        F.when(F.col("scope") == "group", F.count_if(F.col("groups") == 1))
        .alias("private_haplotype_count"),
        F.when(total >= 2, total / (total - 1.0) * (1.0 - F.sum(n * n) / (total * total)))
        .alias("haplotype_diversity"))


def haplotype_diversity(samples: DataFrame, group: str | None) -> DataFrame:
    out = haplotype_metrics(cut(signatures(samples, group), "signatures"))
    return out if group else out.where("scope = 'overall'")


def private_haplotypes(samples: DataFrame, group: str) -> DataFrame:
    """Signatures seen in one group only, in long form with their labels."""
    per_group = cut(signatures(samples, group), "signatures")
    labels = signature_labels(per_group).where("groups = 1").select("fingerprint", "haplotype")
    return per_group.join(labels, "fingerprint").select("grp", "haplotype", "n")


def group_diversity(samples: DataFrame, group: str | None, policy: str = COMPLETE) -> DataFrame:
    """One row per group plus ``Overall`` with every diversity statistic.

    Two passes over the sequences: allele counts, then signatures over the complete sites. Both
    small tables are written once, so the statistics never rescan the sequences.
    """
    check_policy(policy)
    counts = cut(site_counts(samples, group), "site-counts")
    stats = site_statistics(counts)
    haps = haplotype_metrics(cut(signatures(samples, group, counts), "signatures")).drop("n")
    if group is None:
        haps = haps.where("scope = 'overall'")
    joined = stats.join(haps, ["scope", "grp"])
    if policy == COMPLETE:
        usable = (F.col("n") >= 2) & (F.col("complete_sites") > 0)
        joined = joined.withColumn(
            "comparable_pair_count",
            F.when(usable, _pairs_of(F.col("n"))).otherwise(0).cast("bigint")
        ).withColumn("nucleotide_diversity", _k() / F.col("complete_sites"))
    else:
        joined = joined.join(pairwise_pi(samples, group), ["scope", "grp"], "left").withColumn(
            "comparable_pair_count", F.coalesce("comparable_pair_count", F.lit(0)))
    hap_sites = F.max(F.when(F.col("scope") == "overall", F.col("complete_sites"))).over(
        Window.partitionBy(F.lit(0)))  # one row per group
    return joined.select(
        F.col("grp").alias("label"), F.col("n").alias("sample_count"),
        F.col(f"{policy}_sites").alias("callable_site_count"),
        F.col(f"{policy}_segregating").alias("segregating_site_count"),
        "comparable_pair_count", hap_sites.alias("haplotype_site_count"),
        "haplotype_richness", "private_haplotype_count", "haplotype_diversity",
        "nucleotide_diversity", _theta(policy).alias("watterson_theta"),
        _k().alias("mean_pairwise_differences"),
        tajima_d(F.col("n"), F.col("complete_segregating"), _k()).alias("tajima_d"),
        F.col("complete_sites").alias("tajima_callable_site_count"))


def diversity_warnings(table: DataFrame, policy: str) -> DataFrame:
    """Warnings as rows, derived from the group diversity table."""
    n = F.col("sample_count")
    comp, hap = F.col("tajima_callable_site_count"), F.col("haplotype_site_count")
    pairwise = F.lit(policy == PAIRWISE)
    rules = [
        ("too_few_samples", n < 2),
        ("no_comparable_pair", (n >= 2) & (F.col("comparable_pair_count") == 0)),
        ("no_callable_site", (n >= 2) & (F.col("callable_site_count") == 0)),
        ("no_complete_site", (n >= 2) & (comp == 0)),
        ("tajima_undefined", (n >= 2) & (comp > 0) & F.col("tajima_d").isNull()),
        ("tajima_uses_complete_sites", pairwise & (comp > 0)),
        ("haplotypes_indistinct", hap == 0),
        ("haplotypes_use_complete_sites", pairwise & (hap > 0)),
    ]
    codes = F.array(*[F.when(cond, F.lit(code)) for code, cond in rules])
    return table.select(F.col("label").alias("scope"), F.explode(F.array_compact(codes)).alias("code"))


def mismatch_distribution(samples: DataFrame, group: str | None) -> DataFrame:
    """Bins of pairwise differences on scope-complete sites: pairs and their frequency."""
    bins = mismatch_counts(scoped_sequences(samples, group))
    total = F.sum("pair_count").over(Window.partitionBy("scope", "grp"))
    return bins.select("scope", "grp", "differences", "pair_count",
                       (F.col("pair_count") / total).alias("frequency"))


def mismatch_summary(bins: DataFrame) -> DataFrame:
    """Mean, population variance and smallest mode of each mismatch distribution."""
    d, c = F.col("differences").cast("double"), F.col("pair_count").cast("double")
    sums = bins.groupBy("scope", "grp").agg(
        F.sum("pair_count").alias("pair_count"),
        (F.sum(d * c) / F.sum(c)).alias("mean_differences"),
        F.max(F.struct(F.col("pair_count"), (-F.col("differences")).alias("neg"))).alias("__top"))
    spread = (bins.join(sums.select("scope", "grp", "mean_differences"), ["scope", "grp"])
              .groupBy("scope", "grp")
              .agg((F.sum(c * F.pow(d - F.col("mean_differences"), F.lit(2))) / F.sum(c))
                   .alias("variance_differences")))
    return (sums.join(spread, ["scope", "grp"])
            .withColumn("mode_differences", -F.col("__top.neg")).drop("__top"))


def scoped_sequences(samples: DataFrame, group: str | None) -> DataFrame:
    """Distinct sequences per scope over that scope's complete sites: scope, grp, sequence, n."""
    counts = cut(site_counts(samples, group), "site-counts")
    kept = scope_sites(counts).where("complete AND alleles >= 2")
    by_site = Window.partitionBy("scope", "grp").orderBy("pos")
    islands = kept.select("scope", "grp", "pos",
                          (F.col("pos") - F.row_number().over(by_site)).alias("island"))
    runs = (islands.groupBy("scope", "grp", "island")
            .agg(F.min("pos").cast("int").alias("start"), F.count(F.lit(1)).cast("int").alias("len"))
            .groupBy("scope", "grp")
            .agg(F.sort_array(F.collect_list(F.struct("start", "len"))).alias("runs")))
    base = grouped(samples, group)
    members = base.select(F.lit("overall").alias("scope"), F.lit(OVERALL).alias("grp"), "sequence")
    if group:
        members = members.unionByName(
            base.select(F.lit("group").alias("scope"), "grp", "sequence"))
    # a scope without any complete site has no mismatch distribution
    anchored = scope_sites(counts).where("complete").groupBy("scope", "grp").agg(
        F.count(F.lit(1)).alias("complete_sites"))
    scopes = anchored.join(runs, ["scope", "grp"], "left")
    masked = members.join(scopes, ["scope", "grp"]).withColumn(
        "sequence", F.coalesce(take_sites(F.col("sequence"), F.col("runs")), F.lit("")))
    return masked.groupBy("scope", "grp", "sequence").agg(F.count(F.lit(1)).alias("n"))
